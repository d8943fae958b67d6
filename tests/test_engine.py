"""The risk engine against hand values, independent recomputation, and its failure policies."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import finance
from tidewatch.operators import audit, cleaning, evaluate, features, garch, har, recursions, risk, validation, walkforward
from tidewatch.plans import nightly
from tidewatch.sources import market, storage

D = dt.date


def weekdays(n, start=D(1996, 1, 1)):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(1)
    return out


def bars(ticker="SYN", n=120, seed=7):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    open_ = np.concatenate([[100], close[:-1]]) * (1 + rng.normal(0, 0.003, n))
    high = np.maximum(open_, close) * (1 + abs(rng.normal(0, 0.004, n)))
    low = np.minimum(open_, close) * (1 - abs(rng.normal(0, 0.004, n)))
    return pd.DataFrame({"ticker": ticker, "trade_date": weekdays(n), "open": open_, "high": high, "low": low, "close": close, "adj_close": close, "volume": 1_000_000})


@pytest.fixture(scope="module")
def two(spark):
    both = pd.concat([bars("AAA", 900, 1), bars("BBB", 900, 2)])
    return spark.createDataFrame(both, market.CANONICAL).cache()


@pytest.fixture(scope="module")
def clean(two):
    return cleaning.with_log_returns(two).cache()


@pytest.fixture(scope="module")
def feats(clean):
    return features.build(clean).cache()


def pdf_of(df, ticker="AAA"):
    return df.where(F.col("ticker") == ticker).orderBy("trade_date").toPandas()


# -- formulas ---------------------------------------------------------------------


def test_hand_values(spark):
    assert recursions.ewma_next_step(2e-4, 0.01) == pytest.approx(1.94e-4)
    assert recursions.garch_next_step(recursions.GarchParams(0, 0.02, 0.05, 0.9), 0.01, 2e-4) == pytest.approx(1.87e-4)
    lit = lambda v: F.lit(float(v))
    one = spark.range(1).select(
        finance.qlike_term(lit(2), lit(1)).alias("qlike"),
        F.sqrt(finance.vol_error_sq(lit(0.04 / 252), lit(0.0484 / 252))).alias("rmse"),
        finance.kupiec_lr(lit(1000), lit(50), lit(0.05)).alias("even"),
        finance.kupiec_lr(lit(1756), lit(0), lit(0.01)).alias("none"),
        finance.kupiec_lr(lit(10), lit(10), lit(0.05)).alias("all"),
        finance.regime(lit(0.95)).alias("regime"),
    )
    r = one.first()
    assert r["qlike"] == pytest.approx(1 - math.log(2)) and r["rmse"] == pytest.approx(2.0)
    assert r["even"] == pytest.approx(0, abs=1e-9) and r["none"] == pytest.approx(-2 * 1756 * math.log(0.99)) and r["all"] == pytest.approx(-20 * math.log(0.05))
    assert r["regime"] == "stressed"
    p = risk.with_p(spark.createDataFrame([(0.0,), (3.841458820694124,)], "kupiec_lr double")).collect()
    assert [x["kupiec_p"] for x in p] == pytest.approx([1.0, 0.05])


def test_breach_is_strict(spark):
    rows = spark.createDataFrame([("A", D(2024, 1, i), "m", 1.0, r) for i, r in enumerate((-2.0, 2.0, -finance.Z_SCORES[95]), 1)], "ticker string, trade_date date, model string, var_forecast double, log_return double")
    got = [(r["trade_date"].day, r["level"]) for r in risk.daily(rows).where("breach").collect()]
    assert got == [(1, 95)]


# -- sources and storage ----------------------------------------------------------


def test_normalizers(spark):
    raw = [("2024-01-05", "1", "3", "1", "2", "2", "2.5", 1), ("2024-01-05", "1", "4", "1", "3", "3", "3.5", 2), ("2024-01-04", "x", "2", "1", "1", "1", None, 0), ("2024-01-08", None, None, None, None, None, "5", 3)]
    df = spark.createDataFrame(raw, ["Date", "Open", "High", "Low", "Close", "Adj Close", "Volume", "ingest_pos"])
    rows = market.normalize_wide(df, "T").orderBy("trade_date").collect()
    assert [(r["trade_date"], r["open"], r["close"], r["volume"]) for r in rows] == [(D(2024, 1, 4), None, 1.0, None), (D(2024, 1, 5), 1.0, 3.0, 4)]
    only = market.normalize_adjusted(df.drop("Volume", "Adj Close"), "T")
    assert only.columns == market.COLUMNS and only.where("adj_close = close").count() == 2
    with pytest.raises(ValueError):
        market.normalize_wide(df.drop("Close"), "T")


def test_symbols(spark):
    assert market.provider_symbol("AAPL") == "aapl.us"
    with pytest.raises(ValueError):
        market.provider_symbol("^NOPE")
    got = spark.createDataFrame([("AAPL",), ("^GSPC",), ("^NOPE",)], "t string").select(market.provider_symbols(F.col("t")), market.file_stem(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("aapl.us", "AAPL"), (market.INDEX_SYMBOLS["^GSPC"], "GSPC"), (None, "NOPE")]


def test_providers_fall_back(spark, tmp_path):
    spark.createDataFrame(bars("SYN", 10), market.CANONICAL).write.parquet(f"{tmp_path}/b/SYN.parquet")
    first, second = market.FileProvider(spark, f"{tmp_path}/a", name="a"), market.FileProvider(spark, f"{tmp_path}/b", name="b")
    chain = market.FallbackProvider(first, second)
    assert chain.fetch("SYN", "1996-01-02", "1996-01-04").count() == 3 and chain.sources == {"SYN": "b"}
    with pytest.raises(RuntimeError):
        chain.fetch("SYN", "2020-01-01", "2020-02-01")


def test_errors_and_retries():
    try:
        try:
            raise ValueError("SSL certificate problem")
        except ValueError as inner:
            raise RuntimeError("outer") from inner
    except RuntimeError as e:
        assert market.is_certificate_error(e)
    loop = RuntimeError("x")
    loop.__context__ = loop
    assert not market.is_certificate_error(loop)
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("no")
        return "ok"

    assert market.with_retries(flaky, sleep=waits.append) == "ok" and waits == [2.0, 5.0]


def test_upsert_is_idempotent(spark, tmp_path):
    store = storage.Store(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame(bars("SYN", 20), market.CANONICAL)
    keys = ["ticker", "trade_date"]
    assert store.upsert("raw", rows, keys) == 20
    assert store.upsert("raw", rows, keys) == 0
    changed = rows.limit(3).withColumn("close", F.lit(1.0))
    assert store.upsert("raw", changed, keys) == 0 and store.read("raw").where("close = 1").count() == 3


def test_guarded_landing(spark, tmp_path):
    store = storage.Store(spark, f"file://{tmp_path}/store")
    full = spark.createDataFrame(bars("SYN", 20), market.CANONICAL)
    assert store.land(full).first()["status"] == "written"
    short = full.where(F.col("trade_date") < D(1996, 1, 8))
    assert store.land(short).first()["status"] == "guarded" and store.read("landing").count() == 20
    assert store.land(short, force=True).first()["status"] == "written" and store.read("landing").count() == 5
    store.increment(short, "1996-01-09")
    store.increment(short, "1996-01-09")
    assert spark.read.parquet(f"file://{tmp_path}/store/increments").count() == 5


def test_migrations_run_once(spark):
    statements = {"002": "create table {database}.b (x int) using parquet", "001": "create table {database}.a (x int) using parquet"}
    assert storage.migrate(spark, "risk_test", statements) == ["001", "002"]
    assert storage.migrate(spark, "risk_test", statements) == []


def test_sections():
    assert storage.replace_section("x<a>old<b>y", "<a>", "<b>", "new") == "x<a>\nnew\n<b>y"
    with pytest.raises(ValueError):
        storage.replace_section("x", "<a>", "<b>", "new")


# -- validation and cleaning ------------------------------------------------------


def test_all_violations_are_reported(spark):
    good = bars("SYN", 8)
    bad = good.copy()
    bad.loc[0, "low"] = bad.loc[0, "high"] + 1
    bad.loc[1, "open"] = -1.0
    bad.loc[2, "close"] = None
    bad.loc[4, "trade_date"] = bad.loc[3, "trade_date"]
    validation.validate_bars(spark.createDataFrame(good, market.CANONICAL), "good")
    with pytest.raises(validation.ValidationError) as e:
        validation.validate_bars(spark.createDataFrame(bad, market.CANONICAL), "bad")
    assert {"high_below_low", "open_not_positive", "close_null", "duplicate_key"} <= {k for k, _ in e.value.violations}
    with pytest.raises(validation.ValidationError):
        validation.validate_bars(spark.createDataFrame(good, market.CANONICAL).withColumn("extra", F.lit(1)), "strict")
    with pytest.raises(validation.ValidationError):
        validation.validate_bars(spark.createDataFrame(good, market.CANONICAL).withColumn("trade_date", F.col("trade_date").cast("timestamp")), "dates")


def test_calendar_and_gaps(spark):
    calendar = market.weekday_calendar(spark, "2023-12-01", "2024-02-01").where("session_date != date'2024-01-15'")
    cut = lambda t: cleaning.last_completed_session(calendar, t).first()[0]
    assert cut("2024-01-09 18:00:00") == D(2024, 1, 8) and cut("2024-01-09 22:00:00") == D(2024, 1, 9)
    assert cleaning.next_session(calendar, "2024-01-12").first()[0] == D(2024, 1, 16)
    days = [D(2024, 1, d) for d in (2, 3, 5, 6, 8, 9)]
    rows = spark.createDataFrame([("T", d, 100.0 + i, 102.0 + i, 99.0 + i, 100.5 + i, 100.5 + i, 1) for i, d in enumerate(days)], market.CANONICAL)
    r = cleaning.gap_report(rows, calendar, "2024-01-09 18:00:00").first()
    assert (r["missing_sessions"], r["non_session_rows"], r["partial_rows"]) == ([D(2024, 1, 4)], [D(2024, 1, 6)], [D(2024, 1, 9)])
    assert (r["expected_sessions"], r["clean_rows"]) == (5, 4)
    kept = cleaning.clean_bars(rows, calendar, "2024-01-09 18:00:00").orderBy("trade_date").collect()
    assert len(kept) == 4 and kept[0]["log_return"] is None
    assert cleaning.telescoping(cleaning.clean_bars(rows, calendar, "2024-01-09 18:00:00")).first()["telescopes"]


# -- features ---------------------------------------------------------------------


def test_features_against_pandas(clean, feats):
    c, f = pdf_of(clean), pdf_of(feats)
    r = np.log(c["adj_close"]).diff()
    gk = 0.5 * np.log(c["high"] / c["low"]) ** 2 - (2 * math.log(2) - 1) * np.log(c["close"] / c["open"]) ** 2
    want = {"log_return": r, "r2": r**2, "gk_var": gk, "park_var": np.log(c["high"] / c["low"]) ** 2 / (4 * math.log(2)), "target_gk_var_next": gk.shift(-1)}
    want |= {f"ret_lag_{k}": r.shift(k) for k in range(1, 6)} | {f"rvol_{n}": np.sqrt(252 * (r**2).rolling(n).mean()) for n in (5, 21, 63)}
    want |= {"har_rv_w": gk.rolling(5).mean(), "har_rv_m": gk.rolling(22).mean()}
    for k, v in want.items():
        assert (f[k].isna() == v.isna()).all(), k
        assert np.nanmax(abs(f[k] - v)) < 1e-12, k
    assert [f[f"rvol_{n}"].first_valid_index() for n in (5, 21, 63)] == [5, 21, 63]
    assert [f[k].first_valid_index() for k in ("har_rv_w", "har_rv_m")] == [4, 21]


def test_vix_is_left_joined(spark, feats):
    vix = spark.createDataFrame([(D(1996, 1, 2), 10.0), (D(1996, 1, 4), 20.0)], "trade_date date, vix_close double")
    rows = features.with_vix(feats, vix)
    assert rows.count() == feats.count()
    got = rows.where("ticker = 'AAA' and vix_close is not null").orderBy("trade_date").collect()
    assert [r["vix_log_change"] for r in got] == [None, pytest.approx(math.log(2))]


def spoiled(df, column, after=850):
    """``df`` with the tail of a column changed."""
    cut = weekdays(900)[after]
    return df.withColumn(column, F.when(F.col("trade_date") >= cut, F.col(column) * 3).otherwise(F.col(column))), cut


def until(df, cut):
    return {(r["ticker"], r["trade_date"]): r["var_forecast"] for r in df.where(F.col("trade_date") <= cut).collect()}


# -- forecasts --------------------------------------------------------------------


def loop_ewma(r, lam=0.94):
    s = [np.mean(r[:252] ** 2)]
    for x in r:
        s.append(lam * s[-1] + (1 - lam) * x * x)
    return s


def test_ewma(clean):
    r = pdf_of(clean)["log_return"].dropna().to_numpy()
    got = pdf_of(recursions.ewma_forecasts(clean))["var_forecast"].to_numpy()
    s = loop_ewma(r)
    assert got == pytest.approx(s[756 : len(r)], rel=1e-12) and len(got) == 899 - 756
    live = recursions.ewma_live(clean).where("ticker = 'AAA'").first()
    assert live["var_forecast"] == pytest.approx(s[-1], rel=1e-12)
    bad, cut = spoiled(clean, "log_return")
    assert until(recursions.ewma_forecasts(bad), cut) == pytest.approx(until(recursions.ewma_forecasts(clean), cut), rel=1e-12)
    assert recursions.ewma_forecasts(clean.where(F.col("trade_date") < D(1997, 1, 1))).count() == 0
    steep = recursions.garch_filter(clean, recursions.GarchParams(0, 1, 0.1, 0.2)).where("ticker = 'AAA'").orderBy("trade_date").collect()
    assert recursions.block_rows(0.2) < len(steep) and all(b["variance_pct2"] == pytest.approx(a["next_variance_pct2"], rel=1e-12) for a, b in zip(steep, steep[1:]))


def test_garch_filter(clean):
    p = recursions.GarchParams(0.01, 0.1, 0.08, 0.85)
    eps = 100 * pdf_of(clean)["log_return"].dropna().to_numpy() - p.mu
    s = [p.omega / (1 - p.alpha - p.beta)]
    for e in eps:
        s.append(p.omega + p.alpha * e * e + p.beta * s[-1])
    got = pdf_of(recursions.garch_filter(clean, p))
    assert got["variance_pct2"].to_numpy() == pytest.approx(s[:-1], rel=1e-10) and got["next_variance_pct2"].to_numpy() == pytest.approx(s[1:], rel=1e-10)
    assert garch.filtered(eps, p.omega, p.alpha, p.beta) == pytest.approx(s, rel=1e-12)


def test_garch_fit_recovers_parameters():
    rng = np.random.default_rng(5)
    s, r = 1.0, []
    for _ in range(4000):
        e = math.sqrt(s) * rng.normal()
        r.append(0.05 + e)
        s = 0.05 + 0.1 * e * e + 0.85 * s
    mu, omega, alpha, beta, ok = garch.fit(np.array(r))
    assert ok and abs(alpha - 0.1) < 0.03 and abs(beta - 0.85) < 0.06 and abs(mu - 0.05) < 0.05
    assert garch.fit(np.zeros(900)) is None


def failing(n_fail):
    """A fitter that fails for the histories of these lengths."""

    def fitter(r):
        return None if len(r) in n_fail else (0.0, 0.1 + len(r) / 1e4, 0.05, 0.9, True)

    return fitter


def test_garch_fallback_policy(clean):
    one = clean.where("ticker = 'AAA'")
    months = garch.refits(one, fitter=failing(set()))
    points = sorted(r["t"] for r in months.collect())
    plain = garch.effective(months)
    assert plain.where("fallback or unconverged").count() == 0
    kept = garch.effective(garch.refits(one, fitter=failing({points[2]})))
    rows = {r["t"]: r for r in kept.collect()}
    assert rows[points[2]]["fallback"] and rows[points[2]]["since"] == points[1]
    a, b = (pdf_of(garch.forecasts(one, x).where("trade_date is not null")) for x in (plain, kept))
    same = a["t"] < points[2]
    assert np.allclose(a["var_forecast"][same], b["var_forecast"][same]) and not np.allclose(a["var_forecast"][~same], b["var_forecast"][~same])
    assert len(a) == 899 - 756
    with pytest.raises(Exception, match="first fit raised"):
        garch.effective(garch.refits(one, fitter=failing({points[0]}))).collect()


def test_har_equals_the_generic_harness(feats):
    ours = har.forecasts(feats).orderBy("ticker", "trade_date").toPandas()
    rows = walkforward.walk_forward(feats, features.HAR_COLUMNS, walkforward.har_factory, "har_rv")
    other = rows.where("not is_live and not skipped").orderBy("ticker", "trade_date").toPandas()
    assert len(ours) == len(other) == 2 * (900 - 756)
    assert ours["var_forecast"].to_numpy() == pytest.approx(other["var_forecast"].to_numpy(), rel=1e-8)
    live = {r["ticker"]: r["var_forecast"] for r in rows.where("is_live").collect()}
    assert {r["ticker"]: r["var_forecast"] for r in har.live(feats).collect()} == pytest.approx(live, rel=1e-8)


def test_har_doesnt_see_the_future(clean, feats):
    bad, cut = spoiled(clean, "high")
    assert until(har.forecasts(features.build(bad)), cut) == pytest.approx(until(har.forecasts(feats), cut), rel=1e-9)


def test_walk_forward_alignment(feats):
    class Identity:  # here, so that it is sent to the workers by value
        def fit(self, x, y):
            return self

        def predict(self, x):
            return x[:, 0]

    got = pdf_of(walkforward.walk_forward(feats, ["r2"], Identity, "id").where("not is_live"))
    f = pdf_of(feats)
    want = dict(zip(f["trade_date"], f["r2"].shift(1), strict=True))
    assert all(v == max(want[d], 1e-8) for d, v in zip(got["trade_date"], got["var_forecast"], strict=True)) and len(got) == 144


def test_boosted_trees_learn():
    rng = np.random.default_rng(2)
    x = rng.random((800, 4))
    y = np.exp(2 * x[:, 0] - x[:, 1] + rng.normal(0, 0.1, 800))
    m = walkforward.LogTarget(walkforward.BoostedTrees(trees=60, rate=0.1)).fit(x[:600], y[:600])
    e = np.log(m.predict(x[600:])) - np.log(y[600:])
    assert np.var(e) < 0.15 * np.var(np.log(y[600:]))
    again = walkforward.LogTarget(walkforward.BoostedTrees(trees=60, rate=0.1)).fit(x[:600], y[:600])
    assert (again.predict(x) == m.predict(x)).all()
    with_zero = walkforward.LogTarget(walkforward.LogOls()).fit(np.vstack([x[:20], x[:1]]), np.append(y[:20], 0.0))
    assert with_zero.dropped == 1


# -- evaluation and risk ----------------------------------------------------------


def test_the_runs_grow_all_trees():
    import inspect

    from tidewatch.plans import nightly

    assert nightly.TREES == inspect.signature(walkforward.BoostedTrees).parameters["trees"].default == 300
    assert inspect.signature(nightly.run).parameters["trees"].default == 300  # a night fits them all


@pytest.fixture(scope="module")
def forecasts(clean, feats):
    rows = recursions.ewma_forecasts(clean).unionByName(har.forecasts(feats).drop("floored")).withColumn("is_live", F.lit(False))
    return rows.cache()


def test_ablation_ignores_live_and_calibrated_rows(forecasts, feats):
    table = {(r["ticker"], r["model"]): r for r in evaluate.ablation(forecasts, feats).collect()}
    assert {r["n_obs"] for r in table.values()} == {143}
    day = F.lit(weekdays(900)[800])
    extra = forecasts.where(F.col("trade_date") == day).withColumn("is_live", F.lit(True)).withColumn("var_forecast", F.lit(9.0))
    cal = forecasts.where((F.col("model") == "har_rv") & (F.col("trade_date") > day)).withColumn("model", F.lit("har_rv_cal"))
    again = {(r["ticker"], r["model"]): r for r in evaluate.ablation(forecasts.unionByName(extra).unionByName(cal), feats).collect()}
    assert again == table
    literal = evaluate.ablation(forecasts.unionByName(cal), feats, all_models=True).collect()
    assert len(literal) == 6 and {r["n_obs"] for r in literal} == {99}


def test_ablation_average_and_markdown(forecasts, feats):
    table = evaluate.ablation(forecasts, feats)
    rows = evaluate.with_average(table).where("model = 'har_rv'").collect()
    by = {r["ticker"]: r["qlike"] for r in rows}
    assert by["AVERAGE"] == pytest.approx((by["AAA"] + by["BBB"]) / 2)
    text = evaluate.markdown(table, "qlike")
    assert text.splitlines()[0] == "| ticker | ewma_094 | har_rv |" and text.count("**") == 6


def test_coverage_counts(forecasts, clean):
    rows = risk.common_returns(forecasts, clean)
    got = {(r["ticker"], r["model"], r["level"]): r for r in risk.coverage(rows).collect()}
    pdf = rows.toPandas()
    for (t, m), g in pdf.groupby(["ticker", "model"]):
        for level, z in finance.Z_SCORES.items():
            x = int((g["log_return"] < -z * np.sqrt(g["var_forecast"])).sum())
            assert got[t, m, level]["observed_breaches"] == x and got[t, m, level]["n_obs"] == len(g)
    assert risk.breaches(rows).count() == sum(r["observed_breaches"] for r in got.values())
    assert validation.invariants(risk.breaches(rows), "breaches").agg(F.sum("n_bad")).first()[0] == 0
    assert validation.invariants(risk.coverage(rows), "coverage").agg(F.sum("n_bad")).first()[0] == 0


def test_calibration_uses_only_the_past(forecasts, clean, feats):
    rows = risk.common_returns(forecasts, clean)
    f = pdf_of(feats)
    f = f[f["r2"].notna() & (f["gk_var"] > 0)]
    for r in risk.calibration_factors(rows, feats).where("ticker = 'AAA'").collect():
        past = f[f["trade_date"] < r["first_date"]]
        assert r["factor"] == pytest.approx(past["r2"].mean() / past["gk_var"].mean(), rel=1e-10)
    table = risk.backtest(forecasts, clean, feats)
    fires = risk.trigger(risk.coverage(rows)).first()[0]
    assert (table.where("model = 'har_rv_cal'").count() == 4) == fires
    stored = risk.calibrated(rows, feats).withColumn("is_live", F.lit(False)).select(*forecasts.columns)
    again = risk.backtest(forecasts.unionByName(stored), clean, feats)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, table.collect()), key=str)


def test_trigger_without_range_models(forecasts, clean):
    rows = risk.common_returns(forecasts.where("model = 'ewma_094'"), clean)
    assert risk.trigger(risk.coverage(rows)).first()[0] is False


def test_audit_rules_fire_alone(spark):
    base = bars("IDX", 60)
    base["close"] = base["adj_close"] = 100 * 1.001 ** np.arange(60)
    calendar = market.weekday_calendar(spark, "1995-12-01", "1997-01-01")

    def judge(change, ticker="T"):
        b = base.copy()
        b["ticker"] = ticker
        b["volume"] = b["volume"].astype(object)
        change(b)
        return audit.audit(spark.createDataFrame(b.where(b.notna(), None), market.CANONICAL), calendar, indexes=("IDX",)).first()

    assert judge(lambda b: None)["go"]
    assert not judge(lambda b: b.drop(index=[10, 20], inplace=True))["go"]
    assert not judge(lambda b: b.loc.__setitem__((slice(0, 3), "volume"), 0))["go"]
    assert judge(lambda b: b.loc.__setitem__((slice(0, 3), "volume"), 0), "IDX")["go"]
    jump = judge(lambda b: b.loc.__setitem__((slice(0, 30), "close"), b.loc[:30, "close"] * 2))
    assert jump["n_jumps"] == 1 and not jump["adjustment_ok"] and jump["max_adj_move"] < 0.01


def test_canaries_name_what_tripped(spark, clean, feats):
    table = nightly.canaries(clean, feats, har.forecasts(feats))
    nightly.enforce(table.where("canary != 'negative_gk'"))
    with pytest.raises(nightly.CanaryError, match="floored"):
        nightly.enforce(spark.createDataFrame([("floored", 2), ("telescoping", 0)], "canary string, n long"))


def test_import_needs_no_session():
    import subprocess
    import sys

    code = "import tidewatch.plans.registry, tidewatch.operators.garch, bench"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(__import__("pathlib").Path(__file__).parent.parent), timeout=120)


def test_entry_without_the_training_subpackage(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).parent.parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "tidewatch", tmp_path / "tidewatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, timeout=120, env={**__import__("os").environ, "PYTHONPATH": str(tmp_path)})

"""Storage, intake, nights, reports and streams over small tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import audit, cleaning, evaluate, features, garch, recursions, reports, walkforward
from tidewatch.plans import nightly, schema, session
from tidewatch.sources import ingest, market, storage
from tidewatch.streaming import streams

from .test_engine import D, bars, weekdays


def store_of(spark, path):
    return storage.Store(spark, f"file://{path}/store")


def frame(spark, *parts):
    return spark.createDataFrame(pd.concat(parts), market.CANONICAL)


def test_upsert_rewrites_touched_months_only(spark, tmp_path):
    store, keys = store_of(spark, tmp_path), ["ticker", "trade_date"]
    rows = frame(spark, bars("^A/B c", 60), bars("B", 60, 2))
    assert store.upsert("raw", rows, keys) == 120
    before = store._manifest("raw")[1]
    late = rows.where(F.col("trade_date") >= D(1996, 3, 1)).withColumn("close", F.lit(5.0))
    assert store.upsert("raw", late, keys) == 0
    after = store._manifest("raw")[1]
    assert {k for k in after if after[k] != before.get(k)} == {"1996-03"} and store.count("raw") == 120
    assert store.read("raw").where("close = 5").count() == late.count()
    assert store.upsert("raw", rows.limit(0), keys) == 0 and store.count("raw") == 120
    assert store.replace("raw", rows.limit(0)) == 0 and store.count("raw") == 0 and store.exists("raw")


def test_tables_change_together(spark, tmp_path, monkeypatch):
    store = store_of(spark, tmp_path)
    one, two = frame(spark, bars("A", 5)), frame(spark, bars("A", 7))
    assert store.replace_all({"a": one, "b": one}) == {"a": 5, "b": 5}
    monkeypatch.setattr(store, "_publish", lambda *rows: None)  # a run that dies before its last step
    store.replace_all({"a": two, "b": two})
    assert store.count("a") == store.count("b") == 5


def test_audit_of_a_provider(spark):
    actions = spark.createDataFrame([("AA", D(1996, 2, 1), "split")], "ticker string, ex_date date, note string")
    metrics, around = audit.run(Server(spark, "one"), ("AA", "CC"), "1996-03-20", calendar(spark), actions, indexes=("CC",))
    assert {r["ticker"]: r["n_missing"] for r in metrics.collect()} == {"AA": 0, "CC": 0} and around.first()["continuous"]


def test_session_settings(spark):
    got = session.session(session.Settings("file:///s", spark.conf.get("spark.checkpoint.dir"), {"spark.sql.shuffle.partitions": "4"}))
    assert got.conf.get("spark.sql.adaptive.enabled") == "true" and got.conf.get("spark.sql.shuffle.partitions") == "4"


def test_landing_by_ticker(spark, tmp_path):
    store = store_of(spark, tmp_path)
    both = frame(spark, bars("^VIX", 20), bars("B", 20, 2))
    assert {r["status"] for r in store.land(both).collect()} == {"written"}
    part = store._manifest("landing")[1]
    next_ = frame(spark, bars("^VIX", 5), bars("B", 22, 2))
    got = {r["ticker"]: r["status"] for r in store.land(next_).collect()}
    assert got == {"^VIX": "guarded", "B": "written"} and store.count("landing") == 42
    assert sum(part[k] == v for k, v in store._manifest("landing")[1].items()) == 1


class Server:
    """Bars by ticker, of which some are cut short or fail."""

    def __init__(self, spark, name, short=(), fails=()):
        self.spark, self.name, self.short, self.fails = spark, name, short, fails

    def fetch(self, ticker, start, end):
        if ticker in self.fails:
            raise ValueError("no")
        days = weekdays(60)
        df = frame(self.spark, bars(ticker, 60, len(ticker)))
        first = max(start, days[40].isoformat()) if ticker in self.short else start
        return df.where(F.col("trade_date").between(F.lit(first).cast("date"), F.lit(end).cast("date")))


def test_increment_path(spark, tmp_path):
    store = store_of(spark, tmp_path)
    days = weekdays(60)
    chain = lambda short: ingest.default_provider(Server(spark, "one", short, fails=("CC",)), Server(spark, "two"))
    first = ingest.fetch_and_load(store, chain(()), ("AA", "CC"), "1996-01-01", days[49].isoformat())
    assert {(r["ticker"], r["status"], r["source"]) for r in first.collect()} == {("AA", "written", "one"), ("CC", "written", "two")}
    again = ingest.fetch_and_load(store, chain(("AA",)), ("AA", "CC"), "1996-01-01", days[59].isoformat())
    assert {(r["ticker"], r["status"]) for r in again.collect()} == {("AA", "guarded"), ("CC", "written")}
    raw = store.read("raw")
    n = {r["ticker"]: r["count"] for r in raw.groupBy("ticker").count().collect()}
    gone = sum(days[49].isoformat() < d.isoformat() < ingest.trailing_from(days[59].isoformat()) for d in days)
    assert n == {"AA": 60 - gone, "CC": 60} and store.count("landing") == 110
    assert {r["source"] for r in raw.select("source").distinct().collect()} == {"one", "two"}
    with pytest.raises(RuntimeError):
        ingest.fetch_and_load(store, ingest.default_provider(Server(spark, "one", fails=("AA",))), ("AA",), "1996-01-01", "1996-02-01")


def test_replay(spark, tmp_path):
    store, folder = store_of(spark, tmp_path), f"file://{tmp_path}/files"
    frame(spark, bars("AA", 10)).coalesce(1).write.parquet(folder)
    assert ingest.replay(store, folder) == {"before": 0, "upserted": 10, "after": 10, "new": 10}
    assert ingest.replay(store, folder) == {"before": 10, "upserted": 10, "after": 10, "new": 0}
    frame(spark, bars("AA", 10)).limit(0).write.parquet(f"file://{tmp_path}/none")
    with pytest.raises(ValueError):
        ingest.replay(store, f"file://{tmp_path}/none")


def test_http_providers(spark):
    asked = []

    def opener(address, timeout):
        asked.append((address, timeout))
        return "No data" if "zz" in address else "Date,Open,High,Low,Close,Volume\n1996-01-02,1,3,0.5,2,10.5\n1996-01-03,2,3,1,2.5,11.5\n"

    p = ingest.CsvProvider(spark, "http://host/q", opener)
    rows = p.fetch("AAPL", "1996-01-01", "1996-01-31").orderBy("trade_date").collect()
    assert [r["volume"] for r in rows] == [10, 12] and rows[0]["adj_close"] == rows[0]["close"] == 2.0
    assert asked == [("http://host/q?s=aapl.us&d1=19960101&d2=19960131&i=d", 30.0)]
    with pytest.raises(ValueError):
        p.fetch("ZZ", "1996-01-01", "1996-01-31")
    calls, renewed, waits = [], [], []

    def client(ticker, start, end):
        calls.append((ticker, start, end))
        if len(calls) < 3:
            raise OSError("no")
        return [("1996-01-02", 1.0, 3.0, 0.5, 2.0, 1.9, 10.0)]

    wide = ingest.WideProvider(spark, client, lambda: renewed.append(1), sleep=waits.append)
    assert wide.fetch("A", "1996-01-01", "1996-01-31").first()["adj_close"] == 1.9
    assert calls[-1] == ("A", "1996-01-01", "1996-02-01") and len(renewed) == 2 and waits == [2.0, 5.0]


def calendar(spark, n=1000):
    days = weekdays(n)
    return spark.createDataFrame([(d, dt.datetime(d.year, d.month, d.day, 21)) for d in days], "session_date date, close_utc timestamp")


def test_two_nights(spark, tmp_path):
    """The second night brings an overlapping batch; forecasts, scores and parameters are those of one night over all."""
    days = weekdays(830)
    all_bars = frame(spark, bars("AAA", 830, 1), bars("BBB", 830, 2), bars("^VIX", 830, 3))
    vix = spark.createDataFrame([(d, 20.0 + i % 7) for i, d in enumerate(days)], "trade_date date, vix_close double")
    night = lambda store, batch, as_of: nightly.run(spark, store, batch, calendar(spark), vix, f"{as_of} 23:00:00", trees=2, strict=False)
    parts = store_of(spark, tmp_path / "parts")
    night(parts, all_bars.where(F.col("trade_date") <= days[810]), days[810])
    second = night(parts, all_bars.where(F.col("trade_date") > days[800]), days[829])
    assert second.rows["raw"] == 3 * 19 and second.rows["clean"] == 2 * 19
    whole = store_of(spark, tmp_path / "whole")
    one = night(whole, all_bars, days[829])
    for name, keys in (("forecasts", nightly.KEYS), ("coverage", ["ticker", "model", "level"]), ("ablation", ["ticker", "model"])):
        a, b = (s.read(name).drop("loaded_at").toPandas().sort_values(keys).reset_index(drop=True) for s in (parts, whole))
        pd.testing.assert_frame_equal(a, b[a.columns], rtol=1e-9)
    models = {r["model"]: r for r in nightly.totals(parts.read("forecasts")).collect()}
    assert set(evaluate.BASE_MODELS) <= set(models) and models["garch_11"]["n_live"] == 2 and models["ewma_094"]["n_settled"] == 2 * (829 - 756)
    assert {r["canary"] for r in one.canaries.collect()} == {"telescoping", "negative_gk", "floored", "garch_fallback", "garch_unconverged"}
    assert {"AAA", "BBB"} == {r["ticker"] for r in parts.read("features").select("ticker").distinct().collect()}


def test_recursions_of_any_length(spark, monkeypatch):
    n = 3000
    rng = np.random.default_rng(3)
    r = rng.normal(0, 0.02, n)
    days = [(D(1960, 1, 1) + dt.timedelta(i)) for i in range(n)]
    rows = spark.createDataFrame([("A", d, float(x)) for d, x in zip(days, r)], "ticker string, trade_date date, log_return double")
    v, want = float(np.mean(r[:252] ** 2)), []
    for x in r:
        want.append(v)
        v = 0.5 * v + 0.5 * x * x
    got = [x["var_forecast"] for x in recursions.ewma_forecasts(rows, 0.5, 0).orderBy("trade_date").collect()]
    assert recursions.block_rows(0.5) < n / 5 and np.allclose(got, want, rtol=1e-12)
    p = recursions.GarchParams(0.05, 0.1, 0.05, 0.9)
    eps, v, want = 100 * r - 0.05, 0.1 / 0.05, []
    for e in eps:
        want.append(v)
        v = 0.1 + 0.05 * e * e + 0.9 * v
    got = [x["variance_pct2"] for x in recursions.garch_filter(rows, p).orderBy("trade_date").collect()]
    assert recursions.block_rows(0.9) < n and np.allclose(got, want, rtol=1e-10)


def test_garch_fit_reaches_a_grid_search():
    rng = np.random.default_rng(5)
    v, r = 1.0, []
    for _ in range(1500):
        r.append(np.sqrt(v) * rng.normal())
        v = 0.05 + 0.08 * r[-1] ** 2 + 0.87 * v
    r = np.array(r)

    def loss(mu, omega, alpha, beta):
        s = garch.filtered(r - mu, omega, alpha, beta)[:-1]
        return float(np.sum(np.log(s) + (r - mu) ** 2 / s))

    *found, converged = garch.fit(r)
    grid = min(loss(mu, o, a, b) for mu in (float(np.mean(r)), 0.0) for o in (0.02, 0.05, 0.1, 0.2) for a in (0.04, 0.06, 0.08, 0.1, 0.13) for b in (0.7, 0.8, 0.85, 0.87, 0.9, 0.93) if a + b < 1)
    assert converged and loss(*found) <= grid + 1e-3


def test_months_are_dealt_over_slots():
    dates = pd.Series(weekdays(100))
    starts = garch.month_starts(dates, 30)
    assert starts[0] == 30 and all(dates[a].month != dates[a - 1].month for a in starts[1:]) and len(starts) == 1 + sum(dates[i].month != dates[i - 1].month for i in range(31, 100))
    assert sorted(x for k in range(garch.SLOTS) for x in starts[k :: garch.SLOTS]) == starts


def test_features_by_joins(spark):
    clean = cleaning.with_log_returns(frame(spark, bars("AA", 90), bars("B", 3, 2)))
    ours = features.build(clean)
    rows = {r["column"]: r for r in features.cross_check(ours, features.by_joins(clean), [c for c in ours.columns if c not in ("ticker", "trade_date")]).collect()}
    assert all(r["max_abs_diff"] < 1e-12 and r["nulls_agree"] for r in rows.values()) and rows["rvol_63"]["n_values"] == 27
    wrong = features.cross_check(ours, features.by_joins(clean.withColumn("close", F.col("close") * 1.01)), ["gk_var"]).first()
    assert wrong["max_abs_diff"] > 0


def test_walk_forward_records(spark):
    rows = features.build(cleaning.with_log_returns(frame(spark, bars("AA", 830))))
    spoiled = rows.withColumn(features.TARGET, F.when(F.dayofmonth("trade_date") == 3, 0.0).otherwise(F.col(features.TARGET)))
    r = walkforward.result_records(walkforward.walk_forward(spoiled, features.HAR_COLUMNS, walkforward.har_factory, "har_rv")).first()
    assert r["n_live"] == 1 and r["n_forecasts"] == 830 - 756 and r["n_dropped"] > 10 and 3 <= r["n_refits"] <= 5 and r["n_skipped"] == 0


def test_reports(spark):
    table = spark.createDataFrame([("A", "ewma_094", 95, 100, 5.0, 7, 0.07, 0.75, False), ("A", "har_rv", 95, 100, 5.0, 12, 0.12, 7.9, True)], "ticker string, model string, level int, n_obs long, expected_breaches double, observed_breaches long, breach_rate double, kupiec_lr double, kupiec_reject boolean")
    text = reports.backtest(table).splitlines()
    assert len(text) == 3 and "7.00" in text[1] and "7.900" in text[2] and text[0].split()[:3] == ["ticker", "model", "level"]
    gap = spark.createDataFrame([("A", [D(1996, 1, 2)] * 12, [])], "ticker string, missing_sessions array<date>, non_session_rows array<date>")
    assert "and 2 more" in reports.gaps(gap)
    assert reports.markdown(spark.createDataFrame([("x", None, 1.23456)], "a string, b string, c double"), {"c": "%.2f"}).splitlines() == ["| a | b | c |", "| --- | --- | --- |", "| x |  | 1.23 |"]
    assert reports.audit(spark.createDataFrame([("A", 0.5)], "ticker string, gap_rate double")).endswith("| A | 0.5000 |")


def test_coverage_needs_observations(spark):
    from tidewatch.functions.finance import kupiec_lr

    one = spark.range(1)
    assert one.select(kupiec_lr(F.lit(10.0), F.lit(0.0), F.lit(0.05))).first()[0] > 0
    for n, p in ((0.0, 0.05), (10.0, 1.0)):
        with pytest.raises(Exception, match="likelihood"):
            one.select(kupiec_lr(F.lit(n), F.lit(0.0), F.lit(p))).collect()


def test_schema_migrations(spark):
    made = storage.migrate(spark, "risk_tables", schema.migrations())
    assert len(made) == len(schema.migrations()) >= 10 and storage.migrate(spark, "risk_tables", schema.migrations()) == []
    spark.sql("insert into risk_tables.forecasts values ('A', date'1996-01-02', 'm', -1.0, false, null, '1996-01')")
    assert spark.table("risk_tables.forecasts_violations").collect() == [("var_forecast", 1)]


def test_streams_of_increments_and_corrections(spark, tmp_path):
    store = store_of(spark, tmp_path)
    rows = frame(spark, bars("AA", 12))
    store.increment(rows.limit(8), "1996-01-20")
    go = lambda: streams.increments_stream(spark, f"{store.folder}/increments", store, f"file://{tmp_path}/state").awaitTermination()
    go()
    assert store.count("raw") == 8
    store.increment(rows.withColumn("close", F.col("low")), "1996-01-21")
    go()
    assert store.count("raw") == 12 and store.read("raw").where("close = low and source = 'increment'").count() == 12
    ticks = lambda name, xs: spark.createDataFrame([(i, dt.datetime(1996, 1, d, 10), 1, "T", v, "") for i, (d, v) in enumerate(xs)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/ticks")
    run = lambda: streams.corrected_sessions(streams.ticks(spark, f"file://{tmp_path}/ticks", "*.parquet"), store, "days", f"file://{tmp_path}/days-state").awaitTermination()
    ticks("a", [(2, 1.0), (3, 2.0)])
    run()
    ticks("b", [(2, 9.0), (20, 3.0)])
    run()
    ticks("c", [(2, 99.0)])  # later than the watermark
    run()
    got = {r["trade_date"].day: (r["n_ticks"], r["high"]) for r in store.read("days").collect()}
    assert got == {2: (2, 9.0), 3: (1, 2.0), 20: (1, 3.0)}



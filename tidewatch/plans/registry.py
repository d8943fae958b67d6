"""Queries by name, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import audit, cleaning, dashboard, evaluate, features, garch, har, recursions, risk, validation, walkforward
from tidewatch.sources import ingest, market, storage
from tidewatch.streaming import streams

from . import nightly
from .flow import Flow
from .oracles import ORACLES  # noqa: F401

QUERIES: dict = {}
DIGITS = 6
GARCH = recursions.GarchParams(mu=0.05, omega=400.0, alpha=0.08, beta=0.85)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, so that sums in another order compare equal."""
    return df.select(*[F.round(c, DIGITS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(build, staged: bool = False):
    """Registers ``build(flow)`` under its name."""

    def run(spark, sf_dir):
        return rounded(build(Flow(spark, sf_dir, staged=staged)))

    QUERIES[build.__name__] = run
    return run


def branched(build):
    """A query with several branches on the clean bars: trades are read once, and the bars written."""
    return query(build, staged=True)


def reporting(build):
    """A query on forecasts: under its name on the two models that its SQL has, and with ``_all_models`` on all five."""

    def run(spark, sf_dir):
        return rounded(build(Flow(spark, sf_dir, staged=True, all_models=True)))

    QUERIES[f"{build.__name__}_all_models"] = run
    return branched(build)


def _with_faults(raw: DataFrame) -> DataFrame:
    """Bars of which some are spoiled by rule, and some copied."""
    day = F.dayofmonth("trade_date")
    bad = raw.withColumn("low", F.when(day == 3, F.col("high") + 1).otherwise(F.col("low"))).withColumn("open", F.when(day == 7, -F.col("open")).otherwise(F.col("open")))
    bad = bad.withColumn("close", F.when(day == 11, F.lit(None).cast("double")).otherwise(F.col("close"))).withColumn("volume", F.when(day == 13, F.lit(-1)).otherwise(F.col("volume")).cast("long"))
    return bad.unionByName(bad.where(day == 17))


@query
def bars_from_trades(f: Flow) -> DataFrame:
    return f.raw


@query
def validation_violations(f: Flow) -> DataFrame:
    found = validation.violations(_with_faults(f.raw), validation.bar_checks(), ["ticker", "trade_date"])
    return found.groupBy("check").agg(F.count("*").alias("n"))


@query
def clean_violations(f: Flow) -> DataFrame:
    """Faults of clean bars whose log returns are there; the rules are those of raw bars."""
    bad = _with_faults(f.clean.drop("log_return")).withColumn("log_return", F.lit(0.0))
    return validation.violations(bad, validation.bar_checks(), ["ticker", "trade_date"]).groupBy("check").agg(F.count("*").alias("n"))


@branched
def forecast_violations(f: Flow) -> DataFrame:
    day = F.dayofmonth("trade_date")
    rows = f.settled.select("ticker", "trade_date", "model", F.when(day == 3, -F.col("var_forecast")).when(day != 5, F.col("var_forecast")).alias("var_forecast"))
    twice = rows.unionByName(rows.where(day == 17))
    return validation.violations(twice, validation.forecast_checks(), ["ticker", "trade_date", "model"]).groupBy("check").agg(F.count("*").alias("n"))


@branched
def stored_invariants(f: Flow) -> DataFrame:
    """Constraints of the forecast, coverage, breach and ablation tables."""
    rows = risk.common_returns(f.forecasts, f.clean)
    parts = {"forecasts": f.forecasts, "coverage": risk.coverage(rows), "breaches": risk.breaches(rows), "ablation": evaluate.ablation(f.forecasts, f.features)}
    out = None
    for name, df in parts.items():
        part = validation.invariants(df, name).withColumn("name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query
def modeled_tickers(f: Flow) -> DataFrame:
    """Bars by ticker with the index among them, of which models are fitted for all others."""
    both = f.raw.unionByName(f.raw.where("ticker = 'R'").withColumn("ticker", F.lit("^VIX")))
    return market.modeled(both).groupBy("ticker").agg(F.count("*").alias("n"))


@query
def bars_of_ticker(f: Flow) -> DataFrame:
    return market.of_ticker(f.raw, "R")


@query
def wide_frame(f: Flow) -> DataFrame:
    """A provider's wide frame of single trades of all days, of which the last of a day counts."""
    t = market.table(f.spark, f.sf_dir, "lineitem").where("l_returnflag = 'A'")
    price = F.col("l_extendedprice")
    raw = t.select(
        F.to_date("l_shipdate").alias("Date"), price.alias("Open"), (price + 1).alias("High"), (price - 1).alias("Low"), price.alias("Close"), (price / 2).alias("Adj Close"), (F.col("l_quantity") / 2).alias("Volume"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ingest_pos"),
    )
    return market.normalize_wide(raw, "A")


@branched
def forecast_totals(f: Flow) -> DataFrame:
    return nightly.totals(f.forecasts)


@branched
def har_result_records(f: Flow) -> DataFrame:
    return walkforward.result_records(walkforward.walk_forward(f.features, features.HAR_COLUMNS, walkforward.har_factory, har.HAR_TAG))


@query
def nightly_tables(f: Flow) -> DataFrame:
    """Stored tables after two nights with EWMA, GARCH and HAR, the second with an overlapping batch."""
    return nightly.tables(nightly.two_nights(f.spark, f.sf_dir, boosted=()))


class _Tables:
    """A provider over the trades' bars; of a ticker in ``short`` it serves the last days only."""

    name = "trades"

    def __init__(self, bars: DataFrame, short: tuple[str, ...] = ()) -> None:
        self.bars, self.short = bars, short

    def fetch(self, ticker: str, start: str, end: str) -> DataFrame:
        first = max(start, "2001-01-01") if ticker in self.short else start
        return self.bars.where((F.col("ticker") == ticker) & F.col("trade_date").between(F.lit(first).cast("date"), F.lit(end).cast("date")))


@query
def increment_path(f: Flow) -> DataFrame:
    """Two intakes, the second with a truncated ticker: what is landed, raw and an increment of each ticker."""
    store, tickers = storage.Store(f.spark, f"{storage.shared_folder(f.spark)}/tidewatch-intake-{uuid.uuid4().hex}"), ("A", "N", "R")
    for end, short in (("2001-08-31", ()), ("2001-09-28", ("N",))):
        result = ingest.fetch_and_load(store, ingest.default_provider(_Tables(f.raw, short)), tickers, "1995-01-01", end)
    count = lambda df, name: df.groupBy("ticker").agg(F.count("*").alias(name))
    increments = f.spark.read.parquet(f"{store.folder}/increments")
    out = result.select("ticker", "status", "source").join(count(store.read("landing"), "n_landed"), "ticker").join(count(store.read("raw"), "n_raw"), "ticker")
    return out.join(count(increments, "n_increment"), "ticker", "left").na.fill(0, ["n_increment"])


@query
def replayed(f: Flow) -> DataFrame:
    """A folder of landed files replayed into an empty raw table, and again."""
    folder = f"{storage.shared_folder(f.spark)}/tidewatch-replay-{uuid.uuid4().hex}"
    f.raw.repartition(3).write.parquet(f"{folder}/files")
    store = storage.Store(f.spark, f"{folder}/store")
    rows = [("first", *ingest.replay(store, f"{folder}/files").values()), ("second", *ingest.replay(store, f"{folder}/files").values())]
    return f.spark.createDataFrame(rows, "run string, before long, upserted long, after long, new long")


@query
def feature_invariants(f: Flow) -> DataFrame:
    return validation.invariants(f.features, "features")


@query
def upsert_merge(f: Flow) -> DataFrame:
    day = F.dayofmonth("trade_date")
    old = f.raw.where(day <= 20).select("ticker", "trade_date", "close", F.lit("first").alias("source"))
    new = f.raw.where(day >= 15).select("ticker", "trade_date", (F.col("close") * 2).alias("close"), F.lit("second").alias("source"))
    return storage.merge(old, new, ["ticker", "trade_date"])


@query
def monotonic_guard(f: Flow) -> DataFrame:
    old = f.raw.where((F.col("ticker") != "N") | (F.dayofmonth("trade_date") <= 10))
    new = f.raw.where((F.col("ticker") != "A") | (F.dayofmonth("trade_date") <= 10))
    return storage.guard(old, new)


@query
def first_source(f: Flow) -> DataFrame:
    return market.first_source({"primary": f.raw.where("ticker != 'N'"), "second": f.raw}).groupBy("ticker", "source").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


@query
def normalized_frame(f: Flow) -> DataFrame:
    """A provider's frame made of single trades: several rows a day, of which the last counts."""
    t = market.table(f.spark, f.sf_dir, "lineitem").where("l_returnflag = 'R'")
    raw = t.select(
        F.to_date("l_shipdate").alias("Date"), F.col("l_extendedprice").alias("Open"), (F.col("l_extendedprice") + 1).alias("High"), (F.col("l_extendedprice") - 1).alias("Low"),
        F.when(F.col("l_linenumber") < 7, F.col("l_extendedprice")).alias("Close"), (F.col("l_quantity") / 2).alias("Volume"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ingest_pos"),
    )
    return market.normalize_adjusted(raw, "R")


@query
def clean_bars(f: Flow) -> DataFrame:
    return f.clean


@query
def gap_report(f: Flow) -> DataFrame:
    return cleaning.gap_counts(cleaning.gap_report(f.raw, f.calendar, f.as_of))


@query
def gap_dates(f: Flow) -> DataFrame:
    rows = cleaning.gap_report(f.raw, f.calendar, f.as_of)
    return rows.select("ticker", F.posexplode("missing_sessions").alias("pos", "missing_session")).select("ticker", "missing_session")


@query
def session_bounds(f: Flow) -> DataFrame:
    cut = cleaning.last_completed_session(f.calendar, f.as_of)
    return cut.crossJoin(F.broadcast(cleaning.next_session(f.calendar, "2001-10-12")))


@query
def telescoping(f: Flow) -> DataFrame:
    return cleaning.telescoping(f.clean)


@query
def daily_features(f: Flow) -> DataFrame:
    return f.features


@query
def features_canary(f: Flow) -> DataFrame:
    return features.summary(f.features)


@branched
def feature_cross_check(f: Flow) -> DataFrame:
    """Features by windows against the same by equi-joins on row numbers."""
    return features.cross_check(f.features, features.by_joins(f.clean), [c for c in f.features.columns if c not in ("ticker", "trade_date")])


@query
def vix_features(f: Flow) -> DataFrame:
    return features.with_vix(f.features.select("ticker", "trade_date", "gk_var"), f.vix)


@query
def ewma_forecasts(f: Flow) -> DataFrame:
    return recursions.ewma_forecasts(f.clean)


@query
def ewma_live(f: Flow) -> DataFrame:
    return recursions.ewma_live(f.clean)


@query
def har_coefficients(f: Flow) -> DataFrame:
    return har.coefficients(f.features)


@query
def har_forecasts(f: Flow) -> DataFrame:
    return har.forecasts(f.features)


@branched
def har_live(f: Flow) -> DataFrame:
    return har.live(f.features)


@query
def garch_filter_fixed(f: Flow) -> DataFrame:
    return recursions.garch_filter(f.clean, GARCH)


@branched
def garch_refits(f: Flow) -> DataFrame:
    return garch.effective(garch.refits(f.clean))


@branched
def garch_forecasts(f: Flow) -> DataFrame:
    return garch.forecasts(f.clean, garch.effective(garch.refits(f.clean)))


@branched
def har_walk_forward(f: Flow) -> DataFrame:
    """The generic harness with a least-squares regressor; its forecasts are those of ``har_forecasts``."""
    rows = walkforward.walk_forward(f.features, features.HAR_COLUMNS, walkforward.har_factory, har.HAR_TAG)
    return rows.where("not is_live and not skipped").select("ticker", "trade_date", "model", "var_forecast", "floored")


@branched
def boosted_forecasts(f: Flow) -> DataFrame:
    return walkforward.walk_forward(f.features, features.TREE_COLUMNS, walkforward.boosted_factory(trees=nightly.TREES), "lgbm").drop("refit", "dropped")


@branched
def boosted_vix_forecasts(f: Flow) -> DataFrame:
    rows = features.with_vix(f.features, f.vix)
    return walkforward.walk_forward(rows, features.TREE_COLUMNS + features.VIX_COLUMNS, walkforward.boosted_factory(trees=nightly.TREES), "lgbm_vix").drop("refit", "dropped")


@reporting
def ablation(f: Flow) -> DataFrame:
    return evaluate.ablation(f.forecasts, f.features)


@reporting
def ablation_average(f: Flow) -> DataFrame:
    return evaluate.with_average(evaluate.ablation(f.forecasts, f.features))


@reporting
def ablation_span(f: Flow) -> DataFrame:
    return evaluate.uniform_span(evaluate.ablation(f.forecasts, f.features))


@reporting
def var_daily(f: Flow) -> DataFrame:
    return dashboard.derived(dashboard.var_daily(f.forecasts, f.clean))


@reporting
def var_breaches(f: Flow) -> DataFrame:
    return risk.breaches(risk.common_returns(f.forecasts, f.clean))


@reporting
def var_coverage(f: Flow) -> DataFrame:
    return risk.coverage(risk.common_returns(f.forecasts, f.clean))


@reporting
def var_coverage_p(f: Flow) -> DataFrame:
    """With the p-value, which neither engine's SQL has."""
    return risk.with_p(risk.coverage(risk.common_returns(f.forecasts, f.clean)))


@reporting
def calibration_factors(f: Flow) -> DataFrame:
    return risk.calibration_factors(risk.common_returns(f.forecasts, f.clean), f.features)


@reporting
def calibrated_live(f: Flow) -> DataFrame:
    return risk.calibrated_live(f.live, f.features)


@reporting
def var_coverage_cal(f: Flow) -> DataFrame:
    return risk.backtest(f.forecasts, f.clean, f.features)


@reporting
def verdicts(f: Flow) -> DataFrame:
    return risk.verdicts(risk.backtest(f.forecasts, f.clean, f.features))


@reporting
def coverage_summary(f: Flow) -> DataFrame:
    return risk.coverage_summary(risk.backtest(f.forecasts, f.clean, f.features))


@reporting
def report_window(f: Flow) -> DataFrame:
    return risk.report_window(risk.backtest(f.forecasts, f.clean, f.features))


@reporting
def forecast_vs_realized(f: Flow) -> DataFrame:
    return dashboard.forecast_vs_realized(f.forecasts, f.features)


@query
def vol_regime(f: Flow) -> DataFrame:
    return dashboard.vol_regime(f.features)


@reporting
def latest_forecast(f: Flow) -> DataFrame:
    return dashboard.latest_forecast(f.forecasts)


@reporting
def cumulative_breaches(f: Flow) -> DataFrame:
    return dashboard.cumulative_breaches(dashboard.var_daily(f.forecasts, f.clean))


@reporting
def dashboard_measures(f: Flow) -> DataFrame:
    return dashboard.measures(dashboard.var_daily(f.forecasts, f.clean), ["ticker", "model"])


@reporting
def coverage_view(f: Flow) -> DataFrame:
    return dashboard.coverage_view(risk.coverage(risk.common_returns(f.forecasts, f.clean)))


@reporting
def coverage_measures(f: Flow) -> DataFrame:
    return dashboard.coverage_measures(risk.coverage(risk.common_returns(f.forecasts, f.clean)), ["model"])


@reporting
def vol_measures(f: Flow) -> DataFrame:
    return dashboard.vol_measures(dashboard.forecast_vs_realized(f.forecasts, f.features), ["ticker", "model"])


@reporting
def data_age(f: Flow) -> DataFrame:
    return dashboard.data_age(dashboard.latest_forecast(f.forecasts), F.lit("2001-12-01").cast("date"))


@query
def dim_date(f: Flow) -> DataFrame:
    return dashboard.dim_date(f.vix, "1995-01-01", F.lit("2002-12-31").cast("date"))


@reporting
def dim_ticker_model(f: Flow) -> DataFrame:
    tickers, models = dashboard.dimensions(dashboard.var_daily(f.forecasts, f.clean))
    return tickers.select(F.lit("ticker").alias("kind"), F.col("ticker").alias("value")).unionByName(models.select(F.lit("model").alias("kind"), F.col("model").alias("value")))


@query
def audit_metrics(f: Flow) -> DataFrame:
    return audit.audit(f.raw, f.calendar, indexes=("N",))


@query
def audit_actions(f: Flow) -> DataFrame:
    actions = f.spark.sql("select * from values ('A', date'1996-03-10', 'bonus'), ('R', date'1997-06-02', 'split') as t(ticker, ex_date, note)")
    return audit.around_actions(f.raw, actions)


@branched
def canaries(f: Flow) -> DataFrame:
    return nightly.canaries(f.clean, f.features, har.forecasts(f.features))


@branched
def garch_canaries(f: Flow) -> DataFrame:
    """All five, with the GARCH parameters and HAR by walk-forward."""
    walked = walkforward.walk_forward(f.features, features.HAR_COLUMNS, walkforward.har_factory, har.HAR_TAG)
    return nightly.canaries(f.clean, f.features, har.forecasts(f.features), garch.effective(garch.refits(f.clean)), [walked])


@query
def streamed_sessions(f: Flow) -> DataFrame:
    return streams.completed_sessions(f.spark, f.sf_dir)

"""The reporting views and measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.finance import annual_vol_pct, regime

from . import risk


def forecast_vs_realized(forecasts: DataFrame, features: DataFrame) -> DataFrame:
    both = forecasts.join(features.select("ticker", "trade_date", "gk_var").where("gk_var > 0"), ["ticker", "trade_date"])
    return both.select(
        "ticker", "trade_date", "model", "var_forecast", F.col("gk_var").alias("realized_gk_var"), annual_vol_pct(F.col("var_forecast")).alias("forecast_ann_vol_pct"), annual_vol_pct(F.col("gk_var")).alias("realized_ann_vol_pct")
    )


def var_daily(forecasts: DataFrame, clean: DataFrame) -> DataFrame:
    """Every forecast with a return at its date, at both levels; not only the common dates."""
    returns = clean.where("log_return is not null").select("ticker", "trade_date", "log_return")
    rows = risk.daily(forecasts.select("ticker", "trade_date", "model", "var_forecast").join(returns, ["ticker", "trade_date"]))
    return rows.select("ticker", "trade_date", "model", "level", "log_return", "var_threshold", "breach")


def derived(daily: DataFrame) -> DataFrame:
    """Chart columns of :func:`var_daily`."""
    return daily.select(
        "*", F.col("breach").cast("int").alias("breach_int"), (-F.col("var_threshold") * 100).alias("neg_var_threshold"), (F.col("log_return") * 100).alias("log_return_pct"), F.when(F.col("breach"), F.col("log_return") * 100).alias("breach_return")
    )


def vol_regime(features: DataFrame) -> DataFrame:
    rows = features.where("rvol_21 is not null").select("ticker", "trade_date", "rvol_21")
    rows = rows.withColumn("pr", F.percent_rank().over(Window.partitionBy("ticker").orderBy("rvol_21")))
    return rows.select("ticker", "trade_date", (F.col("rvol_21") * 100).alias("ann_vol_pct_21d"), F.col("pr").alias("vol_percentile"), regime(F.col("pr")).alias("regime"))


def latest_forecast(forecasts: DataFrame) -> DataFrame:
    """The newest row of each ticker and model, partially aggregated, no sort."""
    top = forecasts.groupBy("ticker", "model").agg(F.max_by(F.struct("trade_date", "var_forecast", "is_live"), "trade_date").alias("x"))
    return top.select("ticker", "model", "x.*", annual_vol_pct(F.col("x.var_forecast")).alias("ann_vol_pct"))


def cumulative_breaches(daily: DataFrame) -> DataFrame:
    w = Window.partitionBy("ticker", "model", "level").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.select(
        "ticker", "model", "level", "trade_date", F.sum(F.col("breach").cast("long")).over(w).alias("cumulative_breaches"), (F.count("*").over(w) * (100 - F.col("level")) / 100).alias("cumulative_expected")
    )


def measures(daily: DataFrame, by: list[str]) -> DataFrame:
    """Totals in a slicer context: days, breaches, expectation, gap and mean threshold.

    The expected rate averages over the levels in the context, each once.
    """
    total = daily.groupBy(*by).agg(
        F.count("*").alias("total_days"), F.count_if("breach").alias("breaches"), F.array_distinct(F.collect_set("level")).alias("_levels"), (F.avg("var_threshold") * 100).alias("avg_daily_var_pct")
    )
    rate = 100 - F.aggregate("_levels", F.lit(0.0), lambda a, x: a + x) / F.size("_levels")
    rows = total.withColumn("expected_rate_pct", rate).withColumn("expected_breaches", F.col("total_days") * F.col("expected_rate_pct") / 100)
    return rows.select(
        *by, "total_days", "breaches", "expected_rate_pct", "expected_breaches", (F.col("breaches") / F.col("total_days") * 100).alias("breach_rate_pct"), (F.col("breaches") - F.col("expected_breaches")).alias("coverage_gap"), "avg_daily_var_pct"
    )


def coverage_view(table: DataFrame) -> DataFrame:
    """Chart columns of a coverage table."""
    return table.withColumn("reject_int", F.col("kupiec_reject").cast("int"))


def coverage_measures(coverage: DataFrame, by: list[str]) -> DataFrame:
    """Lowest p-value (as the highest likelihood ratio, and with :func:`risk.with_p` as itself) and rejections in a slicer context."""
    p = [F.min("kupiec_p").alias("min_kupiec_p")] if "kupiec_p" in coverage.columns else []
    return coverage.groupBy(*by).agg(F.max("kupiec_lr").alias("max_kupiec_lr"), *p, F.count_if("kupiec_reject").alias("kupiec_rejections"))


def vol_measures(versus: DataFrame, by: list[str]) -> DataFrame:
    return versus.groupBy(*by).agg(F.avg("forecast_ann_vol_pct").alias("forecast_vol_pct"), F.avg("realized_ann_vol_pct").alias("realized_vol_pct"))


def data_age(latest: DataFrame, today: Column | None = None) -> DataFrame:
    newest = F.max("trade_date")
    return latest.agg(newest.alias("latest_data_date"), F.date_diff(today if today is not None else F.current_date(), newest).alias("data_age_days"))


def dimensions(daily: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct tickers and models."""
    return daily.select("ticker").distinct(), daily.select("model").distinct()


def dim_date(daily: DataFrame, start: str = "2016-07-11", end: Column | None = None) -> DataFrame:
    """A row for each calendar day."""
    days = F.sequence(F.lit(start).cast("date"), end if end is not None else F.current_date())
    return daily.sparkSession.range(1).select(F.explode(days).alias("trade_date"))

"""Value-at-Risk thresholds, breaches, coverage with the Kupiec test, and calibrated variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.finance import CHI2_5PCT, Z_SCORES, chi2_sf, kupiec_lr, var_threshold

from .cleaning import by_date
from .evaluate import CAL, GK_MODELS, on_common_dates, settled

TRIGGER_RATE = 0.06


def levels(df: DataFrame) -> DataFrame:
    """Each row once for each confidence level, with ``level`` and ``z``; two literals, no join."""
    pairs = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(z).alias("z")) for k, z in Z_SCORES.items()])
    return df.withColumn("_level", F.explode(pairs)).select(*df.columns, "_level.level", "_level.z")


def common_returns(forecasts: DataFrame, clean: DataFrame) -> DataFrame:
    """Base forecasts with the session's log return, on the dates all models of a ticker share."""
    returns = clean.where("log_return is not null").select("ticker", "trade_date", "log_return")
    return on_common_dates(settled(forecasts).join(returns, ["ticker", "trade_date"]))


def daily(rows: DataFrame) -> DataFrame:
    """Threshold and breach of each forecast at each level."""
    out = levels(rows).withColumn("var_threshold", var_threshold(F.col("var_forecast"), F.col("z")))
    return out.withColumn("breach", F.col("log_return") < -F.col("var_threshold")).drop("z")


def breaches(rows: DataFrame) -> DataFrame:
    return daily(rows).where("breach").select("ticker", "model", "level", "trade_date", "log_return", "var_threshold")


def coverage(rows: DataFrame) -> DataFrame:
    """Breach counts and the likelihood ratio by ticker, model and level; no Python."""
    tail = 1 - F.col("level") / 100
    out = daily(rows).groupBy("ticker", "model", "level").agg(F.count("*").alias("n_obs"), F.count_if("breach").alias("observed_breaches"), F.min("trade_date").alias("eval_start"), F.max("trade_date").alias("eval_end"))
    lr = kupiec_lr(F.col("n_obs").cast("double"), F.col("observed_breaches").cast("double"), tail)
    out = out.select(
        "ticker", "model", "level", "n_obs", (tail * F.col("n_obs")).alias("expected_breaches"), "observed_breaches", (F.col("observed_breaches") / F.col("n_obs")).alias("breach_rate"),
        lr.alias("kupiec_lr"), "eval_start", "eval_end",
    )
    return out.withColumn("kupiec_reject", F.col("kupiec_lr") > CHI2_5PCT)


def with_p(table: DataFrame) -> DataFrame:
    return table.withColumn("kupiec_p", chi2_sf(F.col("kupiec_lr")))


def trigger(table: DataFrame) -> DataFrame:
    """One row, ``triggered``: whether the range-target models breach 95 % too often on average; false without such a model."""
    rate = F.avg(F.when((F.col("level") == 95) & F.col("model").isin(GK_MODELS), F.col("breach_rate")))
    return table.agg(F.coalesce(rate >= TRIGGER_RATE, F.lit(False)).alias("triggered"))


def running_factors(features: DataFrame) -> DataFrame:
    """(ticker, trade_date, factor): mean squared return over mean range variance of the usable rows strictly before each row."""
    usable = F.col("r2").isNotNull() & (F.col("gk_var") > 0)
    before = by_date().rowsBetween(Window.unboundedPreceding, -1)
    mean = lambda c: F.avg(F.when(usable, F.col(c))).over(before)
    return features.select("ticker", "trade_date", (mean("r2") / mean("gk_var")).alias("factor"))


def with_factors(rows: DataFrame, features: DataFrame) -> DataFrame:
    """``rows`` with the factor of their month: that of the month's first forecast date, held through the month.

    A forecast date with a return is a feature row too, so an equi-join finds the running value.
    """
    month = Window.partitionBy("ticker", F.trunc("trade_date", "month")).orderBy("trade_date")
    return rows.join(running_factors(features), ["ticker", "trade_date"]).withColumn("factor", F.first("factor").over(month))


def calibration_factors(rows: DataFrame, features: DataFrame) -> DataFrame:
    """(ticker, month, first_date, factor) of each month with a forecast."""
    out = rows.select("ticker", "trade_date").join(running_factors(features), ["ticker", "trade_date"]).groupBy("ticker", F.trunc("trade_date", "month").alias("month"))
    return out.agg(F.min("trade_date").alias("first_date"), F.min_by("factor", "trade_date").alias("factor"))


def calibrated(rows: DataFrame, features: DataFrame) -> DataFrame:
    """Range-target forecasts times their month's factor, with the calibrated tag."""
    out = with_factors(rows.where(F.col("model").isin(GK_MODELS)), features)
    return out.withColumn("model", F.concat("model", F.lit(CAL))).withColumn("var_forecast", F.col("var_forecast") * F.col("factor")).select(*rows.columns)


def calibrated_live(live: DataFrame, features: DataFrame) -> DataFrame:
    """Live forecasts of range-target models times the factor of all rows before their date."""
    inputs = features.where("r2 is not null and gk_var > 0").select("ticker", F.col("trade_date").alias("_d"), "r2", "gk_var")
    some = live.where(F.col("model").isin(GK_MODELS))
    out = some.join(inputs, "ticker").where("_d < trade_date").groupBy("ticker", "trade_date", "model").agg(F.first("var_forecast").alias("v"), (F.avg("r2") / F.avg("gk_var")).alias("factor"))
    return out.select("ticker", "trade_date", F.concat("model", F.lit(CAL)).alias("model"), (F.col("v") * F.col("factor")).alias("var_forecast"))


def backtest(forecasts: DataFrame, clean: DataFrame, features: DataFrame) -> DataFrame:
    """Coverage of the base models and, if the trigger fires, of their calibrated variants.

    One pass: a row of a range-target model counts as itself and as its calibrated variant.
    """
    rows = with_factors(common_returns(forecasts, clean), features)
    own = F.struct(F.col("model").alias("model"), F.col("var_forecast").alias("v"))
    cal = F.struct(F.concat("model", F.lit(CAL)).alias("model"), (F.col("var_forecast") * F.col("factor")).alias("v"))
    both = rows.select("ticker", "trade_date", "log_return", F.explode(F.when(F.col("model").isin(GK_MODELS), F.array(own, cal)).otherwise(F.array(own))).alias("x"))
    table = coverage(both.select("ticker", "trade_date", "log_return", "x.model", F.col("x.v").alias("var_forecast")))
    fires = F.broadcast(trigger(table))  # one row
    return table.join(fires, F.col("triggered") | ~F.col("model").endswith(CAL)).drop("triggered")


def verdicts(table: DataFrame) -> DataFrame:
    """One row: do range-target models underestimate at 95 %, is every model's 99 % rate above 1 %, who deviates more."""
    gk = F.col("model").isin(GK_MODELS)
    per = table.where(~F.col("model").endswith(CAL)).groupBy("model", "level").agg(
        F.sum("breach_rate").alias("s"), F.count("*").alias("n"), F.avg("breach_rate").alias("r"), F.bool_and("kupiec_reject").alias("all_reject")
    )
    l95 = F.col("level") == 95
    rate = lambda cond: F.sum(F.when(cond, F.col("s"))) / F.sum(F.when(cond, F.col("n")))
    one = per.agg(rate(gk & l95).alias("gk_rate_95"), rate(~gk & l95).alias("other_rate_95"), F.bool_and(F.when(gk & l95, F.col("all_reject"))).alias("gk_all_reject_95"), F.min(F.when(~l95, F.col("r"))).alias("least_rate_99"))
    return one.select(
        "*", F.coalesce(F.col("gk_rate_95") >= TRIGGER_RATE, F.lit(False)).alias("underestimates"), (F.col("least_rate_99") > 0.01).alias("all_above_99"),
        (F.abs(F.col("gk_rate_95") - 0.05) > F.abs(F.col("other_rate_95") - 0.05)).alias("gk_deviates_more"),
    )


def report_window(table: DataFrame) -> DataFrame:
    return table.agg(F.min("n_obs").alias("n_obs"), F.max("eval_start").alias("eval_start"), F.min("eval_end").alias("eval_end"))


def coverage_summary(table: DataFrame) -> DataFrame:
    """By model and level over tickers: average breaches and rate, and how many reject."""
    return table.groupBy("model", "level").agg(F.avg("observed_breaches").alias("avg_breaches"), F.avg("breach_rate").alias("avg_rate"), F.count_if("kupiec_reject").alias("n_reject"), F.count("*").alias("n_tickers"))

"""Forecast accuracy against realized range variance, on the dates that all models share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.finance import qlike_term, vol_error_sq

from . import reports

# Base models in display order, those with a range-variance target, and the tag of calibrated ones.
BASE_MODELS = ["ewma_094", "garch_11", "har_rv", "lgbm", "lgbm_vix"]
GK_MODELS = ["har_rv", "lgbm", "lgbm_vix"]
CAL = "_cal"


def settled(forecasts: DataFrame) -> DataFrame:
    """Rows of base models that aren't live."""
    return forecasts.where(~F.col("is_live") & F.col("model").isin(BASE_MODELS))


def on_common_dates(rows: DataFrame) -> DataFrame:
    """Rows of the dates on which every model of the ticker has one."""
    here = F.size(F.collect_set("model").over(Window.partitionBy("ticker", "trade_date")))
    there = F.size(F.collect_set("model").over(Window.partitionBy("ticker")))
    return rows.withColumn("_here", here).withColumn("_there", there).where("_here = _there").drop("_here", "_there")


def ablation(forecasts: DataFrame, features: DataFrame, all_models: bool = False) -> DataFrame:
    """QLIKE and RMSE by ticker and model. ``all_models`` lets calibrated rows into the common dates too."""
    rows = forecasts.where(~F.col("is_live")) if all_models else settled(forecasts)
    both = on_common_dates(rows.join(features.select("ticker", "trade_date", "gk_var").where("gk_var > 0"), ["ticker", "trade_date"]))
    return both.groupBy("ticker", "model").agg(
        F.count("*").alias("n_obs"),
        F.avg(qlike_term(F.col("gk_var"), F.col("var_forecast"))).alias("qlike"),
        F.sqrt(F.avg(vol_error_sq(F.col("gk_var"), F.col("var_forecast")))).alias("rmse_ann_vol_pct"),
        F.min("trade_date").alias("eval_start"),
        F.max("trade_date").alias("eval_end"),
    )


def with_average(table: DataFrame) -> DataFrame:
    """The metrics with an AVERAGE row per model, every ticker of one weight, and flags of the best model of each row."""
    sets = table.groupingSets([["ticker", "model"], ["model"]], "ticker", "model")  # the metrics are read once
    both = sets.agg(F.avg("qlike").alias("qlike"), F.avg("rmse_ann_vol_pct").alias("rmse_ann_vol_pct"), F.grouping("ticker").alias("_all"))
    both = both.select(F.when(F.col("_all") == 1, "AVERAGE").otherwise(F.col("ticker")).alias("ticker"), "model", "qlike", "rmse_ann_vol_pct")
    row = Window.partitionBy("ticker")
    return both.select("*", (F.col("qlike") == F.min("qlike").over(row)).alias("best_qlike"), (F.col("rmse_ann_vol_pct") == F.min("rmse_ann_vol_pct").over(row)).alias("best_rmse"))


def uniform_span(table: DataFrame) -> DataFrame:
    """One row: whether all rows were measured on one number of sessions and one span."""
    return table.agg((F.count_distinct("n_obs") == 1).alias("one_n_obs"), (F.count_distinct("eval_start", "eval_end") == 1).alias("one_span"), F.count_distinct("model").alias("n_models"))


def in_display_order(df: DataFrame) -> DataFrame:
    order = F.coalesce(*[F.when(F.col("model") == m, F.lit(i)) for i, m in enumerate([*BASE_MODELS, *[m + CAL for m in GK_MODELS]])], F.lit(99))
    return df.orderBy("ticker", order)


def markdown(table: DataFrame, value: str) -> str:
    """A table of one metric, tickers by models, the best of a row in bold."""
    best = F.col("best_qlike" if value == "qlike" else "best_rmse")
    cell = F.format_string("%.4f", value)
    rows = with_average(table).select("ticker", "model", F.when(best, F.concat(F.lit("**"), cell, F.lit("**"))).otherwise(cell).alias("cell"))
    found = {r["model"] for r in rows.select("model").distinct().collect()}  # the models, fewer than ten
    known = [m for m in (*BASE_MODELS, *(m + CAL for m in GK_MODELS)) if m in found]
    wide = rows.groupBy("ticker").pivot("model", [*known, *sorted(found.difference(known))]).agg(F.first("cell"))
    return reports.markdown(wide.orderBy(F.col("ticker") == "AVERAGE", "ticker"))

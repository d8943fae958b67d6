"""Rolling features: every frame shares one partitioning and one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.finance import SESSIONS_A_YEAR, garman_klass, log_change, parkinson

from .cleaning import by_date

LAGS = (1, 2, 3, 4, 5)
VOL_WINDOWS = (5, 21, 63)
HAR_WINDOWS = {"har_rv_w": 5, "har_rv_m": 22}
HAR_COLUMNS = ["gk_var", "har_rv_w", "har_rv_m"]
# Inputs of the tree models.
TREE_COLUMNS = ["ret_lag_1", "ret_lag_2", "ret_lag_3", "ret_lag_4", "ret_lag_5", "r2", "park_var", "gk_var", "rvol_5", "rvol_21", "rvol_63", "har_rv_w", "har_rv_m"]
VIX_COLUMNS = ["vix_close", "vix_log_change"]
TARGET = "target_gk_var_next"


def full_mean(column: str, n: int) -> Column:
    """The mean of the last ``n`` rows, null unless all are there."""
    w = by_date().rowsBetween(-(n - 1), 0)
    return F.when(F.count(column).over(w) == n, F.avg(column).over(w))


def build(clean: DataFrame) -> DataFrame:
    """Daily features; a warm-up row has nulls, never a shorter window."""
    rows = clean.select(
        "ticker", "trade_date", "log_return", F.pow("log_return", F.lit(2)).alias("r2"), parkinson(F.col("high"), F.col("low")).alias("park_var"),
        garman_klass(F.col("open"), F.col("high"), F.col("low"), F.col("close")).alias("gk_var"),
    )
    return rows.select(
        "ticker", "trade_date", "log_return", *[F.lag("log_return", k).over(by_date()).alias(f"ret_lag_{k}") for k in LAGS], "r2", "park_var", "gk_var",
        *[F.sqrt(SESSIONS_A_YEAR * full_mean("r2", n)).alias(f"rvol_{n}") for n in VOL_WINDOWS],
        *[full_mean("gk_var", n).alias(name) for name, n in HAR_WINDOWS.items()],
        F.lead("gk_var", 1).over(by_date()).alias(TARGET),
    )


def with_vix(features: DataFrame, vix: DataFrame) -> DataFrame:
    """Features with the index level and its log change, null where the index has no row; a day's row is a small dimension."""
    from pyspark.sql import Window

    w = Window.orderBy("trade_date")  # a row per calendar day
    index = vix.select("trade_date", "vix_close", log_change(F.col("vix_close"), F.lag("vix_close").over(w)).alias("vix_log_change"))
    return features.join(F.broadcast(index), "trade_date", "left")


def summary(features: DataFrame) -> DataFrame:
    """Per ticker: rows, complete 63-day windows, and rows with a negative range variance."""
    return features.groupBy("ticker").agg(F.count("*").alias("n_rows"), F.count("rvol_63").alias("n_rvol_63"), F.count("har_rv_m").alias("n_har_rv_m"), F.count_if(F.col("gk_var") < 0).alias("n_negative_gk"))


def by_joins(clean: DataFrame) -> DataFrame:
    """The features of :func:`build` by another way: rows are numbered once, and lags and windows are equi-joins on these numbers."""
    numbered = clean.select("ticker", "trade_date", "open", "high", "low", "close", "adj_close", F.row_number().over(by_date()).alias("i"))
    spread, body = F.ln("high") - F.ln("low"), F.ln("close") - F.ln("open")
    last = numbered.select("ticker", (F.col("i") + 1).alias("i"), F.col("adj_close").alias("last"))
    rows = numbered.join(last, ["ticker", "i"], "left").select(
        "ticker", "trade_date", "i", (F.ln("adj_close") - F.ln("last")).alias("log_return"), (spread * spread / (4 * F.ln(F.lit(2.0)))).alias("park_var"),
        (spread * spread / 2 - (2 * F.ln(F.lit(2.0)) - 1) * body * body).alias("gk_var"),
    ).withColumn("r2", F.col("log_return") * F.col("log_return"))
    longest = max(*VOL_WINDOWS, *HAR_WINDOWS.values(), *LAGS, 1)
    # each row goes to the rows whose windows hold it; ``k`` is how many rows it lies back
    dealt = rows.select("ticker", F.explode(F.sequence(F.lit(-1), F.lit(longest))).alias("k"), (F.col("i") + F.col("k")).alias("i"), "log_return", "r2", "gk_var")

    def mean(c: str, n: int) -> Column:
        inside = F.when(F.col("k").between(0, n - 1), F.col(c))
        return F.when(F.count(inside) == n, F.sum(inside) / n)

    wide = dealt.groupBy("ticker", "i").agg(
        *[F.max(F.when(F.col("k") == k, F.col("log_return"))).alias(f"ret_lag_{k}") for k in LAGS],
        *[F.sqrt(SESSIONS_A_YEAR * mean("r2", n)).alias(f"rvol_{n}") for n in VOL_WINDOWS],
        *[mean("gk_var", n).alias(name) for name, n in HAR_WINDOWS.items()],
        F.max(F.when(F.col("k") == -1, F.col("gk_var"))).alias(TARGET),
    )
    return rows.join(wide, ["ticker", "i"]).drop("i")


def cross_check(ours: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: the largest difference of two feature frames, whether their nulls agree, and the other frame's values and their mean."""
    a = ours.select("ticker", "trade_date", *[F.col(c).alias(f"a_{c}") for c in columns])
    b = other.select("ticker", "trade_date", *[F.col(c).alias(f"b_{c}") for c in columns])
    both = a.join(b, ["ticker", "trade_date"], "full")
    row = both.agg(*[x for c in columns for x in (F.max(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))).alias(f"d_{c}"), F.count_if(F.col(f"a_{c}").isNull() != F.col(f"b_{c}").isNull()).alias(f"n_{c}"), F.count(f"b_{c}").alias(f"v_{c}"), F.avg(f"b_{c}").alias(f"m_{c}"))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(f"d_{c}", F.lit(0.0)).alias("max_abs_diff"), (F.col(f"n_{c}") == 0).alias("nulls_agree"), F.col(f"v_{c}").alias("n_values"), F.col(f"m_{c}").alias("mean_value")) for c in columns])).alias("x")).select("x.*")

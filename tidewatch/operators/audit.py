"""Data-quality audit of raw bars: gaps, volume, adjustment of prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.finance import log_change

from .cleaning import by_date

# Thresholds of the audit.
JUMP = 0.35
MAX_GAP_RATE = 0.010
MAX_ZERO_VOLUME_RATE = 0.010
MAX_LAST_RATIO_DEVIATION = 0.01
ACTION_DAYS = 7


def moves(bars: DataFrame) -> DataFrame:
    return bars.select("*", F.abs(log_change(F.col("close"), F.lag("close").over(by_date()))).alias("raw_move"), F.abs(log_change(F.col("adj_close"), F.lag("adj_close").over(by_date()))).alias("adj_move"))


def audit(bars: DataFrame, calendar: DataFrame, indexes: tuple[str, ...] = ()) -> DataFrame:
    """Metrics, rates and verdict per ticker; sessions count from its first to its last bar, an index needs no volume."""
    sessions = calendar.select(F.col("session_date").alias("trade_date"), F.lit(True).alias("session"))
    rows = moves(bars).join(F.broadcast(sessions), "trade_date", "left")
    open_ = F.coalesce("session", F.lit(False))
    per = rows.groupBy("ticker").agg(
        F.count("*").alias("n_bars"), F.min("trade_date").alias("first_bar"), F.max("trade_date").alias("last_bar"), F.count_if(open_).alias("in_session"), F.count_if(~open_).alias("n_special"),
        F.count_if(F.coalesce("volume", F.lit(0)) == 0).alias("n_zero_volume"), F.max_by(F.col("close") / F.col("adj_close"), "trade_date").alias("last_close_adj_ratio"), F.max("raw_move").alias("max_raw_move"),
        F.max("adj_move").alias("max_adj_move"), F.count_if(F.col("raw_move") > JUMP).alias("n_jumps"),
    )
    days = F.broadcast(calendar.agg(F.array_sort(F.collect_list("session_date")).alias("_days")))  # a few thousand dates
    expected = F.size(F.filter("_days", lambda d: d.between(F.col("first_bar"), F.col("last_bar")))).cast("long")
    out = per.crossJoin(days).withColumn("expected_sessions", expected).withColumn("n_missing", F.col("expected_sessions") - F.col("in_session"))
    out = out.withColumn("gap_rate", F.try_divide("n_missing", "expected_sessions")).withColumn("zero_volume_rate", F.col("n_zero_volume") / F.col("n_bars"))
    adjusted = (F.abs(F.col("last_close_adj_ratio") - 1) < MAX_LAST_RATIO_DEVIATION) & (F.col("n_jumps") == 0)
    volume = F.col("ticker").isin(*indexes) | (F.col("zero_volume_rate") < MAX_ZERO_VOLUME_RATE)
    out = out.withColumn("adjustment_ok", adjusted).withColumn("go", (F.col("gap_rate") < MAX_GAP_RATE) & volume & adjusted)
    return out.select(
        "ticker", "n_bars", "first_bar", "last_bar", "expected_sessions", "n_missing", "n_special", "n_zero_volume", "last_close_adj_ratio", "max_raw_move", "max_adj_move", "n_jumps", "gap_rate", "zero_volume_rate", "adjustment_ok", "go"
    )


def run(provider, tickers: tuple[str, ...], as_of: str, calendar: DataFrame, actions: DataFrame, years: int = 10, indexes: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """:func:`audit` and :func:`around_actions` of the last ``years`` of the tickers' bars as a provider has them."""
    start = f"{int(as_of[:4]) - years}{as_of[4:]}" if not as_of.endswith("02-29") else f"{int(as_of[:4]) - years}-02-28"
    bars = None
    for t in tickers:
        one = provider.fetch(t, start, as_of)
        bars = one if bars is None else bars.unionByName(one)
    return audit(bars, calendar, indexes), around_actions(bars, actions)


def around_actions(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Per corporate action (ticker, ex_date, note): whether the adjusted series is continuous within a week of it."""
    near = F.col("trade_date").between(F.date_sub("ex_date", ACTION_DAYS), F.date_add("ex_date", ACTION_DAYS))
    rows = bars.join(F.broadcast(actions), "ticker").where(near)  # a short list of known actions
    from pyspark.sql import Window

    w = Window.partitionBy("ticker", "ex_date").orderBy("trade_date")
    move = F.abs(log_change(F.col("adj_close"), F.lag("adj_close").over(w)))
    seen = rows.withColumn("move", move).groupBy("ticker", "ex_date").agg(F.max("move").alias("max_move"))
    return actions.join(seen, ["ticker", "ex_date"], "left").select("ticker", "ex_date", "note", "max_move", F.coalesce(F.col("max_move") < JUMP, F.lit(False)).alias("continuous"))

"""Calendar alignment of raw bars, log returns, and the reports on both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.finance import log_change

TELESCOPING_TOLERANCE = 1e-9


def by_date():
    """The window of a ticker's rows by date. A function, as a window needs a session and modules load without one."""
    return Window.partitionBy("ticker").orderBy("trade_date")


def last_completed_session(calendar: DataFrame, as_of: str, lookback: int = 14) -> DataFrame:
    """One row, ``cutoff``: the latest session whose close is not after ``as_of``, within the lookback."""
    t = F.lit(as_of).cast("timestamp")
    recent = calendar.where((F.col("close_utc") <= t) & (F.col("session_date") >= F.date_sub(F.to_date(t), lookback)))
    return recent.agg(F.max("session_date").alias("cutoff"))


def next_session(calendar: DataFrame, after: Column | str, lookahead: int = 14) -> DataFrame:
    """One row, ``next_session``: the first session strictly after a date, within the lookahead."""
    d = F.lit(after).cast("date") if isinstance(after, str) else after
    return calendar.where((F.col("session_date") > d) & (F.col("session_date") <= F.date_add(d, lookahead))).agg(F.min("session_date").alias("next_session"))


def with_log_returns(bars: DataFrame) -> DataFrame:
    """``log_return`` over consecutive available rows; null on a ticker's first one."""
    return bars.withColumn("log_return", log_change(F.col("adj_close"), F.lag("adj_close").over(by_date())))


def clean_bars(raw: DataFrame, calendar: DataFrame, as_of: str) -> DataFrame:
    """Bars of completed sessions with log returns; the calendar and its cutoff are broadcast dimensions."""
    cutoff = last_completed_session(calendar, as_of)
    sessions = calendar.join(F.broadcast(cutoff), F.col("session_date") <= F.col("cutoff")).select(F.col("session_date").alias("trade_date"))
    return with_log_returns(raw.join(F.broadcast(sessions), "trade_date", "left_semi"))


def gap_report(raw: DataFrame, calendar: DataFrame, as_of: str) -> DataFrame:
    """Per ticker: expected sessions, bars, missing sessions, bars outside sessions, partial bars, clean rows.

    Sessions count from the first bar to the earlier of the last bar and the cutoff.
    """
    cutoff = F.broadcast(last_completed_session(calendar, as_of))
    sessions = F.broadcast(calendar.select(F.col("session_date").alias("trade_date"), F.lit(True).alias("session")))
    bars = raw.crossJoin(cutoff).join(sessions, "trade_date", "left")
    settled = F.col("trade_date") <= F.col("cutoff")
    open_ = F.coalesce("session", F.lit(False))
    dates = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("trade_date"))))
    spans = bars.groupBy("ticker").agg(
        F.min("trade_date").alias("first_bar"),
        F.max("trade_date").alias("last_bar"),
        F.max("cutoff").alias("cutoff"),
        F.count("*").alias("bars_present"),
        F.count_if(settled & open_).alias("clean_rows"),
        dates(settled & ~open_).alias("non_session_rows"),
        dates(~settled).alias("partial_rows"),
        F.collect_set(F.when(settled & open_, F.col("trade_date"))).alias("_present"),
    )
    days = F.broadcast(calendar.agg(F.array_sort(F.collect_list("session_date")).alias("_days")))  # a few thousand dates
    window = F.filter("_days", lambda d: (d >= F.col("first_bar")) & (d <= F.least("last_bar", "cutoff")))
    out = spans.crossJoin(days).withColumn("_window", window)
    return out.select(
        "ticker", "first_bar", "last_bar", F.size("_window").cast("long").alias("expected_sessions"), "bars_present",
        F.array_sort(F.array_except("_window", "_present")).alias("missing_sessions"), "non_session_rows", "partial_rows", "clean_rows",
    )


def gap_counts(report: DataFrame) -> DataFrame:
    """The report with counts in place of the date lists."""
    size = lambda c, name: F.size(c).cast("long").alias(name)
    return report.select(
        "ticker", "first_bar", "last_bar", "expected_sessions", "bars_present", size("missing_sessions", "n_missing"), size("non_session_rows", "n_non_session"), size("partial_rows", "n_partial"), "clean_rows"
    )


def telescoping(clean: DataFrame) -> DataFrame:
    """Per ticker: the sum of log returns, the log of last over first price, and whether they agree."""
    sums = clean.groupBy("ticker").agg(
        F.sum("log_return").alias("sum_log_return"), F.ln(F.max_by("adj_close", "trade_date") / F.min_by("adj_close", "trade_date")).alias("log_total")
    )
    return sums.withColumn("telescopes", F.abs(F.coalesce("sum_log_return", F.lit(0.0)) - F.col("log_total")) <= TELESCOPING_TOLERANCE)

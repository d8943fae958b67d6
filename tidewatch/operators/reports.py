"""Reports as text: a frame of a few rows, formatted in the plan and written out on the driver."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(df: DataFrame, formats: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` as strings: numbers by their format (``%.4f``), a null as nothing."""
    formats = formats or {}
    shown = lambda c: F.format_string(formats[c], c) if c in formats else F.col(c).cast("string")
    return df.select(*[F.when(F.col(c).isNotNull(), shown(c)).otherwise("").alias(c) for c in df.columns])


def markdown(df: DataFrame, formats: Mapping[str, str] | None = None) -> str:
    """A Markdown table of the rows, in their order."""
    body = [tuple(r) for r in cells(df, formats).collect()]
    rows = [tuple(df.columns), ("---",) * len(df.columns), *body]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def fixed_width(df: DataFrame, formats: Mapping[str, str] | None = None) -> str:
    """The rows in columns as wide as their widest cell; numbers to the right."""
    body = [tuple(df.columns), *(tuple(r) for r in cells(df, formats).collect())]
    width = [max(len(r[i]) for r in body) for i in range(len(df.columns))]
    right = [t not in ("string", "date", "boolean") for _, t in df.dtypes]
    return "\n".join("  ".join(x.rjust(w) if to_right else x.ljust(w) for x, w, to_right in zip(r, width, right, strict=True)).rstrip() for r in body)


def dates(column: str, most: int = 10) -> Column:
    """An array of dates as text, shortened behind the first ``most``."""
    rest = F.size(column) - most
    return F.concat(F.array_join(F.slice(column, 1, most).cast("array<string>"), ", "), F.when(rest > 0, F.format_string(" and %d more", rest)).otherwise(""))


def backtest(coverage: DataFrame) -> str:
    """The coverage table of a backtest."""
    shown = coverage.select("ticker", "model", "level", "n_obs", "observed_breaches", "expected_breaches", (100 * F.col("breach_rate")).alias("rate_pct"), "kupiec_lr", "kupiec_reject").orderBy("model", "level", "ticker")
    return fixed_width(shown, {"expected_breaches": "%.1f", "rate_pct": "%.2f", "kupiec_lr": "%.3f"})


def gaps(report: DataFrame) -> str:
    """What cleaning found by ticker: sessions without a bar, and bars without a session."""
    return fixed_width(report.select("ticker", F.size("missing_sessions").alias("missing"), dates("missing_sessions").alias("sessions"), F.size("non_session_rows").alias("extra"), dates("non_session_rows").alias("bars")).orderBy("ticker"))


def audit(metrics: DataFrame) -> str:
    """The audit's metrics by ticker, as Markdown."""
    return markdown(metrics.orderBy("ticker"), {c: "%.4f" for c, t in metrics.dtypes if t == "double"})

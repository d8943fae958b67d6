"""Validation as a DataFrame of violations: every fault of every row is reported, then it may raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.sources.market import CANONICAL, PRICES

CLEAN = T.StructType([*CANONICAL.fields, T.StructField("log_return", T.DoubleType())])
FORECASTS = T.StructType([*CANONICAL.fields[:2], T.StructField("model", T.StringType()), T.StructField("var_forecast", T.DoubleType())])


class ValidationError(ValueError):
    def __init__(self, context: str, violations: list) -> None:
        super().__init__(f"{context}: {len(violations)} kinds of violations: {violations}")
        self.violations = violations


def schema_faults(df: DataFrame, expected: T.StructType) -> list[str]:
    """Differences of columns and types; a date must be a plain date."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in expected}
    out = [f"missing column {c}" for c in want if c not in have] + [f"unexpected column {c}" for c in have if c not in want]
    return out + [f"{c} is {have[c].simpleString()}, not {t.simpleString()}" for c, t in want.items() if c in have and have[c] != t]


def bar_checks() -> dict[str, Column]:
    """Conditions that hold for a faulty bar, by name."""
    c = F.col
    out = {f"{k}_null": c(k).isNull() for k in ("ticker", "trade_date")} | {f"{k}_null": c(k).isNull() | F.isnan(k) for k in PRICES}
    out |= {f"{k}_not_positive": c(k) <= 0 for k in PRICES}
    return out | {
        "volume_negative": c("volume") < 0,
        "high_below_low": c("high") < c("low"),
        "open_outside_range": (c("open") < c("low")) | (c("open") > c("high")),
        "close_outside_range": (c("close") < c("low")) | (c("close") > c("high")),
    }


def forecast_checks() -> dict[str, Column]:
    c = F.col
    return {f"{k}_null": c(k).isNull() for k in FORECASTS.names} | {"var_forecast_not_positive": c("var_forecast") <= 0}


def violations(df: DataFrame, checks: dict[str, Column], keys: list[str]) -> DataFrame:
    """A row (keys, check) for each fault, in one pass and one shuffle by key; ``duplicate_key`` marks all rows of a key."""
    copies = F.count("*").over(Window.partitionBy(*keys))
    faults = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks.items()], F.when(F.col("_copies") > 1, F.lit("duplicate_key"))))
    return df.withColumn("_copies", copies).select(*keys, F.explode(faults).alias("check"))


def validate(df: DataFrame, expected: T.StructType, checks: dict[str, Column], keys: list[str], context: str) -> DataFrame:
    """``df`` if it has no fault; else an error that names every kind of fault with its count."""
    if faults := schema_faults(df, expected):
        raise ValidationError(context, faults)
    found = [tuple(r) for r in violations(df, checks, keys).groupBy("check").count().orderBy("check").collect()]
    if found:
        raise ValidationError(context, found)
    return df


def validate_bars(df: DataFrame, context: str) -> DataFrame:
    return validate(df, CANONICAL, bar_checks(), ["ticker", "trade_date"], context)


def validate_clean(df: DataFrame, context: str) -> DataFrame:
    return validate(df, CLEAN, bar_checks(), ["ticker", "trade_date"], context)


def validate_forecasts(df: DataFrame, context: str) -> DataFrame:
    return validate(df, FORECASTS, forecast_checks(), ["ticker", "trade_date", "model"], context)


#: Constraints of stored tables: conditions that hold for a good row.
INVARIANTS = {
    "features": {k: f"{k} is null or {k} >= 0" for k in ("r2", "park_var", "rvol_5", "rvol_21", "rvol_63")},
    "forecasts": {"var_forecast": "var_forecast > 0"},
    "coverage": {
        "level": "level in (95, 99)",
        "observed": "observed_breaches between 0 and n_obs",
        "rate": "breach_rate between 0 and 1",
        "kupiec_lr": "kupiec_lr >= 0",
        "span": "eval_start <= eval_end",
    },
    "breaches": {"threshold": "var_threshold > 0", "breach": "log_return < -var_threshold"},
    "ablation": {"n_obs": "n_obs > 0", "qlike": "qlike >= 0", "rmse": "rmse_ann_vol_pct >= 0", "span": "eval_start <= eval_end"},
}


def invariants(df: DataFrame, name: str) -> DataFrame:
    """(invariant, n_bad) of a table, in one aggregation."""
    rules = INVARIANTS[name]
    row = df.agg(*[F.count_if(~F.coalesce(F.expr(cond), F.lit(True))).alias(k) for k, cond in rules.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("invariant"), F.col(k).alias("n_bad")) for k in rules])).alias("x")).select("x.*")

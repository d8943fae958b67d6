"""Market-risk formulas as column expressions, all inside whole-stage codegen but for :func:`chi2_sf`."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Sessions of a year, lowest variance, lowest argument of a logarithm, daily decay.
SESSIONS_A_YEAR = 252
VARIANCE_FLOOR = 1e-8
LOG_FLOOR = 1e-12
DECAY = 0.94
# One-sided normal quantiles by confidence level in percent.
Z_SCORES = {95: 1.6448536269514722, 99: 2.3263478740408408}
#: The 5 % point of chi-squared with one degree of freedom.
CHI2_5PCT = 3.841458820694124


def log_change(price: Column, previous: Column) -> Column:
    """Difference of logs (not the log of the ratio, which rounds otherwise)."""
    return F.ln(price) - F.ln(previous)


def parkinson(high: Column, low: Column) -> Column:
    """Range variance ln(H/L)^2 / (4 ln 2)."""
    return F.pow(F.ln(high / low), 2) / (4 * math.log(2))


def garman_klass(open_: Column, high: Column, low: Column, close: Column) -> Column:
    """Range variance 0.5 ln(H/L)^2 - (2 ln 2 - 1) ln(C/O)^2; it can be negative."""
    return 0.5 * F.pow(F.ln(high / low), 2) - (2 * math.log(2) - 1) * F.pow(F.ln(close / open_), 2)


def annual_vol_pct(variance: Column) -> Column:
    return F.sqrt(SESSIONS_A_YEAR * variance) * 100


def safe_ln(x: Column) -> Column:
    """The log of x, at least of the floor; null for null, which greatest() would skip."""
    return F.when(x.isNotNull(), F.ln(F.greatest(x, F.lit(LOG_FLOOR))))


def var_threshold(variance: Column, z: Column) -> Column:
    """Value-at-Risk as a positive loss of the log return."""
    return z * F.sqrt(variance)


def qlike_term(realized: Column, forecast: Column) -> Column:
    """h/f - ln(h/f) - 1, the loss whose mean is QLIKE."""
    return realized / forecast - F.ln(realized / forecast) - 1


def vol_error_sq(realized: Column, forecast: Column) -> Column:
    """Squared error in annualized volatility points."""
    return F.pow(annual_vol_pct(realized) - annual_vol_pct(forecast), 2)


def kupiec_lr(n: Column, x: Column, p: Column) -> Column:
    """Likelihood ratio of x exceptions in n against rate p; 0 ln 0 is 0, and rounding never makes it negative.

    A row without observations, or with a rate outside (0, 1), is an error.
    """
    rate = x / n
    wrong = F.raise_error(F.format_string("no likelihood ratio of %s observations at rate %s", n.cast("string"), p.cast("string"))).cast("double")

    def part(count: Column, share: Column) -> Column:
        return F.when(count > 0, count * F.ln(share)).otherwise(F.lit(0.0))

    null = part(n - x, 1 - p) + part(x, p)
    other = part(n - x, 1 - rate) + part(x, rate)
    return F.when((n > 0) & (p > 0) & (p < 1), F.greatest(F.lit(-2.0) * (null - other), F.lit(0.0))).otherwise(wrong)


def chi2_sf(lr: Column) -> Column:
    """Upper tail of chi-squared with one degree of freedom; a few rows per ticker, so Python costs nothing."""

    def tail(values: pd.Series) -> pd.Series:
        return values.map(lambda v: math.erfc(math.sqrt(v / 2)) if v == v else None)

    return F.pandas_udf(tail, "double")(lr)


def regime(percentile: Column) -> Column:
    return F.when(percentile < 0.25, "calm").when(percentile < 0.75, "normal").when(percentile < 0.95, "elevated").otherwise("stressed")

"""EWMA and GARCH variance recursions, as running sums.

x[t] = decay * x[t-1] + u[t-1] is decay**i * (x at the start + sum of u[k] * decay**-(k+1)),
a window sum over a block of a ticker's rows.  A block has as many rows as keep
``decay ** -n`` in double range; by its end the block before the last one weighs
exp(-300), which no double shows beside the last, so that a block starts from the inputs
of the one before.  Any number of rows goes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.finance import DECAY

from .cleaning import by_date

MIN_TRAIN = 756
SEED_WINDOW = 252
EWMA_TAG, GARCH_TAG = "ewma_094", "garch_11"


def whole():
    return Window.partitionBy("ticker")


def block_rows(decay: float) -> int:
    """Rows of a block: the fewest that shrink a start by exp(300)."""
    return math.ceil(300 / -math.log(decay))


def _recursion(t: Column, start: Column, inputs: Column, decay: float) -> Column:
    """x[t] of each row from x[0] = ``start`` and the inputs of the rows before."""
    rows = block_rows(decay)
    block, i, d = F.floor(t / rows), t % rows, F.lit(decay)
    own = Window.partitionBy("ticker", block).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(inputs * F.pow(d, -(i + 1))).over(own), F.lit(0.0))
    before = Window.partitionBy("ticker").orderBy(block).rangeBetween(-1, -1)
    carried = F.sum(inputs * F.pow(d, rows - 1 - i)).over(before) + F.when(block == 1, F.pow(d, F.lit(rows)) * start).otherwise(0.0)
    return F.pow(d, i) * (F.when(block == 0, start).otherwise(carried) + within)


def indexed(returns: DataFrame) -> DataFrame:
    """Rows with a return, their number ``t`` from 0, and the ticker's row count ``n``."""
    rows = returns.where("log_return is not null").select("ticker", "trade_date", "log_return")
    return rows.withColumn("t", F.row_number().over(by_date()) - 1).withColumn("n", F.count("*").over(whole()))


def _ewma(returns: DataFrame, decay: float) -> DataFrame:
    rows = indexed(returns).withColumn("r2", F.col("log_return") * F.col("log_return"))
    seed = F.avg(F.when(F.col("t") < SEED_WINDOW, F.col("r2"))).over(whole())
    return rows.withColumn("seed", seed).withColumn("var_forecast", _recursion(F.col("t"), F.col("seed"), (1 - decay) * F.col("r2"), decay))


def ewma_forecasts(returns: DataFrame, decay: float = DECAY, min_train: int = MIN_TRAIN) -> DataFrame:
    """(ticker, trade_date, model, var_forecast) from row ``min_train`` on; a shorter ticker gives none."""
    return _ewma(returns, decay).where(F.col("t") >= min_train).select("ticker", "trade_date", F.lit(EWMA_TAG).alias("model"), "var_forecast")


def ewma_live(returns: DataFrame, decay: float = DECAY, min_train: int = MIN_TRAIN) -> DataFrame:
    """The forecast of the session after each ticker's last one: (ticker, last_date, model, var_forecast)."""
    last = _ewma(returns, decay).where((F.col("t") == F.col("n") - 1) & (F.col("n") > min_train))
    return last.select("ticker", F.col("trade_date").alias("last_date"), F.lit(EWMA_TAG).alias("model"), (decay * F.col("var_forecast") + (1 - decay) * F.col("r2")).alias("var_forecast"))


@dataclass(frozen=True)
class GarchParams:
    """Of returns in percent."""

    mu: float
    omega: float
    alpha: float
    beta: float


def garch_filter(returns: DataFrame, p: GarchParams) -> DataFrame:
    """The conditional variance of each session under fixed parameters, in percent squared, and ``next_variance``."""
    rows = indexed(returns).withColumn("eps", 100 * F.col("log_return") - p.mu)
    level = p.omega / (1 - p.alpha - p.beta) if p.alpha + p.beta < 1 else None
    rows = rows.withColumn("start", F.lit(level) if level is not None else F.var_pop("eps").over(whole()))
    u = p.omega + p.alpha * F.col("eps") * F.col("eps")
    rows = rows.withColumn("variance_pct2", _recursion(F.col("t"), F.col("start"), u, p.beta))
    return rows.select("ticker", "trade_date", "variance_pct2", (u + p.beta * F.col("variance_pct2")).alias("next_variance_pct2"))


def garch_next_step(p: GarchParams, last_return: float, last_variance: float) -> float:
    """The variance after a session with this return and variance, in return units."""
    return (p.omega + p.alpha * (100 * last_return - p.mu) ** 2 + p.beta * last_variance * 1e4) * 1e-4


def ewma_next_step(last_variance: float, last_return: float, decay: float = DECAY) -> float:
    return decay * last_variance + (1 - decay) * last_return**2

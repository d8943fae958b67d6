"""GARCH(1,1) by walk-forward maximum likelihood.

Refits are independent of one another, so the months of a ticker are dealt over SLOTS
groups, each with one copy of its returns; a second pass per ticker picks the effective
parameters and steps the recursion.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cleaning import by_date
from .recursions import GARCH_TAG, MIN_TRAIN, whole

BLOCK = 64
#: Fit: returns in percent -> (mu, omega, alpha, beta, converged), or None if it fails.
Fit = Callable[[np.ndarray], tuple[float, float, float, float, bool] | None]


def filtered(eps: np.ndarray, omega: float, alpha: float, beta: float) -> np.ndarray:
    """Conditional variances of the sessions of ``eps`` and of the one after, by blocks of a lower triangular product."""
    n = len(eps)
    start = omega / (1 - alpha - beta) if alpha + beta < 1 else float(np.var(eps))
    u = np.zeros(-(-n // BLOCK) * BLOCK)
    u[:n] = omega + alpha * eps**2
    powers = beta ** np.arange(BLOCK + 1)
    lag = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    lower = np.where(lag >= 0, powers[np.maximum(lag, 0)], 0.0)
    inner = np.einsum("ij,kj->ik", u.reshape(-1, BLOCK), lower)  # not by a library that starts threads of its own
    out, s = np.empty(len(u) + 1), start
    out[0] = start
    for i, row in enumerate(inner):
        out[1 + i * BLOCK : 1 + (i + 1) * BLOCK] = row + s * powers[1:]
        s = out[(i + 1) * BLOCK]
    return out[: n + 1]


def _unpack(v: np.ndarray) -> tuple[float, float, float, float]:
    share = 1 / (1 + math.exp(-v[2]))  # of alpha + beta, below 0.9999
    part = 1 / (1 + math.exp(-v[3]))  # of it that is alpha
    return float(v[0]), math.exp(v[1]), 0.9999 * share * part, 0.9999 * share * (1 - part)


def fit(r: np.ndarray, rounds: int = 400) -> tuple[float, float, float, float, bool] | None:
    """Quasi-maximum likelihood by a downhill simplex from a variance-targeting start."""
    var = float(np.var(r))
    if not np.isfinite(var) or var <= 0:
        return None

    def loss(v: np.ndarray) -> float:
        if not -30 < v[1] < 30 or abs(v[2]) > 30 or abs(v[3]) > 30:
            return math.inf
        mu, omega, alpha, beta = _unpack(v)
        eps = r - mu
        s = filtered(eps, omega, alpha, beta)[:-1]
        return float(np.sum(np.log(s) + eps**2 / s)) if (s > 0).all() else math.inf

    start = np.array([float(np.mean(r)), math.log(0.05 * var), 3.0, -2.5])
    simplex = [start] + [start + d for d in np.diag([0.1 * math.sqrt(var), 0.5, 0.7, 0.7])]
    rows = sorted(((loss(v), i, v) for i, v in enumerate(simplex)), key=lambda x: x[:2])
    used, done = 5, False
    while used < rounds and not done:
        mid = np.mean([v for _, _, v in rows[:-1]], axis=0)
        worst = rows[-1]

        def tried(step: float, mid=mid, worst=worst) -> tuple[float, int, np.ndarray]:
            nonlocal used
            used += 1
            v = mid + step * (mid - worst[2])
            return loss(v), used, v

        new = tried(1.0)
        if new[0] < rows[0][0]:
            new = min(new, tried(2.0), key=lambda x: x[:2])
        elif new[0] >= rows[-2][0]:
            new = tried(0.5 if new[0] < worst[0] else -0.5)
        if new[0] < worst[0]:
            rows[-1] = new
        else:
            rows = [rows[0]] + [(loss(v), used + i, v) for i, v in enumerate((rows[0][2] + (v - rows[0][2]) / 2 for _, _, v in rows[1:]), 1)]
            used += 4
        rows.sort(key=lambda x: x[:2])
        done = rows[-1][0] - rows[0][0] < 1e-6 * (1 + abs(rows[0][0])) * 1e-2
    if not math.isfinite(rows[0][0]):
        return None
    return (*_unpack(rows[0][2]), done)


#: Groups that a ticker's refit months are dealt over.
SLOTS = 8


def month_starts(dates: pd.Series, least: int) -> list[int]:
    """The first place of each month from place ``least`` on, of dates in order."""
    months = pd.to_datetime(dates).dt.to_period("M").to_numpy()
    return [i for i in range(least, len(months)) if i == least or months[i] != months[i - 1]]


def _rows(returns: DataFrame) -> DataFrame:
    rows = returns.where("log_return is not null").select("ticker", "trade_date", (100 * F.col("log_return")).alias("r"))
    return rows.withColumn("t", F.row_number().over(by_date()) - 1).withColumn("n", F.count("*").over(whole()))


def refits(returns: DataFrame, min_train: int = MIN_TRAIN, fitter: Fit = fit) -> DataFrame:
    """(ticker, t, mu, omega, alpha, beta, converged, raised) of each refit, t the first forecast row of its month."""
    rows = _rows(returns).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        r = pdf["r"].to_numpy()
        out = []
        for t in month_starts(pdf["trade_date"], min_train)[key[1] :: SLOTS]:
            got = fitter(r[:t])
            mu, omega, alpha, beta, ok = got or (None, None, None, None, False)
            out.append((key[0], t, mu, omega, alpha, beta, ok, got is None))
        return pd.DataFrame(out, columns=["ticker", "t", "mu", "omega", "alpha", "beta", "converged", "raised"])

    return rows.groupBy("ticker", "slot").applyInPandas(run, "ticker string, t int, mu double, omega double, alpha double, beta double, converged boolean, raised boolean")


def effective(refits: DataFrame) -> DataFrame:
    """Refits with the parameters in force: a failed one keeps the former ones, and the time of their fit.

    A first fit that only failed to converge is used; one that raised is an error.
    """
    by = Window.partitionBy("ticker").orderBy("t")
    first = F.row_number().over(by) == 1
    usable = F.col("converged") | (first & ~F.col("raised"))
    own = F.when(usable, F.struct(F.col("t").alias("since"), "mu", "omega", "alpha", "beta"))
    rows = refits.withColumn("first", first).withColumn("in_force", F.last(own, ignorenulls=True).over(by))
    bad = F.raise_error(F.concat(F.lit("the first fit raised, and there is none before it: "), "ticker"))
    rows = rows.withColumn("since", F.when(F.col("first") & F.col("raised"), bad.cast("int")).otherwise(F.col("in_force.since")))
    return rows.select(
        "ticker", "t", "since", *[F.col(f"in_force.{k}").alias(k) for k in ("mu", "omega", "alpha", "beta")], (~F.col("converged") & ~F.col("first")).alias("fallback"), (F.col("first") & ~F.col("converged")).alias("unconverged")
    )


def forecasts(returns: DataFrame, in_force: DataFrame) -> DataFrame:
    """(ticker, trade_date, t, model, var_forecast), with one live row per ticker whose trade_date is null.

    The recursion is rebuilt from all history when parameters change, and stepped on when they don't.
    """
    rows = _rows(returns)

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("t"), right.sort_values("t")
        r, out, at, since = left["r"].to_numpy(), {}, None, None
        points = [*right["t"], len(r) + 1]
        for p, hi in zip(right.itertuples(), points[1:], strict=True):
            eps = r - p.mu
            if since != p.since:
                at, since = filtered(eps[: p.t], p.omega, p.alpha, p.beta)[-1], p.since
            for t in range(p.t, min(hi, len(r) + 1)):
                out[t] = at
                if t < len(r):
                    at = p.omega + p.alpha * eps[t] ** 2 + p.beta * at
        ts = sorted(out)
        dates = left["trade_date"].tolist() + [None]
        return pd.DataFrame({"ticker": key[0], "trade_date": [dates[t] for t in ts], "t": ts, "model": GARCH_TAG, "var_forecast": [out[t] * 1e-4 for t in ts]})

    pairs = rows.groupBy("ticker").cogroup(in_force.groupBy("ticker"))
    return pairs.applyInPandas(run, "ticker string, trade_date date, t int, model string, var_forecast double")

"""Walk-forward forecasts of any regressor: a ticker's refit months are dealt over SLOTS groups, each with one copy of its rows.

Session i is forecast from row i-1; the model of its month is trained on rows up
to i0-2, i0 the month's first forecast session.  Rows without all features and a
target don't train; a forecast whose row lacks a feature is skipped.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.finance import VARIANCE_FLOOR

from .cleaning import by_date
from .features import TARGET
from .garch import SLOTS, month_starts
from .recursions import MIN_TRAIN, whole


class Regressor(Protocol):
    def fit(self, x: np.ndarray, y: np.ndarray) -> object: ...

    def predict(self, x: np.ndarray) -> np.ndarray: ...


class LogTarget:
    """A regressor on ln(y), of y > 0 only; predictions exp(m + s^2 / 2), s^2 the training residuals' population variance."""

    def __init__(self, inner: Regressor) -> None:
        self.inner, self.dropped = inner, 0

    def fit(self, x: np.ndarray, y: np.ndarray) -> LogTarget:
        good = y > 0
        self.dropped = int((~good).sum())
        logs = np.log(y[good])
        self.inner.fit(x[good], logs)
        self.half = 0.5 * float(np.var(logs - self.inner.predict(x[good])))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.exp(self.inner.predict(x) + self.half)


class LogOls:
    """Least squares with an intercept on safe logs of the features."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> LogOls:
        self.coef = np.linalg.lstsq(self._design(x), y, rcond=None)[0]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._design(x) @ self.coef

    @staticmethod
    def _design(x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), np.log(np.maximum(x, 1e-12))])


class BoostedTrees:
    """Gradient-boosted histogram trees, leaf-wise, with row bagging and feature sampling; in place of an absent library."""

    def __init__(self, trees: int = 300, rate: float = 0.05, leaves: int = 31, least: int = 20, rows: float = 0.8, features: float = 0.8, bins: int = 64, seed: int = 42) -> None:
        self.trees, self.rate, self.leaves, self.least, self.rows, self.share, self.bins, self.seed = trees, rate, leaves, least, rows, features, bins, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rng = np.random.default_rng(self.seed)
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        self.base, self.forest = float(np.mean(y)), []
        at = np.full(len(y), self.base)
        for _ in range(self.trees):
            bag = np.sort(rng.choice(len(y), max(1, int(self.rows * len(y))), replace=False))
            cols = np.sort(rng.choice(x.shape[1], max(1, int(round(self.share * x.shape[1]))), replace=False))
            tree = self._grow(b[bag], (y - at)[bag], cols)
            self.forest.append(tree)
            at = at + self.rate * self._walk(tree, b)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        return self.base + self.rate * sum((self._walk(t, b) for t in self.forest), np.zeros(len(x)))

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)])

    def _best(self, b: np.ndarray, g: np.ndarray, cols: np.ndarray) -> tuple[float, int, int]:
        """(gain, feature, bin) of the best split; all features in one histogram."""
        flat = (b[:, cols] + np.arange(len(cols)) * self.bins).ravel()
        size = len(cols) * self.bins
        n = np.bincount(flat, minlength=size).reshape(-1, self.bins).cumsum(1)
        s = np.bincount(flat, np.repeat(g, len(cols)), size).reshape(-1, self.bins).cumsum(1)
        total, sums = len(g), float(g.sum())
        ok = (n >= self.least) & (total - n >= self.least)
        gain = np.where(ok, s**2 / np.maximum(n, 1) + (sums - s) ** 2 / np.maximum(total - n, 1) - sums**2 / total, -np.inf)
        k = int(gain.argmax())
        return float(gain.flat[k]), int(cols[k // self.bins]), k % self.bins

    def _grow(self, b: np.ndarray, g: np.ndarray, cols: np.ndarray) -> list[list[float]]:
        """Nodes (feature, bin, left, right, value); a leaf has feature -1."""
        nodes = [[-1, 0, 0, 0, float(g.mean())]]
        open_ = [(*self._best(b, g, cols), 0, np.arange(len(g)))]
        for _ in range(self.leaves - 1):
            k = max(range(len(open_)), key=lambda i: open_[i][0])
            gain, f, cut, node, rows = open_.pop(k)
            if gain <= 1e-12:
                break
            less = b[rows, f] <= cut
            for part in (rows[less], rows[~less]):
                nodes.append([-1, 0, 0, 0, float(g[part].mean())])
                open_.append((*self._best(b[part], g[part], cols), len(nodes) - 1, part))
            nodes[node][:4] = [f, cut, len(nodes) - 2, len(nodes) - 1]
        return nodes

    @staticmethod
    def _walk(nodes: list[list[float]], b: np.ndarray) -> np.ndarray:
        a = np.array(nodes)
        at = np.zeros(len(b), int)
        live = np.flatnonzero(a[at, 0] >= 0)
        while len(live):
            f, cut, left, right = a[at[live], :4].astype(int).T
            at[live] = np.where(b[live, f] <= cut, left, right)
            live = live[a[at[live], 0] >= 0]
        return a[at, 4]


def walk_forward(features: DataFrame, columns: list[str], factory: Callable[[], Regressor], tag: str, target: str = TARGET, min_train: int = MIN_TRAIN) -> DataFrame:
    """(ticker, trade_date, model, var_forecast, floored, is_live, skipped, refit, dropped); a live row has the last date of its ticker, a skipped one no forecast.

    ``refit`` marks the first row of a fitted model, ``dropped`` counts the training rows that its target left out.
    """
    rows = features.select("ticker", "trade_date", *columns, F.col(target).alias("_y"))
    rows = rows.withColumn("t", F.row_number().over(by_date()) - 1).withColumn("n", F.count("*").over(whole())).where(F.col("n") > min_train)
    dealt = rows.drop("n").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t").reset_index(drop=True)
        x, y, n = pdf[columns].to_numpy(float), pdf["_y"].to_numpy(float), len(pdf)
        whole = ~np.isnan(x).any(1)
        starts = [*month_starts(pdf["trade_date"], min_train), n]
        out = []
        for t0, t1 in list(zip(starts, starts[1:], strict=False))[key[1] :: SLOTS]:
            train = whole[: t0 - 1] & ~np.isnan(y[: t0 - 1])
            model = factory()
            model.fit(x[: t0 - 1][train], y[: t0 - 1][train])
            for i in [*range(t0 - 1, t1 - 1), *([n - 1] if t1 == n else [])]:
                is_live = i == n - 1
                v = float(model.predict(x[i : i + 1])[0]) if whole[i] else None
                out.append((key[0], pdf["trade_date"][i if is_live else i + 1], tag, None if v is None else max(v, VARIANCE_FLOOR), v is not None and v < VARIANCE_FLOOR, is_live, v is None, i == t0 - 1, getattr(model, "dropped", 0)))
        return pd.DataFrame(out, columns=["ticker", "trade_date", "model", "var_forecast", "floored", "is_live", "skipped", "refit", "dropped"])

    return dealt.groupBy("ticker", "slot").applyInPandas(run, "ticker string, trade_date date, model string, var_forecast double, floored boolean, is_live boolean, skipped boolean, refit boolean, dropped int")


def result_records(rows: DataFrame) -> DataFrame:
    """By ticker and model, of :func:`walk_forward`'s rows: forecasts, refits, floored, skipped, most training rows dropped by a fit, and live forecasts."""
    return rows.groupBy("ticker", "model").agg(
        F.count_if(~F.col("is_live") & ~F.col("skipped")).alias("n_forecasts"), F.count_if("refit").alias("n_refits"), F.count_if("floored").alias("n_floored"), F.count_if("skipped").alias("n_skipped"),
        F.max("dropped").cast("long").alias("n_dropped"), F.count_if(F.col("is_live") & ~F.col("skipped")).alias("n_live"),
    )


def boosted_factory(**options: float) -> Callable[[], Regressor]:
    return lambda: LogTarget(BoostedTrees(**options))


def har_factory() -> Regressor:
    return LogTarget(LogOls())

"""HAR regression of log variances, refitted monthly on an expanding window, without leaving Catalyst.

Sums of products over the window frame that ends two rows before a refit are
sufficient; three normal equations are solved by determinants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.finance import VARIANCE_FLOOR, safe_ln

from .cleaning import by_date
from .features import HAR_COLUMNS, TARGET
from .recursions import MIN_TRAIN, whole

HAR_TAG = "har_rv"


def train_frame():
    """Training rows of a forecast end two rows before it: the target of the row before is not known yet."""
    return by_date().rowsBetween(Window.unboundedPreceding, -2)


def _det(m: list[list[Column]]) -> Column:
    a, b, c = m
    return a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])


def _rows(features: DataFrame) -> DataFrame:
    x = [safe_ln(F.col(c)) for c in HAR_COLUMNS]
    rows = features.select("ticker", "trade_date", TARGET, *[v.alias(f"x{k}") for k, v in enumerate(x, 1)])
    rows = rows.withColumn("t", F.row_number().over(by_date()) - 1).withColumn("n", F.count("*").over(whole()))
    usable = F.col("x1").isNotNull() & F.col("x2").isNotNull() & F.col("x3").isNotNull() & (F.col(TARGET) > 0)
    rows = rows.withColumn("y", F.when(usable, F.ln(TARGET)))
    names = ["y", "x1", "x2", "x3"]
    terms = {a: F.when(F.col("y").isNotNull(), F.col(a)) for a in names}
    terms |= {f"{a}_{b}": F.when(F.col("y").isNotNull(), F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]}
    sums = [F.avg(v).over(train_frame()).alias(f"m_{k}") for k, v in terms.items()]
    return rows.select("*", F.count("y").over(train_frame()).alias("n_train"), *sums, *[F.lag(f"x{k}", 1).over(by_date()).alias(f"p{k}") for k in (1, 2, 3)])


def _solved(rows: DataFrame) -> DataFrame:
    """b0..b3 and the residuals' population variance from the means of the training rows."""
    m = lambda a, b: F.col(f"m_{min(a, b, key=['y', 'x1', 'x2', 'x3'].index)}_{max(a, b, key=['y', 'x1', 'x2', 'x3'].index)}")
    cov = lambda a, b: m(a, b) - F.col(f"m_{a}") * F.col(f"m_{b}")
    xs = ["x1", "x2", "x3"]
    rows = rows.select("*", *[cov(a, b).alias(f"c_{a}_{b}") for i, a in enumerate(xs) for b in xs[i:]], *[cov(a, "y").alias(f"g_{a}") for a in xs], cov("y", "y").alias("g_y"))
    c = [[F.col(f"c_{min(a, b)}_{max(a, b)}") for b in xs] for a in xs]
    g = [F.col(f"g_{a}") for a in xs]
    det = _det(c)
    swap = lambda k: [[g[i] if j == k else c[i][j] for j in range(3)] for i in range(3)]
    rows = rows.select("*", *[F.when(det != 0, _det(swap(k)) / det).alias(f"b{k + 1}") for k in range(3)])
    b0 = F.col("m_y") - sum((F.col(f"b{k}") * F.col(f"m_x{k}") for k in (1, 2, 3)), F.lit(0.0))
    s2 = F.col("g_y") - sum((F.col(f"b{k}") * F.col(f"g_x{k}") for k in (1, 2, 3)), F.lit(0.0))
    return rows.select("*", b0.alias("b0"), F.greatest(s2, F.lit(0.0)).alias("s2"))


def coefficients(features: DataFrame, min_train: int = MIN_TRAIN) -> DataFrame:
    """(ticker, month, refit_date, n_train, b0..b3, s2) of each refit, at the first forecast session of a month."""
    rows = _rows(features).where((F.col("t") >= min_train) & (F.col("n") > min_train)).withColumn("month", F.trunc("trade_date", "month"))
    first = F.row_number().over(Window.partitionBy("ticker", "month").orderBy("t"))
    rows = _solved(rows.withColumn("_first", first).where("_first = 1"))
    return rows.select("ticker", "month", F.col("trade_date").alias("refit_date"), "n_train", "b0", "b1", "b2", "b3", "s2")


def _predicted(p: list[Column]) -> Column:
    mean = F.col("b0") + sum((F.col(f"b{k}") * v for k, v in enumerate(p, 1)), F.lit(0.0))
    return F.exp(mean + 0.5 * F.col("s2"))


def forecasts(features: DataFrame, min_train: int = MIN_TRAIN) -> DataFrame:
    """(ticker, trade_date, model, var_forecast, floored); a session whose former row lacks a feature is left out."""
    base = _rows(features).where((F.col("t") >= min_train) & (F.col("n") > min_train)).withColumn("month", F.trunc("trade_date", "month"))
    month = Window.partitionBy("ticker", "month").orderBy("t")
    stats = [c for c in base.columns if c.startswith("m_")]
    rows = base.select("ticker", "trade_date", "month", "t", "p1", "p2", "p3", *[F.first(c).over(month).alias(c) for c in stats])
    rows = _solved(rows)
    raw = _predicted([F.col(f"p{k}") for k in (1, 2, 3)])
    rows = rows.withColumn("raw", raw).where("raw is not null")
    return rows.select("ticker", "trade_date", F.lit(HAR_TAG).alias("model"), F.greatest("raw", F.lit(VARIANCE_FLOOR)).alias("var_forecast"), (F.col("raw") < VARIANCE_FLOOR).alias("floored"))


def live(features: DataFrame, min_train: int = MIN_TRAIN) -> DataFrame:
    """(ticker, last_date, model, var_forecast): the last refit applied to each ticker's last row."""
    last = _rows(features).where((F.col("t") == F.col("n") - 1) & (F.col("n") > min_train)).select("ticker", F.col("trade_date").alias("last_date"), "x1", "x2", "x3")
    coef = coefficients(features, min_train)
    newest = coef.groupBy("ticker").agg(F.max_by(F.struct("b0", "b1", "b2", "b3", "s2"), "month").alias("c")).select("ticker", "c.*")
    rows = last.join(newest, "ticker").withColumn("raw", _predicted([F.col(f"x{k}") for k in (1, 2, 3)])).where("raw is not null")
    return rows.select("ticker", "last_date", F.lit(HAR_TAG).alias("model"), F.greatest("raw", F.lit(VARIANCE_FLOOR)).alias("var_forecast"))

"""Bars, calendar and volatility index from the driver's tables, and frames of file providers."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ["open", "high", "low", "close", "adj_close"]
CANONICAL = T.StructType(
    [T.StructField("ticker", T.StringType()), T.StructField("trade_date", T.DateType()), *[T.StructField(p, T.DoubleType()) for p in PRICES], T.StructField("volume", T.LongType())]
)
COLUMNS = CANONICAL.names


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_from_trades(lineitem: DataFrame) -> DataFrame:
    """Daily bars of the trades of each return flag, one partially aggregated shuffle.

    First and last price go by the trade's key; the adjusted close is the close.
    """
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    price = F.col("l_extendedprice")
    bars = lineitem.groupBy(F.col("l_returnflag").alias("ticker"), F.to_date("l_shipdate").alias("trade_date")).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), F.sum("l_quantity").cast("long").alias("volume")
    )
    return bars.select("ticker", "trade_date", "open", "high", "low", "close", F.col("close").alias("adj_close"), "volume")


def weekday_calendar(spark: SparkSession, start: str = "1995-01-01", end: str = "2002-12-31") -> DataFrame:
    """Sessions on weekdays with their close at 21:00 UTC; a dimension of a few thousand rows."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("session_date"))
    return days.where(F.weekday("session_date") < 5).select("session_date", (F.col("session_date").cast("timestamp") + F.expr("interval 21 hours")).alias("close_utc"))


def volatility_index(orders: DataFrame) -> DataFrame:
    """A stand-in index: the mean order price of each day."""
    return orders.groupBy(F.to_date("o_orderdate").alias("trade_date")).agg(F.avg("o_totalprice").alias("vix_close"))


def keep_last(df: DataFrame, position: str, keys: tuple[str, ...] = ("ticker", "trade_date")) -> DataFrame:
    """The row with the highest ingest position of each key."""
    by = Window.partitionBy(*keys).orderBy(F.col(position).desc())
    return df.withColumn("_rank", F.row_number().over(by)).where("_rank = 1").drop("_rank", position)


def _bars(df: DataFrame, ticker: Column, names: dict[str, str], position: str) -> DataFrame:
    number = lambda c: F.expr(f"try_cast(`{c}` as double)")
    rows = df.select(
        ticker.alias("ticker"),
        F.to_date(names["date"]).alias("trade_date"),
        *[number(names[p]).alias(p) for p in PRICES],
        (F.bround(number(names["volume"])) if names.get("volume") else F.lit(None)).cast("long").alias("volume"),
        F.col(position).alias("_position"),
    )
    return keep_last(rows.na.drop(how="all", subset=PRICES), "_position").select(*COLUMNS)


def _required(df: DataFrame, names: list[str]) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {missing}")


def normalize_wide(df: DataFrame, ticker: str, position: str = "ingest_pos") -> DataFrame:
    """A provider's frame (Date, Open, High, Low, Close, Adj Close, Volume) as canonical bars.

    Rows without any price go, a half volume rounds to even, and the last row of a date stays.
    """
    _required(df, ["Date", "Open", "High", "Low", "Close", "Adj Close", "Volume"])
    names = {"date": "Date", "open": "Open", "high": "High", "low": "Low", "close": "Close", "adj_close": "Adj Close", "volume": "Volume"}
    return _bars(df, F.lit(ticker), names, position)


def normalize_adjusted(df: DataFrame, ticker: str, position: str = "ingest_pos") -> DataFrame:
    """A frame of adjusted prices only (volume optional): the adjusted close is the close."""
    _required(df, ["Date", "Open", "High", "Low", "Close"])
    names = {"date": "Date", "open": "Open", "high": "High", "low": "Low", "close": "Close", "adj_close": "Close"}
    if "Volume" in df.columns:
        names["volume"] = "Volume"
    return _bars(df, F.lit(ticker), names, position)


# Tickers that are inputs of models and have none of their own.
NON_MODELED = ("^VIX",)


def modeled(df: DataFrame, tickers: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the tickers that models are fitted for: the given ones, or all but NON_MODELED."""
    return df.where(F.col("ticker").isin(*tickers)) if tickers else df.where(~F.col("ticker").isin(*NON_MODELED))


def of_ticker(df: DataFrame, ticker: str) -> DataFrame:
    """Rows of one ticker, by a bound parameter."""
    return df.sparkSession.sql("select * from {rows} where ticker = :ticker", args={"ticker": ticker}, rows=df)


# Index symbols of the second provider.
INDEX_SYMBOLS = {"^GSPC": "^spx", "^VIX": "^vix"}


def provider_symbol(ticker: str) -> str:
    """The second provider's symbol of a ticker."""
    if ticker in INDEX_SYMBOLS:
        return INDEX_SYMBOLS[ticker]
    if ticker.startswith("^"):
        raise ValueError(f"no symbol for index {ticker}")
    return f"{ticker.lower()}.us"


def provider_symbols(ticker: Column) -> Column:
    """:func:`provider_symbol` as a column, null for an unknown index."""
    known = F.create_map(*[F.lit(x) for pair in INDEX_SYMBOLS.items() for x in pair])
    return F.coalesce(known[ticker], F.when(~ticker.startswith("^"), F.concat(F.lower(ticker), F.lit(".us"))))


def file_stem(ticker: Column) -> Column:
    """The landing file's name: the ticker without its caret."""
    return F.replace(ticker, F.lit("^"), F.lit(""))


class FileProvider:
    """Bars from Parquet or CSV files under a folder, by Spark's readers."""

    def __init__(self, spark: SparkSession, folder: str, kind: str = "parquet", name: str = "files") -> None:
        self.spark, self.folder, self.kind, self.name = spark, folder, kind, name

    def fetch(self, ticker: str, start: str, end: str) -> DataFrame:
        """Canonical bars from ``start`` to ``end``, both included, by date; ValueError if there are none."""
        path = f"{self.folder}/{ticker.replace('^', '')}.{self.kind}"
        if self.kind == "csv":
            raw = self.spark.read.option("header", True).csv(path).withColumn("ingest_pos", F.monotonically_increasing_id())
            bars = normalize_adjusted(raw, ticker) if "Adj Close" not in raw.columns else normalize_wide(raw, ticker)
        else:
            bars = self.spark.read.schema(CANONICAL).parquet(path).where(F.col("ticker") == ticker)
        bars = bars.where(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        if bars.isEmpty():
            raise ValueError(f"no bars of {ticker} from {start} to {end} in {self.name}")
        return bars.orderBy("trade_date")


class FallbackProvider:
    """Providers in order of preference; ``sources`` records which one served each ticker."""

    def __init__(self, *providers: FileProvider) -> None:
        self.providers, self.sources = providers, {}

    def fetch(self, ticker: str, start: str, end: str) -> DataFrame:
        said = []
        for p in self.providers:
            try:
                bars = p.fetch(ticker, start, end)
            except Exception as e:  # noqa: BLE001  any failure means the next provider
                said.append(f"{p.name}: {e}")
                continue
            self.sources[ticker] = p.name
            return bars
        raise RuntimeError(f"no provider has {ticker}: {'; '.join(said)}")


def first_source(frames: dict[str, DataFrame]) -> DataFrame:
    """The set-based fallback: per ticker all bars of the first source, in order of ``frames``, that has any."""
    rows = None
    for i, (name, df) in enumerate(frames.items()):
        part = df.select(*COLUMNS, F.lit(name).alias("source"), F.lit(i).alias("_rank"))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy("ticker").agg(F.min("_rank").alias("_rank"))
    return rows.join(best, ["ticker", "_rank"]).drop("_rank")


def chain(error: BaseException | None) -> Iterator[BaseException]:
    """An exception and what lies behind it, each once."""
    seen: list[BaseException] = []
    while error is not None and not any(error is e for e in seen):
        yield error
        seen.append(error)
        error = error.__cause__ or error.__context__


def is_certificate_error(error: BaseException | None) -> bool:
    """Whether an exception, or what lies behind it, speaks of certificates."""
    return any(re.search("certificate|ssl", f"{type(e).__name__} {e}", re.IGNORECASE) for e in chain(error))


def with_retries(fetch, waits: tuple[float, ...] = (2.0, 5.0), sleep=None):
    """``fetch()``, tried again after each wait; the last error is raised."""
    import time

    for wait in (*waits, None):
        try:
            return fetch()
        except Exception:
            if wait is None:
                raise
            (sleep or time.sleep)(wait)


def trailing_start(as_of: Column, sessions: int = 5) -> Column:
    """The first calendar day of a re-fetch of the last sessions: 2n + 3 days back."""
    return F.date_sub(as_of, 2 * sessions + 3)

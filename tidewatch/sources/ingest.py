"""From providers to the raw table: HTTP and file providers, guarded backfill, trailing increments, replay of landed files.

Fetching is the driver's work, a request for each ticker; everything after it is one frame.
"""

from __future__ import annotations

import csv
import io
import urllib.parse
import urllib.request
from collections.abc import Callable
from datetime import date, timedelta
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import validation

from . import market
from .storage import Store

#: Sessions that a guarded ticker fetches again.
TRAILING_SESSIONS = 5
RAW_KEYS = ["ticker", "trade_date"]
RESULT = "ticker string, n_old long, n_new long, status string, source string"


class Provider(Protocol):
    name: str

    def fetch(self, ticker: str, start: str, end: str) -> DataFrame: ...


class CsvProvider:
    """Bars as CSV by HTTP (symbol, compact start and end dates, daily interval), adjusted prices only.

    ``opener`` turns an address and a timeout into the body; there is no other network code.
    """

    def __init__(self, spark: SparkSession, address: str, opener: Callable[[str, float], str] | None = None, name: str = "csv", timeout: float = 30.0) -> None:
        self.spark, self.address, self.name, self.timeout = spark, address, name, timeout
        self.opener = opener or self._open

    @staticmethod
    def _open(address: str, timeout: float) -> str:
        with urllib.request.urlopen(address, timeout=timeout) as reply:  # noqa: S310  the address is the caller's
            return reply.read().decode()

    def fetch(self, ticker: str, start: str, end: str) -> DataFrame:
        """Canonical bars from ``start`` to ``end``, both included; ValueError if the body has none."""
        asked = {"s": market.provider_symbol(ticker), "d1": start.replace("-", ""), "d2": end.replace("-", ""), "i": "d"}
        body = self.opener(f"{self.address}?{urllib.parse.urlencode(asked)}", self.timeout)
        rows = list(csv.reader(io.StringIO(body)))
        if len(rows) < 2 or "no data" in body[:64].lower():
            raise ValueError(f"{self.name} has no data of {ticker}")
        schema = ", ".join(f"`{c}` string" for c in rows[0])
        frame = self.spark.createDataFrame([tuple(r) for r in rows[1:] if len(r) == len(rows[0])], schema)
        return market.normalize_adjusted(frame.withColumn("ingest_pos", F.monotonically_increasing_id()), ticker)


class WideProvider:
    """Bars from a client that returns rows of Date, Open, High, Low, Close, Adj Close, Volume for an exclusive end.

    ``client`` is called with (ticker, start, end) and tried again after each of ``waits``; ``renew`` is called before a retry.
    """

    def __init__(self, spark: SparkSession, client: Callable[[str, str, str], list[tuple]], renew: Callable[[], None] = lambda: None, name: str = "wide", waits: tuple[float, ...] = (2.0, 5.0), sleep=None) -> None:
        self.spark, self.client, self.renew, self.name, self.waits, self.sleep = spark, client, renew, name, waits, sleep

    def fetch(self, ticker: str, start: str, end: str) -> DataFrame:
        after, tried = (date.fromisoformat(end) + timedelta(days=1)).isoformat(), []

        def once() -> list[tuple]:
            if tried:
                self.renew()
            tried.append(1)
            return self.client(ticker, start, after)

        rows = market.with_retries(once, self.waits, self.sleep)
        if not rows:
            raise ValueError(f"{self.name} has no data of {ticker}")
        columns = "Date string, Open double, High double, Low double, Close double, `Adj Close` double, Volume double, ingest_pos long"
        return market.normalize_wide(self.spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], columns), ticker)


def default_provider(primary: Provider, *others: Provider) -> market.FallbackProvider:
    """The chain that a nightly run asks: the primary provider, then the others in order."""
    return market.FallbackProvider(primary, *others)


def backfill(store: Store, provider: market.FallbackProvider, tickers: tuple[str, ...], start: str, end: str, force: bool = False) -> DataFrame:
    """Each ticker's whole history landed behind the guard, then validated; a result row for each (RESULT).

    All tickers land as one frame.  An error of a fetch or of the validation stops the run.
    """
    bars = None
    for t in tickers:
        one = provider.fetch(t, start, end).select(*market.COLUMNS)
        bars = one if bars is None else bars.unionByName(one)
    result = store.land(bars, force)
    written = result.where("status = 'written'").select("ticker")
    validation.validate_bars(store.read("landing").join(F.broadcast(written), "ticker", "left_semi").select(*market.COLUMNS), "landing")
    return _with_source(store.spark, result, provider)


def _with_source(spark: SparkSession, result: DataFrame, provider: market.FallbackProvider) -> DataFrame:
    rows = [(r["ticker"], r["n_old"], r["n_new"], r["status"], provider.sources.get(r["ticker"])) for r in result.collect()]  # a row for each ticker
    return spark.createDataFrame(rows, RESULT)


def load_raw(store: Store, bars: DataFrame, sources: DataFrame | str, context: str) -> int:
    """Validated bars into the raw table, stamped with their ``source`` (one, or a frame of ticker and source); the new rows."""
    bars = validation.validate_bars(bars.select(*market.COLUMNS), context)
    if isinstance(sources, str):
        stamped = bars.withColumn("source", F.lit(sources))
    else:
        stamped = bars.join(F.broadcast(sources.select("ticker", "source")), "ticker", "left")  # a row for each ticker
    return store.upsert("raw", stamped, RAW_KEYS)


def trailing_from(as_of: str, sessions: int = TRAILING_SESSIONS) -> str:
    """The first calendar day of a re-fetch that covers the last sessions."""
    return (date.fromisoformat(as_of) - timedelta(days=2 * sessions + 3)).isoformat()


def fetch_and_load(store: Store, provider: market.FallbackProvider, tickers: tuple[str, ...], start: str, as_of: str, force: bool = False) -> DataFrame:
    """A night's intake: :func:`backfill`, and for guarded tickers a trailing window as a dated increment; all goes to raw.

    The results by ticker; the raw table is what changed.
    """
    result = backfill(store, provider, tickers, start, as_of, force)
    rows = {r["ticker"]: r["status"] for r in result.collect()}
    landed = [t for t, status in rows.items() if status == "written"]
    guarded = [t for t, status in rows.items() if status == "guarded"]
    if landed:
        load_raw(store, store.read("landing").where(F.col("ticker").isin(landed)), result, "landing")
    if guarded:
        bars = None
        for t in guarded:
            one = provider.fetch(t, trailing_from(as_of), as_of).select(*market.COLUMNS)
            bars = one if bars is None else bars.unionByName(one)
        store.increment(bars, as_of)
        load_raw(store, bars, _with_source(store.spark, result, provider), "increment")
    return result


def replay(store: Store, folder: str, source: str = "files") -> dict[str, int]:
    """All Parquet files of a folder (not of its subfolders) into raw as one upsert: rows before, read, after, and new.

    Of a key in several files the row of the last file name counts.
    """
    named = store.spark.read.schema(market.CANONICAL).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "false").parquet(folder).withColumn("ingest_pos", F.col("_metadata.file_path"))
    if named.isEmpty():
        raise ValueError(f"no Parquet files in {folder}")
    before, rows = store.count("raw"), market.keep_last(named, "ingest_pos")
    upserted = rows.count()
    load_raw(store, rows, source, "replay")
    after = store.count("raw")
    return {"before": before, "upserted": upserted, "after": after, "new": after - before}

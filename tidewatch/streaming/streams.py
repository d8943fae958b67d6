"""Structured Streaming forms: sessions completed by a watermark, late corrections by upsert, EWMA as keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.finance import DECAY
from tidewatch.sources import ingest, market
from tidewatch.sources.storage import Store, shared_folder


def _folder(spark: SparkSession, what: str) -> str:
    """A folder for a stream's state, under the shared one."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def ticks(spark: SparkSession, path: str, pattern: str = "events.parquet") -> DataFrame:
    """A file stream of ticks (ts, ticker, value)."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)
    return rows.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("ticker"), "value")


def sessions(rows: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """Daily bars; append mode gives one only when the watermark has passed its day, so a partial day never shows."""
    day = F.window("ts", "1 day")
    bars = rows.withWatermark("ts", lateness).groupBy(day.alias("day"), "ticker").agg(F.count("*").alias("n_ticks"), F.max("value").alias("high"), F.min("value").alias("low"))
    return bars.select("ticker", F.to_date("day.start").alias("trade_date"), "n_ticks", "high", "low")


def completed_sessions(spark: SparkSession, path: str) -> DataFrame:
    """All that :func:`sessions` emits over the files of ``path``."""
    out, state = _folder(spark, "sessions"), _folder(spark, "sessions-state")
    done = sessions(ticks(spark, path)).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema("ticker string, trade_date date, n_ticks long, high double, low double").parquet(out)


def upsert_stream(bars: DataFrame, store: Store, name: str, state: str):
    """Bars of a stream merged by key into a table, so that a re-sent day replaces the former one."""

    def put(batch: DataFrame, _: int) -> None:
        store.upsert(name, batch, ["ticker", "trade_date"])

    return bars.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()


def increments_stream(spark: SparkSession, folder: str, store: Store, state: str, source: str = "increment"):
    """Dated increments merged into raw as they appear: each file once, whole, by key; a later load date wins."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in market.CANONICAL) + ", load_date date"
    rows = spark.readStream.schema(schema).parquet(folder)

    def put(batch: DataFrame, _: int) -> None:
        ingest.load_raw(store, market.keep_last(batch, "load_date"), source, "increment")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()


def corrected_sessions(rows: DataFrame, store: Store, name: str, state: str, lateness: str = "13 days"):
    """Daily bars of a tick stream with late corrections: a day's bar is sent again whenever a tick comes within ``lateness``, and replaces the former one.

    13 days are those of a re-fetch of the last five sessions; a later tick is dropped by the watermark.
    """
    day = F.window("ts", "1 day")
    bars = rows.withWatermark("ts", lateness).groupBy(day.alias("day"), "ticker").agg(F.count("*").alias("n_ticks"), F.max("value").alias("high"), F.min("value").alias("low"))
    bars = bars.select("ticker", F.to_date("day.start").alias("trade_date"), "n_ticks", "high", "low")

    def put(batch: DataFrame, _: int) -> None:
        store.upsert(name, batch, ["ticker", "trade_date"])

    return bars.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()


def ewma_stream(returns: DataFrame, decay: float = DECAY) -> DataFrame:
    """(ticker, trade_date, var_forecast): the EWMA recursion over a stream of (ticker, trade_date, log_return), one number of state a ticker.

    The first return seeds it; rows of a batch are taken by date.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        v = state.get[0] if state.exists else None
        for pdf in batches:
            pdf = pdf.sort_values("trade_date")
            out = []
            for r in pdf["log_return"]:
                out.append(v)
                v = r * r if v is None else decay * v + (1 - decay) * r * r
            yield pd.DataFrame({"ticker": key[0], "trade_date": pdf["trade_date"], "var_forecast": out})
        if v is not None:
            state.update((v,))

    return returns.groupBy("ticker").applyInPandasWithState(step, "ticker string, trade_date date, var_forecast double", "v double", "append", "NoTimeout")

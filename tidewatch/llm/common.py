"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows per Arrow batch for texts, where the session leaves Spark's default, which is ten times as many and made for numbers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint folder, or, on one machine only, one of ours where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewatch-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    It cuts the lineage, is computed once, and survives a lost executor.
    """
    path = f"{shared_dir(df.sparkSession)}/tidewatch-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes the folders of frames from :func:`stored` that nothing reads any more.

    The driver's garbage is collected too, for that is when Spark deletes the shuffle files of finished plans.
    """
    for df in frames:
        if path := _FOLDERS.pop(df, None):
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
            context._jvm.System.gc()


def whole_text(column: str = "text") -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def hash_share(column: Column, share: float, seed: str) -> Column:
    """True for about ``share`` of the values, by hash: the same rows at every run and every size."""
    slots = 1 << 30
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(slots)) < F.lit(int(min(1.0, share) * slots))

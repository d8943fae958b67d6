"""Keyed tables on Parquet: upsert, guarded landing, increments, schema versions."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def merge(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with the rows of ``incoming`` put in or, by key, in place; nothing is deleted."""
    both = existing.withColumn("_tag", F.lit(0)).unionByName(incoming.withColumn("_tag", F.lit(1)), allowMissingColumns=True)
    by = Window.partitionBy(*keys).orderBy(F.col("_tag").desc())
    return both.withColumn("_rank", F.row_number().over(by)).where("_rank = 1").drop("_rank", "_tag")


def guard(existing: DataFrame, incoming: DataFrame, force: bool = False) -> DataFrame:
    """ticker, old and new row counts, and ``status``: a batch with fewer rows than what has landed is guarded."""
    count = lambda df, name: df.groupBy("ticker").agg(F.count("*").alias(name))
    both = count(incoming, "n_new").join(count(existing, "n_old"), "ticker", "left").na.fill(0, ["n_old"])
    status = F.lit("written") if force else F.when(F.col("n_new") < F.col("n_old"), "guarded").otherwise("written")
    return both.select("ticker", "n_old", "n_new", status.alias("status"))


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the folder that all executors share and read back, for what several branches of a plan need.

    The lineage is cut, the file sizes tell the planner what is small, and a lost executor costs nothing.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidewatch-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for all executors; on one machine, and there only, one of ours where it names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="tidewatch-"))
        found = _OWN[0]
    return found


MANIFEST = "name string, version long, parts map<string,string>"


class Store:
    """Tables under a folder, as Parquet parts by month, ticker or whole, named by a manifest.

    A write goes to a new version folder and touches only the parts that its rows fall
    into; then one appended manifest file names the parts of the table, or of several that
    change together, so that a reader sees all of a write or nothing.  Within a part rows are sorted, for skipping by
    statistics, and dealt over ``FILES`` tasks by ticker.
    """

    FILES = 8

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _manifest(self, name: str) -> tuple[int, dict[str, str]]:
        """The newest version and the folder of each part."""
        from pyspark.errors import AnalysisException

        try:
            rows = self.spark.read.schema(MANIFEST).json(f"{self.folder}/_manifest")
            found = rows.where(F.col("name") == name).orderBy(F.desc("version")).first()
        except AnalysisException:
            found = None
        return (found["version"], dict(found["parts"] or {})) if found else (0, {})

    def exists(self, name: str) -> bool:
        return self._manifest(name)[0] > 0

    def _opened(self, name: str, folders: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.folder}/{name}/{f}" for f in folders])

    def read(self, name: str) -> DataFrame:
        return self._opened(name, sorted(self._manifest(name)[1].values()))

    def count(self, name: str) -> int:
        return self.read(name).count() if self.exists(name) else 0

    def _written(self, name: str, rows: DataFrame, part: Column, written: set[str], stays: dict[str, str], version: int) -> tuple[str, int, dict[str, str]]:
        """Writes ``rows``, whose values of ``part`` are ``written``, as a version, which with what ``stays`` is the table; its manifest row."""
        order = [c for c in ("model", "ticker", "trade_date") if c in rows.columns]
        dealt = [F.pmod(F.xxhash64("ticker"), F.lit(self.FILES))] if "ticker" in rows.columns else []
        path, parts = f"v{version}", dict(stays)
        if written:
            out = rows.withColumn("_part", part).repartition("_part", *dealt).sortWithinPartitions("_part", *order)
            out.write.mode("overwrite").partitionBy("_part").parquet(f"{self.folder}/{name}/{path}")
            parts |= {k: f"{path}/_part={k}" for k in written}
        elif not parts:
            rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/{path}/empty")
            parts = {"empty": f"{path}/empty"}
        if len(parts) > 1:
            parts.pop("empty", None)
        return name, version, parts

    def _publish(self, *rows: tuple[str, int, dict[str, str]]) -> None:
        self.spark.createDataFrame(list(rows), MANIFEST).coalesce(1).write.mode("append").json(f"{self.folder}/_manifest")

    @staticmethod
    def _by_month(df: DataFrame) -> Column:
        return F.coalesce(F.date_format("trade_date", "yyyy-MM"), F.lit("none")) if "trade_date" in df.columns else F.lit("all")

    def replace(self, name: str, df: DataFrame) -> int:
        """Whole new content; the row count."""
        return self.replace_all({name: df})[name]

    def replace_all(self, tables: dict[str, DataFrame]) -> dict[str, int]:
        """Whole new content of several tables, seen by readers at once; their row counts."""
        done, rows = {}, []
        for name, df in tables.items():
            df = stage(df, "replace")
            month = self._by_month(df)
            rows.append(self._written(name, df, month, {r[0] for r in df.select(month).distinct().collect()}, {}, self._manifest(name)[0] + 1))
            done[name] = df.count()
        self._publish(*rows)
        return done

    def upsert(self, name: str, df: DataFrame, keys: list[str]) -> int:
        """:func:`merge` into the months that ``df`` falls into, loaded_at renewed; the number of new keys."""
        df = stage(df.withColumn("loaded_at", F.current_timestamp()), "upsert")
        version, parts = self._manifest(name)
        month = self._by_month(df)
        touched = {r[0] for r in df.select(month).distinct().collect()}  # months of a batch
        old = [f for k, f in parts.items() if k in touched]
        rows = df.dropDuplicates(keys)
        if old:
            rows = stage(merge(self._opened(name, old), rows, keys), "merged")
        before = self._opened(name, old).count() if old else 0
        self._publish(self._written(name, rows, month, touched, {k: f for k, f in parts.items() if k not in touched}, version + 1))
        return rows.count() - before

    def land(self, bars: DataFrame, force: bool = False) -> DataFrame:
        """Whole-ticker landing of ``bars`` behind the guard; the results by ticker. Validation comes after landing."""
        bars = stage(bars, "landing")
        version, parts = self._manifest("landing")
        old = self.read("landing") if version else bars.limit(0)
        done = guard(old, bars, force).collect()  # a row for each ticker of the batch
        taken = [r["ticker"] for r in done if r["status"] == "written"]
        result = self.spark.createDataFrame(done, "ticker string, n_old long, n_new long, status string")
        if taken:
            rows = bars.join(F.broadcast(result.where("status = 'written'").select("ticker")), "ticker", "left_semi").select(*bars.columns)
            gone = {"t" + t.encode().hex().upper() for t in taken}
            self._publish(self._written("landing", rows, F.concat(F.lit("t"), F.hex("ticker")), gone, {k: f for k, f in parts.items() if k not in gone}, version + 1))
        return result

    def increment(self, bars: DataFrame, load_date: str) -> None:
        """A dated increment, its day's former content replaced."""
        bars.withColumn("load_date", F.lit(load_date).cast("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load_date").parquet(f"{self.folder}/increments")


def migrate(spark: SparkSession, database: str, migrations: dict[str, str]) -> list[str]:
    """Run the named statements that have not run yet, in order of name; their names."""
    spark.sql(f"create database if not exists {database}")
    spark.sql(f"create table if not exists {database}.schema_migrations (version string, applied_at timestamp) using parquet")
    ran = {r["version"] for r in spark.table(f"{database}.schema_migrations").select("version").collect()}
    new = [v for v in sorted(migrations) if v not in ran]
    for v in new:
        spark.sql(migrations[v].format(database=database))
        spark.sql(f"insert into {database}.schema_migrations values ('{v}', timestamp_seconds({int(time.time())}))")
    return new


def replace_section(text: str, start: str, end: str, body: str) -> str:
    """``text`` with what lies between two markers replaced."""
    if start not in text or end not in text:
        raise ValueError("the markers aren't there")
    head, rest = text.split(start, 1)
    return f"{head}{start}\n{body}\n{end}{rest.split(end, 1)[1]}"

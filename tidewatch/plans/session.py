"""Settings of a run, and the session that goes with them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

# What the plans count on; a session may add to it.
CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "zstd",
}


@dataclass(frozen=True)
class Settings:
    """The store's folder, the folder that executors share, and more of Spark's settings."""

    store: str
    shared: str
    conf: dict[str, str] = field(default_factory=dict)


def session(settings: Settings, name: str = "tidewatch") -> SparkSession:
    """The running session, or a new one, with CONF, the shared folder and the settings' own values."""
    builder = SparkSession.builder.appName(name)
    for k, v in {**CONF, "spark.checkpoint.dir": settings.shared, **settings.conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()

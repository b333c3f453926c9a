"""Sessions with the settings that the engine's results rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Results depend on the first; the others let Spark choose join sides and partition sizes as it runs.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(app: str = "larkspur", master: str | None = None, **extra: str) -> SparkSession:
    """A session with SETTINGS; ``extra`` has further ones with dots written as ``__``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in extra.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

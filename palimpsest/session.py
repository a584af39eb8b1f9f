"""A session set up for this library."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "palimpsest", **conf: str) -> SparkSession:
    """Adaptive plans, skew-join splitting, Arrow exchange, UTC. ``conf`` wins
    (dots in names as double underscores)."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.executorEnv.OMP_NUM_THREADS": "1",
    }
    base |= {k.replace("__", "."): str(v) for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=base).getOrCreate()

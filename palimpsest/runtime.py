"""Cutting lineage where several steps read the same intermediate rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of an execution go when it ends, not when the driver's garbage collector finds them.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the
    session. Only where that is unset, on one machine, an own one is made."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="palimpsest-"))
    return _own[0]


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for what is planned inside, put back afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet into the shared folder, and read back: like
    checkpoint(), but columnar. The files go by ``release``, or when the
    session's file system closes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest-{uuid.uuid4().hex}"
    with setting(spark, CLEAN, "true"):
        df.write.parquet(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._palimpsest_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``materialize`` gave and that nothing
    unread depends on any more; other DataFrames are left alone."""
    for t in tables:
        path = t.__dict__.pop("_palimpsest_path", None)
        if path:
            p = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

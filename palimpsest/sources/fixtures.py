"""The test tables seen as documents in versions.

A document is a run of 400 ids, so everything that is matched within a document
stays within a bounded group, however many documents there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Dealt out over all cores if its files are too few or too small to be split:
    for rows with much work each. Large tables are left as they are read."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * n) if df.rdd.getNumPartitions() < n else df


def documents(spark: SparkSession, sf_dir: str, versions: int = 2) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).where("text IS NOT NULL")
    return d.select("doc_id", F.expr(f"doc_id div {SPAN}").alias("document"), (1 + F.expr("doc_id div 20") % versions).cast("int").alias("version"), F.when(F.col("text").contains("|"), "table").otherwise("text").alias("kind"), F.expr("doc_id div 40").alias("page_idx"), F.col("source").alias("parent"), F.col("doc_id").alias("ord"), "text", "lang")


def sql_documents(versions: int = 2) -> str:
    return f"d AS (SELECT doc_id, doc_id // {SPAN} AS document, CAST(1 + (doc_id // 20) % {versions} AS INT) AS version, CASE WHEN contains(text, '|') THEN 'table' ELSE 'text' END AS kind, doc_id // 40 AS page_idx, source AS parent, doc_id AS ord, text, lang FROM documents WHERE text IS NOT NULL)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.expr(f"vec_id div {SPAN}").alias("document"), (1 + F.col("label") % 2).cast("int").alias("version"), "label", F.col("embedding").cast("array<double>").alias("v"))


SQL_VECTORS = f"v AS (SELECT vec_id, vec_id // {SPAN} AS document, CAST(1 + label % 2 AS INT) AS version, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"

#: Rows of an order, numbered: (order, line) is not a key of lineitem.
GRID_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    rn = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*GRID_ORDER))
    return table(spark, sf_dir, "lineitem").withColumn("rn", rn).select("l_orderkey", "rn", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), "l_linenumber", "l_partkey", "l_suppkey")


SQL_GRID = f"g AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(GRID_ORDER)}) AS rn, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_linenumber, l_partkey, l_suppkey FROM lineitem)"

"""A training corpus from raw documents: toxic ones go, frequent lines go, one
of each group of near copies stays, sources are mixed to target weights, and
what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import linededup, mixing, packing, simhash, toxicity
from palimpsest.llm._common import materialize
from palimpsest.llm.queries import tokenizer_path

#: SQL cannot express a trained classifier or a tokenizer.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (trained on the labelled ones outside its
    held-out fold) doesn't call toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_documents(docs, model, docs.columns).where("predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least 5 of them hold, which stay in
    the one of the largest id; n_chars follows the text. Null texts stay null."""
    out = linededup.dedup_lines(docs, keep=docs.columns)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    return out.select(*[text.alias("text") if c == "text" else F.coalesce(F.length(text), F.lit(0)).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked SimHash fingerprints (``simhash.near_duplicates``:
    met under block triples, ruled out by pivot distances, verified bit by bit) the
    document of the smallest id. Rows that repeat its id stay with it; rows without
    an id stay."""
    found = simhash.near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("__p_copy")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("__p_copy"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often (0, 1 or 2 times) as the mix takes its words, to
    the nearest whole number, in the order of the schedule's slots."""
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    taken = mixing.mix_sources(docs.withColumn("__p_mark", mark), keep=["__p_mark"])
    times = taken.where("taken > 0").groupBy("doc_id", "__p_mark").agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("__p_times"), F.min("first_slot").alias("__p_first"), F.min("again_slot").alias("__p_again"))
    times = times.where("__p_times > 0").withColumnRenamed("doc_id", "__p_id")
    out = docs.withColumn("__p_key", mark).join(times, F.col("doc_id").eqNullSafe(F.col("__p_id")) & (F.col("__p_key") == F.col("__p_mark")))
    slots = F.when(F.col("__p_times") == 1, F.array("__p_first")).otherwise(F.array("__p_first", F.coalesce("__p_again", "__p_first")))
    out = out.withColumn("__p_slot", F.explode(slots))
    return out.repartitionByRange("__p_slot").sortWithinPartitions("__p_slot", "doc_id").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("simhash near-dedup", drop_copies), ("source mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Artifact features: one row in, one row out, plus statistics per document."""

from __future__ import annotations

import heapq
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import tokens as k

ANCHORS = 8
STOP_SHARE = 0.6


def with_tokens(artifacts: DataFrame, unfold: bool = False) -> DataFrame:
    """Adds text_clean and tokens. ``unfold`` first undoes entities and
    compatibility forms (an Arrow UDF)."""
    text = t.unfold(F.col("text")) if unfold else F.col("text")
    return artifacts.withColumn("text_clean", t.text_clean(text)).withColumn("tokens", t.tokens(F.col("text_clean")))


def stopwords(tokens: DataFrame, by: list[str], share: float = STOP_SHARE) -> DataFrame:
    """by, tok, df: tokens in over ``share`` of the artifacts, numbers and hexadecimal ones excepted."""
    n = tokens.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    df = tokens.select(*by, F.explode(F.array_distinct("tokens")).alias("tok")).groupBy(*by, "tok").agg(F.count(F.lit(1)).alias("df"))
    return df.join(n, by).where((F.col("df") / F.col("n") > share) & ~F.col("tok").rlike(k.STOP_EXEMPT)).select(*by, "tok", "df")


def without_stopwords(artifacts: DataFrame, stops: DataFrame, by: list[str]) -> DataFrame:
    """Artifacts whose tokens lack the stop-words of their group; one short list per group is joined."""
    per = stops.groupBy(*by).agg(F.collect_set("tok").alias("stops"))
    out = artifacts.join(per, by, "left")
    kept = F.filter("tokens", lambda x: ~F.array_contains(F.col("stops"), x))
    return out.withColumn("tokens", F.when(F.col("stops").isNull(), F.col("tokens")).otherwise(kept)).withColumn("text_clean", F.array_join("tokens", " ")).drop("stops")


def inverse_frequency(tokens: DataFrame, by: list[str]) -> DataFrame:
    """by, tok, idf = ln((N + 1) / (df + 1)) + 1."""
    n = tokens.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    df = tokens.select(*by, F.explode(F.array_distinct("tokens")).alias("tok")).groupBy(*by, "tok").agg(F.count(F.lit(1)).alias("df"))
    return df.join(n, by).select(*by, "tok", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def anchors(tokens: DataFrame, by: list[str], key: str, limit: int = ANCHORS) -> DataFrame:
    """by, key, rank, tok: the rarest tokens of each artifact, ties by the token."""
    idf = inverse_frequency(tokens, by)
    each = tokens.select(*by, key, F.explode(F.array_distinct("tokens")).alias("tok")).join(idf, [*by, "tok"])
    order = W.partitionBy(*by, key).orderBy(F.desc("idf"), "tok")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(*by, key, "rank", "tok")


def with_anchors(tokens: DataFrame, by: list[str], key: str, limit: int = ANCHORS) -> DataFrame:
    """Adds anchors, as ``anchors`` finds them, a group in one place: rows are
    moved once and tokens are never rows, so a group must be of bounded size."""

    def rarest(group: pa.Table) -> pa.Table:
        sets = [set(x or []) for x in group["tokens"].to_pylist()]
        df = Counter(x for s in sets for x in s)
        found = [heapq.nsmallest(limit, s, key=lambda x: (df[x], x)) for s in sets]
        for n, f in enumerate(group.schema):
            if pa.types.is_list(f.type):  # whose elements may be null by the schema declared
                group = group.set_column(n, f.name, group.column(n).cast(pa.list_(f.type.value_type)))
        return group.append_column("anchors", pa.array(found, pa.list_(pa.string())))

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in tokens.dtypes)
    return tokens.groupBy(*by).applyInArrow(rarest, f"{kinds}, anchors array<string>")


def with_features(tokens: DataFrame, by: list[str], key: str) -> DataFrame:
    """All that text scoring needs, a row per artifact; anchors that are there already stay,
    and without the raw text headings are left out."""
    base = tokens.withColumn("hashes", F.transform("tokens", token_hash))
    base = base.withColumn("simhash", vote(F.col("hashes"))).drop("hashes")
    base = base.withColumn("shingles", k.shingles(F.col("tokens"), 4)).withColumn("labels", k.labels(F.col("tokens"))).withColumn("numbers", k.numeric_tokens(F.col("text_clean")))
    if "text" in tokens.columns:
        base = base.withColumn("heading", k.is_heading(F.col("tokens"), F.col("text")))
    if "anchors" in tokens.columns:
        return base
    best = anchors(tokens, by, key).groupBy(*by, key).agg(F.collect_list("tok").alias("anchors"))
    return base.join(best, [*by, key], "left").withColumn("anchors", F.coalesce("anchors", F.array().cast("array<string>")))


def token_hash(x: Column) -> Column:
    """The 64 low bits of a token's MD5."""
    hexed = F.md5(x.cast("binary"))
    half = lambda at: F.conv(F.substring(hexed, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(17), 32).bitwiseOR(half(25))


def _sign_of(i: int):
    return lambda s, h: s + F.getbit(h, F.lit(i)).cast("int") * 2 - 1


def vote(hashes: Column) -> Column:
    """SimHash of token hashes: bit i set if at least half of them have it; none: 0."""
    total = F.lit(0).cast("long")
    for i in range(64):
        ones = F.aggregate(hashes, F.lit(0), _sign_of(i))
        total = total.bitwiseOR(F.when(ones >= 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(hashes) > 0, total).otherwise(F.lit(0).cast("long"))


def with_simhash(tokens: DataFrame) -> DataFrame:
    """Adds simhash. The hashes are a step of their own, so that they are made once per row."""
    return tokens.withColumn("hashes", F.transform("tokens", token_hash)).withColumn("simhash", vote(F.col("hashes"))).drop("hashes")

"""Candidate pairs: equi-joins on exploded keys within a document.

Each probe is a (document, kind, key) equi-join of the older version's blocks
(``a``) with the newer one's (``b``); a document bounds every group. Probes are
united and made distinct; nothing compares all pairs but what asks for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tokens as k

BY = ["document", "kind"]


def sides(artifacts: DataFrame, older: int = 1) -> tuple[DataFrame, DataFrame]:
    return artifacts.where(F.col("version") == older), artifacts.where(F.col("version") == older + 1)


def probe(a: DataFrame, b: DataFrame, keys: Column, key: str) -> DataFrame:
    """Pairs (a, b) that share a key; ``keys`` is an array of each block's keys."""
    left = a.select(*BY, F.col(key).alias("a"), F.explode(F.array_distinct(keys)).alias("key"))
    right = b.select(*BY, F.col(key).alias("b"), F.explode(F.array_distinct(keys)).alias("key"))
    return left.join(right, [*BY, "key"]).select(*BY, "a", "b").distinct()


def exact(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return probe(a, b, F.array("text_clean"), key)


def head(n: int = 5) -> Column:
    return F.when(F.size("tokens") > 0, F.array(F.array_join(F.slice("tokens", 1, n), " ")))


def tail(n: int = 5) -> Column:
    return F.when(F.size("tokens") > 0, F.array(F.array_join(F.slice("tokens", F.greatest(F.size("tokens") - (n - 1), F.lit(1)), n), " ")))


def simhash_bucket() -> Column:
    return F.array(F.shiftrightunsigned("simhash", 48).cast("string"))


def capped_tokens(a: DataFrame, b: DataFrame, key: str, cap: int = 24) -> DataFrame:
    """Pairs that share a token, of each token the first ``cap`` blocks of b."""
    order = W.partitionBy(*BY, "key").orderBy("ord", key)
    right = b.select(*BY, key, "ord", F.explode(F.array_distinct("tokens")).alias("key")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).select(*BY, F.col(key).alias("b"), "key")
    left = a.select(*BY, F.col(key).alias("a"), F.explode(F.array_distinct("tokens")).alias("key"))
    return left.join(right, [*BY, "key"]).select(*BY, "a", "b").distinct()


def candidates(a: DataFrame, b: DataFrame, key: str, extra: list[DataFrame] | None = None) -> DataFrame:
    """The union of the probes for text: exact, trigram, head, tail, SimHash bucket, tokens."""
    found = [exact(a, b, key), probe(a, b, k.shingles(F.col("tokens"), 3), key), probe(a, b, head(), key), probe(a, b, tail(), key), probe(a, b, simhash_bucket(), key), capped_tokens(a, b, key), *(extra or [])]
    return reduce(DataFrame.unionByName, found).distinct()


def page_window(a: DataFrame, b: DataFrame, key: str, window: int = 2) -> DataFrame:
    """Pairs of different kinds in one document with the same parent, or pages
    at most ``window`` apart: two equi-joins instead of a range condition."""
    left = a.select("document", F.col("kind").alias("a_kind"), F.col(key).alias("a"), "parent", "page_idx")
    right = b.select("document", F.col("kind").alias("b_kind"), F.col(key).alias("b"), "parent", "page_idx")
    cols = ["document", "a_kind", "b_kind", "a", "b"]
    same = left.join(right, ["document", "parent"]).where("a_kind <> b_kind").select(*cols)
    near = left.withColumn("page_idx", F.explode(F.sequence(F.col("page_idx") - window, F.col("page_idx") + window))).join(right, ["document", "page_idx"]).where("a_kind <> b_kind").select(*cols)
    return same.unionByName(near).distinct()


def shortlist(a: DataFrame, b: DataFrame, key: str, want: int = 72, found: DataFrame | None = None) -> DataFrame:
    """a, b, rank: of each block of a the pairs ``found`` first, then the nearest
    by parent, page and order, ``want`` in all. Within a document and kind every
    pair is ranked, so a document must be of bounded size."""
    left = a.select(*BY, F.col(key).alias("a"), F.col("parent").alias("pa"), F.col("page_idx").alias("ga"), F.col("ord").alias("oa"))
    right = b.select(*BY, F.col(key).alias("b"), F.col("parent").alias("pb"), F.col("page_idx").alias("gb"), F.col("ord").alias("ob"))
    pairs = left.join(right, BY)
    first = F.lit(1)
    if found is not None:
        pairs = pairs.join(found.select(*BY, "a", "b", F.lit(0).alias("hit")), [*BY, "a", "b"], "left")
        first = F.coalesce("hit", F.lit(1))
    order = W.partitionBy(*BY, "a").orderBy(first, (F.col("pa") != F.col("pb")).cast("int"), F.abs(F.col("ga") - F.col("gb")), F.abs(F.col("oa") - F.col("ob")), "b")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= want).select(*BY, "a", "b", "rank")


def cosine_pairs(a: DataFrame, b: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Cosine of all pairs of a group; norms are made once per row."""
    unit = lambda d, n, v: d.select(*by, F.col(key).alias(n), F.col("v").alias(v), F.sqrt(k.dot(F.col("v"), F.col("v"))).alias(f"n{v}"))
    pairs = unit(a, "a", "va").join(unit(b, "b", "vb"), by)
    norm = F.col("nva") * F.col("nvb")
    return pairs.select(*by, "a", "b", F.when(norm > 0, k.dot(F.col("va"), F.col("vb")) / norm).otherwise(0.0).alias("score"))


def top_k(pairs: DataFrame, by: list[str], limit: int) -> DataFrame:
    order = W.partitionBy(*by, "a").orderBy(F.desc("score"), "b")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def hyperplane_pairs(a: DataFrame, b: DataFrame, key: str, by: list[str], dim: int, tables: int = 8, bits: int = 6) -> DataFrame:
    """Approximate neighbours: pairs on one side of ``bits`` random planes in at least one table."""
    import random

    rng = random.Random(7)
    planes = [[[rng.gauss(0, 1) for _ in range(dim)] for _ in range(bits)] for _ in range(tables)]

    def keys(v: Column) -> Column:
        side = lambda p: F.when(k.dot(v, F.array(*[F.lit(x) for x in p])) >= 0, "1").otherwise("0")
        return F.array(*[F.concat(F.lit(f"{n}:"), *[side(p) for p in t]) for n, t in enumerate(planes)])

    left = a.select(*by, F.col(key).alias("a"), F.col("v").alias("va"), F.explode(keys(F.col("v"))).alias("key"))
    right = b.select(*by, F.col(key).alias("b"), F.col("v").alias("vb"), F.explode(keys(F.col("v"))).alias("key"))
    met = left.join(right, [*by, "key"]).dropDuplicates([*by, "a", "b"])
    return met.select(*by, "a", "b", k.cosine(F.col("va"), F.col("vb")).alias("score"))

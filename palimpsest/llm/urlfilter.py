"""URL rules by a sort-merge range join, SQL only.

A host's canonical key is its labels in reverse, each closed by a dot, so that
a host and all its subdomains are one interval of keys that start alike. Any
two such intervals are nested or apart. URLs and rule hosts are sorted
together and swept once: at every rule host the sweep holds the stack of the
rules whose interval is open there, and a URL takes the stack of the last rule
host before it, pops what has closed, and lets the longest rule left whose
path starts the URL's path decide.

The sweep runs per (last label of the host, salt): URLs are dealt over the
salts, each rule is copied to all of them, so no label or host, however
frequent, fills one task. Stacks hold distinct rules of nested hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import ascii_lower

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if null or without ://."""
    at = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    known = F.coalesce(url.contains("://"), F.lit(False))
    return F.when(known, ascii_lower(F.regexp_extract(url, at, 1))).otherwise(""), F.when(known, F.regexp_extract(url, at, 2)).otherwise("")


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    one = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*one) if one else F.lit(None).cast("array<struct<verdict:string,host:string,path:string>>")))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """One row per rule host: its key, last label, and ``stack``: every rule of
    the host or of one that it is under. Of rules alike in host and path the
    smallest verdict (allow) stands."""
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND host <> ''").groupBy(ascii_lower(F.col("host")).alias("host"), "path").agg(F.min("verdict").alias("verdict"))
    rules = rules.withColumn("rule", F.concat("host", "path")).withColumn("size", F.length("rule"))
    one = F.struct("size", F.length("host").alias("host_size"), "host", "path", "rule", "verdict", reversed_host(F.col("host")).alias("key"))
    per_host = rules.groupBy("host").agg(F.collect_list(one).alias("own"))
    labels = F.split("host", r"\.")
    above = per_host.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("up"))
    stack = above.join(per_host.select(F.col("host").alias("up"), "own"), "up").groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("stack"))
    return stack.select(reversed_host(F.col("host")).alias("key"), F.substring_index("host", ".", -1).alias("top"), "stack")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url", salts: int = 64) -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    A rule fits its host and all subdomains if the URL's path starts with the
    rule's; the one of most characters (host and path together, then host)
    wins, and without one ``rule`` is null and the verdict ``default``. Null
    URLs and ids, repeated rows and rules, and empty tables of either are fine.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", reversed_host(F.col("host"))).withColumn("top", F.substring_index("host", ".", -1))
    urls = urls.withColumn("salt", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(salts)).cast("int"))
    starts = rule_stacks(rules).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    kind = starts.schema["stack"].dataType
    both = starts.select(F.lit(None).cast(urls.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "key", "top", "salt", F.lit(0).alias("is_url"), "stack")
    both = both.unionByName(urls.withColumn("is_url", F.lit(1)).withColumn("stack", F.lit(None).cast(kind)))
    sweep = W.partitionBy("top", "salt").orderBy("key", "is_url").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = both.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("is_url = 1")
    fits = F.filter("open", lambda r: F.col("key").startswith(r["key"]) & F.col("path").startswith(r["path"]))
    best = F.element_at(F.when(F.size(fits) > 0, fits), -1)
    return swept.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))

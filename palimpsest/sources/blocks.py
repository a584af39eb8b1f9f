"""Version files: a JSON array of blocks per version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..schema import BLOCK, KINDS


def normal_kinds(kinds: str | list[str] | None) -> list[str]:
    """None, "all" and "*" mean every kind; others are lower-cased and kept if known."""
    asked = [kinds] if isinstance(kinds, str) else list(kinds or [])
    asked = [k.strip().lower() for k in asked]
    return list(KINDS) if not asked or {"all", "*"} & set(asked) else [k for k in KINDS if k in asked]


def artifacts(blocks: DataFrame, kinds: str | list[str] | None = None) -> DataFrame:
    """Blocks (with document, version and place ``at`` in the version) of the
    wanted kinds as artifacts. Missing kinds count as text, missing pages as -1."""
    from pyspark.sql import Window as W

    kind = F.lower(F.coalesce("type", F.lit("text")))
    rows = blocks.withColumn("kind", kind).where(F.col("kind").isin(normal_kinds(kinds)))
    pos = F.row_number().over(W.partitionBy("document", "version", "kind").orderBy("at")) - 1
    rows = rows.withColumn("pos", pos)
    return rows.select("document", "version", F.concat_ws("-", "kind", F.col("pos").cast("string")).alias("id"), "kind", "pos", F.coalesce("text", F.lit("")).alias("text"), t.image_path(F.col("img_path")).alias("img_path"), F.when(F.col("kind") == "table", F.col("table_body")).alias("table_body"), F.coalesce("page_idx", F.lit(-1)).alias("page_idx"), F.coalesce("parent", F.lit("")).alias("parent"), F.coalesce("source_file", F.lit("")).alias("source_file"), F.coalesce("order", F.col("at")).alias("ord"))


def read_version(spark: SparkSession, path: str, document: str, version: int, key: str = "text") -> DataFrame:
    """The blocks of one version file, in order; ``key`` is read as the text."""
    schema = BLOCK if key in BLOCK.names else T.StructType([*BLOCK.fields, T.StructField(key, T.StringType())])
    raw = spark.read.schema(schema).json(path, multiLine=True)
    text = F.col("text") if key == "text" else F.coalesce(F.col(key), F.col("text"))
    whole = raw.withColumn("text", text).withColumn("at", F.coalesce("order", F.monotonically_increasing_id().cast("int")))
    return whole.select(F.lit(document).alias("document"), F.lit(version).alias("version"), *[f.name for f in BLOCK], "at")


def _plain_path(path: Column) -> Column:
    """A file's address with one slash after the scheme."""
    return F.regexp_replace(path, "^([a-zA-Z0-9+.-]+):/+", "$1:/")


def read_versions(spark: SparkSession, documents: dict[str, list[str]], key: str = "text", kinds: str | list[str] | None = None) -> DataFrame:
    """Artifacts of documents, each given by the paths of its versions, old to
    new; a document needs two at least and every path must exist. All files are
    one scan, whatever their number; a list of (path, document, version) is
    joined to it."""
    listed = []
    for name, paths in documents.items():
        if len(paths) < 2 or not all(paths):
            raise ValueError(f"{name} needs two versions or more, none of them missing")
        for i, path in enumerate(paths, 1):
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            whole = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p)
            listed.append((whole.toUri().toString(), name, i, path))
    manifest = spark.createDataFrame([x[:3] for x in listed], "file string, document string, version int").withColumn("file", _plain_path(F.col("file")))
    schema = BLOCK if key in BLOCK.names else T.StructType([*BLOCK.fields, T.StructField(key, T.StringType())])
    raw = spark.read.schema(schema).json(sorted({x[3] for x in listed}), multiLine=True)
    text = F.col("text") if key == "text" else F.coalesce(F.col(key), F.col("text"))
    raw = raw.select("*", _plain_path(F.col("_metadata.file_path")).alias("file"), F.monotonically_increasing_id().alias("place")).withColumn("text", text)
    at = F.row_number().over(W.partitionBy("document", "version").orderBy("place")) - 1
    rows = raw.join(manifest, "file").withColumn("at", F.coalesce("order", at))
    return artifacts(rows.select("document", "version", *[f.name for f in BLOCK], "at"), kinds)


def read_mapped(spark: SparkSession, path: str, key: str = "text") -> DataFrame:
    """A wide frame written before (a row per item, a text column for each
    version): blanks for nulls, ``row_idx`` in the file's order."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("place")) - 1
    rows = raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns if c != "row_idx"], F.monotonically_increasing_id().alias("place"))
    return rows.withColumn("row_idx", place.cast("int")).drop("place")


def renamed(table: DataFrame, source: int = 0, revised: int = 1) -> DataFrame:
    """A spreadsheet whose columns at two places are called source and revised."""
    if len({source, revised}) < 2 or not 0 <= min(source, revised) <= max(source, revised) < len(table.columns):
        raise ValueError(f"no two columns {source} and {revised} in {table.columns}")
    names = {source: "source", revised: "revised"}
    taken = {table.columns[i] for i in range(len(table.columns)) if i not in names} & {"source", "revised"}
    return table.drop(*taken).select(*[F.col(f"`{c}`").alias(names.get(i, c)) for i, c in enumerate(table.columns) if c not in taken or i in names])


def lines(blocks: DataFrame, media: str = "split", patterns: list[str] | None = None) -> DataFrame:
    """document, version, page_idx, line of every block's lines, by page and
    place, without page furniture. ``media`` says what becomes of images and
    tables: "split" like text, "whole" as one line, or "drop"."""
    other = F.lower(F.coalesce("type", F.lit("text"))).isin("image", "table")
    if media == "drop":
        blocks = blocks.where(~other)
    body = F.trim(F.coalesce("text", F.lit("")))
    kept = blocks.withColumn("body", body).where((F.col("body") != "") & ~t.is_header_line(F.col("body"), patterns))
    parts: Column = F.split("body", r"\r?\n")
    if media == "whole":
        parts = F.when(other, F.array("body")).otherwise(parts)
    out = kept.select("document", "version", "page_idx", "at", F.posexplode(parts).alias("n", "line")).withColumn("line", F.trim("line"))
    return out.where((F.col("line") != "") & ~t.is_header_line(F.col("line"), patterns)).select("document", "version", "page_idx", "at", "n", "line")


def column_texts(table: DataFrame, column: str, name: str = "text") -> DataFrame:
    """One column of a spreadsheet (read as CSV) without its nulls."""
    return table.select(F.col(column).alias(name)).na.drop()

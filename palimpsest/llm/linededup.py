"""Line deduplication over a whole corpus.

Lines are exploded, normalised and hashed (128 bits); documents are counted
per hash; lines of frequent hashes are dropped everywhere but in the largest
document id that holds them; the rest is put together again by position.

Shape at scale: only (hash, id, positions) rows of long enough lines are
shuffled for the counts. Copies of one line spread over the corpus meet after
a map-side distinct, one row per document. Rows of a
hash that very many documents hold are dealt over many tasks (salted_join). The text itself moves at most once, beside the positions to drop.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import WS_BYTES, materialize, salted_join, sliced, text_or_empty


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids, marks, his, los, at = [], [], [], [], []
            for i, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if len(text) < min_chars:
                    continue
                seen: dict[bytes, list[int]] = {}
                for pos, line in enumerate(text.split(b"\n")):
                    if len(line) >= min_chars:
                        key = line.strip(WS_BYTES).lower()
                        if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                            seen.setdefault(digest(key), []).append(pos)
                for d, places in seen.items():
                    ids.append(i)
                    marks.append(mark)
                    his.append(int.from_bytes(d[:8], "big", signed=True))
                    los.append(int.from_bytes(d[8:], "big", signed=True))
                    at.append(places)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(marks, pa.int64()), pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.array(at, pa.list_(pa.int32()))], ["id", "mark", "hi", "lo", "at"])

    return run


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns are the text as bytes and the positions to drop."""
    for batch in batches:
        n = batch.num_columns
        counts, dropped, kept = [], [], []
        for text, drop in zip(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist(), strict=True):
            lines = text.split(b"\n")
            gone = set(drop or ())
            counts.append(len(lines))
            dropped.append(len(gone))
            kept.append(b"\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text)
        names = [*batch.schema.names[: n - 2], "n_lines", "n_dropped", "kept_text"]
        yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: the id) of every row, with ``n_lines``,
    ``n_dropped`` and ``kept_text``.

    A line's key is the line without white space at its ends, A-Z lower-cased;
    keys under ``min_chars`` code points never count. Null or empty text is
    one empty line. Rows that repeat an id count as one document and are all
    treated alike; a null id counts as one document below all others. Input
    columns named like an output column give way to it. An empty table gives
    an empty table.
    """
    keep = [c for c in (keep or [id_col]) if c not in ("n_lines", "n_dropped", "kept_text")]
    base = docs.select(*[F.col(c).alias(f"__p_k{i}") for i, c in enumerate(keep)], F.col(id_col).alias("__p_id"), text_or_empty(text_col).alias("__p_text"))
    base = base.withColumn("__p_mark", F.xxhash64("__p_text"))
    id_type = base.schema["__p_id"].dataType
    keys = base.select(F.col("__p_id").alias("id"), F.col("__p_mark").alias("mark"), F.col("__p_text").cast("binary").alias("t"))
    lines = materialize(keys.mapInArrow(sliced(_keys(min_chars)), T.StructType([T.StructField("id", id_type), *T._parse_datatype_string("mark long, hi long, lo long, at array<int>").fields])))

    found = materialize(lines.select("hi", "lo", "id").distinct().groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs))
    held = salted_join(lines, found, ["hi", "lo"], "n", lines.count(), ["id", "mark"])
    drops = held.where(~F.col("id").eqNullSafe(F.col("last"))).groupBy(F.col("id").alias("__p_did"), F.col("mark").alias("__p_dmark")).agg(F.flatten(F.collect_set("at")).alias("__p_drop"))

    joined = base.join(drops, F.col("__p_id").eqNullSafe(F.col("__p_did")) & (F.col("__p_mark") == F.col("__p_dmark")), "left")
    joined = joined.select(*[f"__p_k{i}" for i in range(len(keep))], F.col("__p_text").cast("binary").alias("__p_t"), "__p_drop")
    schema = T.StructType([T.StructField(f"__p_k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)] + T._parse_datatype_string("n_lines long, n_dropped long, kept_text string").fields)
    out = joined.mapInArrow(sliced(_rebuild), schema)
    return out.select(*[F.col(f"__p_k{i}").alias(c) for i, c in enumerate(keep)], "n_lines", "n_dropped", "kept_text")

"""Pieces shared by the training-data operators.

Nothing here collects rows of the corpus to the driver. ``materialize`` (of the
library) writes a table into the shared checkpoint folder, so that lost
executors cost a re-read and never a recomputation of the whole lineage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialize, release

__all__ = ["LOWER", "UPPER", "WORD", "WS", "WS_BYTES", "ascii_lower", "crc_of_id", "materialize", "release", "running", "salted_join", "sampled", "sliced", "text_or_empty"]

#: The white space of every contract here: [\x20\x09-\x0D], as bytes and text.
WS = " \t\n\x0b\x0c\r"
WS_BYTES = WS.encode()
#: A word is a run of anything else (Java and RE2 syntax alike).
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_of_id(name: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


#: Rows that a step over whole texts takes from an Arrow batch at a time.
BATCH_ROWS = 256


def sliced(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = BATCH_ROWS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with batches of ``rows`` rows at most, whatever the session's
    batch size is, so that a worker's memory follows the texts of so many."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batch.slice(lo, rows) for batch in batches for lo in range(0, batch.num_rows, rows))

    return cut


def running(rows: DataFrame, group: list[str], key: str, values: dict[str, str], ties: list[str], bits: int = 12) -> DataFrame:
    """Exclusive running sums of ``values`` (new column -> summed column)
    within each ``group``, in the order of ``key`` (a 64-bit hash), then
    ``ties``. A group may hold any share of the rows: it is cut into
    2**bits cells by the first bits of the key, each summed by its own task,
    and cells meet only through one row each.

    ``group`` columns must not be null. ``rows`` is read twice.
    """
    cell = "__p_cell"
    # unsigned order of the key, so that cells follow one another
    rows = rows.withColumn(cell, F.shiftrightunsigned(F.col(key), 64 - bits).cast("int"))
    cells = rows.groupBy(*group, cell).agg(*[F.sum(v).alias(f"__p_s_{n}") for n, v in values.items()])
    before = W.partitionBy(*group).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(*group, cell, *[F.coalesce(F.sum(f"__p_s_{n}").over(before), F.lit(0)).alias(f"__p_o_{n}") for n in values])
    inside = W.partitionBy(*group, cell).orderBy(key, *ties).rowsBetween(W.unboundedPreceding, -1)
    out = rows.join(cells, [*group, cell])
    return out.select(*[c for c in rows.columns if c != cell], *[(F.col(f"__p_o_{n}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).cast("long").alias(n) for n, v in values.items()])


#: A key with more than 1 / HEAVY_SHARE of all rows (and over HEAVY_LEAST) is dealt over SALTS tasks.
HEAVY_SHARE, HEAVY_LEAST, SALTS = 20_000, 500, 64


def salted_join(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int, spread: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (one row per key ``on``, not null; ``weight``
    at least as many as its rows, the weights summing to ``total`` at most).

    Heavy keys are HEAVY_SHARE at most, so their list is broadcast; their rows
    are dealt over SALTS tasks by ``spread``, their table rows copied to each.
    """
    limit = max(HEAVY_LEAST, total // HEAVY_SHARE)
    heavy = table.where(F.col(weight) > limit).select(*on, F.lit(True).alias("__p_heavy"))
    salts = F.when(F.col(weight) > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
    table = table.withColumn("__p_salt", F.explode(salts))
    rows = rows.join(F.broadcast(heavy), on, "left").withColumn("__p_salt", F.when(F.col("__p_heavy"), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(-1)))
    return rows.join(table, [*on, "__p_salt"], how).drop("__p_salt", "__p_heavy")


def sampled(rows: DataFrame, total: int, wanted: int, key: str, salt: str) -> DataFrame:
    """At most ``wanted`` of ``total`` rows, those of the smallest hash of
    ``key``. A first cut by the hash leaves about twice as many, so that no task
    sorts more than a few times ``wanted`` rows, however many parts there are."""
    h = F.xxhash64(F.col(key).cast("string"), F.lit(salt))
    if total > 4 * wanted:
        rows = rows.where(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * 2 * wanted / total))
    return rows.orderBy(F.pmod(h, F.lit(1 << 40)), key).limit(wanted)

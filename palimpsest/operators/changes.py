"""Change labels of adjacent version pairs and the nested change log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tables as tb
from ..functions import text as t
from ..functions import tokens as k
from ..functions.similarity import near_ratio

SAME, SHORT_SAME, SHORT_WORDS = 0.98, 0.96, 6
BATCH_TABLES, BATCH_OTHERS = 3, 6
# Labels from the gravest, and what they are recognised by, in this order.
PRIORITY = ["major", "minor", "modified", "new", "deleted", "nochange", "skipped", "unidentified"]
SEVERITY = [("major", "major"), ("minor", "minor"), ("new", "new"), ("addition", "new"), ("added", "new"), ("deleted", "deleted"), ("remove", "deleted"), ("no change", "nochange"), ("no_change", "nochange"), ("identical", "nochange"), ("skipped", "skipped"), ("unidentified", "unidentified"), ("modified", "modified"), ("add", "new"), ("del", "deleted")]
# What makes a change major, minor or none.
RULES = {
    "major": ["a requirement's meaning, value, limit or obligation changes", "content is added or removed that changes what must be done", "a table gains or loses rows, or a cell gains content"],
    "minor": ["wording or order changes and the meaning stays"],
    "no change": ["only formatting differs", "only white space differs", "only case differs", "only punctuation differs", "only numbering differs"],
}


def exact_changes(blocks: DataFrame, by: list[str]) -> DataFrame:
    """by, change: per block of two versions whether its content stays, is new or
    is deleted. Equal contents pair up in order; a surplus is new or deleted."""
    body = blocks.withColumn("content", F.md5(t.content(F.col("text"))))
    nth = F.row_number().over(W.partitionBy(*by, "version", "content").orderBy("ord"))
    body = body.select(*by, "version", "content", nth.alias("nth"))
    sides = body.groupBy(*by, "content", "nth").agg(F.count_if(F.col("version") == 1).alias("old"), F.count_if(F.col("version") == 2).alias("new"))
    label = F.when(F.col("new") == 0, "Deleted").when(F.col("old") == 0, "New").otherwise("No Change")
    return sides.select(*by, label.alias("change"))


def identical(left: Column, right: Column, kind: Column, left_html: Column | None = None, right_html: Column | None = None, contents: tuple[Column, Column] | None = None) -> Column:
    """Equal in content: tables by their cells, everything else by normalised
    text or the same set of words. ``contents``: both sides' normalised texts,
    where they are at hand."""
    a, b = contents or (t.content(left), t.content(right))
    words = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    # words stand apart by one space; few pairs whose first words all occur on the other side need their sets
    first = F.forall(F.split(F.substring_index(a, " ", 8), " "), lambda w: F.concat(F.lit(" "), b, F.lit(" ")).contains(F.concat(F.lit(" "), w, F.lit(" "))))
    text = (a == b) | (first & k.same_set(words(a), words(b)))
    x = tb.matrix(F.coalesce(left, F.lit("")), left_html if left_html is not None else F.lit(""))
    y = tb.matrix(F.coalesce(right, F.lit("")), right_html if right_html is not None else F.lit(""))
    cells = F.when((F.size(x) == 0) & (F.size(y) == 0), text).otherwise(tb.canonical(x) == tb.canonical(y))
    return F.when(kind == "table", cells).otherwise(text)


def trivial(left: Column, right: Column, contents: tuple[Column, Column] | None = None) -> Column:
    """The label that needs no look at the meaning, or null: emptiness and equal content."""
    a, b = t.is_blank(left), t.is_blank(right)
    x, y = contents or (t.content(left), t.content(right))
    return F.when(a & b, "No Change").when(a, "New").when(b, "Deleted").when(x == y, "No Change")


def classify(pairs: DataFrame, left: str = "left_text", right: str = "right_text", left_html: str | None = None, right_html: str | None = None) -> DataFrame:
    """Adds change_type (null: not trivial) to pairs with kind. Each side is
    normalised once, in one pass over the pairs; only what the cheap rules leave
    reaches the ratio (the others as nulls, which cost nothing)."""
    a, b = F.col("__a"), F.col("__b")
    html = [F.col(c) if c else None for c in (left_html, right_html)]
    rows = pairs.withColumn("__a", t.content(F.col(left))).withColumn("__b", t.content(F.col(right)))
    same = identical(F.col(left), F.col(right), F.col("kind"), *html, contents=(a, b))
    rows = rows.withColumn("__t", F.when(same, "No Change").otherwise(trivial(F.col(left), F.col(right), (a, b))))
    open_ = lambda c: F.when(F.col("__t").isNull(), c)
    rows = rows.withColumn("__r", near_ratio(open_(a), open_(b)))
    short = (F.col("kind") == "text") & (F.least(F.size(F.split("__a", " ")), F.size(F.split("__b", " "))) <= SHORT_WORDS)
    alike = F.when((F.col("__r") >= SAME) | (short & (F.col("__r") >= SHORT_SAME)), "No Change")
    return rows.withColumn("change_type", F.coalesce("__t", alike)).drop("__a", "__b", "__t", "__r")


def batches(pairs: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``batch``: runs of neighbours, tables apart from the rest, three
    tables or six others at most each."""
    w = W.partitionBy(*by).orderBy(*order)
    is_table = (F.col("kind") == "table").cast("int")
    turned = F.when(F.lag(is_table).over(w) == is_table, 0).otherwise(1)
    out = pairs.withColumn("__t", turned).withColumn("__run", F.sum("__t").over(w))
    within = F.row_number().over(W.partitionBy(*by, "__run").orderBy(*order)) - 1
    size = F.when(F.col("kind") == "table", BATCH_TABLES).otherwise(BATCH_OTHERS)
    out = out.withColumn("__n", F.floor(within / size).cast("int"))
    started = F.when((F.col("__run") == F.lag("__run").over(w)) & (F.col("__n") == F.lag("__n").over(w)), 0).otherwise(1)
    return out.withColumn("__s", started).withColumn("batch", F.sum("__s").over(w) - 1).drop("__t", "__run", "__n", "__s")


Labeller = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def rule_labeller(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The default for pairs that are not trivial, without a model: changed
    numbers or obligations are major, the rest minor."""
    import re

    strong = re.compile(r"\d+(?:[.,]\d+)*|\b(?:shall|must|should|not|require\w*)\b", re.I)
    for f in frames:
        major = [sorted(strong.findall(a or "")) != sorted(strong.findall(b or "")) for a, b in zip(f["left_text"], f["right_text"], strict=True)]
        yield pd.DataFrame({"pair_key": f["pair_key"], "change_type": ["Major Change" if m else "Minor Change" for m in major], "change_description": ["Values or obligations differ" if m else "Wording differs" for m in major]})


def label_rest(pairs: DataFrame, labeller: Labeller = rule_labeller) -> DataFrame:
    """pair_key, change_type, change_description of non-trivial pairs (pair_key,
    kind, left_text, right_text), by any labeller over batches."""
    return pairs.select("pair_key", "kind", "left_text", "right_text").mapInPandas(labeller, "pair_key string, change_type string, change_description string")


def merged(pairs: DataFrame, labelled: DataFrame) -> DataFrame:
    """All pairs with a label: the labeller's, else the trivial one, else Unidentified."""
    told = labelled.select("pair_key", F.col("change_type").alias("__told"), F.col("change_description").alias("change_description"))
    out = pairs.join(told, "pair_key", "left")
    return out.withColumn("change_type", F.coalesce("__told", "change_type", F.lit("Unidentified"))).withColumn("change_description", F.coalesce("change_description", F.when(F.col("change_type") == "Unidentified", "No result").otherwise(F.lit("")))).drop("__told")


def pair_key(row: Column, va: Column, vb: Column) -> Column:
    return F.concat_ws("||", row.cast("string"), F.concat(F.lit("v"), va.cast("string"), F.lit("-v"), vb.cast("string")), F.lit("WHOLE"))


def table_rows_changed(old: DataFrame, new: DataFrame, by: list[str], key: str, columns: list[str]) -> DataFrame:
    """by, key, row_change (added, deleted, changed, same) and changed_cells of
    rows that carry one key each, by a full outer join."""
    a = old.select(*by, key, F.struct(*columns).alias("x"))
    b = new.select(*by, key, F.struct(*columns).alias("y"))
    both = a.join(b, [*by, key], "full")
    cells = F.when(F.col("x").isNull() | F.col("y").isNull(), 0)
    n = F.lit(0)
    for c in columns:
        n = n + (~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))).cast("int")
    cells = cells.otherwise(n)
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "deleted").when(cells > 0, "changed").otherwise("same")
    return both.select(*by, key, change.alias("row_change"), cells.alias("changed_cells"))


def table_label(added: Column, deleted: Column, changed: Column, filled: Column | None = None) -> Column:
    """Added or deleted rows, or a cell filled, are major; changed cells minor."""
    major = (added > 0) | (deleted > 0)
    if filled is not None:
        major = major | (filled > 0)
    return F.when(major, "Major Change").when(changed > 0, "Minor Change").otherwise("No Change")


def pruned(deleted: DataFrame, old_keys: DataFrame, by: list[str], key: str) -> DataFrame:
    """Rows said to be deleted that the old table really had."""
    return deleted.join(old_keys.select(*by, key).distinct(), [*by, key], "left_semi")


def shown_rows(rows: Column, changed: Column) -> Column:
    """All rows of a table's change, or four of them where it has over 20 or over 10 changed."""
    return F.when((F.size(rows) > 20) | (changed > 10), F.slice(rows, 1, 4)).otherwise(rows)


def nested(pairs: DataFrame, by: list[str]) -> DataFrame:
    """One row per requirement (``by`` and row_idx): kind, and Change_log as a
    map from "vA-vB" to its pairs with page info."""
    page = lambda own, other: F.coalesce(F.when(F.col("change_type") == "Deleted", F.col("left_page")).otherwise(own), other)
    entry = F.struct("pair_key", "change_type", "change_description", page(F.col("left_page"), F.col("right_page")).alias("source_page"), page(F.col("right_page"), F.col("left_page")).alias("target_page"))
    name = F.concat(F.lit("v"), F.col("va").cast("string"), F.lit("-v"), F.col("vb").cast("string"))
    return pairs.groupBy(*by, "row_idx").agg(F.first("kind").alias("kind"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(name.alias("k"), F.array(entry).alias("v"))))).alias("Change_log"))


def stats(pairs: DataFrame, versions: int, by: list[str]) -> DataFrame:
    """The counters of a change trace. ``trivial_type`` is the label before the labeller."""
    kind = F.col("trivial_type")
    return pairs.groupBy(*by).agg(F.lit(versions).alias("versions"), F.countDistinct("row_idx").alias("rows"), F.count(F.lit(1)).alias("pairs_possible"), F.count_if(kind == "No Change").alias("pairs_trivial_nochange"), F.count_if(kind.isin("New", "Deleted")).alias("pairs_trivial_other"), F.count_if(kind.isNull()).alias("pairs_sent"), F.count_if((F.col("kind") == "table") & (kind == "No Change")).alias("tables_identical"))


def severity(label: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    out = None
    for part, to in SEVERITY:
        out = F.when(s.contains(part), to) if out is None else out.when(s.contains(part), to)
    return out.otherwise("unidentified")


def priority(label: Column) -> Column:
    out = None
    for i, p in enumerate(PRIORITY):
        out = F.when(label == p, i) if out is None else out.when(label == p, i)
    return out.otherwise(len(PRIORITY) - 1)


def rolled_up(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """The gravest label of each group."""
    own = severity(F.col(label))
    return rows.groupBy(*by).agg(F.min_by(own, priority(own)).alias("change"))


def repositioned(rows: DataFrame, by: list[str], position: str = "row_idx", target: str = "target_order") -> DataFrame:
    """Adds place: rows whose change is New follow the row at their target order,
    all others keep their order (a stable sort)."""
    is_new = (F.col("change_type") == "New").cast("int")
    at = F.when(is_new == 1, F.coalesce(F.col(target), F.lit(1))).otherwise(F.col(position))
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(at, is_new, position)) - 1)


def judged(pairs: DataFrame) -> DataFrame:
    """Metrics over judged pairs (predicted, judged, score; a negative score is a failed call)."""
    ok = F.col("score") >= 0
    share = F.count_if(ok & (F.col("score") <= 0.5)) / F.greatest(F.count_if(ok), F.lit(1))
    agreed = lambda l: F.count_if((F.col("predicted") == l) & (F.col("judged") == l))  # noqa: E731, E741
    return pairs.agg(F.coalesce(F.avg(F.when(ok, F.col("score"))), F.lit(0.0)).alias("average"), share.alias("failure_rate"), F.count_if(F.col("score") == 1).alias("perfect"), F.count_if((F.col("score") > 0.5) & (F.col("score") < 1)).alias("medium"), F.count_if(ok & (F.col("score") <= 0.5)).alias("fail"), F.count_if(F.col("predicted") == "major").alias("major_predicted"), agreed("major").alias("major_agreed"), F.count_if(F.col("predicted") == "minor").alias("minor_predicted"), agreed("minor").alias("minor_agreed"))


def normal_label(label: Column) -> Column:
    s = F.lower(F.trim(F.replace(label, F.lit(" "), F.lit(" "))))
    return F.when(s.isin("no change", "no changes"), "no change").when(s.contains("minor"), "minor").when(s.contains("major"), "major").otherwise(F.coalesce(s, F.lit("")))

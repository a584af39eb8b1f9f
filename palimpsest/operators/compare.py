"""From the blocks of all versions to a labelled change log, in one call."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize
from . import chaining, changes, matching

CONTENT = ["text", "table_body", "page"]


@dataclass
class Comparison:
    """``edges`` between blocks of adjacent versions, ``wide`` (a row per item),
    ``pairs`` (each pair of versions of an item, labelled) and ``log`` (a nested row per item)."""

    edges: DataFrame
    wide: DataFrame
    pairs: DataFrame
    log: DataFrame


def edges_of(artifacts: DataFrame, versions: int) -> DataFrame:
    """Accepted and near edges of all kinds between all adjacent versions. Steps
    are independent; each is matched within its documents."""
    out = []
    for k in range(1, versions):
        for found in (matching.match_text(artifacts, older=k), matching.match_text(artifacts, older=k, kind="image"), matching.match_table(artifacts, older=k)):
            found = materialize(found)
            accepted = found.where("accepted")
            near = matching.near(found, accepted, chaining.BY)
            out.append(chaining.best_edges(accepted.select(*chaining.BY, "a", "b", "score"), near.select(*chaining.BY, "a", "b", "score"), k))
    return materialize(reduce(DataFrame.unionByName, out))


def compare(artifacts: DataFrame, versions: int, labeller: changes.Labeller = changes.rule_labeller) -> Comparison:
    """``artifacts`` (see schema.ARTIFACT) of documents with ``versions`` versions
    each: matched, chained, classified, labelled and nested."""
    edges = edges_of(artifacts, versions)
    blocks = artifacts.select("document", "kind", "version", "id").distinct()
    wide = materialize(chaining.wide(chaining.chains(blocks, edges, versions), artifacts, versions))
    pairs = chaining.adjacent(wide, versions, CONTENT, ["document", "kind", "row_idx", "chain_id"])
    pairs = pairs.where("left_text IS NOT NULL OR right_text IS NOT NULL OR left_table_body IS NOT NULL OR right_table_body IS NOT NULL")
    key = F.concat_ws("||", "document", changes.pair_key(F.col("row_idx"), F.col("va"), F.col("vb")))
    classified = materialize(changes.classify(pairs.withColumn("pair_key", key), left_html="left_table_body", right_html="right_table_body").withColumn("trivial_type", F.col("change_type")))
    told = changes.label_rest(classified.where("change_type IS NULL"), labeller)
    labelled = materialize(changes.merged(classified, told))
    return Comparison(edges, wide, labelled, changes.nested(labelled, ["document"]))


def compare_files(spark: SparkSession, documents: dict[str, list[str]], labeller: changes.Labeller = changes.rule_labeller) -> Comparison:
    """``compare`` of version files, old to new; all documents with the same number of versions."""
    from ..sources.blocks import read_versions

    sizes = {len(paths) for paths in documents.values()}
    if len(sizes) != 1:
        raise ValueError("all documents need the same number of versions")
    return compare(materialize(read_versions(spark, documents)), sizes.pop(), labeller)

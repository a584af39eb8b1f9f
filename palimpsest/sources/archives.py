"""Archives: zipped version workspaces and requirement interchange files.

Both read whole archives as binary rows, so any file system that Spark reads
will do, and each archive is one row's work in one task.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_footer_table

IMAGES = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tiff", ".webp")
MEMBERS = "path string, role string, name string, page_idx int, content binary"
BLOCKS = "path string, at int, type string, text string, img_path string, table_body string, page_idx int, parent string, source_file string, order int"


def _depth(name: str) -> tuple[int, str]:
    return name.count("/"), name.lower()


def choose(names: list[str]) -> tuple[str | None, list[str]]:
    """The block file of a workspace (structured.json, else the shallowest JSON)
    and its images (those in an images folder if there is one), each base name once."""
    files = [n for n in names if not n.endswith("/")]
    told = sorted((n for n in files if n.rsplit("/", 1)[-1].lower() == "structured.json"), key=_depth)
    other = sorted((n for n in files if n.lower().endswith(".json")), key=_depth)
    images = [n for n in files if n.lower().endswith(IMAGES)]
    inside = [n for n in images if "images" in n.lower().split("/")[:-1]]
    once: dict[str, str] = {}
    for n in sorted(inside or images, key=str.lower):
        once.setdefault(n.rsplit("/", 1)[-1], n)
    return (told or other or [None])[0], list(once.values())


def _walk(data: bytes, deep: int = 2) -> Iterator[tuple[str, bytes]]:
    """Members, those of archives inside too."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for n in z.namelist():
            if n.lower().endswith(".zip") and deep:
                yield from _walk(z.read(n), deep - 1)
            elif not n.endswith("/"):
                yield n, z.read(n)


def workspace_members(data: bytes) -> list[tuple[str, str, int | None, bytes]]:
    found = dict(_walk(data))
    blocks, images = choose(list(found))
    out: list[tuple[str, str, int | None, bytes]] = [("image", n.rsplit("/", 1)[-1], i, found[n]) for i, n in enumerate(images)]
    if blocks:
        out.append(("structured" if blocks.lower().endswith("structured.json") else "blocks", blocks, None, found[blocks]))
    return out


def read_workspaces(spark: SparkSession, path: str) -> DataFrame:
    """MEMBERS of zipped workspaces: the chosen block file and the images."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, *m) for p, c in zip(f["path"], f["content"], strict=True) for m in workspace_members(c)], columns=["path", "role", "name", "page_idx", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, MEMBERS)


def workspace_blocks(members: DataFrame, footer: list[str] | None = None) -> DataFrame:
    """BLOCKS of each workspace; one image block per image where there is no
    block file. Footer tables (``footer``: their words) go, from structured files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, role, name, page, content in f[["path", "role", "name", "page_idx", "content"]].itertuples(index=False):
                if role == "image":
                    out.append((path, page, "image", "", f"images/{name}", None, page, "", name, page, False))
                    continue
                for i, b in enumerate(json.loads(content)):
                    out.append((path, i, b.get("type") or "text", b.get("text") or "", b.get("img_path"), b.get("table_body"), b.get("page_idx", -1), b.get("parent") or "", b.get("source_file") or "", b.get("order", i), role == "structured"))
            df = pd.DataFrame(out, columns=[c.split()[0] for c in BLOCKS.split(", ")] + ["structured"])
            yield df.astype({"at": "Int32", "page_idx": "Int32", "order": "Int32"})

    told = members.where("role <> 'image'").select("path").distinct().withColumn("told", F.lit(True))
    wanted = members.join(told, "path", "left").where("role <> 'image' OR told IS NULL").drop("told")
    rows = wanted.mapInPandas(run, BLOCKS + ", structured boolean")
    if footer:
        rows = rows.where(~(F.col("structured") & F.coalesce(is_footer_table(F.col("table_body"), footer), F.lit(False))))
    return rows.drop("structured")


_SECTION = re.compile(r"^\d+(\.\d+)*$")


def flat_text(el: ElementTree.Element) -> str:
    """All text inside, anchors as [text](target)."""
    out = el.text or ""
    for child in el:
        inner = flat_text(child)
        if child.tag.rsplit("}", 1)[-1] == "a" and child.get("href"):
            inner = f"[{inner.strip()}]({child.get('href')})"
        out += inner + (child.tail or "")
    return out


def requirement_texts(data: bytes, general: bool = True, skip_language: str | None = None) -> list[str]:
    """Texts of the XHTML attribute values in a zipped ReqIF file, one each,
    paragraphs joined by newlines. ``general``: only of definitions with ids of
    five hyphened parts, and no bare section numbers; ``skip_language``: a suffix
    of definition ids to leave out."""
    out = []
    for name, content in _walk(data):
        if not name.lower().endswith(".reqif"):
            continue
        for value in ElementTree.fromstring(content).iter():
            if value.tag.rsplit("}", 1)[-1] != "ATTRIBUTE-VALUE-XHTML":
                continue
            ref = next(((e.text or "") for e in value.iter() if e.tag.endswith("ATTRIBUTE-DEFINITION-XHTML-REF")), "")
            if general and len(ref.lstrip("_").split("-")) != 5 or skip_language and ref.endswith(skip_language):
                continue
            paragraphs = [e for e in value.iter() if e.tag.rsplit("}", 1)[-1] == "p"] or [e for e in value.iter() if e.tag.rsplit("}", 1)[-1] == "THE-VALUE"]
            text = "\n".join(x for x in (flat_text(p).strip() for p in paragraphs) if x)
            if text and not (general and _SECTION.match(text)):
                out.append(text)
    return out


def read_requirements(spark: SparkSession, path: str, general: bool = True, skip_language: str | None = None, distinct: bool = True) -> DataFrame:
    """path, n, text of requirement archives."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, i, x) for p, c in zip(f["path"], f["content"], strict=True) for i, x in enumerate(requirement_texts(c, general, skip_language))], columns=["path", "n", "text"])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, n int, text string")
    return rows.groupBy("path", "text").agg(F.min("n").alias("n")).select("path", "n", "text") if distinct else rows

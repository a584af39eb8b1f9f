"""The labeller protocol, line cascade, images and readers, on values."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import images, tables, tokens
from palimpsest.operators import labelling
from palimpsest.sources import blocks

RULES = {"major": ["m1", "m2", "m3"], "minor": ["n1", "n2"], "no change": ["z"]}


def column(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_salvage():
    item = {"pair_key": "a", "change_type": "New"}
    assert labelling.salvaged(json.dumps([item])) == [item]
    assert labelling.salvaged("```json\n" + json.dumps([item]) + "\n```") == [item]
    assert labelling.salvaged("Sure: " + json.dumps([item]) + " done") == [item]
    assert labelling.salvaged('{"pair_key": "a", "n": {"b": 1}} and {"pair_key": "c"}') == [{"pair_key": "a", "n": {"b": 1}}, {"pair_key": "c"}]
    assert labelling.salvaged("no") is None and labelling.salvaged(None) is None and labelling.salvaged('{"pair_key"') is None
    assert labelling.first_object('x {"score": 1} y') == {"score": 1} and labelling.first_object("[1]") is None and labelling.first_object(None) is None


def test_protocol(spark):
    rows = [(0, "k1", "text", 1, "a", "b", 0), (0, "k2", "table", 2, None, "<table>", 1), (1, "k3", "odd", 3, "c", "d", 0), (2, "k4", "text", 4, "e", "f", 0)]
    pairs = spark.createDataFrame(rows, "batch int, pair_key string, kind string, row_id int, left string, right string, place int")
    pairs = pairs.withColumn("kind", labelling.known_kind(F.col("kind"))).withColumn("left_blob", labelling.blob(F.col("kind"), F.col("left"), F.col("left"))).withColumn("right_blob", labelling.blob(F.col("kind"), F.col("right"), F.col("right")))
    asked = labelling.prompts(pairs, RULES, ["batch"])
    by = {r.batch: r for r in asked.collect()}
    assert by[0].pair_keys == ["k1", "k2"] and by[0].prompt.index('"k1"') < by[0].prompt.index('"k2"') and "TABLE_RAW:\n<table>\n" in by[0].prompt and "- m3" in by[0].prompt and 'KIND: "text"' in by[1].prompt

    def model(prompts):
        answer = {'"k1"': json.dumps([{"pair_key": "k1", "change_type": "Major Change", "description": "d", "confidence": 0.5, "row_changes": [1]}]), '"k3"': "nothing", '"k4"': json.dumps([{"pair_key": "k4", "change_type": "Odd"}])}
        return [(next(v for k, v in answer.items() if k in p), len(p), 2) for p in prompts]

    replied = labelling.called(asked, model)
    got = {r.pair_key: tuple(r)[1:] for r in labelling.labelled(replied).collect()}
    assert got["k1"] == ("Major Change", "d", 0.5, "[1]") and got["k2"][:2] == ("Unidentified", "No result") and got["k3"][:2] == ("Unidentified", labelling.FAILED) and got["k4"][0] == "Unidentified"
    total = sum(len(r.prompt) for r in by.values())
    assert tuple(labelling.token_sums(replied).first()) == (total, 6, total + 6)


def test_judge(spark):
    pairs = spark.createDataFrame([("a", "x", "y", "Major Change"), ("b", "x", None, "Deleted"), ("c", "x", "z", "Minor Change")], "pair_key string, left_text string, right_text string, change_type string")
    got = {r.pair_key: r for r in labelling.judged_pairs(pairs, RULES, lambda ps: [('{"change_type": "Major", "score": 0.9, "reason": "r"}' if "Revised:\ny" in p else "none", 1, 1) for p in ps]).collect()}
    assert (got["a"].judged_type, got["a"].score) == ("Major", 0.9) and (got["b"].judged_type, got["b"].score) == ("Deleted", 1.0) and got["c"].score == -1.0
    prompt = labelling.judge_prompts(pairs, RULES).first().prompt
    assert "- m2" in prompt and "- m3" not in prompt and "- n2" not in prompt


def test_line_cascade(spark):
    values = ["a\n b \n\nc", "Speed: 20 Force 35%", "one  two   three", "one - two;three", "x|y", "alone", "", None, "```markdown x```"]
    assert column(spark, tokens.lineified, values) == [["a", "b", "c"], ["Speed: 20", "Force: 35%"], ["one", "two", "three"], ["one", "two", "three"], ["x", "y"], ["alone"], [], [], ["x"]]
    df = spark.createDataFrame([(["A b.", "c"], ["a B", "d"]), ([], None)], "a array<string>, b array<string>")
    assert [r.x for r in df.select(tokens.line_set_jaccard(F.col("a"), F.col("b"), lambda x: F.regexp_replace(F.lower(x), "[.]", "")).alias("x")).collect()] == [1 / 3, 0.0]


def test_table_marks(spark):
    values = ["| a | b |\n|---|---|\n| 1 | 2 |", "a | b", "x <TABLE class=1>", "text\n--- : |", "plain", None, "\n |a|\n\n |-- --- |"]
    assert column(spark, tables.is_markdown_table, values) == [True, False, False, False, False, False, True]
    assert column(spark, tables.table_like, values) == [True, True, True, True, False, False, True]


def png(pixels, kinds=(0, 1, 2, 3, 4)):
    high, wide, _ = pixels.shape
    flat = pixels.reshape(high, wide * 3).astype(int)
    raw = bytearray()
    for y in range(high):
        up = flat[y - 1] if y else np.zeros(wide * 3, int)
        left, corner = (np.concatenate([np.zeros(3, int), v[:-3]]) for v in (flat[y], up))
        p = left + up - corner
        d = np.abs(np.stack([p - left, p - up, p - corner]))
        paeth = np.choose(d.argmin(axis=0), [left, up, corner])
        kind = kinds[y % len(kinds)]
        raw += bytes([kind]) + ((flat[y] - [0 * left, left, up, (left + up) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(raw))) + chunk(b"IEND", b"")


def test_images(spark):
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (40, 50, 3), np.uint8)
    assert np.array_equal(images.pixels(png(image)), image) and np.array_equal(images.pixels(b"P6\n# c\n50 40\n255\n" + image.tobytes()), image)
    slope = np.repeat(np.tile(np.arange(0, 250, 5, np.uint8), (40, 1))[..., None], 3, axis=2)
    noisy = np.clip(slope.astype(int) + rng.integers(-3, 4, slope.shape), 0, 255).astype(np.uint8)
    patches = np.repeat(np.kron(rng.integers(40, 200, (8, 10)), np.ones((5, 5), int))[..., None], 3, axis=2)
    grain = patches + rng.integers(-3, 4, patches.shape)
    files = [png(slope), png(noisy), png(image), b"broken", None, png(slope)[:60], png(np.zeros((3, 3, 3), np.uint8)), png(patches.astype(np.uint8)), png(grain.astype(np.uint8))]
    got = [r.f for r in spark.createDataFrame(list(enumerate(files)), "i int, b binary").repartition(1).sortWithinPartitions("i").select("i", images.features("b").alias("f")).orderBy("i").collect()]
    assert got[3] is got[4] is got[5] is None and (got[0].width, got[0].height) == (50, 40)
    want = np.concatenate([np.histogram(image[..., c], 32, (0, 255))[0] for c in range(3)])
    assert np.allclose(got[2].histogram, want / np.linalg.norm(want))
    assert got[0].dhash == "1" * 64 == got[1].dhash and got[2].dhash != got[0].dhash and got[6].colours == ["#000000"] and got[0].edges == 0 and got[2].edges > 0.5
    df = spark.createDataFrame([(got[7].phash, got[8].phash), (got[7].phash, got[2].phash), (None, "1"), ("10", "1")], "a string, b string")
    near = [r.s for r in df.select(images.hash_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert near[0] > 0.8 > near[1] and near[2:] == [0.0, 0.0]


def test_readers(spark, tmp_path):
    (tmp_path / "m.csv").write_text('v1_text,v2_text\n"a, b",\n,"c\nd"\n')
    assert [tuple(r) for r in blocks.read_mapped(spark, str(tmp_path / "m.csv")).orderBy("row_idx").collect()] == [("a, b", "", 0), ("", "c\nd", 1)]
    sheet = spark.createDataFrame([("1", "2", "3")], "old string, x string, new string")
    assert blocks.renamed(sheet, 0, 2).columns == ["source", "x", "revised"]
    with pytest.raises(ValueError):
        blocks.renamed(sheet, 1, 3)
    assert blocks.column_texts(blocks.renamed(sheet), "revised").first().text == "2"
    for name, n in (("a", 2), ("b", 3)):
        for v in (1, 2):
            (tmp_path / f"{name}{v}.json").write_text(json.dumps([{"type": "text", "text": f"{name}{v}{i}"} for i in range(n)]))
    got = blocks.read_versions(spark, {d: [str(tmp_path / f"{d}{v}.json") for v in (1, 2)] for d in "ab"})
    assert {(r.document, r.version, r.id, r.text, r.ord) for r in got.collect()} == {(d, v, f"text-{i}", f"{d}{v}{i}", i) for d, n in (("a", 2), ("b", 3)) for v in (1, 2) for i in range(n)}

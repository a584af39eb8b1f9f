"""Functions and operators that SQL cannot check, against hand-made expectations and brute force."""

import io
import itertools
import json
import math
import random
import zipfile
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import similarity as sm
from palimpsest.functions import tables as tb
from palimpsest.functions import text as t
from palimpsest.functions import tokens as k
from palimpsest.operators import blocking, chaining, changes, features, matching, report, retrieval, scoring
from palimpsest.sources import archives, blocks
from palimpsest.streaming import progress


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("**Speed** shall be 2 5 km / h", "speed shall be 25 km/h"),
        ("a<br/>b <sup>2</sup> $\\alpha$ x", "a b 2 x"),
        ("well-known | cell\t• item", "well known cell item"),
        ("<= 5 ~ 6 (note)", "<= 56 note"),
        ("", ""),
    ],
)
def test_clean(spark, text, want):
    assert one(spark, t.clean, text) == want


def test_numbers_vanish_from_matching_text(spark):
    assert one(spark, t.normal, "section 9.6.1 has 12/34 and 25km") == "section <num> has <num> and 25km"
    assert one(spark, t.text_clean, "section 9.6.1 has 12/34 and 25km") == "section has and 25km"


def test_unfold_and_scalars(spark):
    assert one(spark, t.unfold, "Ａ &amp; b") == "A & b"
    assert [one(spark, t.to_number, x) for x in ("1,234.5*", "n/a", "- ", "+7", "x1", "1 000")] == [1234.5, None, None, 7.0, None, 1000.0]
    assert one(spark, t.diagnostic_id, "see IO DID: 12AF and DID 9999") == "12AF" and one(spark, t.diagnostic_id, "none") is None
    assert one(spark, t.image_path, "a\\b/./c.png") == "images/c.png" and one(spark, t.base_name, "x/Y.PNG") == "y"
    assert [one(spark, t.normal_scalar, x) for x in ("0.0", " ", "-3.7", "x")] == ["1", "", "3", ""]
    assert [one(spark, t.multiplier, h) for h in ("Sales (000)", "in Million", "plain", "k")] == [1000.0, 1e6, 1.0, 1e3]
    assert one(spark, t.core_requirement, "Intro. It shall stop; end") == "It shall stop"


def test_table_parsing(spark):
    md = "| a | b |\n|---|:--|\n| 1 | x |\n|  | y |\ntext"
    assert one(spark, lambda c: tb.pipe_rows(c), md) == [["a", "b"], ["1", "x"], ["", "y"]]
    assert one(spark, lambda c: tb.collapsed(tb.pipe_rows(c)), md) == [["a", "b"], ["1", "x y"]]
    html = "<table><tr><th colspan=2>H<br>x</th></tr><tr><td>1</td><td><b>2</b></td></tr></table>"
    g = one(spark, tb.html_grid, html)
    assert g.rows == [["H x"], ["1", "2"]] and g.headers == ["H x"] and (g.n_rows, g.n_cols) == (2, 2) and g.tags == {"table": 1, "tr": 2, "th": 1, "td": 2}
    assert one(spark, lambda a, b: tb.matrix(a, b), md, html) == [["H x"], ["1", "2"]]
    assert one(spark, lambda c: report.markdown_cells(tb.pipe_rows(c)), "|a|b|\n|1|2|") == "| a | b |\n|---|---|\n| 1 | 2 |"


def test_sets_and_lines(spark):
    assert one(spark, k.entities, "ECU and ABS1, not Abs") == ["ABS1", "ECU"]
    assert one(spark, k.atoms, "ECU ABS\nGPS") == ["abs", "ecu", "ecu abs", "gps"]
    assert one(spark, k.line_bag, "Left & Right (note)") == ["left", "left & right", "left right", "right"]
    assert one(spark, k.numeric_tokens, "0x1f 3/4 1.5 gb/t 1234 add") and "0x1f" in one(spark, k.numeric_tokens, "0x1f")
    assert one(spark, k.word_tokens, "a, b_1!") == ["a", ",", "b_1", "!"]


def test_ratio_and_bounds(spark):
    rng = random.Random(1)
    for _ in range(50):
        a = "".join(rng.choice("abc d") for _ in range(rng.randrange(60)))
        b = a[: rng.randrange(61)] + rng.choice(["", "x", a[:3]])
        r = SequenceMatcher(None, a, b, autojunk=False).ratio()
        got = sm.bounded(a, b, 0.96)
        assert (got >= 0.96) == (r >= 0.96) and (r < 0.96 or abs(got - r) < 1e-12)
    assert one(spark, sm.ratio, "abc", "abd") == pytest.approx(2 / 3) and one(spark, sm.character_signals, "abc", "xxabcxx").contain_char == 1.0 and sm.ratio_and_share("", "") == (0, 0)


def test_assignment_is_optimal():
    rng = np.random.default_rng(2)
    for n, m in ((3, 3), (2, 5), (5, 2), (6, 6), (1, 1)):
        c = rng.random((n, m))
        got = sm.assignment(c)
        small, large = min(n, m), max(n, m)
        best = min(sum(c[i, p[i]] if n <= m else c[p[i], i] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert len(got) == small and sum(c[i, j] for i, j in got) == pytest.approx(best)


def test_warp_and_numbers():
    def brute(a, b):
        a, b = ([(x - np.mean(s)) / np.std(s) for x in s] for s in (a, b))
        d = {(-1, -1): 0.0}
        for i in range(len(a)):
            for j in range(len(b)):
                d[i, j] = (a[i] - b[j]) ** 2 + min(d.get((i - 1, j), 1e12), d.get((i, j - 1), 1e12), d.get((i - 1, j - 1), 1e12))
        return 1 / (1 + d[len(a) - 1, len(b) - 1] / (len(a) + len(b)))

    rng = random.Random(4)
    for _ in range(20):
        a, b = ([rng.random() for _ in range(rng.randrange(3, 9))] for _ in range(2))
        assert sm.warp(a, b) == pytest.approx(brute(a, b))
    assert sm.warp([1, 2], [1, 2, 3]) == 0 and sm.warp([1, None, 2, 3], [2, 4, 6]) == pytest.approx(1)
    assert sm.numbers_alike("10 and 20%", "20% 10") == 1 and sm.numbers_alike("", "x") == 1 and sm.numbers_alike("5", "x") == 0
    assert sm.greedy_mean([[0.9, 0.2], [0.8, 0.1]]) == pytest.approx(0.5)


def blocks_df(spark, rows):
    return spark.createDataFrame(rows, "document long, version int, kind string, id string, ord int, page_idx int, parent string, text string")


def test_match_text_of_a_version_with_itself(spark):
    texts = ["the brake system shall stop the vehicle within limits", "a heading of few", "another clause about the steering wheel and its cover that goes on for long enough"]
    rows = [(1, v, "text", f"text-{i}", i, 1, "p", x) for v in (1, 2) for i, x in enumerate(texts)]
    got = matching.match_text(blocks_df(spark, rows)).collect()
    assert {(r.a, r.b) for r in got if r.accepted} == {(f"text-{i}", f"text-{i}") for i in range(3)} and all(r.score == 1 for r in got)


def test_scores_sum_their_weights(spark):
    texts = [(1, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta eta theta")]
    rows = blocks_df(spark, [(1, v, "text", "x", 1, v, "p", x) for v, x in texts]).withColumn("id", F.concat("id", F.col("version").cast("string")))
    full = features.with_features(features.with_tokens(rows), blocking.BY, "id")
    pairs = spark.createDataFrame([(1, "text", "x1", "x2")], "document long, kind string, a string, b string")
    r = scoring.text_scores(pairs, full, blocking.BY, "id").first()
    assert r.dice == pytest.approx(8 / 12) and r.contain_tok == pytest.approx(4 / 6) and r.page == pytest.approx(0.98) and r.parent == 1 and r.shingle_cover == pytest.approx(1 / 3)
    assert r.score == pytest.approx(sum(w * r[n] for n, w in scoring.TEXT.items()))


def test_text_scores_in_one_place_are_those_by_joins(spark, monkeypatch):
    texts = ["alpha beta gamma delta epsilon 0x1f", "alpha beta gamma delta eta 12.5", "alpha beta gamma delta epsilon 0x1f", "", "beta gamma delta eta theta one two three"]
    rows = blocks_df(spark, [(1, v, "text", f"{v}{i}", i, 9 * i, "pq"[i % 2], x) for v in (1, 2) for i, x in enumerate(texts)])
    full = features.with_features(features.with_tokens(rows), blocking.BY, "id")
    pairs = spark.createDataFrame([(1, "text", f"1{i}", f"2{j}") for i in range(5) for j in range(5)], "document long, kind string, a string, b string")
    monkeypatch.setattr(scoring, "CELL_PAIRS", 4)
    got, want = ({(r.a, r.b): r for r in f(pairs, full, blocking.BY, "id").collect()} for f in (scoring.text_scores, scoring.joined_text_scores))
    assert set(got) == set(want) and len(got) == 25 and "x" not in next(iter(got.values()))
    assert all(got[p][n] == pytest.approx(want[p][n]) for p in got for n in [*scoring.TEXT, "score"])


def test_table_and_image_scores(spark):
    row = dict.fromkeys(scoring.TABLE, 0.5) | {"row_overlap": 0.7, "numeric_share_a": 0.6, "numeric_share_b": 0.6, "numeric_score": 0.9}
    df = spark.createDataFrame([row, row | {"row_overlap": 0.1, "rowbag_jacc": 0.1, "col_sem_top2": 0.2, "numeric_share_a": 0.1}])
    got = sorted(r.score for r in scoring.table_score(df).collect())
    full = sum(w * 0.5 for w in scoring.TABLE.values())
    weak = full - 0.28 * 0.25 - 0.10 * 0.4 - 0.07 * (0.5 - 0.12)
    assert got == pytest.approx(sorted([full + 0.08, weak * 0.7]))
    assert {r.path for r in scoring.table_robust(scoring.table_score(df)).collect()} == {"numeric", "base"}
    image = {"image_sim": 0.8, "text_sim": 0.4, "legend_sim": 0.5, "data_sim": 0.7, "axis_sim": 0.2, "geometry_sim": 0.1, "same_file": True, "same_parent": False, "subtype": "pie"}
    got = scoring.image_score(spark.createDataFrame([image, image | {"subtype": "photo"}])).collect()
    assert [r.score for r in got] == pytest.approx([0.4 + 0.3 + 0.01, 0.7 * 0.6 + 0.3 * (0.8 * 0.8 + 0.2 * 0.4) + 0.01]) and [r.threshold for r in got] == [0.6, 0.55]


@pytest.mark.parametrize("seed", range(4))
def test_chains_are_walks(spark, seed):
    rng = random.Random(seed)
    ids = {v: [f"{v}{c}" for c in "abcde"] for v in (1, 2, 3)}
    edges = {v: {s: rng.choice([*ids[v + 1], "foreign"]) for s in [*ids[v], "odd"] if rng.random() < 0.6} for v in (1, 2)}
    rows = blocks_df(spark, [(1, v, "text", i, 1, 1, "", "") for v in ids for i in ids[v]])
    e = spark.createDataFrame([(1, "text", v, s, r, 1.0, False) for v in edges for s, r in edges[v].items()] or [(1, "text", 9, "", "", 1.0, False)], "document long, kind string, k int, sid string, rid string, score double, is_near boolean")
    want, live = set(), set(ids[1])
    starts = {1: set(ids[1])}
    for v in (1, 2):
        reached = {edges[v][s] for s in live if s in edges[v]}
        starts[v + 1] = set(ids[v + 1]) - reached
        live = set(ids[v + 1]) | reached
    for v, roots in starts.items():
        for r in roots:
            path = [None] * (v - 1) + [r]
            for u in range(v, 3):
                path.append(edges[u].get(path[-1]) if path[-1] else None)
            want.add(tuple(path))
    got = {(r.v1, r.v2, r.v3) for r in chaining.chains(rows, e, 3).collect()}
    assert got == want


def test_classify(spark):
    pairs = [("", "", "text", "No Change"), ("", "x", "text", "New"), ("x", " ", "text", "Deleted"), ("**A b**", "a  B", "text", "No Change"), ("b a", "a b", "text", "No Change"), ("| a | b |", "|A|B|", "table", "No Change"), ("limit is 5", "limit is 6 or more", "text", None), ("x" * 99 + "y", "x" * 99 + "z", "text", "No Change")]
    df = spark.createDataFrame([(*p, str(i)) for i, p in enumerate(pairs)], "left_text string, right_text string, kind string, want string, pair_key string")
    got = changes.classify(df)
    assert all(r.change_type == r.want for r in got.collect())
    full = changes.merged(got, changes.label_rest(got.where("change_type IS NULL"))).collect()
    assert {r.change_type for r in full} == {"No Change", "New", "Deleted", "Major Change"}


def test_versions_and_labels(spark):
    assert chaining.versions_of(["v1_text", "v2_text", "x", "v10_text"]) == [1, 2, 10]
    with pytest.raises(ValueError):
        chaining.versions_of(["v1_text"])
    assert [one(spark, changes.severity, x) for x in ("Major Change", "added row", "No Change", "removed", None, "??")] == ["major", "new", "nochange", "deleted", "unidentified", "unidentified"]
    assert one(spark, report.row_label, "3||v1-v2||Row_label") == "Row label"


def test_version_files(spark, tmp_path):
    old = [{"type": "text", "text": "first\nPage: 1 of 2\nsecond", "page_idx": 1}, {"type": "table", "text": "| a |", "table_body": "<table></table>"}, {"type": "other", "text": "x"}, {"text": "no kind"}]
    for i in (1, 2):
        (tmp_path / f"v{i}.json").write_text(json.dumps(old[: 5 - i]))
    got = blocks.read_versions(spark, {"doc": [str(tmp_path / "v1.json"), str(tmp_path / "v2.json")]}).collect()
    assert {(r.version, r.id) for r in got} == {(1, "text-0"), (1, "text-1"), (1, "table-0"), (2, "text-0"), (2, "table-0")}
    raw = blocks.read_version(spark, str(tmp_path / "v1.json"), "doc", 1)
    assert [r.line for r in blocks.lines(raw, "drop").orderBy("at", "n").collect()][:2] == ["first", "second"]
    assert blocks.normal_kinds("Table") == ["table"] and len(blocks.normal_kinds("*")) == 3
    with pytest.raises(ValueError):
        blocks.read_versions(spark, {"doc": ["x"]})


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, c in members.items():
            z.writestr(n.replace("__", "/").replace("_dot_", "."), c)
    return out.getvalue()


def test_workspaces(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(zipped(deep__other_dot_json="[]", structured_dot_json=json.dumps([{"type": "table", "table_body": "<table>home about terms</table>"}, {"text": "kept"}]), images__b_dot_png=b"1", c_dot_png=b"2"))
    (tmp_path / "b.zip").write_bytes(zipped(x__p1_dot_jpg=b"1", x__p2_dot_JPG=b"2"))
    members = archives.read_workspaces(spark, str(tmp_path / "*.zip"))
    got = archives.workspace_blocks(members, ["home", "about", "terms"]).collect()
    assert sorted((r.path[-5:], r.type, r.text, r.img_path) for r in got) == [("a.zip", "text", "kept", None), ("b.zip", "image", "", "images/p1.jpg"), ("b.zip", "image", "", "images/p2.JPG")]


def test_requirements(spark, tmp_path):
    value = "<ATTRIBUTE-VALUE-XHTML><THE-VALUE><div><p>See <a href='u'>link</a> now</p><p>second</p></div></THE-VALUE><DEFINITION><ATTRIBUTE-DEFINITION-XHTML-REF>{}</ATTRIBUTE-DEFINITION-XHTML-REF></DEFINITION></ATTRIBUTE-VALUE-XHTML>"
    section = value.replace("See <a href='u'>link</a> now", "1.2").replace("<p>second</p>", "")
    good, other = "_a-b-c-d-e", "_a-b_de-DE"
    xml = "<R>" + value.format(good) * 2 + value.format(other) + section.format(good) + "</R>"
    (tmp_path / "r.reqifz").write_bytes(zipped(x_dot_reqif=xml))
    text = "See [link](u) now\nsecond"
    assert [r.text for r in archives.read_requirements(spark, str(tmp_path / "*.reqifz")).collect()] == [text]
    assert len(archives.requirement_texts((tmp_path / "r.reqifz").read_bytes(), general=False)) == 4
    assert len(archives.requirement_texts((tmp_path / "r.reqifz").read_bytes(), general=False, skip_language="_de-DE")) == 3


def test_hybrid_finds_the_same_text(spark):
    corpus = spark.createDataFrame([(i, f"clause {i} about {w} systems and how they shall work") for i, w in enumerate("brake door light horn mirror seat belt lamp".split())], "doc_id long, text string")
    q = spark.createDataFrame([(1, "clause 0 about brake systems and how they shall work")], "item_id long, text string")
    found = retrieval.hybrid(q, corpus)
    assert found.orderBy("rank").first().doc_id == 0
    assert [r.doc_id for r in retrieval.accepted(found, q, corpus).collect()] == [0]


def test_hybrid_counts_frequent_terms(spark):
    """Against BM25 and cosine over all terms, for a query of frequent words alone too."""
    texts = ["the brake shall work", "the brake of the brake", "the horn shall sound the horn", "shall the mirror", "the the the seat belt shall hold"]
    queries = ["the brake", "the shall", "horn the mirror shall"]
    tf = [Counter(x.split()) for x in texts]
    n, mean = len(texts), sum(sum(c.values()) for c in tf) / len(texts)
    df = Counter(w for c in tf for w in c)
    idf = {w: math.log((n + 1) / (k + 1)) + 1 for w, k in df.items()}
    norm = lambda c: math.sqrt(sum((k * idf[w]) ** 2 for w, k in c.items()))
    want = {}
    for i, q in enumerate(map(Counter, map(str.split, queries))):
        both = {}
        for j, c in enumerate(tf):
            met = q.keys() & c.keys()
            if met:
                bm = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in met)
                both[j] = bm, sum(c[w] * q[w] * idf[w] ** 2 for w in met) / norm(c) / norm(q)
        most = [max(v[k] for v in both.values()) for k in (0, 1)]
        score = {j: 0.15 * cos / most[1] + 0.85 * bm / most[0] for j, (bm, cos) in both.items()}
        for rank, j in enumerate(sorted(score, key=lambda j: (-score[j], j))[:3], 1):
            want[i, rank] = j, pytest.approx(score[j])
    frame = lambda rows, key: spark.createDataFrame(list(enumerate(rows)), f"{key} long, text string")
    got = retrieval.hybrid(frame(queries, "item_id"), frame(texts, "doc_id")).collect()
    assert {(r.item_id, r.rank): (r.doc_id, r.score) for r in got} == want


def test_progress_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), []
    events = spark.sql("SELECT 'a' AS task_id, 'text' AS kind, cast(id * 10 AS int) AS completed_ratio, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 3) AS ts FROM range(8)")
    events.write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    q = progress.publish(progress.latest(stream, late="1 seconds"), lambda df, n: out.extend(df.collect()), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    want = {(r.start, r.completed_ratio) for r in progress.latest(events).collect()}
    assert {(r.start, r.completed_ratio) for r in out} <= want and len(out) >= 2
    m = progress.monotone(events, ["task_id"]).orderBy("ts").collect()
    assert [r.checkpoint for r in m] == [False, *[True] * 7]


def test_assignment_of_parts_gives_the_same_total():
    rng = np.random.default_rng(11)
    rows = [(f"a{k}.{i}", f"b{k}.{j}", float(rng.integers(0, 100)) / 100) for k in range(12) for i in range(4) for j in range(3)]
    rows += [(f"a{k}.0", f"b{k + 1}.0", 0.0) for k in range(11)]
    f = pd.DataFrame(rows, columns=["a", "b", "score"])
    whole, parts = matching._assigned(f, 1_000), matching._assigned(f, 4)
    assert parts["a"].is_unique and parts["b"].is_unique
    assert abs(parts["score"].sum() - whole["score"].sum()) < 1e-9
    none = matching._assigned(f.assign(score=0.0), 4)
    assert len(none) == 0 and list(none.columns) == ["a", "b", "score"]
    greedy = matching._assigned(f, 2)
    assert greedy["a"].is_unique and greedy["b"].is_unique


def test_run_bound_settles_texts_of_the_same_letters(monkeypatch):
    """Never under the ratio, and low enough that long texts of the same letters are not matched character by character."""
    import random
    from difflib import SequenceMatcher

    from palimpsest.functions import similarity as sm

    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(300)]
    for n in (0, 1, 5, 40, 150):
        a = " ".join(rng.choices(words, k=n))
        for change in (0, 1, 3, 20):
            b = list(a)
            for _ in range(change):
                at = rng.randrange(len(b) + 1)
                b[at : at + rng.randint(0, 2)] = rng.choices("abc ", k=rng.randint(0, 2))
            b = "".join(b)
            exact = SequenceMatcher(None, a, b, autojunk=False).ratio()
            assert sm.run_bound(a, b) >= exact - 1e-12
            found = sm.bounded(a, b, 0.96)
            assert found == exact if exact >= 0.96 else found < 0.96
    some = rng.choices(words, k=2_000)
    a, b = " ".join(some), " ".join(reversed(some))
    monkeypatch.setattr(SequenceMatcher, "ratio", lambda self: pytest.fail("matched in full"))
    assert sm.bounded(a, b, 0.96) < 0.96


def test_content_of_unmarked_texts(spark):
    """The short way gives what all steps give."""
    texts = ["", "  ", "Plain  text, 1 2 3 km h\n4\t5", "a+b = c % d - e", "Ünï 1   2", "`code` *x* _y_ ~~z~~", "# head\ntext", "<b>1</b> | 2", "5 km / h", "> = 3", "1 2 3 4 5 6"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "i int, x string")
    full = F.lower(F.trim(t.spark_steps(F.coalesce("x", F.lit("")), t.CONTENT)))
    assert all(r.a == r.b for r in rows.select(t.content(F.col("x")).alias("a"), full.alias("b")).collect())
    blank = F.col("x").isNull() | (F.trim(F.regexp_replace("x", r"\s+", " ")) == "")
    assert all(r.a == r.b for r in rows.select(t.is_blank(F.col("x")).alias("a"), blank.alias("b")).collect())


def test_classify_normalises_each_side_once(spark):
    """One pass over the pairs, each text normalised in one expression."""
    rows = [("text", "One two three", "one  two, three"), ("text", None, "new"), ("text", "***", ""), ("text", "b a", "a b"), ("text", "a shall be 5", "a shall be 6 at most"), ("table", "| a | b |", "| a | c |"), ("text", "gone", " "), ("text", "the same five words but one here x" * 9, "the same five words but one here x" * 9 + "y")]
    found = changes.classify(spark.createDataFrame(rows, "kind string, left_text string, right_text string"))
    got = [r.change_type for r in found.collect()]
    assert got == ["No Change", "New", "No Change", "No Change", None, None, "Deleted", "No Change"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("km") <= 2


def test_character_shares_are_the_matchers_without_it(monkeypatch):
    """Long texts don't go through the library's matcher, whose steps are those of both lengths."""
    rng = random.Random(3)
    make = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    texts = ["", "a", *(make(x, n) for x in ("ab", "abcdefghij", "eeeeetttttaaaaa    bcdfghjkqxz", "".join(map(chr, range(97, 400)))) for n in (9, 199, 200, 900))]
    texts += [x[: len(x) // 2] + make("abcxyz", 5) + x[len(x) // 3 :] for x in texts[2:]]
    a, b = zip(*[(i, j) for i in range(len(texts)) for j in range(len(texts))], strict=True)
    want = [sm.ratio_and_share(texts[i], texts[j]) for i, j in zip(a, b, strict=True)]
    monkeypatch.setattr(sm, "SequenceMatcher", None)
    assert list(zip(*sm.character_shares(texts, a, b), strict=True)) == want
    monkeypatch.setattr(sm, "SequenceMatcher", SequenceMatcher)
    monkeypatch.setattr(sm, "MOST_RUNS", 50)  # the way out for texts of very many runs
    assert list(zip(*sm.character_shares(texts, a, b), strict=True)) == want


def test_shared_text_scores_are_those_of_pairs_by_joins(spark, monkeypatch):
    texts = ["alpha beta gamma delta epsilon 0x1f gb123", "alpha beta gamma delta eta 12.5a", "alpha beta gamma delta epsilon 0x1f gb123", "", "beta gamma delta eta theta one two three alpha beta gamma delta", "one two three"]
    rows = blocks_df(spark, [(d, v, kind, f"{v}{i}{kind}", i, 9 * i, ["p", "q", None][i % 3], x) for d in (1, 2) for kind in ("text", "table")[:d] for v in (1, 2, 3) for i, x in enumerate(texts)])
    rows = features.with_tokens(rows)
    full = features.with_features(features.with_anchors(rows.drop("text"), ["document"], "id"), ["document"], "id")
    pairs = blocking.probe(*blocking.sides(full), F.col("shingles"), "id")
    want = {(r.document, r.a, r.b): r for r in scoring.joined_text_scores(pairs, full, blocking.BY, "id").collect()}
    by_joins = lambda whole: monkeypatch.setattr(scoring, "WHOLE", whole)
    for whole in (4096, 20):  # all in one place; the document of two kinds by joins
        by_joins(whole)
        got = {(r.document, r.a, r.b): r for r in scoring.shared_text_scores(rows, ["document"], blocking.BY, "id").collect()}
        assert set(got) == set(want) and len(got) == 48
        assert all(got[p][n] == (None if want[p][n] is None else pytest.approx(want[p][n])) for p in got for n in [*scoring.TEXT, "score"])


def test_normal_form_is_that_of_its_steps(spark):
    """Steps left out, merged or made once give what all steps in order give."""
    rng = random.Random(5)
    bits = ["<", ">", "<sup>", "</sup>", "<br/>", "=", "-", "--", "–", "•", "\t", ";", "\n", " ", "  ", "```markdown", "`", "_", "~", "$", "\\a", "{", "}", "km", "/", "h", "m", "s", "1", "23", "4.5", "6/7", ".", "%", "a", "B", "é", "ΑΣ", "â€™", "Â", "Ã—", "\xa0", "x", "!", "<num>", "𐐀", "😀"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(2000)]
    made = lambda found, f: [r[0] for r in spark.createDataFrame([(x,) for x in found], "text string").coalesce(1).select(f(F.col("text"))).collect()]
    plain = lambda c: F.trim(t.spark_steps(F.lower(t.spark_steps(t.spark_replace(c, t.MOJIBAKE), t.BEFORE_LOWER)), t.AFTER_LOWER))
    cleaned = made(texts, plain)
    normal = made(cleaned, lambda c: t.spark_steps(c, t.NUMBERS))
    assert made(texts, t.clean) == cleaned and made(texts, t.normal) == normal and made(texts, t.text_clean) == made(normal, plain)

"""Tables' signals on values worked out by hand, and whole comparisons."""

import math
import statistics

import numpy as np
import pytest

from palimpsest.functions import grids
from palimpsest.operators import changes, compare, matching, scoring

A = [["Step", "Speed (million)", "Name"], ["1", "10", "fast car"], ["2", "20", "slow car"], ["3", "40", "red bus"], ["4", "30", "n/a"]]
B = [["Step", "Speed (million)", "Label"], ["1", "11", "fast car"], ["2", "21", "slow car"], ["3", "41", "blue bus"], ["4", "31", ""], ["5", "50", "extra"]]


def test_grid():
    g = grids.grid_of(A)
    assert g["headers"] == A[0] and g["n_rows"] == 4 and g["first_column"] == ["1", "2", "3", "4"] and g["numeric_share"] == [1, 1, 0]
    assert g["columns"][1] == [1e7, 2e7, 4e7, 3e7] and g["columns"][2] == [None] * 4 and "speed million" in g["bigrams"] and "car fast 1".split()[0] in g["row_texts"][0]
    bare = grids.grid_of([["1", "2"], ["3"], []])
    assert bare["headers"] == [] and bare["columns"] == [[1, 3, None], [2, None, None]] and grids.grid_of(None)["n_rows"] == 0
    assert grids.number(" 1,234 *") == 1234 and grids.number("-") is None and grids.scale_of("x (0000)") == 1e4 and grids.scale_of("in billion") == 1e9


def test_grid_signals():
    a, b = grids.grid_of(A), grids.grid_of(B)
    s = grids.signals_of(a, b)
    assert s["header_jacc"] == 2 / 4 and s["col_count_sim"] == 1 and s["row_count_sim"] == 1 - 1 / 5 and s["row_label"] == 0
    assert s["numeric_share_a"] == 2 / 3 and s["type_align"] == pytest.approx(1.0) and 0 < s["series"] <= 1 and s["trend_sim"] == pytest.approx(1.0)
    x, y = [grids.filled(c) for c in a["columns"][:2]], [grids.filled(c) for c in b["columns"][:2]]
    ra, rb = statistics.correlation(*x), statistics.correlation(*y)
    assert s["corr_sim"] == pytest.approx(1 / (1 + 2 * (ra - rb) ** 2)) and s["miss_sim"] == pytest.approx(1.0)
    # two of four rows are alike: one has the same words but one, the last lacks its mark
    words = [(set(p.split()), set(q.split())) for p in a["row_texts"] for q in b["row_texts"]]
    alike = sum(any(len(set(p.split()) & set(q.split())) > 0.35 * len(set(p.split()) | set(q.split())) or p in q or q in p for q in b["row_texts"]) for p in a["row_texts"])
    assert words and s["row_overlap"] == alike / 4
    same = grids.signals_of(a, a)
    assert all(math.isclose(same[k], 1.0, rel_tol=1e-9) for k in ("header_jacc", "header_bigram_jacc", "rowbag_jacc", "row_overlap", "type_align", "corr_sim", "series"))
    none = grids.signals_of(grids.grid_of([]), a)
    assert all(np.isfinite(v) for v in none.values()) and none["row_overlap"] == none["series"] == none["corr_sim"] == 0


def blocks(spark):
    rows = []

    def add(doc, version, kind, pos, text, body=None, parent="p"):
        rows.append((doc, version, f"{kind}-{pos}", kind, pos, text, None, body, pos // 4, parent, "f", pos))

    base = [f"The {w} controller shall report status {i} to the central unit within {10 + i} seconds of the request being made" for i, w in enumerate(["engine", "brake", "door", "light", "steering", "battery", "cooling", "seat"])]
    html = lambda g: "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in g) + "</table>"
    flat = lambda g: "\n".join("| " + " | ".join(r) + " |" for r in g)
    other = [["Code", "Meaning", "Unit"], ["E17", "pump stopped", "bar"], ["E18", "valve open", "bar"], ["E19", "sensor lost", "volt"]]
    for doc in ("d1", "d2"):
        for i, x in enumerate(base):
            add(doc, 1, "text", i, x)
        for i, x in enumerate([*base[:3], base[3].replace("13 seconds", "99 minutes"), *base[4:7], "An entirely new sentence about windscreen wipers and their washing fluid reservoir"]):
            add(doc, 2, "text", i, x)
        for i, g in enumerate((A, other)):
            add(doc, 1, "table", i, flat(g), html(g))
        for i, g in enumerate((other, A[:4] + [["4", "3500", "stopped by hand"]])):
            add(doc, 2, "table", i, flat(g), html(g))
    return spark.createDataFrame(rows, "document string, version int, id string, kind string, pos int, text string, img_path string, table_body string, page_idx int, parent string, source_file string, ord int")


def test_table_scores(spark):
    art = blocks(spark).where("document = 'd1'")
    found = matching.match_table(art)
    got = {(r.a, r.b): r for r in found.collect()}
    assert {("table-0", "table-1"), ("table-1", "table-0")} == set(got)
    for r in got.values():
        v = r.asDict()
        structured = v["row_overlap"] >= 0.3 or v["rowbag_jacc"] >= 0.25 or v["col_sem_top2"] >= 0.5
        assert structured
        base = sum(w * v[n] for n, w in scoring.TABLE.items())
        base = base * (0.7 if v["row_overlap"] < 0.3 else 1) + (0.08 if v["row_overlap"] > 0.6 else 0)
        numeric = sum(w * v["num_col_quant_align" if n == "col_quant_align" else n] for n, w in scoring.TABLE_NUMERIC.items())
        sure = min(v["numeric_share_a"], v["numeric_share_b"]) >= 0.55 and numeric > base
        assert v["numeric_score"] == pytest.approx(numeric) and v["score"] == pytest.approx(numeric if sure else base) and v["path"] == ("numeric" if sure else "base")
    same = got["table-1", "table-0"]
    assert same.row_overlap == same.rowbag_jacc == same.teds == 1.0 and same.accepted


def test_guard_table(spark):
    good = {"score": 0.9, "semantic": 0.8, "teds": 0.5, "header_jacc": 0.5, "rowbag_jacc": 0.5, "reg_jacc": 0.5, "row_overlap": 0.5, "col_sem_top2": 0.5, "rows_a": 10.0, "rows_b": 10.0, "mutual": True, "margin": 0.5, "same_parent": True, "page_gap": 0}
    cases = [({}, True), ({"teds": 0.05}, False), ({"score": 0.1}, False), ({"reg_jacc": 0.1, "rowbag_jacc": 0.2}, False), ({"reg_jacc": 0.1}, True), ({"row_overlap": 0.1, "col_sem_top2": 0.5}, True), ({"row_overlap": 0.1, "semantic": 0.75}, False), ({"semantic": 0.5, "rows_b": 60.0}, False), ({"semantic": 0.75, "rows_b": 60.0}, True), ({"mutual": False, "semantic": 0.69}, False), ({"margin": 0.0}, False)]
    df = spark.createDataFrame([tuple({**good, **c}.values()) for c, _ in cases], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'double'}" for k, v in good.items()))
    assert [r.accepted for r in matching.guard_table(df).collect()] == [w for _, w in cases]


def test_compare(spark):
    got = compare.compare(blocks(spark), 2)
    edges = {(r.document, r.kind, r.sid, r.rid) for r in got.edges.where("NOT is_near").collect()}
    want = {(d, "text", f"text-{i}", f"text-{i}") for d in ("d1", "d2") for i in range(7)} | {(d, "table", "table-1", "table-0") for d in ("d1", "d2")}
    assert want <= edges and not any(r[3] == "text-7" for r in edges)
    labels = {(r.document, r.kind, r.left_text, r.change_type) for r in got.pairs.collect()}
    count = lambda kind, label: sum(k == kind and c == label for d, k, _, c in labels if d == "d1")
    assert count("text", "No Change") == 6 and count("text", "Major Change") == 1 and count("text", "Deleted") == 1 and count("text", "New") == 1
    assert got.pairs.where("change_type = 'No Change' and kind = 'table'").count() == 2
    items = got.wide.count()
    assert got.log.count() == items == got.pairs.select("document", "row_idx").distinct().count()
    assert {c for c, in changes.stats(got.pairs, 2, ["document"]).select("pairs_sent").distinct().collect()} == {got.pairs.where("document = 'd1' and trivial_type is null").count()}


def test_compare_files(spark, tmp_path):
    import json

    for v in (1, 2):
        (tmp_path / f"{v}.json").write_text(json.dumps([{"type": "text", "text": f"The pump shall start within {['5 seconds', '10 minutes and an hour'][v - 1]} after the key is turned by the driver"}, {"type": "text", "text": "Nothing else in this document changes between its versions at all"}]))
    got = compare.compare_files(spark, {"d": [str(tmp_path / "1.json"), str(tmp_path / "2.json")]})
    assert sorted(r.change_type for r in got.pairs.collect()) == ["Major Change", "No Change"]
    with pytest.raises(ValueError):
        compare.compare_files(spark, {"a": ["1", "2"], "b": ["1", "2", "3"]})

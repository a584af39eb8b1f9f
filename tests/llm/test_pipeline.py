"""Near copies and the pipeline on small tables, against brute force."""

from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from palimpsest.llm import linededup, simhash

DATA = "/root/testdata/sf0.001"


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_copies(spark):
    docs = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet").where("doc_id < 500")
    rows = {r.doc_id: r.text for r in docs.collect()}
    extra = [(10_000 + i, " ".join(f"word{j}" for j in range(140)) + f" number {i} of many") for i in range(150)] + [(20_000, None), (20_001, ""), (20_002, "a b"), (20_003, "A  b"), (None, "a b")]
    all_docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string")).repartition(4)
    got = {(r.doc_id): r.group_id for r in simhash.near_copies(all_docs).collect()}
    sets = {i: shingles(t or "") for i, t in [*rows.items(), *extra] if i is not None}
    ids = sorted(sets)
    close = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 0.5 * len(sets[b]) <= len(sets[a]) <= 2 * len(sets[b])]
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in close}
    sure = [p for p, j in like.items() if j >= 0.9]
    assert len(sure) > 100 and sum(got[a] == got[b] for a, b in sure) >= 0.97 * len(sure)
    # no group holds a document that is like none of the others
    groups = defaultdict(list)
    for i, g in got.items():
        if i is not None:
            groups[g].append(i)
    for g in groups.values():
        for i in g:
            assert len(g) == 1 or not sets[i] or any(like.get((min(i, o), max(i, o)), 0) >= 0.68 for o in g if o != i)
    assert got[20_000] == got[20_001] == 20_000 and got[20_002] == got[20_003]
    assert simhash.near_copies(all_docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    out, docs = [spark.read.parquet(f"{DATA}/documents.parquet")], None
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name.replace(" ", "_"))
        f(spark, out[-1], DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages(spark, staged):
    raw, clean, lines, single, mixed, packed = staged
    assert all(d.columns == raw.columns for d in staged[:-1]) and [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "source mixing", "packing"]
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = ids(clean)
    assert sum(i in kept for i, y in truth.items() if not y) >= 0.95 * sum(not y for y in truth.values())
    want = {r.doc_id: r.kept_text for r in linededup.dedup_lines(clean).collect()}
    assert {r.doc_id: r.text for r in lines.collect()} == want and all(r.n_chars == len(r.text) for r in lines.collect())
    assert ids(single) <= ids(lines)
    texts = [r.text for r in single.collect()]
    assert len(set(texts)) == len(texts)
    assert ids(mixed) <= ids(single) and mixed.count() >= single.count()
    total = {r.doc_id: 0 for r in mixed.collect()}
    for r in packed.collect():
        total[r.doc_id] += r.length
    assert all(total.values())


def test_run_agrees(spark, staged):
    assert corpus_pipeline.run(spark, DATA).count() == staged[-1].count()


def varied(base, rng, share, tag):
    """``base`` with about ``share`` of its words changed, in a few runs."""
    w = list(base)
    for at in rng.choice(len(w) // 10, max(1, round(share * len(w))), replace=False):
        w[at * 10] = f"{tag}{at}"
    return " ".join(w)


def linked_groups(sets, least=0.8):
    """id -> smallest id of its group, all pairs compared."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= least * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_copies_at_the_threshold(spark):
    """All pairs from 0.8 to 0.9 are found, and nothing else."""
    rng = np.random.default_rng(8)
    rows, sets, near = [], {}, 0
    for i in range(250):
        base = [f"p{i}w{j}" for j in range(100 + i)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, varied(base, rng, 0.008 + 0.0002 * (i % 100), f"c{i}x"))]
    for i, t in rows:
        sets[i] = shingles(t)
    for i in range(250):
        a, b = sets[2 * i], sets[2 * i + 1]
        near += 0.8 <= len(a & b) / len(a | b) < 0.9
    assert near > 50
    got = {r.doc_id: r.group_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == linked_groups(sets)


def test_signatures_never_rule_out_a_pair_alike():
    """Signatures differ in no more bits than sets in members, for equal, nested, far and empty sets."""
    rng = np.random.default_rng(10)
    for n in (0, 1, 7, 300, 5_000):
        some = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for other in (some, some[: n // 2], np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))):
            bits = sum(int(x).bit_count() for x in (simhash.signature(some) ^ simhash.signature(other)).view(np.uint64))
            assert bits <= len(np.setxor1d(some, other))
    assert simhash.signature(some[:0]).tolist() == [0] * simhash.SIGN_WORDS


def test_crowd_of_near_copies(spark):
    """Families of differing copies larger than a crowd, some beyond a leader's reach, and texts that only share a passage."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(2):
        base = [f"f{k}w{j}" for j in range(150)]
        for i in range(60):
            rows.append((len(rows), varied(base, rng, 0.007 + 0.0005 * i, f"f{k}c{i}x")))
    passage = " ".join(f"common{j}" for j in range(20))
    rows += [(len(rows) + i, f"{passage} " + " ".join(f"own{i // 2}w{j}" for j in range(60)) + f" end{i}") for i in range(40)]
    sets = {i: shingles(t) for i, t in rows}
    want = linked_groups(sets)
    assert 20 < len(set(want.values())) < len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.group_id for r in simhash.near_copies(df, crowd=2, rounds=2).collect()} == want


def test_drop_copies_keeps_one_of_each_simhash_component(spark):
    """The stage drops what fingerprints of 2 differing bits or fewer connect, all pairs compared, and nothing else."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(80):
        base = [f"s{i}w{j}" for j in range(100 + 5 * i)]
        rows += [(3 * i, " ".join(base)), (3 * i + 1, varied(base, rng, 0.002 + 0.0002 * i, f"d{i}x")), (3 * i + 2, " ".join(base).upper())]
    rows += [(1_000, None), (1_001, " "), (1_002, "a b"), (None, "A b")]
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in rows if i is not None}
    bits = {i: {(j, f >> j & 1) for j in range(64)} for i, f in prints.items()}
    # sets of (place, bit) share 64 - d of 64 + d members at d differing bits
    want = {i for i, g in linked_groups(bits, 62 / 66).items() if i == g}
    middle = {3 * i + 1 for i in range(80)}
    assert middle & want and middle - want
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [r.doc_id for r in corpus_pipeline.drop_copies(spark, df, "").collect()]
    assert len(got) == len(set(got)) and set(got) == want | {None}

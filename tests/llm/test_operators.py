"""Each operator against a brute-force version on a small table with nulls,
empty and long texts, ties, repeated rows and an extra, clashing column; and on
an empty table."""

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from palimpsest.llm import ann, linededup, mixing, packing, ppm, queries, sharding, simhash, tiff, toxicity, urlfilter
from palimpsest.llm.components import components

DATA = "/root/testdata/sf0.001"
WS = re.compile(r"[^\x20\x09-\x0D]+")
LINE = "The quick brown fox jumps over the lazy dog near the river bank"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(t):
    return WS.findall(t or "")


@pytest.fixture(scope="module")
def rows(spark):
    got = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    long = " ".join(f"word{i % 977} Stra\u00dfe\u00c9{i % 13}" for i in range(30_000))
    odd = [(10_001, None, "src1"), (10_002, "", None), (10_003, " \n\t\n ", None), (10_004, "one", ""), (10_005, "Two words", "src1"), (10_006, long, "src0"), (10_006, long, "src0"), (None, LINE, None)]
    odd += [(10_010 + i, f"x{i}\n  {LINE.upper() if i % 2 else LINE}\t\n\n{LINE}", "hot") for i in range(9)]
    return got + odd


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame([(i, t, s, "clash", 1) for i, t, s in rows], "doc_id long, text string, source string, n_lines string, size int")
    return df.repartition(5).persist()


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def test_line_dedup(docs, rows, empty):
    held = defaultdict(set)
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(i)
    last = {k: max(i for i in s if i is not None) for k, s in held.items() if len(s) >= 5}
    want = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if last.get(key(x), i) == i]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = [tuple(r) for r in linededup.dedup_lines(docs).collect()]
    assert last and Counter(got) == Counter(want)
    assert linededup.dedup_lines(empty).count() == 0


def test_shards(docs, rows, empty):
    got = sharding.shard_documents(docs, 7).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots, shard_of = defaultdict(list), {}
    for r in got:
        slots[r.shard].append(r.slot)
        assert shard_of.setdefault((r.text_crc32, r.size), r.shard) == r.shard
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty).count() == 0


def minimax(sizes, k):
    """Smallest capacity of a contiguous partition, by dynamic programming."""
    before = np.concatenate([[0], np.cumsum(sizes)])
    best = [float(x) for x in before]
    for _ in range(k - 1):
        best = [min(max(best[j], before[i] - before[j]) for j in range(i + 1)) for i in range(len(before))]
    return int(best[-1])


@pytest.mark.parametrize("seed", range(3))
def test_minimax_is_optimal(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = [int(x) for x in rng.integers(1, 100, 40)] + [5_000] * seed
    df = spark.createDataFrame(list(enumerate(sizes)), "atom int, s long")
    giants, cuts, capacity = sharding.minimax_cuts(df, 6)
    rest = [s for i, s in enumerate(sizes) if i not in giants]
    assert len(giants) == seed and capacity == minimax(rest, 6 - seed) and len(cuts) <= 6 - seed
    ends = [*cuts[1:], len(sizes)]
    assert max(sum(s for i, s in enumerate(sizes) if a <= i < b and i not in giants) for a, b in zip(cuts, ends, strict=True)) <= capacity


def test_mixing(docs, rows, empty):
    got = mixing.mix_sources(docs).collect()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    cap, left, target, open_ = {s: 2 * size[s] for s in order}, 1.5 * sum(size.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > cap[s]]
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = cap[s]
            left -= cap[s]
            open_.remove(s)
    of = {(i, len(words(t))): s for i, t, s in rows}
    taken = defaultdict(int)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(words(t))) for i, t, _ in rows)
    for r in got:
        s = of[r.doc_id, r.size]
        assert r.source_size == size[s] and math.isclose(r.target, target[s], rel_tol=1e-9, abs_tol=1e-6) and 0 <= r.taken <= 2 * r.size
        assert (r.first_slot is None) == (r.taken == 0)
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix_sources(empty).count() == 0


def test_schedule_is_even(spark):
    targets = spark.createDataFrame([(1, 600.0, 600), (2, 300.0, 300), (3, 100.0, 100)], "pos int, target double, goal long")
    slots = mixing.slots_of(targets, 8, 4).orderBy("time").collect()
    assert Counter(r.pos for r in slots) == {1: 150, 2: 75, 3: 25} and len({r.time for r in slots}) >= 248
    for upto in (16, 64, 200):
        n = Counter(r.pos for r in slots[:upto])
        assert all(abs(n[p] - upto * share) < 4 for p, share in ((1, 0.6), (2, 0.3), (3, 0.1)))


def test_mix_comes_from_its_schedule(spark, docs, rows):
    """Fewer slots take fewer words, other times give another order."""
    got = mixing.mix_sources(docs).collect()
    half = mixing.mix_sources(docs, schedule=lambda t, b, n: mixing.slots_of(t, b, n).where("k % 2 = 0")).collect()
    late = mixing.mix_sources(docs, schedule=lambda t, b, n: mixing.slots_of(t, b, n).withColumn("time", 5000 - mixing.F.col("time"))).collect()
    total = sum(r.taken for r in got)
    assert 0.4 * total < sum(r.taken for r in half) < 0.6 * total
    order = lambda some: [r.doc_id for r in sorted((r for r in some if r.taken), key=lambda r: (r.first_slot, str(r.doc_id)))]
    assert order(got) != order(late) and sorted(map(str, order(got))) == sorted(map(str, order(late)))
    assert all((r.again_slot is None) or r.taken > r.size for r in got)


def test_urls(spark):
    urls = ["http://a.Example.ORG/es/1?x", "https://example.org/en/1", "https://notexample.org/en/12", "http://org", "http://org/", "http://x.com/fr/#a", "http://com/de/a", "http://x.com/DE/a", "nothing", None, "", "a://b://c/d", "http://example.org./es/", "http://x.com?/fr/", "http://u@x.org:80/\n/a", "http://example.org/es/", "HTTP://EXAMPLE.org/en/1a/b"] * 2
    pages = spark.createDataFrame([(i if i % 5 else None, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")

    def judge(u, rules):
        at = (u or "").find("://")
        rest = u[at + 3 :] if at >= 0 else ""
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, "allow")

    for rules in (urlfilter.RULES, urlfilter.RULES + [("block", "a.example.org", "/"), ("allow", "a.example.org", "/es"), ("block", "example.org", "/"), ("block", "x.com", "/fr/")], []):
        got = urlfilter.filter_urls(pages, urlfilter.rule_table(spark, rules)).collect()
        assert Counter(map(tuple, got)) == Counter((i if i % 5 else None, *judge(u, rules)) for i, u in enumerate(urls))
    assert urlfilter.filter_urls(pages.limit(0), urlfilter.rule_table(spark, urlfilter.RULES)).count() == 0


def test_simhash(docs, rows, empty):
    def brute(t):
        w = lower(t or "").encode().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        n = [0] * 64
        for s in sh:
            h = xxhash.xxh64_intdigest(s, 42)
            for b in range(64):
                n[b] += h >> b & 1
        return sum(1 << b for b in range(64) if n[b] * 2 > len(sh))

    fps = [(i, brute(t)) for i, t, _ in rows]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                root[find(a)] = find(b)
    low = {}
    for x, (i, _) in enumerate(fps):
        if i is not None:
            low[find(x)] = min(low.get(find(x), i), i)
    want = Counter((i, f"{f:016x}", low.get(find(x))) for x, (i, f) in enumerate(fps))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("crowd", [2, 64])
def test_simhash_links_connect_like_all_pairs(spark, crowd):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 6, dtype=np.uint64)]
    fps = {b ^ sum(1 << int(i) for i in rng.choice(64, int(rng.integers(0, 6)), replace=False)) for b in base for _ in range(60)} | {0, (1 << 64) - 1, 1 << 63}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in signed:
        for b in signed:
            if (a ^ b & ((1 << 64) - 1)).bit_count() <= 2 if a >= 0 and b >= 0 else ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), crowd)).collect()}
    assert got == {f: find(f) for f in signed if any(find(g) == find(f) for g in signed if g != f)}


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 5000), (5000, 1000), (7, 7), (2000, 2000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 5000: 1000}


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    want = Counter()
    for i, text, _ in rows:
        want[(i, tuple(t.encode(text or "", add_special_tokens=False).ids) + (1,))] += 1
    got = packing.pack_documents(docs, path).collect()
    seq, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    assert sorted(seq) == list(range(len(seq)))
    pad = 0
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at <= packing.CAPACITY
        pad += packing.CAPACITY - at
    for (i, ids), times in want.items():
        at = 0
        raw = np.array(ids, "<u4").tobytes()
        pieces = sorted(by_doc[i, len(ids)])
        for start, n, crc in pieces[::times]:
            assert start == at and crc == zlib.crc32(raw[4 * at : 4 * (at + n)])
            at += n
        assert at == len(ids) and len(pieces) % times == 0
    assert pad < 0.04 * sum(len(x) for _, x in want.elements()) + packing.CAPACITY
    assert packing.pack_documents(empty, path).count() == 0


def test_cuts():
    for n in range(1, 9000):
        got = packing.cuts(n)
        assert sum(x for x, _ in got) == n and all(0 < x * k <= packing.CAPACITY for x, k in got)


@pytest.mark.parametrize("text", ["It's 'll A\u0301 \u0130stanbul \u03a3\u03a3 x\u00a0y a.b c,d. (e) 12a \u4f60\u597d! <|endoftext|> \u2026", "\x1c\x85\u3000 o'clock't ...", "\u00c9COLE,,, na\u00efve\u2019s"])
def test_word_ids_are_the_tokenizers(text):
    ids = packing.WordIds(queries.tokenizer_path())
    assert ids.by_word and ids.of(text.encode()) == ids.whole(text)


def test_tiff_round_trip(docs, rows, empty):
    got = tiff.digest_media(tiff.store_texts(docs)).collect()

    def padded(t):
        b = (t or "").encode()
        return b + b" " * (-len(b) % 192 if b else 192)

    want = Counter((i, len((t or "").encode()), len(padded(t)), hashlib.sha256(padded(t)).hexdigest(), zlib.crc32(padded(t)[-16:])) for i, t, _ in rows)
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert {k for r in got for k in r.feature.split("stored=")[1].split("+")} >= {"lzw/tiles/2", "packbits/strips/1", "deflate/strips/2"}
    pages = tiff.tiff_pages(tiff.store_texts(docs)).where("doc_id = 10006").orderBy("page").collect()
    assert len(pages) > 2 and all(p.error is None for p in pages)
    assert tiff.digest_media(tiff.store_texts(empty)).count() == 0


@pytest.mark.parametrize("data", [b"", b"a", b"ab" * 5000, bytes(range(256)) * 300, b"\0" * 70_000, np.random.default_rng(0).integers(0, 256, 60_000, np.uint8).tobytes()])
def test_codecs(data):
    assert tiff.unpackbits(tiff.packbits(data), len(data)) == data
    assert tiff.unlzw(tiff.lzw(data), len(data)) == data


def test_lzw_of_the_specification():
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == raw and tiff.unlzw(raw, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_broken_files(spark):
    good = tiff.store_payload(b"x" * 192 * 600)
    files = spark.createDataFrame([(1, good), (2, None), (3, b""), (4, b"II*\0"), (5, good[:-100]), (6, good)], "page long, media binary")
    got = tiff.tiff_pages(files.withColumnRenamed("page", "id")).collect()
    assert Counter((r.id, r.error is None) for r in got if r.id in (1, 3, 4, 6)) == {(1, True): 2, (3, False): 1, (4, False): 1, (6, True): 2}
    assert b"".join(r.samples for r in sorted((r for r in got if r.id == 1), key=lambda r: r.page)) == b"x" * 192 * 600
    assert tiff.tiff_pages(files).columns.count("page") == 1


def tiff_of(fields, chunk=b"x" * 64):
    return tiff.write_tiff([(fields, [chunk])])


def test_odd_files_are_error_rows(spark):
    """Zero and huge dimensions, counts that differ, cut and wrong streams, loops."""
    page = {tiff.WIDTH: (4, [8]), tiff.HEIGHT: (4, [8]), tiff.BITS: (3, [8]), tiff.COMPRESSION: (3, [1]), tiff.SAMPLES: (3, [1]), tiff.ROWS_PER_STRIP: (4, [8]), tiff.STRIP_BYTES: (4, [64])}
    tile = {k: v for k, v in page.items() if k not in (tiff.ROWS_PER_STRIP, tiff.STRIP_BYTES)} | {tiff.TILE_WIDTH: (4, [8]), tiff.TILE_HEIGHT: (4, [8]), tiff.TILE_BYTES: (4, [64])}
    fields = lambda d, **over: [(t, *over.get(str(t), v)) for t, v in d.items() if over.get(str(t), v)]
    case = lambda d, tag, kind, values, **more: tiff_of(fields(d, **{str(tag): (kind, values)}), **more)
    bad = [case(page, tiff.WIDTH, 4, [0]), case(page, tiff.HEIGHT, 4, [0]), case(page, tiff.WIDTH, 4, [4_000_000_000]), tiff_of(fields(page, **{str(tiff.WIDTH): (4, [4_000_000_000]), str(tiff.HEIGHT): (4, [4_000_000_000])}))]
    bad += [case(page, tiff.STRIP_BYTES, 4, []), case(page, tiff.STRIP_BYTES, 4, [32, 32]), case(page, tiff.STRIP_BYTES, 4, [63]), case(page, tiff.ROWS_PER_STRIP, 4, [0]), case(page, tiff.SAMPLES, 3, [0]), case(page, tiff.BITS, 3, [16])]
    bad += [case(tile, tiff.TILE_WIDTH, 4, [0]), case(tile, tiff.TILE_HEIGHT, 4, [0]), case(tile, tiff.TILE_WIDTH, 4, [1 << 31]), case(page, tiff.STRIP_BYTES, 4, [1 << 31])]
    for how, raw in ((tiff.LZW, tiff.lzw(bytes(range(64)))), (tiff.DEFLATE, zlib.compress(bytes(range(64)))), (tiff.PACKBITS, tiff.packbits(bytes(range(64))))):
        whole = fields(page, **{str(tiff.COMPRESSION): (3, [how]), str(tiff.STRIP_BYTES): (4, [len(raw)])})
        assert [p["samples"] for p in tiff.read_tiff(tiff_of(whole, raw))] == [bytes(range(64))]
        cut = raw[: len(raw) // 2]
        bad.append(tiff_of(fields(page, **{str(tiff.COMPRESSION): (3, [how]), str(tiff.STRIP_BYTES): (4, [len(cut)])}), cut))
        bad.append(tiff_of(fields(page, **{str(tiff.COMPRESSION): (3, [how])}), b"\x80" * 64))
        bad.append(tiff_of(fields(page, **{str(tiff.COMPRESSION): (3, [how]), str(tiff.WIDTH): (4, [1 << 20]), str(tiff.HEIGHT): (4, [1 << 12]), str(tiff.STRIP_BYTES): (4, [len(raw)])}), raw))
    good = tiff_of(fields(page))
    loop = bytearray(good)
    loop[-4:] = loop[4:8]  # the directory follows itself
    beyond = bytearray(good)
    beyond[-4:] = b"\xff\xff\xff\x7f"
    files = [*bad, good, bytes(loop), bytes(beyond), good[:20], b"MM\0*" + b"\xff" * 40]
    got = tiff.tiff_pages(spark.createDataFrame(list(enumerate(files)), "id int, media binary")).collect()
    by = defaultdict(list)
    for r in got:
        by[r.id].append(r)
    n = len(bad)
    assert all([p.error is None for p in by[i]] == [False] for i in range(n))
    assert [[p.error is None for p in by[i]] for i in range(n, n + 5)] == [[True], [True], [True, False], [False], [False]]
    rng = np.random.default_rng(6)
    whole = tiff.store_payload(bytes(rng.integers(0, 256, 192 * 40, np.uint8)))
    for _ in range(400):  # any byte may be wrong
        broken = bytearray(whole)
        for at in rng.integers(0, len(broken), 3):
            broken[at] = int(rng.integers(0, 256))
        assert all(p["error"] is None or isinstance(p["error"], str) for p in tiff._read_all(bytes(broken[-300:] if rng.random() < 0.1 else broken)))


def ppm_brute(train, texts, order):
    """Method C with exclusion, straight from its definition."""
    n = defaultdict(Counter)
    edge = bytes([255])
    for t in train:
        b = edge * order + t + edge
        for p in range(order, len(b)):
            for o in range(order + 1):
                n[b[p - o : p]][b[p]] += 1
    out = []
    for t in texts:
        b, total = edge * order + t + edge, 0.0
        for p in range(order, len(b)):
            gone = set()
            for o in range(order, -1, -1):
                seen = n.get(b[p - o : p])
                if not seen:
                    continue
                fresh = {s: c for s, c in seen.items() if s not in gone}
                if not fresh:
                    continue
                whole = sum(fresh.values()) + len(fresh)
                if b[p] in fresh:
                    total += math.log10(fresh[b[p]] / whole)
                    break
                total += math.log10(len(fresh) / whole)
                gone |= set(fresh)
            else:
                total -= math.log10(256 - len(gone))
        out.append(total)
    return out


def test_ppm(spark, rows, empty):
    some = [r for r in rows if len(r[1] or "") < 1500][:60] + [(10_050, "a\0b" + "\U0001f600 zq" * 3, ""), (10_051, "Z" * 60 + " " + "Z" * 60, ""), (10_052, "\u00df\u00e9 new", "")]
    fold = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _, _ in some]
    texts = [lower(t or "").encode() for _, t, _ in some]
    train = [t for t, h in zip(texts, fold, strict=True) if not h]
    assert 0 < len(train) < len(some)
    c = Counter(w for t in train for w in [*t.split(), b" "])
    total = sum(c.values())
    want = {}
    for (i, _, _), t, h, s in zip(some, texts, fold, ppm_brute(train, texts, 3), strict=True):
        ws = [*t.split(), b" "]
        want[i] = (h, len(ws), sum(c[w] > 0 for w in ws), total, sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in ws), s)
    df = spark.createDataFrame(some, "doc_id long, text string, score string").repartition(3)
    for hot in (3, 1000):
        got = ppm.score_texts(df, order=3, hot_words=hot).collect()
        assert len(got) == len(some)
        for r in got:
            assert tuple(r)[1:5] == want[r.doc_id][:4]
            assert math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9) and math.isclose(r.score, want[r.doc_id][5], rel_tol=1e-5)
    pruned = {r.doc_id: r.score for r in ppm.score_texts(df, order=3, max_nodes=800).collect()}
    assert all(-1e5 < s < 0 for s in pruned.values())
    assert ppm.score_texts(empty).count() == 0
    nothing = ppm.score_texts(df.where("doc_id = 10050 or doc_id = 10051").where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in nothing)


def test_ppm_scores_by_the_whole_trie(spark, rows):
    """The strings in memory may be few: scores are those of all counts."""
    df = spark.createDataFrame([r[:2] for r in rows if len(r[1] or "") < 1500][:40], "doc_id long, text string").repartition(2)
    texts = {r.doc_id: lower(r.text or "").encode() for r in df.collect()}
    train = [t for i, t in texts.items() if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    want = dict(zip(texts, ppm_brute(train, list(texts.values()), 3), strict=True))
    for r in ppm.score_texts(df, order=3, max_nodes=800).collect():
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-5)


def test_table_finds_what_it_holds():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 56, 5000, dtype=np.uint64))
    table = ppm.Table(keys[::2], np.arange(len(keys[::2])) + 1.0)
    hit, value = table.find(keys)
    assert hit.tolist() == [i % 2 == 0 for i in range(len(keys))] and value[::2].tolist() == list(range(1, len(keys[::2]) + 1)) and not value[1::2].any()
    assert not ppm.Table(keys[:0], np.zeros(0)).find(keys)[0].any()


def test_ppm_of_a_text_over_a_piece(spark):
    """Order 5, and a text that is counted and scored in several pieces."""
    rng = np.random.default_rng(4)
    long = "".join(rng.choice(list("abc de\n"), 9000))
    some = [(i, t) for i, t in enumerate([long, "abc de", "", "zz top", "abcde" * 30, long[:700], "a" * 300, "caffe\u0301"])]
    texts = [t.encode() for _, t in some]
    train = [t for (i, _), t in zip(some, texts, strict=True) if zlib.crc32(str(i).encode()) % 7 != 2]
    assert len(train) < len(texts)
    pieces = [(len(b), parts) for b, parts in ppm.pieces([b"x" * (3 * ppm.PIECE)], 5)]
    assert len(pieces) == 4 and sum(b - a for _, p in pieces for _, a, b in p) == 3 * ppm.PIECE + 1
    for nodes in (100, 1_000_000):
        got = {r.doc_id: r.score for r in ppm.score_texts(spark.createDataFrame(some, "doc_id long, text string"), max_nodes=nodes).collect()}
        for (i, _), want in zip(some, ppm_brute(train, texts, 5), strict=True):
            assert math.isclose(got[i], want, rel_tol=1e-5, abs_tol=1e-6)
    with pytest.raises(ValueError):
        ppm.score_texts(spark.createDataFrame(some, "doc_id long, text string"), order=7)


def test_knn(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[300:420] = x[300]
    rows = [(i, [float(a) for a in v], "x") for i, v in enumerate(x)]
    rows += [(10_000, None, ""), (10_100, [0.0] * 8, ""), (10_200, [float("nan")] + [1.0] * 7, ""), (10_300, [float("inf")] * 8, ""), (10_400, [None] + [1.0] * 7, ""), (10_500, [], ""), (10_600, [1.0] * 3, ""), (None, [1.0] * 8, ""), rows[300], rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4)
    v = x.astype(np.float64)
    got = defaultdict(list)
    for r in ann.knn(df, recall=0.99, sample=200).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        best = [i for i in heapq.nsmallest(11, range(900), key=lambda i: (d[i], i)) if i != q][:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(math.isclose(s, d[i], rel_tol=1e-12, abs_tol=1e-12) for _, i, s in found)
        hits += len(set(best) & {i for _, i, _ in found})
    assert hits >= 0.9 * 10 * len(got)
    assert [i for _, i, _ in got[300]] == list(range(301, 311))
    few = ann.knn(df.where("vec_id < 4 or vec_id >= 10000")).collect()
    assert [(r.query_id, r.rank) for r in sorted(few)] == [(0, 1), (0, 2), (0, 3)]
    assert ann.knn(df.limit(0)).count() == 0


def test_knn_makes_no_row_for_a_visit(spark, monkeypatch):
    """Queries meet leaves in memory of bounded size: no table has a row per query and leaf."""
    x = np.random.default_rng(6).normal(size=(1_500, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    made = []

    def counted(table, real=ann.materialize):
        out = real(table)
        made.append(out.count())
        return out

    monkeypatch.setattr(ann, "materialize", counted)
    monkeypatch.setattr(ann, "LEAF_ROWS", 32)
    monkeypatch.setattr(ann, "CHUNK", 200, raising=False)
    got = defaultdict(set)
    for r in ann.knn(df, k=2, every=2).collect():
        got[r.query_id].add(r.vec_id)
    assert max(made) <= len(x)
    assert set(got) == set(range(0, len(x), 2)) and all(len(g) == 2 for g in got.values())
    d = ((x[::2, None] - x[None]) ** 2).sum(axis=2)
    d[np.arange(len(d)), np.arange(0, len(x), 2)] = np.inf
    assert sum(len(set(row.argsort()[:2]) & got[2 * i]) for i, row in enumerate(d)) >= 0.9 * 2 * len(d)


def test_nearest_of_a_chunk_in_small_blocks(monkeypatch):
    for name, value in (("BLOCK_QUERIES", 3), ("BLOCK_ROWS", 7), ("EXACT", 5), ("PENDING", 11)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(7)
    x, ids = rng.integers(0, 3, (60, 3)).astype(float), rng.permutation(60)
    found = ann.Found(x[:20], ids[:20], np.full(20, np.inf), 4)
    for lo in range(0, 60, 25):
        found.meet(np.arange(20), x[lo : lo + 25], ids[lo : lo + 25])
    got = defaultdict(list)
    for i, j, d in zip(*found.cut(), strict=True):
        got[int(i)].append((float(d), int(j)))
    for i in range(20):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        assert got[i] == sorted((float(e), int(j)) for e, j in zip(d, ids, strict=True) if j != ids[i])[:4]


def test_toxicity(spark, empty):
    docs, labels = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet"), spark.read.parquet(f"{DATA}/../sf0.01/labels.parquet")
    model = toxicity.train(docs, labels)
    scored = toxicity.score_documents(docs.withColumn("score", docs.lang), model, ["doc_id", "score"]).withColumn("held_out", toxicity.held_out())
    assert scored.count() == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.score, truth[r.doc_id]) for r in scored.collect() if r.held_out and r.doc_id in truth]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert pos and sum(a > b for a in pos for b in neg) > 0.9 * len(pos) * len(neg)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (None, "idiot " * 50_000)], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in toxicity.score_documents(odd, model, ["doc_id"]).collect())
    none = toxicity.train(empty.select("doc_id", "text"), labels.limit(0))
    assert toxicity.score_documents(odd, none, ["doc_id"]).where("score between 0 and 1").count() == 4
    assert toxicity.score_documents(empty, none, ["doc_id"]).count() == 0


def test_noisy_or_finds_the_sentence():
    bags = [([[0, 1], [2]], 0, 1.0)] * 20 + [([[0, 1], [2, 3]], 1, 1.0)] * 20
    bias, w = toxicity.fit(bags, 4)
    m = toxicity.Model(bias, {b"a": w[0], b"b": w[1], b"c": w[2], b"bad": w[3]})
    text = b"a b. c bad. a c."
    score, worst, lo, hi = m.score(text)
    assert score > 0.8 and worst > 0.8 and text[lo:hi] == b" c bad" and m.score(b"a b. c.")[0] < 0.2

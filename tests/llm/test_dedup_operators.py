"""Exact, SimHash and suffix dedup against brute force, with odd rows."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash

from envmon.llm import exact_dedup as X
from envmon.llm import simhash as S
from envmon.llm import suffix_dedup as D
from envmon.llm.components import connected_components
from envmon.llm.queries import REGISTRY
from tests.conftest import SF_SMALL


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=str)


# exact -----------------------------------------------------------------------------------------

def brute_exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    key = lambda i: -1 if i is None else i
    return sorted(((i, max(groups[t or ""], key=key), len(groups[t or ""]), i == max(groups[t or ""], key=key),
                    hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


@pytest.mark.parametrize("cut", [None, 4])
def test_exact_report(odd_docs, cut):
    history = None if cut is None else odd_docs["doc_id"] <= cut
    from pyspark.sql import functions as F
    got = X.dedup_report(odd_docs, None if history is None else F.col("doc_id") <= cut).drop("in_history")
    want = brute_exact([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_exact_keeps_one_row_of_each_text(odd_docs, no_docs):
    kept = X.dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    got = kept.collect()
    assert len(got) == len({r.text or "" for r in got}) == len({r.text or "" for r in odd_docs.collect()})
    assert {r.doc_id for r in got} == {5, 9, 7, 3, 8, 11}
    assert X.dedup(no_docs).count() == 0 and X.dedup_report(no_docs).count() == 0


def test_minimal_perfect_hash_is_minimal_and_compares_bytes():
    rng = np.random.default_rng(1)
    d = rng.integers(0, 256, (5000, 32), dtype=np.uint8)
    shard = X.build_shard(d, np.arange(5000), np.ones(5000))
    assert sorted(X.lookup_shard(shard, d).tolist()) == list(range(5000))
    near = d.copy()
    near[:, 31] ^= 1
    assert (X.lookup_shard(shard, near) == -1).all()
    tiny = X.build_shard(d[:1], np.arange(1), np.ones(1))
    assert X.lookup_shard(tiny, d[:3]).tolist() == [0, -1, -1]


def test_minimal_perfect_hash_with_hashes_that_no_level_parts(monkeypatch):
    monkeypatch.setattr(X, "_cell", lambda words, level, size: np.zeros(len(words), np.uint64))
    d = np.random.default_rng(2).integers(0, 256, (4, 32), dtype=np.uint8)
    shard = X.build_shard(d, np.arange(4), np.ones(4))
    assert shard["rest"] == 4 and sorted(X.lookup_shard(shard, d).tolist()) == [0, 1, 2, 3]


# SimHash ---------------------------------------------------------------------------------------

def brute_fingerprint(text, k=3):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in folded).split(" ") if w]
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_fingerprints(odd_docs):
    docs = odd_docs.where("length(text) < 1000 or text is null").unionByName(
        odd_docs.limit(1).selectExpr("12L as doc_id", "'A\\u00a0b\\tc  \\u2003D e\\x0bF É' as text",
                                     *odd_docs.columns[2:]))
    for r in S.near_dup_report(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        if r.doc_id != 7:
            assert int(r.fingerprint, 16) == brute_fingerprint(r.text)


@pytest.mark.parametrize("max_bits", [2, 3])
def test_links_are_complete(spark, max_bits):
    rng = random.Random(max_bits)
    fps = {0, 1, 3, (1 << 64) - 1}
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(4):
            x = base
            for b in rng.sample(range(64), rng.randint(0, max_bits + 1)):
                x ^= 1 << b
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {(r.a, r.b) for r in S.links(spark.createDataFrame([(x,) for x in signed], "fp long"), max_bits).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= max_bits}
    assert got == want


def test_near_dup_components(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for _ in range(12):
        words = [rng.choice("abcdefghij") * rng.randint(1, 6) for _ in range(400)]
        for _ in range(5):
            w = list(words)
            w[rng.randrange(400)] = "zz"
            rows.append((n, " ".join(w)))
            n += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fp = {i: brute_fingerprint(t) for i, t in rows}
    want = components(n, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    got = {r.doc_id: r.component_id for r in S.near_dup_report(df).collect()}
    assert got == dict(enumerate(want)) and len(set(want)) < n
    assert ids(S.near_dedup(df)) == sorted(set(want), key=str)


def test_near_dedup_odd_rows(odd_docs, no_docs):
    kept = S.near_dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    # 9 and 4 are empty, 2 and 5 equal, 7 repeats; rows with a null id stay
    assert sorted(r for r in ids(kept) if r is not None and r not in (3, 8)) == [2, 4, 7, 11]
    assert ids(kept).count(None) == 2 and ids(kept).count(7) == 1
    assert S.near_dedup(no_docs).count() == 0 and S.near_dup_report(no_docs).count() == 0
    report = {r.doc_id: r for r in S.near_dup_report(odd_docs).collect()}
    assert report[4].fingerprint == "0" * 16 and report[9].component_id == 4


def test_components_of_a_long_chain(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7), (2000, 2000)]
    rng.shuffle(chain)
    got = connected_components(spark.createDataFrame(chain, "a long, b long")).collect()
    roots = {r.node: r.root for r in got}
    assert len({roots[i] for i in range(301)}) == 1 and roots[1000] == roots[1001] != roots[0]
    assert len(roots) == 303


# suffixes --------------------------------------------------------------------------------------

def brute_repeats(rows):
    known = [(D.NO_ID if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in known:
        for p in range(len(b) - D.LENGTH + 1):
            k = b[p:p + D.LENGTH]
            first[k] = min(first.get(k, i), i)
    out = []
    for (i, _), (key, b) in zip(rows, known):
        gone = bytearray(len(b))
        for p in range(len(b) - D.LENGTH + 1):
            if first[b[p:p + D.LENGTH]] < key:
                gone[p:p + D.LENGTH] = b"\1" * D.LENGTH
        spans = [(p, next((q for q in range(p, len(b)) if not gone[q]), len(b)))
                 for p in range(len(b)) if gone[p] and not (p and gone[p - 1])]
        out.append((key, len(b), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out)


def report(df):
    return sorted((D.NO_ID if r.doc_id is None else r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept))
                  for r in D.repeat_report(df).collect())


def test_repeats_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    base = ["".join(rng.choice("abé ") for _ in range(400)) for _ in range(6)]
    rows = [(None, base[0]), (3, None), (4, ""), (4, base[1]), (4, base[1] + base[0][:60]), (2, "x" * 500),
            (9, "x" * 120 + "y" + "x" * 49), (10, "ab" * 200), (11, "ab" * 100 + "b"), (None, base[0]), (1, "q" * 49)]
    for _ in range(150):
        t = ""
        for _ in range(rng.randint(1, 5)):
            a = rng.randint(0, 300)
            t += rng.choice(base)[a:a + rng.randint(10, 200)] + "".join(rng.choice("abé ") for _ in range(rng.randint(0, 40)))
        rows.append((rng.randint(0, 120), t))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert report(df) == brute_repeats(rows)
    # many blocks, several groups of them, and few buckets parted into fine ones
    monkeypatch.setattr(D, "block_count", lambda total, least: 40)
    for group, most in ((1 << 30, 4096), (9000, 4096), (9000, 3), (1 << 30, 2)):
        monkeypatch.setattr(D, "GROUP_BYTES", group)
        monkeypatch.setattr(D, "MOST_BUCKETS", most)
        assert report(df) == brute_repeats(rows)


def test_repeats_with_heavy_anchors_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    line, rows = "a frequent line of thirty-four bytes", []
    for i in range(300):
        around = ["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 60))) for _ in range(3)]
        rows.append((rng.randint(0, 250), line.join(around) + rng.choice([rows[-1][1][:90] if rows else "", ""])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(D, "block_count", lambda total, least: 7)
    for heavy, group, most in ((0, 1 << 30, 4096), (20, 1 << 30, 4096), (20, 9000, 4)):
        monkeypatch.setattr(D, "HEAVY", heavy)
        monkeypatch.setattr(D, "GROUP_BYTES", group)
        monkeypatch.setattr(D, "MOST_BUCKETS", most)
        assert report(df) == brute_repeats(rows)


def test_a_frequent_line_is_spread_over_the_buckets():
    rng, buckets = random.Random(7), 16
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(60))
    docs = pa.table({"block": pa.array([0] * 30000, pa.int32()), "doc_id": pa.array(range(30000), pa.int64()),
                     "text": pa.array([word() + "a frequent line of thirty-four byt" + word() for _ in range(30000)])})
    docs = docs.append_column("rest", pa.array([True] * 30000))
    sent = D._send_hashes(docs, buckets, 1)
    each = [t for k in range(buckets) if (t := sent.filter(pc.equal(sent.column("bucket"), k))).num_rows]
    bits = pa.concat_tables([D._split_bits(t, D._find_shared(D._merge_hashes(t, 1)), 1) for t in each])
    contexts = D._send_contexts(docs, bits, buckets, 1)
    sizes = collections.Counter(dict(zip(contexts.column("bucket").to_pylist(), contexts.column("raw_size").to_pylist())))
    assert sum(sizes.values()) > 3_000_000 and max(sizes.values()) < 2 * sum(sizes.values()) / buckets


def test_windows_in_parts_have_the_same_anchors(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    off = np.array([0, 10, 10, 3000, 3060, 5000])
    spread = lambda r: {(row, w, h) for row, f, e, h in zip(*map(np.ndarray.tolist, r)) for w in range(f, e + 1)}
    whole = spread(D.runs(data, off))
    monkeypatch.setattr(D, "PART", 700)
    assert spread(D.runs(data, off)) == whole
    assert len(whole) == (2990 - 49) + (60 - 49) + (1940 - 49)


def test_longest_previous_factors():
    # suffix order of five suffixes; documents 3 0 2 1 2
    lpf = lambda docs, lcp, *least: D.longest_previous_factors(np.array(docs, np.int64), np.array(lcp, np.int64), *least).tolist()
    assert lpf([3, 0, 2, 1, 2], [0, 4, 9, 7, 8]) == [4, 0, 9, 7, 8] and lpf([], []) == []
    rng = random.Random(8)
    for _ in range(400):
        n, least = rng.randint(1, 40), rng.randint(1, 6)
        docs, lcp = [rng.randint(0, 6) for _ in range(n)], [0] + [rng.randint(0, 9) for _ in range(n - 1)]
        want = [max([0, *(min(lcp[min(i, j) + 1:max(i, j) + 1]) for j in range(n) if docs[j] < docs[i])]) for i in range(n)]
        assert lpf(docs, lcp, least) == [w if w >= least else 0 for w in want]


def test_windows_in_several_orders_are_those_in_one(monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.integers(97, 100, 300).astype(np.uint8).tobytes()
    texts = list({base[a:a + 50 + int(rng.integers(0, 31))] for a in rng.integers(0, 200, 150).tolist()})
    kind, docs = rng.integers(0, len(texts), 400), rng.integers(0, 30, 400)
    whole = D.earlier_windows(texts, kind, docs)
    held = {}
    for k, d in zip(kind, docs):
        for o in range(len(texts[k]) - 49):
            w = texts[k][o:o + 50]
            held[w] = min(held.get(w, 99), d)
    for k, d, m in zip(kind, docs, whole.tolist()):
        assert m == sum(1 << o for o in range(len(texts[k]) - 49) if held[texts[k][o:o + 50]] < d)
    monkeypatch.setattr(D, "SUFFIXES", 100)
    assert np.array_equal(D.earlier_windows(texts, kind, docs), whole)


def test_cut_repeats(spark, odd_docs, no_docs):
    cut = D.cut_repeats(odd_docs)
    assert cut.columns == odd_docs.columns and cut.count() == odd_docs.count()
    by_id = {r.doc_id: r for r in cut.collect()}
    assert by_id[3].text == "word " * 30000 and by_id[8].text == "end" or by_id[8].text.endswith("end")
    assert by_id[11].text == "Ünïcödé 你好 😀" and by_id[5].kept == "k"
    passage = "é" * 60
    got = D.cut_repeats(spark.createDataFrame([(1, "a" + passage), (2, passage[:30] + "ü" * 3)], "doc_id long, text string"))
    # the first byte of the first ü ends a repeated string: the rest of that character goes too
    assert {r.doc_id: r.text for r in got.collect()} == {1: "a" + passage, 2: "üü"}
    assert D.cut_repeats(no_docs).count() == 0 and D.repeat_report(no_docs).count() == 0


def test_cut_repeats_keeps_replacement_characters_of_the_text(spark):
    passage = "é" * 60
    got = D.cut_repeats(spark.createDataFrame([(1, "a" + passage), (2, passage[:30] + "ü\ufffdü")], "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == {1: "a" + passage, 2: "\ufffdü"}


@pytest.mark.parametrize("name", ["op8_simhash", "op10_suffix_dedup"])
def test_queries_against_brute_force(spark, name):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = REGISTRY[name][0](spark, SF_SMALL).collect()
    assert len(got) == len(rows)
    if name == "op8_simhash":
        fp = {i: brute_fingerprint(t) for i, t in rows}
        assert {r.doc_id: int(r.fingerprint, 16) for r in got} == fp
        root = {i: i for i in fp}
        for a in fp:  # the smallest id reachable: the smaller root takes the other's members
            for b in fp:
                if a < b and (fp[a] ^ fp[b]).bit_count() <= 2 and root[a] != root[b]:
                    low, high = sorted((root[a], root[b]))
                    root = {i: low if r == high else r for i, r in root.items()}
        assert {r.doc_id: r.component_id for r in got} == root
    else:
        want = {i: (n, sum(e - f for f, e in s), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in brute_repeats(rows)}
        assert {r.doc_id: tuple(r[1:]) for r in got} == want

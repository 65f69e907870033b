"""Token files, byte-level BPE and packing: exact round trips against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from envmon.llm import byte_bpe as B
from envmon.llm import packing as K
from envmon.llm import token_orc as O
from envmon.llm.queries import REGISTRY
from envmon.llm.words import WordEncoder, read_vocabulary
from envmon.session import new_path
from tests.conftest import SF_SMALL

WORDS, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORDS)
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


TEXTS = ["Hello, wörld!! x.y  a\n b 12 <|endoftext|> <|ENDOFTEXT|> ÉCOLE it's", "", " ", "Σίσυφος ΟΔΟΣ.", "a\x1cb\x1d c",
         "İstanbul ẞ ǅ", "TAKSİ, gel", "J\u030c x", "H\u0331! W\u030a.", "\u0958. a", "\ufb1d, b", "ﬁ. ﬂ,", "\u212a. \u212b,", "ſ. ı;", "e\u0301 café. x", "a\xa0b c\x85d", "你好。世界 abc你", "😀😀 !!. foo.) \"bar,\" don't. D'OR", "x" * 500, "Ab. ab. AB"]


def test_word_encoder_is_the_library(library):
    e = WordEncoder(read_vocabulary(WORDS))
    rng = random.Random(1)
    made = ["".join(rng.choice("aB cé.,'s1\n\t\x1c!Σ\u0301") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for t in TEXTS + made:
        assert e.encode(t) == library(t)[:-1].tobytes(), repr(t)


def test_word_encoder_on_letters_that_change_when_folded(library):
    e = WordEncoder(read_vocabulary(WORDS))
    rng = random.Random(2)
    letters = "aBIiJHTWYſ\u212a\u212bİıΣσςßẞǅﬁéÉ\u0301\u0307\u030c\u0331\u0345\u0308\u0958\ufb1d\u093c你😀"
    for _ in range(20000):
        t = "".join(rng.choice(letters + ".,;:!?'\"-() \n\t1½Ⅷ\u200b\xad\u2028\x1c") for _ in range(rng.randint(1, 14)))
        assert e.encode(t) == library(t)[:-1].tobytes(), repr(t)


def test_word_memo_is_bounded(library, monkeypatch):
    import envmon.llm.words as W
    monkeypatch.setattr(W, "MEMO_PARTS", 5)
    e = W.WordEncoder(read_vocabulary(WORDS))
    text = "one two. three, four five six! seven eight nine ten one two"
    assert e.encode(text) == library(text)[:-1].tobytes() and len(e) <= 5


def test_orc_round_trip(spark, library, odd_docs, no_docs):
    path = new_path(spark, "test-orc")
    O.write(odd_docs, path, WORDS)
    rows = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd_docs.collect())
    got = O.read_report(spark, path).collect()
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (len(library(t)), zlib.crc32(library(t).tobytes())) for _, _, t in rows)
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0] + [r.n_tokens for r in order])[:-1].tolist()
    assert [r.doc_id for r in order] == [i if known else None for known, i, _ in rows]
    some = O.read(spark, path, [7, 11])
    assert sorted(r.doc_id for r in some.collect()) == [7, 7, 11]
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()
    empty = new_path(spark, "test-orc")
    O.write(no_docs, empty, WORDS)
    assert O.read_report(spark, empty).count() == 0


def test_orc_files_have_run_length_integers_row_index_and_bloom_filters(spark):
    path = new_path(spark, "test-orc")
    O.write(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), path, WORDS)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    file = next(f for f in spark.read.orc(path).inputFiles())
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(file), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == O.ROW_GROUP and reader.getStripes().size() >= 1
    stripe = reader.rows().readStripeFooter(reader.getStripes().get(0))
    kinds = {(s.getColumn(), s.getKind().toString()) for s in stripe.getStreamsList()}
    assert (1, "BLOOM_FILTER_UTF8") in kinds and (1, "ROW_INDEX") in kinds
    assert all(stripe.getColumns(i).getKind().toString() == "DIRECT_V2" for i in (1, 2, 3, 4, 5, 6))  # run-length, version 2


def test_orc_query(spark, library):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    got = {r.doc_id: r for r in REGISTRY["op5_token_orc"][0](spark, SF_SMALL).collect()}
    start = 0
    for i, t in docs:
        ids = library(t)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


# byte-level BPE --------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(RANKS), special_tokens={})


BYTE_TEXTS = ["", None, " ", "  ", "   x", "a\n \nb", "a  b   c", "x \n", "\n\n b", " a", "a ", "it's 'sam !!'s", "a\x1cb\x1d c \x1e",
              "a\xa0 b", "a\u3000 b ", "é É 你好 12 345", "😀 😀", "a\t b", "\r\n \r\n x", "'re 're''ll", " \n\n  \t z", "<|endoftext|>"]


def test_byte_bpe_is_the_library(spark, tik):
    rng = random.Random(3)
    texts = BYTE_TEXTS + ["".join(rng.choice(" \n\t\xa0ab1'!sé\u3000") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(3)
    rows = {r.doc_id: r for r in B.decode(B.encode(df, RANKS, P.PATTERN), RANKS).collect()}
    for i, t in enumerate(texts):
        assert rows[i].ids == tik.encode_ordinary(t or "") and bytes(rows[i].decoded) == (t or "").encode()


def test_byte_bpe_in_many_blocks(spark, tik, odd_docs, no_docs, monkeypatch):
    import types
    from functools import partial
    small = types.FunctionType(B._explode.__code__, dict(B._explode.__globals__, BLOCK_BYTES=1), "small")
    monkeypatch.setattr(B, "_explode", lambda batches, pattern: small(batches, pattern))
    want = [(r.doc_id, tik.encode_ordinary(r.text or "")) for r in odd_docs.collect()]
    for group_blocks, buckets in ((256, 4096), (1e-3, 3)):  # one group of blocks; dozens of groups and few buckets
        monkeypatch.setattr(B, "GROUP_BLOCKS", group_blocks)
        monkeypatch.setattr(B, "MOST_BUCKETS", buckets)
        got = B.encode(odd_docs, RANKS, P.PATTERN).collect()
        assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), x) for i, x in want)
    assert B.encode(no_docs, RANKS, P.PATTERN).count() == 0
    assert B.digest(B.encode(no_docs, RANKS, P.PATTERN), RANKS).count() == 0


def test_decoding_odd_ids(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.decoded) for r in B.decode(df, RANKS).collect()}[1] == b""
    with pytest.raises(Exception, match="not in the vocabulary|out of bounds"):
        B.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>"), RANKS).collect()


def test_byte_bpe_query(spark, tik):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = REGISTRY["op6_byte_bpe"][0](spark, SF_SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = tik.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# packing ---------------------------------------------------------------------------------------

def check_packing(pieces, docs):
    """docs: list of (doc_id, ids); every id in exactly one piece, sequences gapless, little padding."""
    by_seq, total = {}, sum(len(i) for _, i in docs)
    assert sum(p.length for p in pieces) == total and all(p.length > 0 for p in pieces)
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append(p)
    padding = 0
    for s in by_seq.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == np.cumsum([0] + [p.length for p in s])[:-1].tolist()
        n = sum(p.length for p in s)
        assert n <= 4096 and n <= s[0].capacity
        padding += 0 if n & (n - 1) == 0 else 4096 - n
    assert padding <= 0.01 * total
    return by_seq


def test_packing_query(spark, library):
    docs = [(r.doc_id, library(r.text)) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = REGISTRY["op9_packing"][0](spark, SF_SMALL).collect()
    check_packing(got, docs)
    ids = dict(docs)
    at = dict.fromkeys(ids, 0)
    for p in sorted(got, key=lambda p: (p.doc_id, p.start)):
        assert p.start == at[p.doc_id] and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start:p.start + p.length].tobytes())
        at[p.doc_id] += p.length


def test_packer_fills_windows_and_keeps_every_token():
    rng = random.Random(2)
    sizes = [rng.choice([1, 2, 511, 512, 513, 1024, 4095, 4096, 4097, 9000, rng.randint(1, 3000)]) for _ in range(3000)]
    p = K.Packer()
    for i, n in enumerate(sizes):
        p.add(i, n)
        if i % 500 == 0:
            p.pack()
    p.finish()
    seen = [np.zeros(n, int) for n in sizes]
    for capacity, members in p.sequences:
        assert sum(m[2] for m in members) == capacity and capacity <= 4096
        for row, at, n in members:
            seen[row][at:at + n] += 1
    assert all((s == 1).all() for s in seen)
    assert sum(1 for c, _ in p.sequences if c < K.TIERS[0]) <= 9  # only the last few are shorter than the tiers
    cut = sum(len(m) for _, m in p.sequences) - len(sizes)
    assert cut < 1.2 * len(sizes)


def test_step_groups_are_balanced(spark):
    got = K.pack(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").limit(3000).coalesce(1), WORDS).select(
        "step_id", "sequence_id", "capacity").distinct().groupBy("step_id").agg(F.sum("capacity").alias("n")).collect()
    loads = sorted(r.n for r in got)
    assert len(loads) > 3 and loads[-1] - loads[1] <= 2 * 4096  # the first may be the rest of the task


def test_packing_odd_rows(spark, library, odd_docs, no_docs):
    got = K.pack(odd_docs, WORDS).collect()
    check_packing(got, [(r.doc_id, library(r.text)) for r in odd_docs.collect()])
    assert K.pack(no_docs, WORDS).count() == 0 and K.digest(K.pack(no_docs, WORDS)).count() == 0

"""The corpus pipeline against a brute-force version of its stages, and with odd rows."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from envmon.llm import quality as Q
from envmon.llm import suffix_dedup as D
from envmon.llm.queries import quality_model
from tests.conftest import SF_SMALL
from tests.llm.test_dedup_operators import brute_fingerprint, brute_repeats


def fragments_dropped(b: bytes) -> str:
    return b.decode("utf-8", "ignore")


def brute(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality_model(spark, sf_dir, docs)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    raw = [t.encode() for _, t in rows]
    tf = Q.term_frequencies(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in raw])]))
    rows = [r for r, s in zip(rows, model.score(tf)) if s >= 0.7]
    last = {}
    for i, t in rows:
        last[t] = max(i, last.get(t, -1))
    rows = [(i, t) for i, t in rows if last[t] == i]
    fp = {i: brute_fingerprint(t) for i, t in rows}
    kept = []
    for i, t in rows:
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            new = {j for j in fp if j not in seen and (fp[j] ^ fp[x]).bit_count() <= 2}
            seen |= new
            todo += new
        if min(seen) == i:
            kept.append((i, t))
    return {i: fragments_dropped(k) for i, _, _, k in brute_repeats(kept)}


def test_run_against_brute_force(spark):
    want = brute(spark, SF_SMALL)
    got = corpus_pipeline.run(spark, SF_SMALL).collect()
    from tokenizers import Tokenizer
    import public_tokenizers
    import zlib
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in want.items()}
    assert {p.doc_id for p in got} == set(want)
    assert sum(p.length for p in got) == sum(len(x) // 4 for x in ids.values())
    assert all(p.ids_crc32 == zlib.crc32(ids[p.doc_id][4 * p.start:4 * (p.start + p.length)]) for p in got)


def test_stages_keep_the_columns_and_take_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF_SMALL)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).count() >= docs.limit(1).count()


def test_stage_rows(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumn("n_chars", F.lit(-1).cast("bigint"))
    out = corpus_pipeline.STAGES[3][1](spark, docs, SF_SMALL)
    assert out.where("n_chars <> length(text)").count() == 0 and out.count() == docs.count()
    assert D.LENGTH == 50 and len(corpus_pipeline.STAGES) == 5

"""Filter audit, fill-in-middle and chat format against plain versions, with odd rows of every kind."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from envmon.llm import chat_format as C
from envmon.llm import filter_audit as A
from envmon.llm import fim as M
from envmon.llm.queries import REGISTRY
from tests.conftest import SF_SMALL

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# -- filter audit ----------------------------------------------------------------
def mask_of(text, copy):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            bool(re.search(r"[#$%&*|]", text)), copy]


def brute_audit(rows, labels):
    """rows (doc_id, part, text), labels (doc_id, quality, toxic): every document goes through every order."""
    docs, out = [], {}
    for i, part, text in rows:
        text = text or ""
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, _, t in rows)
        good, toxic = (max([int(x[k] == 1) for x in labels if x[0] == i and i is not None], default=0) for k in (1, 2))
        docs.append((part or "", mask_of(text, copy), good, toxic))
    for part in {d[0] for d in docs}:
        shapley = [0] * 5
        for order in itertools.permutations(range(5)):
            here, name = [d for d in docs if d[0] == part], "".join("ABCDE"[x] for x in order)
            for step, f in enumerate(order):
                gone = [d for d in here if d[1][f]]
                here = [d for d in here if not d[1][f]]
                failing = [d for d in docs if d[0] == part and d[1][f]]
                shapley[f] += len(gone)
                out[part, name, step + 1] = [len(here), len(gone), len(failing) - len(gone), sum(sum(d[1]) == 1 for d in failing),
                                             sum(d[2] for d in gone), sum(d[3] for d in gone), f]
        for key, v in out.items():
            if key[0] == part:
                v[6] = shapley["ABCDE".index(key[1][key[2] - 1])]
    return out


AUDIT_ROWS = "doc_id long, source string, text string, part string, mask string, n long, rank int, first int"


def audit_table(spark, rows):
    return spark.createDataFrame([(*r, "p", "m", 1, 2, 3) for r in rows], AUDIT_ROWS)


def test_audit_is_every_document_through_every_order(spark):
    rng, long_ = random.Random(3), " ".join(f"w{i}" for i in range(210))
    texts = [None, "", "A B", long_, long_ + " $", "x " * 250, "x " * 250 + "#", "SHOUT " * 3, long_.upper(), "a\x0bb\x1cc d"]
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, 6, 7, 8, 9]), rng.choice([None, "", "s", "s", "t"]), rng.choice(texts)) for _ in range(60)]
    labels = [(1, 1, 0), (1, 0, 1), (2, 0, 1), (3, 1, None), (None, 1, 1), (99, 1, 1), (5, None, 1)]
    got = A.report(audit_table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute_audit(rows, labels)
    assert len(got) == len(want) == 600 * len({r[1] or "" for r in rows})
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == want


def test_audit_of_nothing_and_of_other_filters(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.report(audit_table(spark, []), none).count() == 0
    counts = spark.createDataFrame([("p", 0, 5, 0, 0), ("p", 3, 2, 1, 0), ("p", 4, 1, 0, 1)], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in A.audit(counts, "XYZ").collect()}
    assert len(got) == 18 and got["YXZ", 1] == (6, 2, 0, 6) and got["YXZ", 2] == (6, 0, 2, 6) and got["ZXY", 1] == (7, 1, 0, 6)
    with pytest.raises(ValueError):
        A.audit(counts, "BA")


def test_ranks_are_lexicographic_and_intervals_cover_each_order_once():
    orders = list(itertools.permutations(range(5)))
    assert [A.lehmer_rank(p, 5) for p in orders] == list(range(120))
    spans = A.removal_intervals(5)
    for mask in range(1, 32):
        hit = np.zeros(120, int)
        for m, step, f, first, last in spans:
            if m == mask:
                hit[first:last] += 1
                assert all(orders[r][step - 1] == f and not any(mask >> x & 1 for x in orders[r][:step - 1]) for r in range(first, last))
        assert (hit == 1).all()


# -- fill-in-middle ----------------------------------------------------------------
def plain_fim(doc_id, text):
    text = text or ""
    h = sha("1:" + ("" if doc_id is None else str(doc_id)))
    a, b, c, d = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return n, "plain", None, None, text
    i, j = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = text[:i], text[i:j], text[j:]
    return (n, "spm", i, j - i, f"<S>{s}<P>{p}<M>{m}") if d % 100 < 20 else (n, "psm", i, j - i, f"<P>{p}<S>{s}<M>{m}")


def test_fim_of_odd_texts(spark, odd_docs, no_docs):
    rng = random.Random(5)
    texts = ["<P>", "a<S", ">b<", "x" * 5000 + "<M>" + "y" * 3000, "é😀你" * 4000, "<" * 9000, "P>" * 700, "a", "\u0000b", "shared passage " * 3000]
    texts += ["".join(rng.choice("ab<PSM>é😀\n") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)]
    extra = spark.createDataFrame([(i, t, "f", 1, "o") for i, t in rows], "doc_id long, text string, form string, n int, output string")
    for df in (extra, odd_docs):
        made = M.transform(df).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
        want = sorted((r.doc_id is None, r.doc_id or 0, *plain_fim(r.doc_id, r.text), r.text or "") for r in df.collect())
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made) == want
    assert M.transform(no_docs).count() == 0


def test_chunks_are_whole_characters_and_shared(monkeypatch):
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdefgh é你😀") for _ in range(9000))
    one, two = ("intro " * 40 + passage).encode(), ("other start " * 99 + passage + " end").encode()
    cut = []
    for raw in (one, two):
        ends = M.chunk_ends(np.frombuffer(raw, np.uint8))
        assert ends[-1] == len(raw) and max(np.diff([0, *ends])) <= M.LONGEST_CHUNK
        cut.append({raw[a:b] for a, b in zip([0, *ends], ends)})
        assert all(c.decode() for c in cut[-1])
    assert len(cut[0] & cut[1]) > 0.8 * len(cut[0])
    memo = M.ChunkMemo(most=3000)
    for raw in (one, two, one):
        t = M.Chunked(np.frombuffer(raw, np.uint8), memo)
        assert t.length == len(raw.decode()) and memo.held <= 3000
        assert all(t.byte_at(k) == len(raw.decode()[:k].encode()) for k in range(0, t.length + 1, 97))


def test_markers_across_chunks(monkeypatch):
    monkeypatch.setattr(M, "LONGEST_CHUNK", 5)
    for text in ("aaaa<P>b", "aaa<S>", "aa<M>aaaa<", "aaaa<Paaa>", "aaaa<", "ab<P" + ">" * 9):
        data = np.frombuffer(text.encode(), np.uint8)
        assert M.Chunked(data, M.ChunkMemo()).marked == any(m in text for m in ("<P>", "<S>", "<M>")), text


def test_fim_query_is_the_plain_version(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    want = {r.doc_id: (*(w := plain_fim(r.doc_id, r.text))[:4], sha(w[4]), sha(r.text or "")) for r in docs}
    assert {r.doc_id: tuple(r)[1:] for r in REGISTRY["op12_fill_in_middle"][0](spark, SF_SMALL).collect()} == want


# -- chat format ------------------------------------------------------------------
CONTROLS = ["<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"]
CHAT = "conv_id long, turn long, role string, text string, stretch string, formatted string, turns string, open string"


def by_conversation(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    return {c: [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=order)] for c in {r[0] for r in rows}}


def plain_reader(text):
    """The turns of a formatted conversation by a hand-written scanner."""
    out, at = [], 0
    while at < len(text):
        start = next(s for s in ("<<SYS>>\n", "[INST] ", "<s> ", "[ROLE] ") if text.startswith(s, at))
        end = {"<<SYS>>\n": "\n<</SYS>>", "[INST] ": " [/INST]", "<s> ": " </s>", "[ROLE] ": " [/ROLE]"}[start]
        to = text.index(end, at + len(start))
        inner = text[at + len(start):to]
        assert not any(c in inner for c in CONTROLS)
        role = {"<<SYS>>\n": "system", "[INST] ": "user", "<s> ": "assistant"}.get(start)
        if role is None:
            role, inner = inner.split("\n", 1)
        out.append((role, re.sub(r"([<\[])\\(?=\\*(?:(?<=<\\)(?:\\*)(?:</?SYS>>|/?s>)|(?<=\[\\)(?:\\*)/?(?:INST|ROLE)\]))", r"\1", inner)))
        at = to + len(end)
    return out


def hostile_rows():
    rng = random.Random(11)
    bits = CONTROLS + ["<\\s>", "<\\\\/s>", "[\\INST]", "<", "[", "\\", "s>", "/s>", "INST]", " ", "\n", "x", "é😀", "<<", "[\\\\/ROLE]", "<\\<SYS>>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "a]b\nc", None]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9))))
            for c in range(120) for t in range(rng.randint(1, 7))]
    rows += [(200, t, "assistant" if t % 2 else "user", f"turn {t}" + ("</s>" if t == 150 else "")) for t in range(300)]
    rows += [(201, None, "user", None), (201, 5, None, "b"), (201, 5, "user", "a"), (201, 5, "user", "a"), (201, -3, "system", "")]
    rows += [(None, 0, "user", "lost"), (None, 1, "assistant", "word " * 40000), (202, 0, "assistant", "</s>[INST] ok [/INST]")]
    return rows


def test_chat_round_trip_of_hostile_texts(spark):
    rows = hostile_rows()
    table = spark.createDataFrame([(*r, "s", "f", "t", "o") for r in rows], CHAT)
    parts = C.format_conversations(table).collect()
    want = by_conversation(rows)
    assert max(p.n_turns for p in parts) <= C.STRETCH and sum(p.conv_id == 200 for p in parts) == 5
    assert {p.stretch for p in parts if p.conv_id == 200 and p.escaped} == {2}
    for conv, turns in want.items():
        mine = sorted((p for p in parts if p.conv_id == conv), key=lambda p: (p.stretch is not None, p.stretch or 0))
        whole = "".join(p.formatted for p in mine)
        if not any(r not in ("user", "assistant", "system", "tool") for r, _ in turns):
            assert [r for r, _ in plain_reader(whole)] == [r for r, _ in turns]
        spans = [p.formatted[s.start:s.end] for p in mine for s in p.loss]
        said = [t for r, t in turns if r == "assistant"]
        assert len(spans) == len(said) and all(s == t or "\\" in s for s, t in zip(spans, said))
    got = {r.conv_id: r for r in C.digest(C.format_conversations(table)).collect()}
    assert set(got) == set(want)
    for conv, turns in want.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learned), sha(learned))
        assert got[conv].formatted_chars == sum(len(p.formatted) for p in parts if p.conv_id == conv)
    assert C.digest(C.format_conversations(table.limit(0))).count() == 0


def test_parser_refuses_what_is_no_conversation(spark):
    bad = ["x", "[INST] a [/INST]x", "x[INST] a [/INST]", "[INST] a </s>", "[INST] a", "[INST]a[/INST]", "[INST] [/INST]", "[/INST] a [INST]",
           "<s> a <s> b </s> </s>", "[ROLE] tool [/ROLE]", " "]
    good = ["", "[INST] a [/INST]", "[INST]  [/INST]<s> \n </s>", "[ROLE] a%0Ab\nt [/ROLE]", "<<SYS>>\n\n<</SYS>>"]
    rows = C.with_turns(spark.createDataFrame([(t,) for t in bad + good], "t string"), "t", "turns").collect()
    assert {r.t for r in rows if r.turns is None} == set(bad)
    assert {r.t: [tuple(x) for x in r.turns] for r in rows if r.turns is not None} == {
        "": [], "[INST] a [/INST]": [("user", "a")], "[INST]  [/INST]<s> \n </s>": [("user", ""), ("assistant", "\n")],
        "[ROLE] a%0Ab\nt [/ROLE]": [("a\nb", "t")], "<<SYS>>\n\n<</SYS>>": [("system", "")]}


def test_escaping_is_undone(spark):
    rng = random.Random(13)
    bits = CONTROLS + ["<", "[", "\\", "s>", "/s>", "<SYS>>", "INST]", "/ROLE]", "x", "<\\", "[\\"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select(
            "t", C.escape(F.col("t")).alias("e"), C.unescape(C.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in CONTROLS), r.t


def test_chat_query_has_the_hostile_conversation_and_no_python(spark):
    got = REGISTRY["op13_chat_format"][0](spark, SF_SMALL)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    said = "</s>[INST] ok [/INST]"
    row = got.where("conv_id = -7").first()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(said), sha(said))
    assert row.turns_sha256 == sha(f"user\n{said}\nassistant\n{said}\n") and row.formatted_chars == 2 * (len(said) + 3) + 24

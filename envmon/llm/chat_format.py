r"""Conversations as training text: a template, its parser, and a loss mask.

Turns are written one after the other, each between an opening and a closing
control string:

    <<SYS>>\ntext\n<</SYS>>   [INST] text [/INST]   <s> text </s>   [ROLE] name\ntext [/ROLE]

for system, user, assistant and any other role, whose name is URL-encoded.  The
grammar is deterministic: the control strings of a formatted text come in pairs that
open and close one turn each, and nothing stands between two turns.

Round trip: a conversation is written as it is and parsed again.  Where the
recovered turns are not the source's, its texts are escaped and it is written and
parsed anew.  Escaping puts a backslash behind the first character of
everything that looks like a control string, with any number of backslashes there
already; the parser takes one away.  An escaped text holds no control string, and
unescaping gives back the text, so the second attempt is identical; should it not be,
the query stops with an error.  Texts without such strings stay as they are.

All of it is DataFrame code.  Turns are grouped by conversation and stretch of
turn numbers (:data:`STRETCH`), so a conversation of any number of turns is
written, parsed and compared in parts on many tasks.  Only a digest of a whole
conversation needs its texts in one row.

Defined results: a null text or role counts as empty, a null turn number comes first, a
null conv_id is a conversation of its own.  Rows of equal turn number come by
role, then text; repeated rows are all kept.  An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turn numbers in one part of a conversation.
STRETCH = 64

#: Opening, space around the text, closing, by role; and those of any other role.
TEMPLATE = {"system": ("<<SYS>>", "\n", "<</SYS>>"), "user": ("[INST]", " ", "[/INST]"), "assistant": ("<s>", " ", "</s>")}
OTHER = ("[ROLE]", " ", "[/ROLE]")
LEARNED = "assistant"

#: What follows the first character of a control string, and the control strings: found by their first character.
AFTER_ANGLE, AFTER_SQUARE = r"(?:</?SYS>>|/?s>)", r"/?(?:INST|ROLE)\]"
CONTROL = rf"[<\[](?:(?<=<){AFTER_ANGLE}|(?<=\[){AFTER_SQUARE})"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, rf"<(?=\\*{AFTER_ANGLE})", r"<\\")
    return F.regexp_replace(text, rf"\[(?=\\*{AFTER_SQUARE})", r"[\\")


def unescape(text: Column) -> Column:
    once = F.regexp_replace(text, rf"<\\(?=\\*{AFTER_ANGLE})", "<")
    once = F.regexp_replace(once, rf"\[\\(?=\\*{AFTER_SQUARE})", "[")
    return F.when(text.contains("\\"), once).otherwise(text)


def _by_role(role: Column, known, other: Column) -> Column:
    out = other
    for name, spec in TEMPLATE.items():
        out = F.when(role == name, F.lit(known(spec))).otherwise(out)
    return out


def _written(turns: Column) -> Column:
    """(open, text, close, learned) of each turn."""
    other_open = lambda role: F.concat(F.lit(OTHER[0] + OTHER[1]), F.url_encode(role), F.lit("\n"))
    return F.transform(turns, lambda t: F.struct(
        _by_role(t["role"], lambda s: s[0] + s[1], other_open(t["role"])).alias("open"), t["text"].alias("text"),
        _by_role(t["role"], lambda s: s[1] + s[2], F.lit(OTHER[1] + OTHER[2])).alias("close"),
        (t["role"] == LEARNED).alias("learned")))


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.concat(p["open"], p["text"], p["close"])), "")


def _loss_spans(parts: Column) -> Column:
    """(start, end) in code points of every text to learn, as written."""
    size = lambda c: F.length(c).cast("long")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + size(p["open"])
        end = start + size(p["text"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + size(p["close"])).alias("at"),
                        F.when(p["learned"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])


def with_turns(df: DataFrame, column: str, into: str) -> DataFrame:
    """Adds ``into``: the turns (role, text) of the formatted text in ``column``, unescaped; null if it doesn't follow the grammar.

    Each step is a column of its own, which the next ones read more than once: the text is searched twice, however long the turns' list.
    """
    # what stands before, between and after the control strings; and these
    df = df.withColumns({"_held": F.split(column, CONTROL), "_marks": F.regexp_extract_all(column, F.lit(CONTROL), F.lit(0))})
    df = df.withColumn("_steps", F.zip_with("_marks", F.slice("_held", F.lit(2), F.size("_held")),
                                            lambda c, x: F.struct(c.alias("c"), x.alias("x"))))
    df = df.withColumn("_pairs", F.zip_with(
        F.filter("_steps", lambda _, i: i % 2 == 0), F.filter("_steps", lambda _, i: i % 2 == 1),
        lambda a, b: F.struct(a["c"].alias("open"), a["x"].alias("x"), b["c"].alias("close"), b["x"].alias("between"))))
    specs = [*TEMPLATE.values(), OTHER]

    def follows(t: Column) -> Column:
        ok = F.lit(False)
        for start, space, end in specs:
            ok = ok | ((t["open"] == start) & (t["close"] == end) & t["x"].startswith(space) & t["x"].endswith(space))
        named = (t["open"] != OTHER[0]) | t["x"].contains("\n")
        return F.coalesce(ok & named & (F.length(t["x"]) >= 2) & (t["between"] == ""), F.lit(False))

    def turn(t: Column) -> Column:
        inner = F.substring(t["x"], F.lit(2), F.length(t["x"]) - 2)
        name = F.substring_index(inner, "\n", 1)
        role = F.url_decode(F.when(t["open"] == OTHER[0], name).otherwise(F.lit("")))
        text = F.when(t["open"] == OTHER[0], F.substring(inner, F.length(name) + 2, F.length(inner))).otherwise(inner)
        for known, (start, _, _) in TEMPLATE.items():
            role = F.when(t["open"] == start, F.lit(known)).otherwise(role)
        return F.struct(role.alias("role"), text.alias("text"))

    whole = (F.element_at("_held", 1) == "") & (F.size("_marks") % 2 == 0) & F.forall("_pairs", follows)
    df = df.withColumn("_turns", F.when(whole, F.transform("_pairs", turn)))
    plain = lambda t: F.struct(t["role"].alias("role"), unescape(t["text"]).alias("text"))
    return df.withColumn(into, F.transform("_turns", plain)).drop("_held", "_marks", "_steps", "_pairs", "_turns")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, stretch, n_turns, formatted, loss, escaped): every conversation's parts in training form.

    A conversation is its parts' texts joined in order of ``stretch`` (a null one first).  ``loss`` holds
    the (start, end) code points of the texts to learn within ``formatted``.
    """
    empty = F.lit("")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
                        lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    parts = (conversations.select("conv_id", F.floor(F.col("turn") / STRETCH).cast("long").alias("stretch"), "turn",
                                  F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
             .groupBy("conv_id", "stretch").agg(turns.alias("turns")))
    tried = parts.withColumn("plain", _written(F.col("turns"))).withColumn("formatted", _joined(F.col("plain")))
    tried = with_turns(tried, "formatted", "found").withColumn("escaped", ~F.col("found").eqNullSafe(F.col("turns")))
    again = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escape(t["text"]).alias("text")))
    done = tried.withColumn("parts", F.when(F.col("escaped"), _written(again)).otherwise(F.col("plain")))
    done = with_turns(done.withColumn("second", F.when(F.col("escaped"), _joined(F.col("parts")))), "second", "found")
    same = ~F.col("escaped") | F.col("found").eqNullSafe(F.col("turns"))
    checked = F.when(same, F.coalesce("second", "formatted")).otherwise(
        F.raise_error(F.lit("a formatted conversation does not parse back")))
    return done.select("conv_id", "stretch", F.size("turns").cast("long").alias("n_turns"), checked.alias("formatted"),
                       _loss_spans(F.col("parts")).alias("loss"), "escaped")


def learned_texts(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted parts: turns, checksums of turns and learned texts, sizes."""
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    parts = with_turns(formatted, "formatted", "turns").select(
        "conv_id", "stretch", F.size("turns").cast("long").alias("n_turns"), F.array_join(said, "").alias("said"),
        F.array_join(learned_texts(F.col("formatted"), F.col("loss")), "").alias("learned"),
        F.length("formatted").cast("long").alias("chars"))
    whole = parts.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sum(F.length("learned")).cast("long").alias("loss_chars"),
        F.array_sort(F.collect_list(F.struct("stretch", "said", "learned"))).alias("parts"))
    joined = lambda field: F.sha2(F.array_join(F.transform("parts", lambda p: p[field]), ""), 256)
    return whole.select("conv_id", "n_turns", joined("said").alias("turns_sha256"), "loss_chars",
                        joined("learned").alias("loss_sha256"), "formatted_chars")

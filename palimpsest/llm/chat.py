"""Chat formatting with a loss mask, in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Turns whose lengths are summed one by one before sums of such stretches are.
STRETCH = 256


def escape(text: Column) -> Column:
    """Puts a backslash more between ``<`` and ``|``, so that no control string is left; ``unescape`` takes it away."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _starts(df: DataFrame, lengths: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of all earlier entries of the array column ``lengths`` for each one."""
    size = F.size(lengths)
    stretches = F.when(size > 0, F.transform(F.sequence(F.lit(0), F.expr(f"(size({lengths}) - 1) div {STRETCH}")), lambda c: F.slice(lengths, c * STRETCH + 1, STRETCH))).otherwise(F.array())
    running = lambda xs: F.aggregate(xs, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    df = df.withColumn("_inner", F.transform(stretches, running))
    df = df.withColumn("_outer", F.aggregate("_inner", F.array(F.lit(0).cast("long")), lambda acc, xs: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(xs, -1)))))
    whole = F.flatten(F.transform("_inner", lambda xs, c: F.transform(F.slice(xs, 1, F.size(xs) - 1), lambda x: x + F.get("_outer", c))))
    return df.withColumn(name, whole).drop("_inner", "_outer")


def _merged(df: DataFrame, turns: str, name: str) -> DataFrame:
    """``df`` with ``name``: the blocks (role, texts) of the array column ``turns``, whose neighbours of one role are folded
    into one; in stretches first, so that a long conversation's fold does not copy all blocks at each turn."""
    kind = "array<struct<role:string,texts:array<string>>>"

    def joined(acc: Column, blocks: Column) -> Column:
        last, first = F.element_at(acc, -1), F.get(blocks, F.lit(0))
        both = F.struct(last.role.alias("role"), F.concat(last.texts, first.texts).alias("texts"))
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(both), F.slice(blocks, F.lit(2), F.size(blocks)))
        return F.when((F.size(acc) > 0) & (last.role == first.role), grown).otherwise(F.concat(acc, blocks))

    none = F.array().cast(kind)
    stretches = F.transform(F.sequence(F.lit(0), F.expr(f"(size({turns}) - 1) div {STRETCH}")), lambda c: F.slice(turns, c * STRETCH + 1, STRETCH))
    df = df.withColumn("_folded", F.transform(stretches, lambda s: F.aggregate(s, none, lambda acc, t: joined(acc, F.array(t)))))
    return df.withColumn(name, F.aggregate("_folded", none, joined)).drop("_folded")


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): each conversation of ``turns`` (conv_id, turn, role, text) as one string.

    Turns are sorted by turn, then role and text, which also settles ties and repeated rows (all are kept).  Adjacent
    turns of one role become one block: start mark, role, line feed, their texts with a separator mark between, end
    mark, line feed.  Control strings inside texts are escaped reversibly; roles are written as in URLs.  Null texts
    and roles are empty, null turns come first, rows with a null conv_id are one conversation, and other columns are
    not read; an empty table gives none.  ``loss`` holds (start, length) in code points of ``formatted`` for each
    turn of ``loss_role``, its escaped text alone.

    One shuffle by conv_id; a conversation has to fit into one row, as its string does.
    """
    struct = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(struct)).alias("turns"))
    chats = _merged(chats.withColumn("turns", F.transform("turns", lambda t: F.struct(t.role.alias("role"), F.array(escape(t.text)).alias("texts")))), "turns", "blocks")
    texts = lambda f: F.flatten(F.transform("blocks", lambda b: F.transform(b.texts, lambda t, i: f(b, t, i))))
    head = lambda b, t, i: F.when(i > 0, F.lit(SEPARATOR)).otherwise(F.concat(F.lit(START), F.url_encode(b.role), F.lit("\n")))
    tail = lambda b, t, i: F.when(i + 1 < F.size(b.texts), F.lit("")).otherwise(F.lit(f"{END}\n"))
    chats = chats.withColumns({"roles": texts(lambda b, t, i: b.role), "bodies": texts(lambda b, t, i: t), "heads": texts(head), "tails": texts(tail)})
    chats = chats.withColumn("pieces", F.zip_with(F.zip_with("heads", "bodies", lambda a, b: F.concat(a, b)), "tails", lambda a, b: F.concat(a, b)))
    chats = chats.withColumn("lengths", F.transform("pieces", lambda p: F.length(p).cast("long")))
    chats = _starts(chats, "lengths", "starts")
    spans = F.transform("roles", lambda r, i: F.struct(r.alias("role"), (F.get("starts", i) + F.length(F.get("heads", i))).alias("start"), F.length(F.get("bodies", i)).cast("long").alias("length")))
    loss = F.transform(F.filter(spans, lambda s: s.role == loss_role), lambda s: F.struct(s.start.alias("start"), s.length.alias("length")))
    return chats.select("conv_id", F.array_join("pieces", "").alias("formatted"), loss.alias("loss"))


def parse_chats(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, as they were."""
    blocks = F.split(formatted, r"<\|im_start\|>", -1)
    blocks = F.slice(blocks, F.lit(2), F.size(blocks))
    body = lambda b: F.regexp_extract(b, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1)
    return F.flatten(F.transform(blocks, lambda b: F.transform(F.split(body(b), r"<\|im_sep\|>", -1), lambda p: F.struct(F.url_decode(F.substring_index(b, "\n", 1)).alias("role"), unescape(p).alias("text")))))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s.start + 1).cast("int"), s.length.cast("int")))), "")

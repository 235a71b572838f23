"""All matches of a pattern with their offsets, and splicing, in column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What marks a match while it is cut out, and stands for nothing else then.
_OPEN, _GROUP, _CLOSE = "\u0001", "\u0003", "\u0002"


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, text>> of a pattern's matches, or of one group in them; ends are exclusive.

    One pass of the pattern puts marks around its matches, and the pieces between the marks tell where each one begins.
    A group is looked for in its match, the last time it occurs, as a label may stand before it but nothing after.
    The three control characters that serve as marks read as blanks.
    """
    kind = "array<struct<start:int,end:int,text:string>>"
    clean = F.translate(text, _OPEN + _GROUP + _CLOSE, "   ")
    shown = f"{_OPEN}$0{_GROUP}${group}{_CLOSE}" if group else f"{_OPEN}$0{_CLOSE}"
    pieces = F.split(F.regexp_replace(clean, F.lit(pattern), F.lit(shown)), f"[{_OPEN}{_GROUP}{_CLOSE}]", -1)
    turns = 3 if group else 2
    whole = f"struct<at:int,last:struct<start:int,end:int,text:string>,out:{kind}>"
    zero = F.struct(F.lit(0).alias("at"), F.lit(None).cast("struct<start:int,end:int,text:string>").alias("last"), F.array().cast(kind).alias("out")).cast(whole)

    def step(acc: Column, x: Column) -> Column:
        piece, turn = x.piece, x.i % turns
        span = F.struct(acc.at.alias("start"), (acc.at + F.length(piece)).alias("end"), piece.alias("text"))
        if not group:
            out = F.when(turn == 1, F.concat(acc.out, F.array(span))).otherwise(acc.out)
            return F.struct(span.getField("end").alias("at"), acc.last.alias("last"), out.alias("out")).cast(whole)
        at = acc.last.end - F.length(F.call_function("substring_index", acc.last.text, piece, F.lit(-1))) - F.length(piece)
        inner = F.struct(at.alias("start"), (at + F.length(piece)).alias("end"), piece.alias("text"))
        out = F.when((turn == 2) & (piece != ""), F.concat(acc.out, F.array(inner))).otherwise(acc.out)
        return F.struct(F.when(turn == 2, acc.at).otherwise(span.getField("end")).alias("at"), F.when(turn == 1, span).otherwise(acc.last).alias("last"), out.alias("out")).cast(whole)

    numbered = F.transform(pieces, lambda piece, i: F.struct(piece.alias("piece"), i.alias("i")))
    return F.coalesce(F.aggregate(numbered, zero, step, lambda acc: acc.out), F.array().cast(kind))


def splice(text: Column, entities: Column, shown) -> Column:  # noqa: ANN001
    """The text with each entity (start, end, ...) replaced by ``shown(entity)``; one that overlaps an earlier one is left out."""
    ordered = F.array_sort(entities)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        piece = F.concat(acc.out, F.substr(text, acc.at + 1, e.start - acc.at), shown(e))
        fits = e.start >= acc.at
        return F.struct(F.when(fits, e.end).otherwise(acc.at).alias("at"), F.when(fits, piece).otherwise(acc.out).alias("out"))

    return F.aggregate(ordered, zero, step, lambda acc: F.concat(acc.out, F.substr(text, acc.at + 1, F.length(text))))


def matched(rows: DataFrame, text: str, pattern: str, before: int, after: int) -> DataFrame:
    """The other columns of ``rows`` and, for each match of ``pattern`` in its column ``text``, ``before``, ``match`` and
    ``after``: what was matched, and up to so many characters on both sides.  Rows without a match, and null texts, go.

    One pass of the pattern marks its matches, which may be empty where it only looks ahead or behind; the pieces between
    the marks are cut to what a neighbour needs once, so that the work grows with the text and the matches, not with their
    product.  The marks' two control characters read as another one.
    """
    rest = [c for c in rows.columns if c != text]
    marked = F.regexp_replace(F.translate(text, _OPEN + _CLOSE, _GROUP * 2), F.lit(pattern), F.lit(f"{_OPEN}$0{_CLOSE}"))
    pieces = F.split(marked, f"[{_OPEN}{_CLOSE}]", -1)
    # An array of one, exploded, keeps Spark from working the pieces out anew for each use.
    cut = rows.select(*rest, F.explode(F.array(pieces)).alias("_pieces")).filter(F.size("_pieces") > 1)
    edges = F.struct("_pieces", F.transform("_pieces", lambda p: F.left(p, F.lit(after))).alias("heads"), F.transform("_pieces", lambda p: F.right(p, F.lit(before))).alias("tails"))
    cut = cut.select(*rest, F.explode(F.array(edges)).alias("_p"))

    def seen(i: Column) -> Column:
        # Pieces with an even index are matches; of two neighbours one at least has a character.
        start = F.greatest(i - (2 * before + 2), F.lit(1))
        tail = F.right(F.array_join(F.slice(F.col("_p.tails"), start, i - start), ""), F.lit(before))
        head = F.left(F.array_join(F.slice(F.col("_p.heads"), i + 1, 2 * after + 2), ""), F.lit(after))
        return F.struct(tail.alias("before"), F.element_at(F.col("_p._pieces"), i).alias("match"), head.alias("after"))

    places = F.filter(F.sequence(F.lit(2), F.size("_p._pieces") - 1), lambda i: i % 2 == 0)
    return cut.select(*rest, F.explode(F.transform(places, seen)).alias("_m")).select(*rest, "_m.*")


def stage(df: DataFrame, kept: list[str], **new: Column) -> DataFrame:
    """The columns ``kept`` and ``new`` ones, worked out once for each row: an array of one, exploded, keeps Spark from
    writing their expressions into every place that names them, which lambdas would then work out for each element.
    They stand in a projection of their own, as those inside a generator are interpreted where one of them is a lambda."""
    rows = df.select(*kept, F.struct(*(c.alias(n) for n, c in new.items())).alias("_v"))
    return rows.select(*kept, F.explode(F.array("_v")).alias("_s")).select(*kept, "_s.*")


def dealt(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """``df`` dealt by ``key`` to as many partitions as shuffles have, however few splits its file has.

    The number is given, as adaptive execution would lay small partitions together again, and rows that are small here
    grow to texts; what is grouped or joined by ``key`` later needs no further shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


#: What a text must hold for patterns that need a digit.
DIGIT = r"\p{Nd}"
#: Entries whose sums are run one by one before sums of such stretches are, and matches of a text that are cut out together.
STRETCH, TOGETHER = 256, 16
#: What a mark says of a match's group.
_SAID = f"{_GROUP}[^{_CLOSE}]*"


def _running(xs: Column) -> Column:
    """The sum before each entry, and that of all."""
    return F.aggregate(xs, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def _starts(sizes: Column) -> Column:
    """The sum before each entry of an array that isn't empty, run in stretches."""
    inner = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / STRETCH).cast("int")), lambda c: _running(F.slice(sizes, c * STRETCH + 1, STRETCH)))
    both = F.transform(F.array(inner), lambda xs: F.struct(xs.alias("inner"), _running(F.transform(xs, lambda x: F.element_at(x, -1))).alias("outer")))
    placed = F.transform(both, lambda b: F.flatten(F.transform(b["inner"], lambda xs, c: F.transform(F.slice(xs, 1, F.size(xs) - 1), lambda x: x + F.get(b["outer"], c)))))
    return F.get(placed, F.lit(0))


def scanned(docs: DataFrame, heads: list[Column], patterns: list[tuple[str, int, str | None, str | None]], width: int) -> DataFrame:
    """(doc_id, head, start, end, value, before, after) of all matches of all patterns in ``docs`` (doc_id, text).

    A pattern is (regular expression, the group that is the span, what the span must look like or None, what a text must
    hold to be searched, ``DIGIT``, a string or None); ``heads`` are constant structs that its matches carry.  ``before`` and ``after`` hold up to ``width`` characters beside the span.  A group is
    looked for in its match, the last time it occurs.  Three control characters read as blanks.

    Texts are read once.  Each pattern marks its matches in one pass, and the marked text is split before them.  Up to
    ``TOGETHER`` matches are cut out of the piece of the text that holds them, where what stands before a mark tells its
    place, so that no match is looked for in a text of many.  Expressions of single rows do this, which Spark compiles,
    where lambdas would be interpreted; only the places of pieces of a text with more matches are sums over an array.
    """
    marks, clean = (_OPEN, _GROUP, _CLOSE), F.col("text")
    for mark in marks:
        clean = F.replace(clean, F.lit(mark), F.lit(" "))
    # Few texts hold a mark, and to look for one is cheaper than to replace it.
    clean = F.when(reduce(or_, (F.contains("text", F.lit(mark)) for mark in marks)), clean).otherwise(F.col("text"))
    rows = stage(docs.filter("text is not null").select("doc_id", "text"), ["doc_id"], clean=clean, digit=F.rlike("text", F.lit(DIGIT)))
    every, grouped = [], any(group for _, group, _, _ in patterns)
    for i, (p, group, _, needs) in enumerate(patterns):
        marked = F.regexp_replace("clean", F.lit(p), F.lit(f"{_OPEN}$0{_GROUP}${group}{_CLOSE}" if group else f"{_OPEN}$0{_CLOSE}"))
        marked = marked if needs is None else F.when(F.col("digit") if needs == DIGIT else F.contains("clean", F.lit(needs)), marked)
        every.append(F.struct(F.lit(i).alias("rule"), marked.alias("marked")))
    # Exploded where it is made: Spark infers a filter on the size of an array that is a column, and would run all patterns
    # for that filter too.
    rows = rows.select("doc_id", "clean", F.explode(F.array(*every)).alias("m")).filter(F.contains("m.marked", F.lit(_OPEN)))
    key = ["doc_id", "rule", "clean"]

    def stripped(text: Column) -> Column:
        """A text without marks."""
        text = F.regexp_replace(text, F.lit(_SAID), F.lit("")) if grouped else text
        return F.replace(F.replace(text, F.lit(_CLOSE), F.lit("")), F.lit(_OPEN), F.lit(""))

    # What stands before the first match, and each match with what follows it.
    rows = stage(rows.select("doc_id", "clean", "m.*"), [*key, "marked"], parts=F.split("marked", _OPEN, -1))
    many = F.size("parts") > TOGETHER + 1
    joined = lambda first, n, mark="": F.array_join(F.slice("parts", first + 1, n), mark)
    # Piece c holds the matches from c * TOGETHER + 1 on and the part before them.
    sizes = F.transform(F.sequence(F.lit(0), F.floor((F.size("parts") - 2) / TOGETHER).cast("int")), lambda c: F.length(stripped(joined(c * TOGETHER, F.lit(TOGETHER)))))
    rows = stage(rows, [*key, "marked", "parts"], bases=F.when(many, F.transform(F.array(sizes), _starts).getItem(0)).otherwise(F.array(F.lit(0))))
    rows = rows.select(*key, "marked", "parts", F.posexplode("bases").alias("c", "base"))
    first, most = F.col("c") * TOGETHER, width + 2
    held = F.when(many, F.slice("parts", first + 1, F.lit(TOGETHER + 1))).otherwise(F.col("parts"))
    body = F.when(many, joined(first, F.lit(TOGETHER + 1), _OPEN)).otherwise(F.col("marked"))
    # What stands beside the piece; each part but the last has a character.
    earlier = F.least(first, F.lit(most))
    lead = F.when(first > 0, F.substring(stripped(joined(first - earlier, earlier)), -width, width)).otherwise("")
    tail = F.when(first + TOGETHER + 1 < F.size("parts"), F.left(stripped(joined(first + TOGETHER + 1, F.lit(most))), F.lit(width))).otherwise("")
    rows = stage(rows, [*key, "base"], held=held, body=body, lead=lead, tail=tail, many=many, over=(first > 0).cast("int"))
    key = ["doc_id", "rule"]
    rows = stage(rows, [*key, "base", "held", "body", "lead", "tail", "over"], plain=F.when(F.col("many"), stripped(F.col("body"))).otherwise(F.col("clean")))
    rows = rows.select(*key, "base", "body", "plain", "lead", "tail", "over", F.posexplode("held").alias("m", "part")).filter("m > 0")
    # A mark says the match and, behind it, the group if that is the span.
    said = F.substring_index("part", _CLOSE, 1)
    ahead = F.call_function("substring_index", "body", F.lit(_OPEN), F.col("m"))
    # Each match before this one has two marks, and what they say of a group if its pattern has one; a later piece of a
    # text begins behind the first mark of a match.
    at = F.length(ahead) - 2 * (F.col("m") - 1) - F.col("over")
    if grouped:
        at = F.when(F.col("rule").isin([i for i, (_, group, _, _) in enumerate(patterns) if group]), F.length(stripped(ahead))).otherwise(at)
    cut = {"at": at, "value": F.substring_index(said, _GROUP, -1) if grouped else said}
    whole = {"whole": F.substring_index(said, _GROUP, 1)} if grouped else {}
    rows = stage(rows, [*key, "base", "plain", "lead", "tail"], **cut, **whole).filter("value <> ''")
    for i, (_, _, keep, _) in enumerate(patterns):
        if keep is not None:
            rows = rows.filter((F.col("rule") != i) | F.rlike("value", F.lit(keep)))
    if grouped:
        at = F.col("at") + F.length("whole") - F.length(F.call_function("substring_index", "whole", "value", F.lit(-1))) - F.length("value")
        rows = stage(rows, [*key, "base", "plain", "lead", "tail", "value"], at=F.when(F.col("whole") == F.col("value"), F.col("at")).otherwise(at))
    rows = rows.withColumn("to", F.col("at") + F.length("value"))
    near = F.substr("plain", F.greatest(F.col("at") - width, F.lit(0)) + 1, F.least(F.col("at"), F.lit(width)))
    before = F.when((F.col("at") >= width) | (F.col("lead") == ""), near).otherwise(F.substring(F.concat("lead", near), -width, width))
    follows = F.substr("plain", F.col("to") + 1, F.lit(width))
    after = F.when(F.col("tail") == "", follows).otherwise(F.left(F.concat(follows, F.col("tail")), F.lit(width)))
    head = F.get(F.array(*heads), F.col("rule"))
    return rows.select("doc_id", head.alias("head"), (F.col("base") + F.col("at")).alias("start"), (F.col("base") + F.col("to")).alias("end"), "value", before.alias("before"), after.alias("after"))

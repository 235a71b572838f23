"""Independent checks of redacted documents: what may still be readable, and what may be released."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import validators as V
from palimpsest.functions.spans import DIGIT, matched, scanned, stage
from palimpsest.operators.spatial import box_join, envelope

#: What must not be left in a redacted text (fixed values).
RESIDUAL = {
    "EMAIL_ADDRESS": r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+",
    "PAN_NUMBER": r"(?i)[A-Z]{5}[0-9]{4}[A-Z]",
    "AADHAAR_NUMBER": r"\b\d{4}[ -]?\d{4}[ -]?\d{4}\b",
    "CREDIT_CARD": r"\b(?:\d[ -]*?){13,19}\b",
    "PHONE_NUMBER": r"\b(?:\+?91[-. ]?)?[6789]\d{9}\b",
}


BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


#: White space, also beyond ASCII, and characters that recognition takes for digits or letters (fixed values).
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
FOR_DIGITS, FOR_LETTERS = "OoIiLlSsBbZzGgQq", "01582693"
#: Words that speak for a tax or a citizen number near by (fixed values).
PAN_CONTEXT = ["pan", "permanent", "account", "income", "tax", "incometax", "card", "govt", "india", "holder", "signature"]
AADHAAR_CONTEXT = ["aadhaar", "uid", "uidai", "govt", "india", "unique", "identification", "enrollment", "resident", "meraaadhaar"]
#: How far such words may be, and the longest run of hyphens that still ties a value to what stands behind it.
CONTEXT, HYPHENS = 120, 200


def _spread(*characters: str) -> str:
    """A pattern of characters with any white space between them."""
    return f"{SPACE}*".join(characters)


def _dense(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(SPACE), "")


def _unless_allowed(rows: DataFrame, allowed: DataFrame | None, shown: Column, key: Callable[[Column], Column]) -> DataFrame:
    """Rows (doc_id, ...) whose ``shown`` text is no text of ``allowed`` (doc_id, text), both written by ``key``."""
    if allowed is None:
        return rows
    may = allowed.select(F.col("doc_id").alias("_d"), key(F.col("text")).alias("_v")).distinct()
    return rows.join(may.hint("merge"), (F.col("doc_id") == F.col("_d")) & (key(shown) == F.col("_v")), "left_anti")


def residual_patterns(redacted: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(doc_id, leak_type, text): patterns left in ``redacted`` (doc_id, text): tax numbers in any case that are no part of a
    longer code, and cards, also in groups, only if their check digit is right.  ``allowed`` (doc_id, text) are spans that
    a reviewer rejected, which may stay.  Texts are read once for all patterns."""
    heads = [F.struct(F.lit(kind).alias("leak_type")) for kind in RESIDUAL]
    needs = {"EMAIL_ADDRESS": "@"}
    rows = scanned(redacted.select("doc_id", "text"), heads, [("(?U)" + p, 0, None, needs.get(kind, DIGIT)) for kind, p in RESIDUAL.items()], HYPHENS)
    kind, digits = F.col("head.leak_type"), F.regexp_replace("value", r"(?U)\D", "")
    good = F.when(kind == "PAN_NUMBER", ~V.in_compound(F.col("before"), F.col("after"))).when(kind == "CREDIT_CARD", V.card_valid(digits)).otherwise(True)
    rows = rows.filter(good).select("doc_id", "head.leak_type", F.trim("value").alias("text"))
    return _unless_allowed(rows, allowed, F.col("text"), lambda t: F.lower(F.trim(t)))


def dense_leaks(redacted: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(doc_id, leak_type, text): tax and citizen numbers whose characters are spread by more than two blanks.

    Matches are those of the text without white space, leftmost first, in any case; they are looked for in the text itself,
    with white space between all characters.  A tax number that is a part of a longer code, letters, digits or hyphens with
    these beside it, is none.  ``allowed`` (doc_id, text) are spans that a reviewer rejected, without blanks and case.
    """
    letter, digit, group = "[A-Za-z]", r"\p{Nd}", _spread(*[r"\p{Nd}"] * 4)
    kinds = {"PAN_NUMBER": _spread(*[letter] * 5, *[digit] * 4, letter), "AADHAAR_NUMBER": _spread(group, f"(?:-{SPACE}*)?{group}", f"(?:-{SPACE}*)?{group}")}
    found = None
    for kind, pattern in kinds.items():
        rows = matched(redacted.select("doc_id", "text"), "text", pattern, HYPHENS, HYPHENS)
        if kind == "PAN_NUMBER":
            rows = rows.filter(~V.in_compound(F.col("before"), F.col("after")))
        rows = rows.filter(F.length("match") > F.length(_dense(F.col("match"))) + 2).select("doc_id", F.lit(kind).alias("leak_type"), F.col("match").alias("text"))
        found = rows if found is None else found.union(rows)
    return _unless_allowed(found, allowed, F.col("text"), lambda t: F.replace(F.lower(F.trim(t)), F.lit(" "), F.lit("")))


def visual_candidates(texts: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(doc_id, leak_type, window): what a reader could take for a tax or citizen number in ``texts`` (doc_id, text), such
    as recognition gives of a page, without its white space.

    Every window of 10 or 12 characters that are not white space is judged, of which white space makes up no more than
    twice as many.  A tax number may have one character that recognition takes for another, has two capitals, a blank at
    most, and no letter, digit, or hyphen tied to one beside it; one with a wrong character needs a word of its context
    near by or no blank.  A citizen number may have two such characters, two blanks, and no digit beside it; a right one
    needs blanks, a first digit from 2 to 9, or a word of its context, one with wrong characters blanks or a word.
    ``allowed`` (doc_id, text) are texts that a reviewer rejected.

    One pass of a pattern that looks ahead marks all windows, overlapping ones too, so the work is linear in the text.
    """
    digit, letter, other = rf"[\p{{Nd}}{FOR_DIGITS}]", rf"[\p{{L}}{FOR_LETTERS}]", r"[\p{L}\p{N}]"
    alone = f"(?<!{other})", f"(?<!{other}-{{1,{HYPHENS}}})", f"(?!-{{0,{HYPHENS}}}{other})"
    ahead = {
        "PAN_NUMBER": f"{alone[0]}(?={_spread(*[letter] * 5, *[digit] * 4, letter)}{alone[2]}){alone[1]}",
        "AADHAAR_NUMBER": rf"(?<!\p{{Nd}})(?={_spread(*[digit] * 12)}(?!\p{{Nd}}))",
    }
    found = None
    for kind, pattern in ahead.items():
        n, words = (10, PAN_CONTEXT) if kind == "PAN_NUMBER" else (12, AADHAAR_CONTEXT)
        rows = matched(texts.select("doc_id", "text"), "text", pattern, CONTEXT, 3 * n + CONTEXT)
        one = SPACE.replace("[", "[^", 1)
        raw = F.regexp_extract(F.left("after", F.lit(3 * n)), f"^{_spread(*[one] * n)}", 0)
        rows = rows.withColumn("raw", raw).filter("raw <> ''").withColumn("window", _dense(F.col("raw")))
        near = F.lower(F.concat("before", F.left("after", F.length("raw") + CONTEXT)))
        context = F.rlike(near, F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(words)})(?![\p{{L}}\p{{N}}_])"))
        blanks = F.length("raw") - F.length(F.replace(F.col("raw"), F.lit(" "), F.lit("")))
        wrong = lambda text, right: F.length(F.regexp_replace(text, F.lit(right), ""))
        if kind == "PAN_NUMBER":
            letters, digits = F.concat(F.left("window", F.lit(5)), F.right("window", F.lit(1))), F.substring("window", 6, 4)
            errors = wrong(letters, r"\p{L}") + wrong(digits, r"\p{Nd}")
            capitals = wrong(F.col("window"), r"\P{Lu}")
            good = (capitals >= 2) & (blanks <= 1) & ((errors == 0) | ((errors == 1) & (context | (blanks == 0))))
        else:
            errors = wrong(F.col("window"), r"\p{Nd}")
            good = (blanks <= 2) & ((errors <= 2) & ((blanks > 0) | context) | (errors == 0) & F.rlike("window", F.lit("^[2-9]")))
        rows = rows.filter(good).select("doc_id", F.lit(kind).alias("leak_type"), "raw", "window")
        found = rows if found is None else found.union(rows)
    kept = _unless_allowed(found, allowed, F.col("raw"), lambda t: F.lower(F.trim(t)))
    return kept.select("doc_id", "leak_type", "window")


def fragments(entities: DataFrame, redacted: DataFrame, words: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, entity_type, text, side): entities of which the ``leading`` or ``trailing`` four characters can be read.

    ``entities`` has doc_id, entity_type, text, and as far as there are boxes status, page and box; ``redacted`` doc_id
    and text; ``words`` those of redacted pages: doc_id, page, ord, text and box; ``pages`` doc_id, page and rotation,
    of all pages.  White space does not count, on neither side; entities of under six characters, and by status those
    that are not pending, accepted or modified, are left out.

    An entity with a box, on an upright page, is looked for in the words whose boxes meet its own, grown by 100 to the
    sides and by one and a half times its height, 15 at least, up and down; on a turned page in all its words; without a
    box or page in the whole document.  Longer ends hold the shorter ones, so four characters decide.  Entities and words
    meet by cells of a grid, and those of a document without boxes meet its text in one array.
    """
    boxed = words is not None and pages is not None
    extra = [F.col(c) if c in entities.columns else F.lit(None).cast(k).alias(c) for c, k in (("status", "string"), ("page", "int"), ("box", BOX))]
    e = entities.select("doc_id", "entity_type", "text", *extra).filter(F.coalesce("status", F.lit("accepted")).isin("pending", "accepted", "modified"))
    e = e.withColumn("page", F.col("page").cast("int")).withColumn("box", F.col("box").cast(BOX)).withColumn("v", _dense(F.col("text"))).filter(F.length("v") >= 6).distinct()
    ends = F.array(F.struct(F.lit("leading").alias("side"), F.left("v", F.lit(4)).alias("end")), F.struct(F.lit("trailing").alias("side"), F.right("v", F.lit(4)).alias("end")))
    e = e.withColumn("ends", ends)
    out = ["doc_id", "entity_type", "text", "side"]
    if boxed:
        turned = pages.select("doc_id", F.col("page").cast("int").alias("page"), (F.coalesce("rotation", F.lit(0)) % 360 != 0).alias("turned")).distinct()
        e = e.join(turned, ["doc_id", "page"], "left")
    placed = F.col("box").isNotNull() & F.col("turned").isNotNull() if boxed else F.lit(False)
    loose = e.filter(~placed).groupBy("doc_id").agg(F.collect_list(F.struct("entity_type", "text", "ends")).alias("es"))
    met = redacted.select("doc_id", _dense(F.col("text")).alias("body")).join(loose.hint("merge"), "doc_id")
    left = F.flatten(F.transform("es", lambda x: F.transform(F.filter(x.ends, lambda s: F.contains(F.col("body"), s.end)), lambda s: F.struct(x.entity_type.alias("entity_type"), x.text.alias("text"), s.side.alias("side")))))
    found = met.select("doc_id", F.explode(left).alias("l")).select("doc_id", "l.*")
    if not boxed:
        return found.select(*out)
    w = words.select("doc_id", F.col("page").cast("int").alias("page"), F.struct("ord", _dense(F.col("text")).alias("w")).alias("word"), F.col("box").cast(BOX).alias("word_box"))
    height = F.greatest(F.col("box.y1") - F.col("box.y0"), F.lit(10.0))
    near = e.filter(placed & ~F.col("turned")).withColumn("reach", envelope(F.col("box"), F.lit(100.0), F.greatest(height * 1.5, F.lit(15.0))))
    key = ["doc_id", "entity_type", "text", "page", "box", "ends"]
    read = F.array_join(F.transform(F.array_sort(F.collect_list("word")), lambda x: x.w), "").alias("body")
    local = box_join(near.select(*key, "reach"), w, ["doc_id", "page"], "reach", "word_box").groupBy(*key).agg(read)
    whole = w.groupBy("doc_id", "page").agg(read).join(e.filter(placed & F.col("turned")).select(*key), ["doc_id", "page"])
    paged = local.select(*out[:3], "ends", "body").union(whole.select(*out[:3], "ends", "body"))
    left = F.filter("ends", lambda s: F.contains(F.col("body"), s.end))
    return found.select(*out).union(paged.select(*out[:3], F.explode(left).alias("s")).select(*out[:3], "s.side"))


def uncertain_pages(stats: DataFrame) -> DataFrame:
    """Page statistics (native_chars, ink, alnum, mean_conf, chars) with ``reason`` where recognition can't be trusted."""
    garbled = F.col("alnum") / F.greatest("chars", F.lit(1)) < 0.25
    reason = (
        F.when((F.col("native_chars") > 0) | (F.col("ink") <= 0), F.lit(None).cast("string"))
        .when(F.col("alnum") == 0, "unreadable")
        .when(F.col("alnum") <= 3, "almost_unreadable")
        .when((F.col("mean_conf") < 45) & (F.col("chars") < 50), "low_confidence")
        .when(garbled, "garbled")
    )
    return stats.withColumn("reason", reason)


def verdict(docs: DataFrame, leaks: DataFrame, uncertain: DataFrame) -> DataFrame:
    """(doc_id, n_leaks, status, safety_status) of ``docs`` (doc_id, has_scanned_pages): leaks fail, doubts go to review."""
    found = leaks.groupBy("doc_id").agg(F.count("*").alias("n_leaks"))
    doubts = uncertain.filter("reason is not null").select("doc_id").distinct().withColumn("doubt", F.lit(True))
    rows = docs.select("doc_id", "has_scanned_pages").join(found.hint("merge"), "doc_id", "left").join(doubts.hint("merge"), "doc_id", "left").withColumn("n_leaks", F.coalesce("n_leaks", F.lit(0)))
    review = F.coalesce(F.col("doubt"), F.lit(False)) | F.coalesce(F.col("has_scanned_pages"), F.lit(False))
    status = F.when(F.col("n_leaks") > 0, "FAILED").when(review, "REVIEW_REQUIRED").otherwise("COMPLETED")
    rows = rows.withColumn("status", status)
    return rows.select("doc_id", "n_leaks", "status", F.when(F.col("status") == "COMPLETED", "VERIFIED").otherwise("UNVERIFIED").alias("safety_status"))


def releasable(jobs: DataFrame) -> DataFrame:
    """Jobs whose result may be downloaded: completed, verified, and stored where redacted files are."""
    return jobs.filter((F.col("status") == "COMPLETED") & (F.col("safety_status") == "VERIFIED") & F.startswith("result_key", F.lit("redacted/")))


def residual_values(values: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, value, status, distance, matched) of ``values`` (doc_id, value) against ``texts`` (doc_id, text): whether a
    value still stands in a released text (``CONFIRMED_LEAK``), or another string of its length that differs in one place
    (``FUZZY_CANDIDATE``, the first one), or neither (``CLEAN``).

    White space around texts and values and blanks inside them do not count; null values, and values of documents without
    a text, are left out.  A string with one wrong place has one right half, so a pattern looks for either half and only
    the strings around those are compared, however long the text is.  A document's values meet its text in one row.
    """
    packed = lambda t: F.replace(F.regexp_replace(t, r"^\s+|\s+$", ""), F.lit(" "), F.lit(""))
    own = values.filter("value is not null").select("doc_id", "value", packed(F.col("value")).alias("v")).distinct()
    own = own.groupBy("doc_id").agg(F.collect_list(F.struct("value", "v")).alias("vs"))
    rows = stage(texts.filter("text is not null").join(own.hint("merge"), "doc_id"), ["doc_id", "vs"], body=packed(F.col("text")))

    def seed(v: Column) -> Column:
        n = F.length(v)
        left = F.floor(n / 2).cast("int")
        literal = lambda t: F.regexp_replace(t, r"([^\p{L}\p{N}])", r"\\$1")
        return F.concat(F.lit("(?s)(?=("), literal(F.left(v, left)), F.lit(".{"), (n - left).cast("string"), F.lit("}|.{"), left.cast("string"), F.lit("}"), literal(F.right(v, n - left)), F.lit("))"))

    def told(x: Column) -> Column:
        there = F.contains(F.col("body"), x.v)
        near = F.when(~there, F.get(F.filter(F.regexp_extract_all(F.col("body"), seed(x.v), F.lit(1)), lambda w: F.levenshtein(w, x.v) <= 1), F.lit(0)))
        return F.struct(x.value.alias("value"), x.v.alias("v"), there.alias("there"), near.alias("near"))

    rows = rows.select("doc_id", F.explode(F.transform("vs", told)).alias("t")).select("doc_id", "t.*")
    status = F.when(F.col("there"), "CONFIRMED_LEAK").when(F.col("near").isNotNull(), "FUZZY_CANDIDATE").otherwise("CLEAN")
    return rows.select("doc_id", "value", status.alias("status"), F.when(F.col("there"), 0).when(F.col("near").isNotNull(), 1).alias("distance"), F.when(F.col("there"), F.col("v")).otherwise(F.col("near")).alias("matched"))


def leak_verdict(redacted: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, leak_type, text) of all checks of texts: residual patterns, spread numbers and ends of known entities."""
    ends = fragments(entities, redacted).select("doc_id", F.col("entity_type").alias("leak_type"), "text")
    return residual_patterns(redacted).unionByName(dense_leaks(redacted)).unionByName(ends)


def geometry_leaks(entities: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, page, start, leak) of redacted boxes that do not hide their entity.

    ``entities`` has doc_id, page, start, text, status and box (x0, y0, x1, y1); ``words`` are those of the redacted
    page: doc_id, page, ord, text and box.  The first check that fails counts: ``inside`` for letters or digits in the
    box, ``narrow`` for a box under 0.35 times its height for each character, ``after`` and ``before`` for an end or a
    beginning of the entity that stands beside the box.  Entities that are not redacted or have no box are left out,
    and those of under four characters are only looked for inside.
    """
    e = entities.filter(F.col("status").isin("pending", "accepted", "modified") & F.col("box").isNotNull())
    e = e.select("doc_id", "page", "start", "box", F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "").alias("t"))
    w = words.select("doc_id", "page", F.col("ord"), F.regexp_replace("text", "[^a-zA-Z0-9]", "").alias("w"), F.col("box").alias("wb"))
    b, c = F.col("box"), F.col("wb")
    height, width = b.y1 - b.y0, b.x1 - b.x0
    reach = F.greatest(height * 1.5, F.lit(30.0))
    level = (c.y0 < b.y1 + 2) & (c.y1 > b.y0 - 2)
    places = {
        "inside": (c.x0 < b.x1) & (c.x1 > b.x0) & (c.y0 < b.y1) & (c.y1 > b.y0),
        "right": level & (c.x0 < b.x1 + reach) & (c.x1 > b.x1),
        "left": level & (c.x0 < b.x0) & (c.x1 > F.greatest(b.x0 - reach, F.lit(0.0))),
    }
    near = level & (c.x0 < b.x1 + reach) & (c.x1 > b.x0 - reach)
    grown = e.withColumn("reach", F.struct((b.x0 - reach).alias("x0"), (b.y0 - 2).alias("y0"), (b.x1 + reach).alias("x1"), (b.y1 + 2).alias("y1")))
    met = box_join(grown, w, ["doc_id", "page"], "reach", "wb").filter(near | places["inside"])
    read = [F.array_join(F.array_sort(F.collect_list(F.when(there, F.struct("ord", "w")))).getField("w"), "").alias(name) for name, there in places.items()]
    texts = met.groupBy("doc_id", "page", "start").agg(*read)
    rows = e.join(texts, ["doc_id", "page", "start"], "left").na.fill("", list(places))
    t, n = F.col("t"), F.length("t")

    def stands(side: str, end: bool) -> Column:
        s = F.col(side)
        piece = (lambda k: F.substr(s, F.lit(1), k)) if end else (lambda k: F.substr(s, F.length(s) - k + 1, k))
        fits = (lambda x: F.endswith(t, x)) if end else (lambda x: F.startswith(t, x))
        some = F.exists(F.sequence(F.lit(4), F.greatest(F.length(s), F.lit(4))), lambda k: fits(piece(k)) & (k <= F.length(s)))
        return ((F.length(s) >= 3) & fits(s)) | ((F.length(s) >= 4) & some)

    leak = (
        F.when(F.length("inside") >= 1, "inside")
        .when(n < 4, None)
        .when((height > 3.0) & (width < n * height * 0.35), "narrow")
        .when(stands("right", True), "after")
        .when(stands("left", False), "before")
    )
    return rows.select("doc_id", "page", "start", leak.alias("leak")).filter("leak is not null")

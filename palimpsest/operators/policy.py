"""Decisions on entities, and what is written in their place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.spans import splice, stage

#: Thresholds by mode: accepted from, reviewed from, rejected by the benign-text score below (fixed values).
MODES = {"balanced": (0.85, 0.50, 0.40), "high_recall": (0.70, 0.30, 0.25), "high_precision": (0.95, 0.75, 0.55)}
IDENTITY = ["AADHAAR_NUMBER", "PAN_NUMBER"]
#: Words and units that are never personal data, and words before a value that make it so (fixed values).
BENIGN = [
    "total", "subtotal", "amount", "qty", "quantity", "price", "rate", "tax", "gst", "sgst", "cgst", "igst", "discount", "balance", "due", "paid", "invoice", "bill",
    "receipt", "date", "description", "particulars", "s.no", "sr.no", "item", "hsn", "sac", "unit", "terms", "conditions", "authorized", "signatory", "signature",
    "seal", "stamp", "page", "rupees", "inr", "rs", "dr", "cr", "net", "gross",
]
UNITS = ["₹", "$", "€", "£", "rs", "rs.", "inr", "kg", "g", "mg", "ml", "l", "ltr", "pcs", "nos", "mtr", "ft", "sqft", "%", "/-"]
PREFIXES = [
    "name", "patient", "customer", "client", "emp", "employee", "holder", "son of", "daughter of", "s/o", "d/o", "w/o", "care of", "c/o", "aadhaar", "uid", "pan",
    "account", "a/c", "mobile", "phone", "contact", "email", "address", "residence", "dob", "birth", "beneficiary",
]
#: What no text in title case has: a small letter that begins a word, or a capital inside one.
UNTITLED = r"(?:^|[^\p{L}])\p{Ll}|\p{L}\p{Lu}"


def benign_score(text: Column, score: Column, before: Column | None = None, box: Column | None = None, page_width: float = 612.0) -> Column:
    """How likely a span is personal data by its look, the text ``before`` it and its ``box`` (x0, y0, x1, y1).

    The first rule that holds counts: words and units without a prefix .05; single characters .02; short texts with few
    digits that stand upright in a margin .20; a prefix at least .85; ten characters or more, mostly digits, .95; else
    the score, .05 higher in title case.
    """
    t, low = F.trim(text), F.lower(F.trim(text))
    n = F.length(t)
    digits = F.length(F.regexp_replace(t, "[^0-9]", "")) / F.greatest(n, F.lit(1))
    named = F.lit(False) if before is None else F.coalesce(T.any_in(F.lower(before), PREFIXES), F.lit(False))
    upright = F.lit(False)
    if box is not None:
        at = F.least(F.lit(1.0), F.greatest(F.lit(0.0), box.x0 / max(1.0, page_width)))
        tall = F.greatest(box.x1 - box.x0, F.lit(1.0)) / F.greatest(box.y1 - box.y0, F.lit(1.0)) < 0.6
        upright = F.coalesce(tall & ((at < 0.10) | (at > 0.90)), F.lit(False))
    titled = F.rlike(t, F.lit(r"\p{L}")) & ~F.rlike(t, F.lit(UNTITLED))
    raised = F.when(titled & (n > 3), F.least(F.lit(0.95), score + 0.05)).otherwise(score)
    return (
        F.when(low.isin(BENIGN + UNITS) & ~named, 0.05)
        .when(n <= 1, 0.02)
        .when(upright & ~named & (n < 15) & (digits < 0.5), 0.20)
        .when(named, F.least(F.lit(0.99), F.greatest(F.lit(0.85), score + 0.15)))
        .when((digits > 0.7) & (n >= 10), 0.95)
        .otherwise(F.least(F.greatest(raised, F.lit(0.0)), F.lit(1.0)))
    )


def decide(entities: DataFrame, mode: str = "balanced") -> DataFrame:
    """Entities with ``status``: accepted, pending (to be reviewed) or rejected; identity numbers below 0.90 are never accepted."""
    auto, review, least = MODES[mode]
    looks, own = benign_score(F.col("text"), F.col("score")), F.col("entity_type").isin(IDENTITY)
    score = F.when(own | (F.col("looks") < least), F.col("score")).otherwise(F.greatest("score", "looks"))
    # Worked out once: a filter on the status would write it out at each place, in a method too long to be compiled.
    out = stage(entities, entities.columns, looks=looks).withColumn("score", score)
    status = (
        F.when(F.col("looks") < least, "rejected")
        .when(own & (F.col("score") < 0.9), F.when(F.col("score") >= review, "pending").otherwise("rejected"))
        .when(F.col("score") >= auto, "accepted")
        .when(F.col("score") >= review, "pending")
        .otherwise("rejected")
    )
    return out.withColumn("status", status).drop("looks")


def blended(pipeline: Column, sensitivity: Column) -> Column:
    """The final score of an outside sensitivity score; 0.6 stands in where there is none."""
    return 0.35 * pipeline + 0.65 * F.coalesce(sensitivity, F.lit(0.6))


def reviewed(entities: DataFrame, reviews: DataFrame, key: str = "id", at: str = "at") -> DataFrame:
    """Entities with the status of their latest review."""
    last = reviews.groupBy(key).agg(F.max_by("status", at).alias("new"))
    return entities.join(last.hint("merge"), key, "left").withColumn("status", F.coalesce("new", "status")).drop("new")


def active(entities: DataFrame) -> DataFrame:
    """What is redacted: all but the rejected; those still to be reviewed too."""
    return entities.filter(F.col("status").isin("pending", "accepted", "modified"))


def _numbered(entities: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id", "entity_type").orderBy("start", "end")
    return entities.withColumn("n", F.row_number().over(order))


def _with_entities(docs: DataFrame, entities: DataFrame, *columns: str) -> DataFrame:
    """Documents with their entities as an array; null where there are none."""
    grouped = entities.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", *columns)).alias("es"))
    return docs.select("doc_id", "text").join(grouped.hint("merge"), "doc_id", "left")


def redact_typed(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, redacted_text, entity_count): each entity's span as [TYPE_n], n its number within the document and type."""
    rows = _with_entities(docs, _numbered(entities), "entity_type", "n")
    shown = splice(F.col("text"), F.col("es"), lambda e: F.concat(F.lit("["), e.entity_type, F.lit("_"), e.n.cast("string"), F.lit("]")))
    return rows.select("doc_id", F.coalesce(shown, F.col("text")).alias("redacted_text"), F.coalesce(F.size("es"), F.lit(0)).alias("n")).select("doc_id", "redacted_text", F.greatest("n", F.lit(0)).alias("entity_count"))


def redact_everywhere(docs: DataFrame, entities: DataFrame, block: str = "█") -> DataFrame:
    """(doc_id, redacted_text): every occurrence of every entity's text as as many blocks, in the order of the entities."""
    order = F.min(F.struct("start", "end")).alias("at")
    values = entities.groupBy("doc_id", F.col("text").alias("v")).agg(order).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("vs"))
    rows = docs.select("doc_id", "text").join(values.hint("merge"), "doc_id", "left")
    done = F.aggregate("vs", F.col("text"), lambda t, v: F.replace(t, v.v, F.repeat(F.lit(block), F.length(v.v))))
    return rows.select("doc_id", F.coalesce(done, F.col("text")).alias("redacted_text"))


def rendered(value: Column, action: Column, replacement: Column | None = None) -> Column:
    """A value under an action: eight blocks, first and last two letters (four stars if short), or its replacement."""
    masked = F.when(F.length(value) <= 4, "****").otherwise(F.concat(F.substring(value, 1, 2), F.lit("****"), F.substring(value, -2, 2)))
    return F.when(action == "blackout", "█" * 8).when(action == "mask", masked).when(action == "replace", replacement if replacement is not None else F.lit("[REDACTED]")).otherwise(value)


def pseudonyms(entities: DataFrame, within: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Entities with ``pseudonym`` [TYPE_n]: n counts distinct values (in lower case) by first appearance, so that a value keeps its name.

    Values are numbered after a reduction to distinct ones; with ``within`` empty, names hold for all documents, and
    values are numbered in ranges of the documents where they come first, with the counts of earlier ranges added: no task
    holds the values of a type.
    """
    keyed = entities.withColumn("v", F.lower("text"))
    if within:
        first = F.min(F.struct("doc_id", "start")).over(Window.partitionBy(*within, "entity_type", "v"))
        out = keyed.dropna(subset=[*within, "entity_type", "v"]).withColumn("first", first)
        out = out.withColumn("n", F.dense_rank().over(Window.partitionBy(*within, "entity_type").orderBy("first"))).drop("first")
    else:
        first = keyed.groupBy("entity_type", "v").agg(F.min(F.struct("doc_id", "start")).alias("first"))
        out = keyed.join(_ranked(first).drop("first").hint("merge"), ["entity_type", "v"])
    return out.withColumn("pseudonym", F.concat(F.lit("["), F.col("entity_type"), F.lit("_"), F.col("n").cast("string"), F.lit("]"))).drop("v", "n")


def _ranked(first: DataFrame) -> DataFrame:
    """``first`` (entity_type, v, first: doc_id and start) with the dense rank ``n`` of each value of a type.

    Quantiles of the documents, as many as shuffles have partitions, bound the ranges; they are numbers in the plan, so a
    task that is run again finds its ranges unchanged.
    """
    ranges = int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = first.agg(F.percentile_approx("first.doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 10_000)).head()[0] or []
    # The number of bounds at or below a document.
    at = F.coalesce(*(F.when(F.col("first.doc_id") < F.lit(b), F.lit(i)) for i, b in enumerate(sorted(set(bounds)))), F.lit(len(set(bounds)))) if bounds else F.lit(0)
    placed = first.withColumn("range", at)
    counts = placed.groupBy("entity_type", "range").agg(F.countDistinct("first").alias("count"))
    before = F.sum("count").over(Window.partitionBy("entity_type").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("entity_type", "range", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.dense_rank().over(Window.partitionBy("entity_type", "range").orderBy("first"))
    # One row for each type and range.
    return placed.withColumn("n", rank).join(F.broadcast(counts), ["entity_type", "range"]).withColumn("n", F.col("n") + F.col("before")).drop("range", "before")


def redact_by_rules(docs: DataFrame, entities: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, redacted_text) under ``rules`` (rule_type, is_active, action); entities without an active rule stay as they are."""
    acted = pseudonyms(entities).join(rules.filter("is_active").select(F.col("rule_type").alias("entity_type"), "action"), "entity_type")
    acted = acted.withColumn("shown", rendered(F.col("text"), F.col("action"), F.col("pseudonym")))
    rows = _with_entities(docs, acted, "shown")
    return rows.select("doc_id", F.coalesce(splice(F.col("text"), F.col("es"), lambda e: e.shown), F.col("text")).alias("redacted_text"))


def tokens(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, pos, type, value): the document as alternating text and entity tokens; an entity that overlaps an earlier one is left out."""
    rows = _with_entities(docs, entities, "entity_type")
    kind = "array<struct<type:string,value:string>>"
    part = lambda t, v: F.when(v != "", F.array(F.struct(t.alias("type"), v.alias("value")))).otherwise(F.array().cast(kind))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, e: Column) -> Column:
        fits = (e.start >= acc.at) & (e.end <= F.length("text"))
        more = F.concat(acc.out, part(F.lit("text"), F.substr("text", acc.at + 1, e.start - acc.at)), part(e.entity_type, F.substr("text", e.start + 1, e.end - e.start)))
        return F.struct(F.when(fits, e.end).otherwise(acc.at).alias("at"), F.when(fits, more).otherwise(acc.out).alias("out"))

    whole = F.aggregate(F.array_sort("es"), zero, step, lambda acc: F.concat(acc.out, part(F.lit("text"), F.substr("text", acc.at + 1, F.length("text")))))
    return rows.select("doc_id", F.posexplode(F.coalesce(whole, part(F.lit("text"), F.col("text")))).alias("pos", "t")).select("doc_id", "pos", "t.type", "t.value")


FIRST_NAMES = ["Asha", "Ravi", "Meera", "Karan", "Leela", "Nikhil", "Tara", "Vijay"]
LAST_NAMES = ["Iyer", "Bose", "Kaul", "Menon", "Dutta", "Sethi", "Rana"]


def synthesised(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, redacted_text): each entity's span replaced by a made-up value of its type, from left to right."""
    rows = _with_entities(docs, entities.withColumn("shown", synthetic(F.col("entity_type"), F.col("text"))), "shown")
    return rows.select("doc_id", F.coalesce(splice(F.col("text"), F.col("es"), lambda e: e.shown), F.col("text")).alias("redacted_text"))


def review_list(entities: DataFrame, types: list[str] | None = None, language: str | None = None, sort: str = "score") -> DataFrame:
    """What a reviewer sees: entities of some types and a language, by ``score`` (highest first), ``type`` or ``position``."""
    rows = entities if types is None else entities.filter(F.col("entity_type").isin(types))
    rows = rows if language is None else rows.filter(F.col("language") == language)
    order = {"score": [F.desc("score")], "type": ["entity_type"], "position": []}[sort]
    return rows.orderBy(*order, "doc_id", "start", "end")


def approve_types(entities: DataFrame, types: list[str], status: str = "accepted") -> DataFrame:
    """Entities of some types with a status of the reviewer's choice, the others as they are."""
    return entities.withColumn("status", F.when(F.col("entity_type").isin(types), status).otherwise(F.col("status")))


def synthetic(kind: Column, value: Column) -> Column:
    """A made-up value of the same kind, the same for the same value whatever its case; unknown kinds give [TYPE]."""
    seed = F.conv(F.substring(F.md5(F.lower(F.trim(value)).cast("binary")), 1, 12), 16, 10).cast("bigint")
    digits = lambda n, k: F.lpad(F.pmod(seed * k + n, F.lit(10**n)).cast("string"), n, "0")
    letter = lambda k: F.char(65 + F.pmod(F.shiftright(seed, k), F.lit(26)))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (1 + F.pmod(F.shiftright(seed, k % 40), F.lit(len(names)))).cast("int"))
    card = F.concat(F.lit("4532"), digits(11, 53))
    check = lambda c: F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(""), lambda a, d: F.when(F.call_function("luhn_check", F.concat(c, d.cast("string"))), d.cast("string")).otherwise(a))
    return (
        F.when(kind == "PHONE_NUMBER", F.concat((6 + F.pmod(seed, F.lit(4))).cast("string"), digits(9, 31)))
        .when(kind == "AADHAAR_NUMBER", F.concat((2 + F.pmod(seed, F.lit(8))).cast("string"), digits(3, 7), F.lit(" "), digits(4, 11), F.lit(" "), digits(4, 13)))
        .when(kind == "PAN_NUMBER", F.concat(letter(1), letter(5), letter(9), F.lit("P"), letter(13), digits(4, 17), letter(17)))
        .when(kind == "EMAIL_ADDRESS", F.concat(F.lit("user"), digits(6, 19), F.lit("@example.com")))
        .when(kind == "IP_ADDRESS", F.concat(F.lit("10."), F.pmod(seed, F.lit(256)).cast("string"), F.lit("."), F.pmod(F.shiftright(seed, 8), F.lit(256)).cast("string"), F.lit(".1")))
        .when(kind == "PIN_CODE", F.concat((1 + F.pmod(seed, F.lit(8))).cast("string"), digits(5, 23)))
        .when(kind == "IFSC_CODE", F.concat(F.lit("SBIN0"), digits(6, 29)))
        .when(kind == "BANK_ACCOUNT", digits(11, 37))
        .when(kind == "PERSON", F.concat(pick(FIRST_NAMES, 3), F.lit(" "), pick(LAST_NAMES, 41)))
        .when(kind == "GST_NUMBER", F.concat(F.lpad((1 + F.pmod(seed, F.lit(35))).cast("string"), 2, "0"), letter(1), letter(5), letter(9), F.lit("P"), letter(13), digits(4, 17), letter(17), (1 + F.pmod(seed, F.lit(9))).cast("string"), F.lit("Z"), letter(21)))
        .when(kind == "VOTER_ID", F.concat(letter(2), letter(7), letter(12), digits(7, 43)))
        .when(kind.isin("PASSPORT", "IN_PASSPORT"), F.concat(letter(3), digits(7, 47)))
        .when(kind == "CREDIT_CARD", F.concat(F.substring(card, 1, 4), F.lit(" "), F.substring(card, 5, 4), F.lit(" "), F.substring(card, 9, 4), F.lit(" "), F.substring(card, 13, 3), check(card)))
        .when(kind.isin("DATE_OF_BIRTH", "DATE_TIME"), F.concat_ws("/", two(1 + F.pmod(seed, F.lit(28))), two(1 + F.pmod(F.shiftright(seed, 6), F.lit(12))), (1970 + F.pmod(F.shiftright(seed, 11), F.lit(31))).cast("string")))
        .when(kind == "URL", F.concat(F.lit("https://example.com/"), F.substring(F.md5(F.lower(F.trim(value)).cast("binary")), 13, 8)))
        .otherwise(F.concat(F.lit("["), kind, F.lit("]")))
    )


def simple_redaction(value: Column, kind: Column, technique: Column) -> Column:
    """Stars, a type mark or a digest of a value; an unknown technique gives stars."""
    stars = F.regexp_replace(value, "(?s).", "*")
    return F.when(technique == "replace", F.concat(F.lit("["), F.coalesce(kind, F.lit("REDACTED")), F.lit("]"))).when(technique == "hash", F.sha2(value, 256)).otherwise(stars)

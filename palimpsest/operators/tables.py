"""Text tables and page layout: types that a column's header gives to the cells below it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import validators as V
from palimpsest.functions.spans import stage
from palimpsest.operators.spatial import box_join

#: Headers by type, in the order in which they are looked for, and headers of other columns (fixed values).
HEADERS = {
    "aadhaar": "AADHAAR_NUMBER", "aadhar": "AADHAAR_NUMBER", "uid": "AADHAAR_NUMBER", "aadhaar number": "AADHAAR_NUMBER", "aadhaar no": "AADHAAR_NUMBER", "aadhar no": "AADHAAR_NUMBER",
    "pan": "PAN_NUMBER", "pan number": "PAN_NUMBER", "pan no": "PAN_NUMBER", "permanent account number": "PAN_NUMBER", "pan card": "PAN_NUMBER",
    "bank account": "BANK_ACCOUNT", "account number": "BANK_ACCOUNT", "salary account": "BANK_ACCOUNT", "a/c no": "BANK_ACCOUNT", "account no": "BANK_ACCOUNT",
    "ref / account": "BANK_ACCOUNT", "bank acct": "BANK_ACCOUNT", "acct no": "BANK_ACCOUNT", "account": "BANK_ACCOUNT", "ifsc": "IFSC_CODE", "ifsc code": "IFSC_CODE",
    "name": "PERSON", "emp name": "PERSON", "employee name": "PERSON", "candidate name": "PERSON", "account holder": "PERSON", "holder name": "PERSON", "customer name": "PERSON",
    "phone": "PHONE_NUMBER", "mobile": "PHONE_NUMBER", "contact": "PHONE_NUMBER", "mobile no": "PHONE_NUMBER", "phone number": "PHONE_NUMBER",
    "email": "EMAIL_ADDRESS", "email id": "EMAIL_ADDRESS", "email address": "EMAIL_ADDRESS",
}
OTHER_HEADERS = [
    "emp id", "employee id", "id", "item", "description", "item description", "qty", "quantity", "rate", "price", "amount", "debit", "credit", "net salary", "salary", "gross salary",
    "tax", "gst", "total", "designation", "role", "dept", "department", "date", "txn date", "transaction date", "status", "remarks", "serial", "s.no", "sl no", "sr no",
]


def header_type(cell: Column) -> Column:
    """The type of a column header: an exact name, or the first name that stands in it as a word; null for others."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(cell)), r"[\r\n\t|]", " "), r"\s+", " "))
    exact = F.element_at(F.create_map(*(F.lit(x) for kv in HEADERS.items() for x in kv)), clean)
    inside = F.coalesce(*(F.when(F.rlike(clean, F.lit(rf"\b{h.replace('/', '[/]')}\b")), F.lit(t)) for h, t in HEADERS.items()))
    return F.when(clean.isin(OTHER_HEADERS), F.lit(None).cast("string")).otherwise(F.coalesce(exact, inside))


def valid_cell(kind: Column, cell: Column) -> Column:
    """Whether a cell looks like its column's type."""
    c = F.trim(cell)
    digits, packed = F.regexp_replace(c, "[^0-9]", ""), F.upper(F.replace(c, F.lit(" "), F.lit("")))
    words = F.split(c, r"\s+")
    named = F.forall(words, lambda w: ~F.rlike(w, F.lit(r"^\p{L}")) | F.rlike(w, F.lit(r"^\p{Lu}")) | F.rlike(c, F.lit("[ऀ-ॿ]")))
    like = lambda col, p: F.rlike(col, F.lit(p))
    return F.coalesce(
        F.when(c == "", False)
        .when(kind == "AADHAAR_NUMBER", (F.length(digits) == 12) & ((V.verhoeff_residue(digits) == 0) | like(c, r"^\d{4}[\s-]?\d{4}[\s-]?\d{4}$")))
        .when(kind == "PAN_NUMBER", like(packed, "^[A-Z]{5}[0-9]{4}[A-Z]$"))
        .when(kind == "BANK_ACCOUNT", ~like(c, "[.,/$€]") & like(F.regexp_replace(c, r"[\s-]", ""), r"^\d{9,18}$"))
        .when(kind == "IFSC_CODE", like(packed, "^[A-Z]{4}0[A-Z0-9]{6}$"))
        .when(kind == "PHONE_NUMBER", F.length(digits).isin(10, 11, 12) & like(digits, r"[6-9]\d{9}$"))
        .when(kind == "EMAIL_ADDRESS", like(c, r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"))
        .when(kind == "PERSON", ~like(c, r"\d") & ~F.upper(c).isin("ACTIVE", "INACTIVE", "PENDING", "APPROVED", "VERIFIED") & F.size(words).between(1, 4) & named),
        F.lit(False),
    )


def text_tables(docs: DataFrame, score: float = 0.85) -> DataFrame:
    """Candidates of cells of pipe or tab tables, typed by the header line above them.

    A line of two cells or more with a known header starts a table; a blank line or one without cells ends it.
    """
    lines = docs.filter(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
    order = Window.partitionBy("doc_id").orderBy("line")
    lines = lines.withColumn("at", F.coalesce(F.sum(F.length("raw") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = F.when(F.contains("raw", F.lit("|")), F.split("raw", r"\|", -1)).when(F.contains("raw", F.lit("\t")), F.split("raw", "\t", -1))
    lines = lines.withColumn("cells", F.when(F.trim("raw") != "", cut)).withColumn("types", F.transform("cells", header_type))
    header = F.exists("types", lambda t: t.isNotNull())
    # What last changed the state: a header's types, or nothing after a line that is no row.
    state = F.when(F.col("cells").isNull(), F.struct(F.lit(None).cast("array<string>").alias("t"))).when(header, F.struct(F.col("types").alias("t")))
    lines = lines.withColumn("header", header).withColumn("state", F.last(state, ignorenulls=True).over(order))
    body = lines.filter(F.col("cells").isNotNull() & ~F.col("header") & F.col("state.t").isNotNull())
    cells = body.select("doc_id", "line", "at", "cells", "state", F.posexplode("cells").alias("i", "cell"))
    before = F.aggregate(F.slice("cells", F.lit(1), F.col("i")), F.lit(0), lambda acc, c: acc + F.length(c) + 1)
    kind, value = F.get("state.t", F.col("i")), F.trim("cell")
    cells = cells.withColumn("entity_type", kind).withColumn("text", value).filter(F.col("entity_type").isNotNull() & valid_cell(F.col("entity_type"), F.col("text")))
    cells = cells.withColumn("start", (F.col("at") + before + F.length("cell") - F.length(F.ltrim("cell"))).cast("int"))
    return cells.select("doc_id", "start", (F.col("start") + F.length("text")).alias("end"), "entity_type", "text", F.lit(score).alias("score"), F.lit("table").alias("source"), F.lit(True).alias("type_locked"), F.lit(90).alias("ord"))


def below_headers(blocks: DataFrame, margin: float = 15.0, widest: float = 2.2) -> DataFrame:
    """Blocks of a page under a header block whose type they fit: (doc_id, page, block, entity_type).

    ``blocks`` has doc_id, page, block, text and box (x0, y0, x1, y1).  The block lies strictly below the header, its
    centre within the header's sides and ``margin``, and it is at most ``widest`` times as wide; of several headers the
    nearest counts.
    """
    heads = stage(blocks, ["doc_id", "page", "block", "box"], t=header_type(F.col("text"))).filter(F.col("t").isNotNull()).select("doc_id", "page", F.col("block").alias("h"), "t", F.col("box").alias("hb"))
    b, h = F.col("box"), F.col("hb")
    mid = (b.x0 + b.x1) / 2
    fits = (b.y0 > h.y1) & mid.between(h.x0 - margin, h.x1 + margin) & ((b.x1 - b.x0) <= (h.x1 - h.x0) * widest) & valid_cell(F.col("t"), F.col("text"))
    # All that lies below a header within its sides and the margin; it reaches down the page, so it is cut into columns only.
    stripe = F.struct((h.x0 - margin).alias("x0"), h.y1.alias("y0"), (h.x1 + margin).alias("x1"), F.lit(1e12).alias("y1"))
    found = box_join(blocks, heads.withColumn("stripe", stripe), ["doc_id", "page"], "box", "stripe", axes=(0,)).filter(fits)
    return found.groupBy("doc_id", "page", "block").agg(F.max_by("t", F.struct(F.col("hb.y1"), -F.col("h"))).alias("entity_type"))


def uncovered(found: DataFrame, blocks: DataFrame, entities: DataFrame) -> DataFrame:
    """Blocks of ``found`` (doc_id, page, block, entity_type) that no entity (doc_id, page, box) covers, with their text."""
    rows = found.join(blocks.select("doc_id", "page", "block", "text", "box").hint("merge"), ["doc_id", "page", "block"])
    covered = box_join(rows, entities.select("doc_id", "page", F.col("box").alias("k")), ["doc_id", "page"], "box", "k").select("doc_id", "page", "block").distinct()
    return rows.join(covered.hint("merge"), ["doc_id", "page", "block"], "left_anti")


#: Types that a header's type replaces, and header types that do (fixed values).
WEAK, STRONG = ["PHONE_NUMBER", "DATE_TIME", "DATE_OF_BIRTH"], ["AADHAAR_NUMBER", "BANK_ACCOUNT", "PAN_NUMBER", "IFSC_CODE"]


def overridden(entities: DataFrame, cells: DataFrame) -> DataFrame:
    """Entities with the type of the table cell that they overlap, where it is a stronger one; of several the first."""
    c = cells.filter(F.col("entity_type").isin(STRONG)).select("doc_id", F.col("start").alias("s0"), F.col("end").alias("e0"), F.col("entity_type").alias("t"))
    e = entities.filter(F.col("entity_type").isin(WEAK)).select("doc_id", "start", "end", "entity_type").distinct()
    met = e.join(c.hint("merge"), "doc_id").filter((F.col("start") < F.col("e0")) & (F.col("end") > F.col("s0")))
    best = met.groupBy("doc_id", "start", "end", "entity_type").agg(F.min_by("t", F.struct("s0", "e0")).alias("t"))
    out = entities.join(best.hint("merge"), ["doc_id", "start", "end", "entity_type"], "left")
    return out.withColumn("entity_type", F.coalesce("t", "entity_type")).drop("t").select(*entities.columns)


def blocks_of(entities: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row for each entity and text block that it meets, with a box cut out in proportion to its characters.

    The range join is by document; the box is padded by one point left and two right, within the block's.
    """
    e, b = entities.alias("e"), blocks.alias("b")
    met = e.join(b.hint("merge"), (F.col("e.doc_id") == F.col("b.doc_id")) & (F.col("e.start") < F.col("b.end_index")) & (F.col("e.end") > F.col("b.start_index")))
    box, length = F.col("b.box"), F.greatest(F.col("b.end_index") - F.col("b.start_index"), F.lit(1))
    at = lambda i: box.x0 + (box.x1 - box.x0) * (F.least(F.greatest(i, F.col("b.start_index")), F.col("b.end_index")) - F.col("b.start_index")) / length
    x0, x1 = F.greatest(at(F.col("e.start")) - 1, box.x0), F.least(at(F.col("e.end")) + 2, box.x1)
    return met.select("e.doc_id", "e.start", "e.end", "e.entity_type", "b.page", "b.block", F.round(x0, 4).alias("x0"), box.y0.alias("y0"), F.round(x1, 4).alias("x1"), box.y1.alias("y1"))


def page_offsets(pages: DataFrame) -> DataFrame:
    """``pages`` (doc_id, page, text) with each one's offsets in the text of all pages, a line feed between, and counts."""
    order = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(order), F.lit(0))
    out = pages.withColumn("start_offset", start).withColumn("end_offset", F.col("start_offset") + F.length("text"))
    return out.withColumn("char_count", F.length("text")).withColumn("word_count", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))


def pages_of(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """Entities with the page that their start lies in, and their offsets within it."""
    p = pages.select(F.col("doc_id").alias("k"), "page", "start_offset", "end_offset")
    met = entities.join(p.hint("merge"), (F.col("doc_id") == F.col("k")) & (F.col("start") >= F.col("start_offset")) & (F.col("start") < F.col("end_offset")))
    return met.select(*entities.columns, "page", (F.col("start") - F.col("start_offset")).alias("page_start"), (F.col("end") - F.col("start_offset")).alias("page_end"))


def ocr_blocks(words: DataFrame) -> DataFrame:
    """Recognised words (doc_id, page, ord, text, conf, box) as blocks of their page's text: the words that are not blank,
    trimmed, with ``start_index`` and ``end_index`` in the text that they make with one blank between.

    Words are numbered along a page, in order of ``ord``; a page's words stream through one task."""
    own = words.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).filter("text <> ''")
    before = F.sum(F.length("text") + 1).over(Window.partitionBy("doc_id", "page").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("start_index", F.coalesce(before, F.lit(0)).cast("int"))
    return own.withColumn("end_index", F.col("start_index") + F.length("text"))


def ocr_pages(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, text, word_count, mean_conf, alnum, chars, box) of the blocks of ``ocr_blocks``: each page's text,
    statistics, and the hull of all boxes.  Confidences below 0 are none; a page without any has a null mean."""
    edge = lambda f, c: f(F.col(f"box.{c}")).alias(c)
    hull = F.struct(edge(F.min, "x0"), edge(F.min, "y0"), edge(F.max, "x1"), edge(F.max, "y1")).alias("box")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_index", "text"))), lambda w: w.text), " ")
    return blocks.groupBy("doc_id", "page").agg(
        text.alias("text"), F.count("*").alias("word_count"), F.avg(F.when(F.col("conf") >= 0, F.col("conf"))).alias("mean_conf"),
        F.sum(F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))).alias("alnum"), F.max("end_index").cast("long").alias("chars"), hull,
    )


def non_maximum(boxes: DataFrame, most: float = 0.4) -> DataFrame:
    """Boxes (doc_id, box, conf) without those that overlap a surer kept one by over ``most``; a fold in each image."""
    kind = "struct<conf:double,box:struct<x0:double,y0:double,x1:double,y1:double>>"
    grouped = boxes.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("conf", "box").cast(kind)), asc=False).alias("bs"))
    step = lambda acc, b: F.when(F.exists(acc, lambda k: V.box_iou(k.box, b.box) > most), acc).otherwise(F.concat(acc, F.array(b)))
    kept = F.aggregate("bs", F.array().cast(f"array<{kind}>"), step)
    return grouped.select("doc_id", F.explode(kept).alias("k")).select("doc_id", "k.box", "k.conf")


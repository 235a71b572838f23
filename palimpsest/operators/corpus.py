"""Made-up training documents with exact spans, and audits of annotated corpora."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The entity type of each field of a template; other fields are filled in without a span (fixed values).
FIELD_TYPES = {
    "name": "PERSON", "dob": "DATE_OF_BIRTH", "aadhaar": "AADHAAR_NUMBER", "pan": "PAN_NUMBER", "gst": "GST_NUMBER", "ifsc": "IFSC_CODE", "phone": "PHONE_NUMBER",
    "email": "EMAIL_ADDRESS", "voter_id": "VOTER_ID",
}


def expanded(rows: DataFrame, templates: list[str], chosen: Column, key: str = "id") -> DataFrame:
    """(key, text, entities) of ``rows``: a template with its ``{fields}`` replaced by the row's columns of these names.

    ``chosen`` is the number of a row's template, from 0; ``entities`` are (start, end, entity_type, text) of the fields
    that have a type, in order, and hold the place of each in the finished text, also where values of any length stand
    before it or a field occurs again.  A null value is empty and no entity.
    """

    def pieces(template: str) -> Column:
        parts = re.split(r"\{(\w+)\}", template)
        held = [(F.lit(p), None) if i % 2 == 0 else (F.coalesce(F.col(p).cast("string"), F.lit("")), FIELD_TYPES.get(p)) for i, p in enumerate(parts)]
        return F.array(*(F.struct(value.alias("text"), F.lit(kind).cast("string").alias("entity_type")) for value, kind in held))

    of = F.lit(None).cast("array<struct<text:string,entity_type:string>>")
    for i, t in enumerate(templates):
        of = F.when(chosen == i, pieces(t)).otherwise(of)
    kind = "array<struct<start:int,end:int,entity_type:string,text:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        end = acc.at + F.length(p.text)
        span = F.struct(acc.at.alias("start"), end.alias("end"), p.entity_type.alias("entity_type"), p.text.alias("text"))
        return F.struct(end.alias("at"), F.when(p.entity_type.isNotNull() & (p.text != ""), F.concat(acc.out, F.array(span))).otherwise(acc.out).alias("out"))

    filled = rows.select(key, of.alias("pieces")).filter("pieces is not null")
    return filled.select(key, F.array_join(F.transform("pieces", lambda p: p.text), "").alias("text"), F.aggregate("pieces", zero, step, lambda acc: acc.out).alias("entities"))


def corpus_faults(manifest: DataFrame, annotations: DataFrame, files: DataFrame, quotas: DataFrame | None = None) -> DataFrame:
    """(fault, id): what an audit of an annotated corpus finds, a row for each document and fault.

    ``manifest`` has id, file_name, tier, category and sha256; ``annotations`` document_id, sha256, total_pages, category
    and entities (page_num, box, start, end, confidence); ``files`` name and sha256 of what is there; ``quotas``
    (category, n) the number of documents that each category must have.  Ids, names and digests must be unique; files and
    annotations must be there and have the manifest's digest; documents without entities are just those of the category
    ``hard_negative``; pages, boxes, spans and confidences of entities must be in order.  A quota's fault has its category
    as id.  Everything is joined by name and id once, and judged row by row.
    """
    twice = lambda c: F.count("*").over(Window.partitionBy(c)) > 1
    rows = manifest.select("id", "file_name", "category", "sha256", twice("id").alias("id2"), twice("file_name").alias("name2"), twice("sha256").alias("sha2"))
    there = files.select(F.col("name").alias("file_name"), F.col("sha256").alias("got"), F.lit(True).alias("there")).dropDuplicates(["file_name"])
    notes = annotations.select(F.col("document_id").alias("id"), F.col("sha256").alias("noted"), F.col("total_pages").alias("pages"), "entities", F.lit(True).alias("annotated")).dropDuplicates(["id"])
    rows = rows.join(there, "file_name", "left").join(notes, "id", "left")
    some, negative = F.size("entities") > 0, F.col("category") == "hard_negative"
    wrong = lambda test: F.coalesce(F.exists("entities", lambda e: ~F.coalesce(test(e), F.lit(False))), F.lit(False))
    faults = {
        "id twice": F.col("id2"), "name twice": F.col("name2"), "digest twice": F.col("sha2"), "no file": F.col("there").isNull(), "file changed": F.col("there") & ~F.col("got").eqNullSafe(F.col("sha256")),
        "no annotation": F.col("annotated").isNull(), "annotation of another file": F.col("annotated") & ~F.col("noted").eqNullSafe(F.col("sha256")), "no pages": F.col("annotated") & ~F.coalesce(F.col("pages") >= 1, F.lit(False)),
        "entities in a hard negative": F.col("annotated") & negative & some, "no entities": F.col("annotated") & ~negative & ~F.coalesce(some, F.lit(False)),
        "page out of range": wrong(lambda e: (e.page_num >= 1) & (e.page_num <= F.col("pages"))), "box out of order": wrong(lambda e: (e.box.x0 < e.box.x1) & (e.box.y0 < e.box.y1)),
        "box off the page": wrong(lambda e: (e.box.x0 >= 0) & (e.box.y0 >= 0)), "span out of order": wrong(lambda e: e["start"] <= e["end"]), "confidence out of range": wrong(lambda e: (e.confidence >= 0) & (e.confidence <= 1)),
    }
    found = rows.select(F.col("id").cast("string").alias("id"), F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in faults.items())))).alias("fault")).select("fault", "id")
    if quotas is None:
        return found
    counts = manifest.groupBy("category").agg(F.count("*").alias("have"))
    off = counts.join(quotas.select("category", "n"), "category", "full").filter(~F.col("have").eqNullSafe(F.col("n")))
    return found.union(off.select(F.lit("quota missed"), F.col("category")))


def audited(faults: DataFrame) -> DataFrame:
    """(fault, n, example) of ``corpus_faults``: how many documents have each fault, and the least id of them."""
    return faults.groupBy("fault").agg(F.countDistinct("id").alias("n"), F.min("id").alias("example"))

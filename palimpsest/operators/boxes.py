"""Recognised words and boxes: shapes that cover entities, and matching of found entities to expected ones by place."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import validators as V
from palimpsest.functions.spans import stage
from palimpsest.operators.evaluate import _assign, settled

#: Types of which no letter may differ but for confusable ones (fixed values).
STRUCTURED = [
    "PAN_NUMBER", "AADHAAR_NUMBER", "IFSC_CODE", "BANK_ACCOUNT", "PASSPORT_NUMBER", "VOTER_ID", "PHONE_NUMBER", "DATE_OF_BIRTH", "EMAIL_ADDRESS", "TAX_ID",
    "CREDIT_CARD", "DRIVING_LICENSE", "VEHICLE_REGISTRATION",
]
_BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
_MATCH = "doc_id long, page int, entity_type string, e_id long, d_id long, method string, iou double, exact boolean, residual int"


def valid_box(box: Column) -> Column:
    """The box if its corners are numbers, not negative and in order, else null."""
    numbers = ~(F.isnan(box.x0) | F.isnan(box.y0) | F.isnan(box.x1) | F.isnan(box.y1))
    return F.when(numbers & (box.x0 < box.x1) & (box.y0 < box.y1) & (box.x0 >= 0) & (box.y0 >= 0), box)


def contained(a: Column, b: Column) -> Column:
    """The share of box ``a`` that lies in box ``b``."""
    w = F.greatest(F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.lit(0.0))
    h = F.greatest(F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0), F.lit(0.0))
    return w * h / ((a.x1 - a.x0) * (a.y1 - a.y0))


def _packed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), V.SEPARATORS, "")


def _read_as(a: Column, b: Column, kind: Column, edits: int) -> tuple[Column, Column, Column]:
    """The distance of two recognised texts, the length of the longer one, and whether they are near enough for their type."""
    n = F.greatest(F.length(_packed(a)), F.length(_packed(b)))
    distance = V.ocr_distance(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))
    most = F.when(kind.isin(STRUCTURED), 0).when(n <= 6, 1).otherwise(edits)
    return distance, n, distance <= most


def dual_channel(expected: DataFrame, detected: DataFrame, spans: float = 0.5, boxes: float = 0.4, edits: int = 2) -> DataFrame:
    """One-to-one matches of largest total weight between entities of one document, page and type.

    ``expected`` has (doc_id, id, entity_type, page, text, start, end, box, is_ocr), ``detected`` the same but for
    ``is_ocr``; ids are unique in a document.  Digital ones are matched by spans that share ``spans`` of their hull
    (weight 1 + share), recognised ones by boxes that share ``boxes`` of their joint area and texts near enough for the
    type (weight 1 + share + 1 - distance / length).  Null or impossible spans and boxes match nothing.  Only
    pairs that contend for a side are handed to Python, one page's of one type at a time.
    """
    e = expected.select("doc_id", "page", "entity_type", F.col("id").alias("e_id"), F.col("text").alias("e_text"), F.col("start").alias("e0"), F.col("end").alias("e1"), valid_box(F.col("box")).alias("e_box"), F.coalesce("is_ocr", F.lit(False)).alias("is_ocr"))
    d = detected.select("doc_id", "page", "entity_type", F.col("id").alias("d_id"), F.col("text").alias("d_text"), F.col("start").alias("d0"), F.col("end").alias("d1"), valid_box(F.col("box")).alias("d_box"))
    distance, n, near = _read_as(F.col("e_text"), F.col("d_text"), F.col("entity_type"), edits)
    sound = (F.col("e0") >= 0) & (F.col("d0") >= 0) & (F.col("e1") > F.col("e0")) & (F.col("d1") > F.col("d0"))
    line, area = V.iou(F.col("e0"), F.col("e1"), F.col("d0"), F.col("d1")), V.box_iou(F.col("e_box"), F.col("d_box"))
    # Both sides grow with the documents, whatever their sizes are taken to be: neither goes to the driver.
    met = e.join(d.hint("merge"), ["doc_id", "page", "entity_type"]).withColumn("iou", F.when(F.col("is_ocr"), area).when(sound, line))
    met = met.filter(F.when(F.col("is_ocr"), (F.col("iou") >= boxes) & near).otherwise(F.col("iou") >= spans)).withColumn("distance", distance)
    same = (F.col("e0") == F.col("d0")) & (F.col("e1") == F.col("d1"))
    shared = F.least("e1", "d1") - F.greatest("e0", "d0")
    weighed = met.select(
        "doc_id", F.col("page").cast("int").alias("page"), "entity_type", F.col("e_id").cast("long").alias("e_id"), F.col("d_id").cast("long").alias("d_id"),
        F.when(F.col("is_ocr"), "box").when(same, "exact_span").otherwise("span").alias("method"), "iou",
        F.when(F.col("is_ocr"), (F.col("distance") == 0) & (F.col("iou") >= 0.85)).otherwise(same).alias("exact"),
        F.when(F.col("is_ocr"), F.col("distance")).otherwise(F.greatest(F.length(F.coalesce("e_text", F.lit(""))) - shared, F.lit(0))).cast("int").alias("residual"),
        (1 + F.col("iou") + F.when(F.col("is_ocr"), 1 - F.col("distance") / F.greatest(n, F.lit(1))).otherwise(0)).alias("weight"),
    )

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        es, ds = ({x: i for i, x in enumerate(sorted(rows[c].unique()))} for c in ("e_id", "d_id"))
        weight = [[0.0] * len(ds) for _ in es]
        at = [(es[r.e_id], ds[r.d_id]) for r in rows.itertuples()]
        for (i, j), w in zip(at, rows["weight"], strict=True):
            weight[i][j] = w
        chosen = _assign(weight)
        return rows[[chosen[i] == j for i, j in at]].drop_duplicates(["e_id", "d_id"]).drop(columns="weight")

    return settled(weighed, ["doc_id", "page", "entity_type"], ["e_id"], ["d_id"], match, _MATCH)


def fragments(expected: DataFrame, detected: DataFrame, matches: DataFrame, boxes: float = 0.4, edits: int = 2) -> DataFrame:
    """(doc_id, e_id, d_ids, iou, exact, residual): recognised entities that ``matches`` of ``dual_channel`` leaves open,
    each made up of two or three open detections of its page and type.

    A fragment lies half in the entity's box or shares a fifth of the joint area, and touches no other expected entity
    of the page.  Fragments are read from left to right; their hull and joint text are held to the rules of a single
    detection, and the hull that shares most wins, fewer fragments first.  A hull that would fit another open entity of
    the document is ambiguous and dropped.  Entities are judged at once: as a fragment touches one entity only, none is
    given away twice.

    Each input is read once and dealt by document once; a page's boxes are one row, in whose arrays fragments and their
    sets are found, and a document's open boxes are one.
    """
    kind = f"struct<id:long,entity_type:string,text:string,box:{_BOX},is_ocr:boolean>"
    none = lambda k: F.lit(None).cast(k)

    def side(df: DataFrame, is_ocr: Column) -> Column:
        return F.struct(F.col("id").cast("long").alias("id"), "entity_type", "text", valid_box(F.col("box")).cast(_BOX).alias("box"), is_ocr.alias("is_ocr")).cast(kind)

    # Everything of a page in one row: what is expected, what is detected, and the ids of both that are matched.
    rows = expected.select("doc_id", F.col("page").cast("int").alias("page"), side(expected, F.coalesce("is_ocr", F.lit(False))).alias("e"), none(kind).alias("d"), none("long").alias("me"), none("long").alias("md"))
    rows = rows.union(detected.select("doc_id", F.col("page").cast("int"), none(kind), side(detected, F.lit(False)), none("long"), none("long")))
    rows = rows.union(matches.select("doc_id", F.col("page").cast("int"), none(kind), none(kind), F.col("e_id").cast("long"), F.col("d_id").cast("long")))
    rows = rows.repartition("doc_id").groupBy("doc_id", "page").agg(*(F.collect_list(c).alias(c) for c in ("e", "d", "me", "md")))
    boxed = lambda xs: F.filter(xs, lambda x: x.box.isNotNull())
    rows = stage(rows, ["doc_id", "page", "me", "md"], e=boxed("e"), d=boxed("d"))
    left = lambda xs, known: F.filter(xs, lambda x: ~F.array_contains(known, x.id))
    rows = stage(rows, ["doc_id", "page", "e"], open_e=left("e", "me"), open_d=left("d", "md"))
    inside = lambda d, e: (contained(d.box, e.box) >= 0.5) | (V.box_iou(d.box, e.box) >= 0.2)
    touches = lambda d, o: (contained(d.box, o.box) >= 0.25) | (V.box_iou(d.box, o.box) >= 0.2)

    def parts(e: Column) -> Column:
        own = F.filter("open_d", lambda d: (d.entity_type == e.entity_type) & inside(d, e) & ~F.exists("e", lambda o: (o.id != e.id) & touches(d, o)))
        return F.array_sort(F.transform(own, lambda d: F.struct(d.box.x0.alias("x0"), d.id.alias("id"), d.text.alias("text"), d.box.alias("box"))))

    read = F.transform(F.filter("open_e", lambda e: e.is_ocr & F.col("page").isNotNull()), lambda e: F.struct(e.alias("e"), parts(e).alias("parts")))
    rows = stage(rows, ["doc_id", "open_e"], read=F.filter(read, lambda r: F.size(r.parts) > 1))
    rest = lambda xs, i: F.slice(xs, i + 2, F.size(xs))
    twos = lambda ps: F.flatten(F.transform(ps, lambda p, i: F.transform(rest(ps, i), lambda q: F.array(p, q))))
    threes = lambda ps: F.flatten(F.transform(ps, lambda p, i: F.flatten(F.transform(rest(ps, i), lambda q, j: F.transform(F.slice(ps, i + j + 3, F.size(ps)), lambda r: F.array(p, q, r))))))
    sets = F.flatten(F.transform("read", lambda r: F.transform(F.concat(twos(r.parts), threes(r.parts)), lambda ps: F.struct(r.e.alias("e"), ps.alias("parts")))))
    # All open entities, as what a hull may not fit, and all sets.
    opens = F.transform("open_e", lambda e: F.struct(e.alias("e"), F.array().cast(f"array<struct<x0:double,id:long,text:string,box:{_BOX}>>").alias("parts")))
    rows = rows.select("doc_id", F.explode(F.concat(opens, sets)).alias("s")).select("doc_id", "s.*")
    edge = lambda f, c: f(F.transform("parts", lambda p: p["box"][c]))
    hull = F.struct(edge(F.array_min, "x0").alias("x0"), edge(F.array_min, "y0").alias("y0"), edge(F.array_max, "x1").alias("x1"), edge(F.array_max, "y1").alias("y1"))
    joint = F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), "")
    rows = rows.withColumn("hull", hull).withColumn("joint", joint).withColumn("iou", V.box_iou(F.col("e.box"), F.col("hull"))).withColumn("d_ids", F.transform("parts", lambda p: p["id"]))
    distance, _, fits = _read_as(F.col("e.text"), F.col("joint"), F.col("e.entity_type"), edits)
    good = (F.col("iou") >= boxes) & fits
    rows = rows.filter((F.size("parts") == 0) | good).withColumn("residual", distance.cast("int"))
    # The best set of each entity, then those of a document whose hull fits no other open entity.
    rank = F.struct("iou", -F.size("parts"), F.transform("d_ids", lambda i: -i))
    best = F.max_by(F.when(F.size("parts") > 0, F.struct("d_ids", "iou", "hull", "residual")), F.when(F.size("parts") > 0, rank))
    rows = rows.groupBy("doc_id", F.col("e.id").alias("e_id")).agg(best.alias("b"), F.first("e.box").alias("box"))
    rows = rows.groupBy("doc_id").agg(F.collect_list(F.struct("e_id", "box", "b")).alias("all"))
    clear = F.filter("all", lambda x: x.b.isNotNull() & ~F.exists("all", lambda o: (o.e_id != x.e_id) & (V.box_iou(o.box, x.b.hull) >= boxes)))
    rows = rows.select("doc_id", F.explode(clear).alias("x")).select("doc_id", "x.e_id", "x.b.*")
    return rows.select("doc_id", "e_id", "d_ids", "iou", ((F.col("residual") == 0) & (F.col("iou") >= 0.85)).alias("exact"), "residual")


def duplicates(detected: DataFrame, matched: DataFrame, least: float = 0.4) -> DataFrame:
    """(doc_id, d_id, duplicate_of): detections not in ``matched`` (doc_id, d_id) that share ``least`` with a matched one
    of their page and type, by boxes where both have one, else by spans; of several the one that shares most."""
    d = detected.select("doc_id", "page", "entity_type", F.col("id").alias("d_id"), "start", "end", valid_box(F.col("box")).alias("box"))
    free = d.join(matched.select("doc_id", "d_id").hint("merge"), ["doc_id", "d_id"], "left_anti")
    used = d.join(matched.select("doc_id", "d_id").hint("merge"), ["doc_id", "d_id"], "left_semi").select("doc_id", "page", "entity_type", F.col("d_id").alias("u"), F.col("start").alias("s0"), F.col("end").alias("e0"), F.col("box").alias("k"))
    spanned = (F.col("end") > F.col("start")) & (F.col("e0") > F.col("s0"))
    share = F.when(F.col("box").isNotNull() & F.col("k").isNotNull(), V.box_iou(F.col("box"), F.col("k"))).when(spanned, V.iou(F.col("start"), F.col("end"), F.col("s0"), F.col("e0")))
    met = free.join(used.hint("merge"), ["doc_id", "page", "entity_type"]).withColumn("iou", share).filter(F.col("iou") >= least)
    return met.groupBy("doc_id", "d_id").agg(F.max_by("u", F.struct("iou", -F.col("u"))).alias("duplicate_of"))


def shapes(entities: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, start, end, entity_type, x, y, width, height): the padded boxes that cover each entity's words.

    ``words`` has (doc_id, ord, text, start_index, end_index, box, symbols), ``symbols`` a box for each character or
    null.  Of a word that an entity covers in part, its characters' boxes count, or its own in proportion.  Boxes that
    share over 45 % of the smaller one's height with the first of a row join that row; a row breaks where a gap is wider
    than twice the height and 35.  Words are ordered within one entity, which is all that an array holds.
    """
    box, n = F.col("box"), F.length("text")
    first, last = F.greatest(F.col("start") - F.col("start_index"), F.lit(0)), F.least(F.col("end") - F.col("start_index"), n)
    chars = F.slice("symbols", F.col("first") + 1, F.col("last") - F.col("first"))
    side = lambda f, c: f(F.transform(chars, lambda s: s[c]))
    at = lambda i: F.floor(box.x0 + (box.x1 - box.x0) * i / F.greatest(n, F.lit(1)) + 0.5).cast("double")
    part = (
        F.when((F.col("first") <= 0) & (F.col("last") >= n), box)
        .when((F.size("symbols") == n) & (F.col("last") > F.col("first")), F.struct(side(F.array_min, "x0").alias("x0"), side(F.array_min, "y0").alias("y0"), side(F.array_max, "x1").alias("x1"), side(F.array_max, "y1").alias("y1")))
        .otherwise(F.struct(at(F.col("first")).alias("x0"), box.y0.alias("y0"), at(F.col("last")).alias("x1"), box.y1.alias("y1")))
    )
    w = words.select(F.col("doc_id").alias("k"), "ord", "text", "start_index", "end_index", F.col("box").cast(_BOX).alias("box"), F.col("symbols").cast(f"array<{_BOX}>").alias("symbols"))
    e = entities.select("doc_id", "start", "end", "entity_type").distinct()
    met = e.join(w.hint("merge"), (F.col("doc_id") == F.col("k")) & (F.col("start_index") < F.col("end")) & (F.col("end_index") > F.col("start")))
    met = met.withColumn("first", first).withColumn("last", last).withColumn("part", part)
    key = ["doc_id", "start", "end", "entity_type"]
    held = met.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "part"))), lambda x: x["part"]).alias("bs"))

    def rowed(acc: Column, b: Column) -> Column:
        def fits(row: Column) -> Column:
            ref = F.get(row, F.lit(0))
            low = F.least(b.y1 - b.y0, ref.y1 - ref.y0)
            return (low > 0) & (F.least(b.y1, ref.y1) - F.greatest(b.y0, ref.y0) > low * 0.45)

        place = F.array_position(F.transform(acc, fits), F.lit(True))
        grown = F.transform(acc, lambda row, i: F.when(i == place - 1, F.concat(row, F.array(b))).otherwise(row))
        return F.when(place > 0, grown).otherwise(F.concat(acc, F.array(F.array(b))))

    def broken(acc: Column, b: Column) -> Column:
        last = F.element_at(F.element_at(acc, -1), -1)
        wide = b.x0 - last.x1 > F.greatest(2 * F.greatest(last.y1 - last.y0, b.y1 - b.y0), F.lit(35.0))
        grown = F.transform(acc, lambda s, i: F.when(i == F.size(acc) - 1, F.concat(s, F.array(b))).otherwise(s))
        return F.when(F.size(acc) == 0, F.array(F.array(b))).when(wide, F.concat(acc, F.array(F.array(b)))).otherwise(grown)

    none = F.array().cast(f"array<array<{_BOX}>>")
    rows = held.select(*key, F.posexplode(F.aggregate("bs", none, rowed)).alias("r", "row"))
    # Sorted by their left sides; equal ones keep their order.
    line = F.transform(F.array_sort(F.transform("row", lambda b, i: F.struct(b.x0.alias("x"), i.alias("i"), b.alias("b")))), lambda x: x["b"])
    parts = rows.select(*key, F.explode(F.aggregate(line, none, broken)).alias("s"))
    end = lambda f, c: f(F.transform("s", lambda b: b[c]))
    parts = parts.select(*key, end(F.array_min, "x0").alias("x0"), end(F.array_min, "y0").alias("y0"), end(F.array_max, "x1").alias("x1"), end(F.array_max, "y1").alias("y1"))
    high = F.col("y1") - F.col("y0")
    pad = lambda most, share: F.least(F.lit(float(most)), F.greatest(F.lit(1.0), F.floor(high * share + 0.5).cast("double")))
    return parts.select(*key, (F.col("x0") - pad(4, 0.08)).alias("x"), (F.col("y0") - pad(3, 0.05)).alias("y"), (F.col("x1") - F.col("x0") + 2 * pad(4, 0.08)).alias("width"), (high + 2 * pad(3, 0.05)).alias("height"))

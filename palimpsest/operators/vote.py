"""From candidates to entities: context scores, groups of overlapping spans, and weighted election of one entity each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T

#: Types of language models, and what a vote of each source weighs (fixed values).
GENERIC = ["PERSON", "ORGANIZATION", "LOCATION", "DATE_TIME", "O", "NRP"]
WEIGHTS = {"regex": 1.4, "presidio": 1.0, "spacy": 0.9}
#: (type, words near it, change of the score), in their order (fixed values).
BOOSTS = [
    ("AADHAAR_NUMBER", ["aadhaar", "uid", "uidai", "aadhar"], 0.12),
    ("PAN_NUMBER", ["pan", "permanent account", "income tax"], 0.12),
    ("DATE_OF_BIRTH", ["dob", "born", "birth", "date of birth", "d.o.b", "जन्म"], 0.10),
    ("PERSON", ["mr", "mrs", "ms", "dr", "shri", "smt", "name", "applicant", "candidate"], 0.10),
    ("PHONE_NUMBER", ["phone", "mobile", "cell", "contact", "tel", "mob"], 0.10),
    ("EMAIL_ADDRESS", ["email", "mail", "e-mail"], 0.05),
    ("GST_NUMBER", ["gst", "gstin", "invoice", "tax"], 0.10),
    ("IFSC_CODE", ["ifsc", "bank", "neft", "rtgs"], 0.10),
    ("UPI_ID", ["upi", "payment", "gpay", "phonepe", "paytm", "bhim", "transfer"], 0.12),
    ("BANK_ACCOUNT", ["account", "a/c", "acc", "savings", "current", "bank"], 0.12),
    ("DRIVING_LICENCE", ["licence", "license", "dl", "driving"], 0.12),
    ("PIN_CODE", ["pin", "pincode", "postal", "zip", "post", "पिन"], 0.12),
]
PENALTIES = [
    ("PERSON", ["order", "invoice", "ref", "id", "number", "product", "item", "section"], 0.15),
    ("PERSON", ["enclave", "flat", "apartment", "society", "nagar", "marg", "street", "road", "address"], 0.50),
    ("AADHAAR_NUMBER", ["order", "invoice", "ref", "tracking", "ticket", "version"], 0.20),
    ("DATE_TIME", ["phone", "mobile", "contact", "tel", "aadhaar", "pan", "gst", "ifsc", "uid", "account", "a/c"], 0.60),
    ("ORGANIZATION", ["aadhaar", "pan", "gst", "ifsc", "uid"], 0.40),
    ("LOCATION", ["pan", "ifsc", "gst"], 0.35),
    ("DATE_OF_BIRTH", ["version", "v.", "release", "patch"], 0.90),
    ("PIN_CODE", ["version", "v.", "release", "patch", "otp", "code"], 0.40),
]
#: The same for texts in Hindi (fixed values).
HINDI_BOOSTS = [
    ("AADHAAR_NUMBER", ["आधार", "आधार संख्या", "आधार नं", "आधार नंबर", "uid", "uidai", "यूआईडी"], 0.10),
    ("PAN_NUMBER", ["स्थायी खाता संख्या", "पैन", "पैन नं", "पैन नंबर", "pan", "income tax"], 0.10),
    ("DATE_OF_BIRTH", ["जन्म तिथि", "जन्मतिथि", "जन्म दिनांक", "dob", "जन्म", "उम्र", "आयु"], 0.10),
    ("PHONE_NUMBER", ["मोबाइल", "फोन", "दूरभाष", "संपर्क", "mobile", "phone"], 0.10),
    ("PERSON", ["नाम", "आवेदक", "आवेदिका", "पिता का नाम", "माता का नाम", "name", "applicant", "श्री", "श्रीमती", "कुमारी", "डॉ"], 0.10),
    ("ADDRESS", ["पता", "पूरा पता", "ग्राम", "गाँव", "जिला", "राज्य", "पिन कोड", "तहसील", "मोहल्ला", "नगर", "शहर", "गली", "address", "village", "district", "state", "pin"], 0.10),
    ("GST_NUMBER", ["जीएसटी", "जीएसटीआईएन", "gst", "gstin"], 0.10),
    ("IFSC_CODE", ["आईएफएससी", "ifsc", "बैंक", "bank"], 0.10),
    ("VOTER_ID", ["मतदाता पहचान", "वोटर आईडी", "voter", "election"], 0.10),
    ("PIN_CODE", ["पिन", "पिन कोड", "pin", "pincode", "postal", "zip"], 0.10),
]
HINDI_PENALTIES = [
    ("AADHAAR_NUMBER", ["order", "tracking", "invoice", "version"], 0.25),
    ("PIN_CODE", ["version", "otp", "code", "ref"], 0.30),
    ("DATE_TIME", ["phone", "mobile", "contact", "tel", "aadhaar", "pan", "gst", "ifsc", "uid", "account", "a/c"], 0.60),
]


def adjusted(score: Column, kind: Column, near: Column, boosts: list = BOOSTS, penalties: list = PENALTIES) -> Column:
    """The score after each boost (1 at most) and then each penalty (0 at least), in order; only those of its type change it."""
    within = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    changes = [*boosts, *((t, words, -by) for t, words, by in penalties)]
    out = F.when(F.lit(False), score)
    for name in dict.fromkeys(t for t, _, _ in changes):
        own = score
        for t, words, by in changes:
            own = within(own + F.when(T.any_in(near, words), F.lit(by)).otherwise(F.lit(0.0))) if t == name else own
        out = out.when(kind == name, own)
    return out.otherwise(within(score))


def score_context(candidates: DataFrame, docs: DataFrame, width: int = 60, hindi: bool = False) -> DataFrame:
    """Candidates with scores changed by the words of their line or sentence, which are those beside them where candidates
    have ``before``, ``raw`` and ``after`` (80 characters at most), else cut from ``docs``."""
    lists = (HINDI_BOOSTS, HINDI_PENALTIES) if hindi else (BOOSTS, PENALTIES)
    if "raw" in candidates.columns:
        whole, joined = F.concat(F.right("before", F.lit(width)), F.col("raw"), F.left("after", F.lit(width))), candidates
    else:
        whole, joined = T.context(F.col("body"), F.col("start"), F.col("end"), width), candidates.join(docs.select("doc_id", F.col("text").alias("body")), "doc_id")
    return T.with_context(joined, "near", whole, F.col("text")).withColumn("score", adjusted(F.col("score"), F.col("entity_type"), F.col("near"), *lists)).select(*candidates.columns)


def group_spans(candidates: DataFrame) -> DataFrame:
    """Candidates with ``pos`` (by start, then higher score, then ``ord``) and ``grp``: spans that overlap; touching ones do not.
    Those with a true column ``late`` are groups of their own."""
    late = ["late"] if "late" in candidates.columns else []
    order = Window.partitionBy("doc_id", *late).orderBy("start", F.desc("score"), "ord", "end", "entity_type")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    free = F.coalesce(F.col("start") >= before, F.lit(True))
    out = candidates.withColumn("pos", F.row_number().over(order)).withColumn("new", ((free | F.col("late")) if late else free).cast("int"))
    return out.withColumn("grp", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def weight(source: Column) -> Column:
    out = F.when(F.lit(False), 1.0)
    for s, w in WEIGHTS.items():
        out = out.when(source == s, w)
    return out.otherwise(1.0)


def elect(candidates: DataFrame, threshold: float = 0.5, structured_first: bool = True, locked: Column | None = None) -> DataFrame:
    """Entities (doc_id, start, end, entity_type, text, score, source, merged_from): one of each group of candidates.

    A locked candidate of the best score gives the type; else the largest weighted sum of scores does, among structured
    types if there are any.  A structured entity's score is the group's best, a generic one's the weighted mean; those
    below ``threshold`` go.  The span is that of the elected type's best weighted candidate.  Ties go to the earlier.
    Candidates may have ``late``: true ones stand for themselves, and entities then have ``late`` and ``ord`` too.
    """
    late = ["late"] if "late" in candidates.columns else []
    rows = group_spans(candidates).withColumn("w", weight(F.col("source")))
    rows = rows.withColumn("sw", F.col("score") * F.col("w")).withColumn("locked", F.col("type_locked") if locked is None else locked)
    rows = rows.withColumn("structured", ~F.col("entity_type").isin(GENERIC) if structured_first else F.lit(True))
    by_type = rows.groupBy("doc_id", *late, "grp", "entity_type").agg(
        F.sum("sw").alias("votes"), F.min("pos").alias("first"), F.max("structured").alias("structured"),
        F.max(F.when(F.col("locked"), F.struct("score", -F.col("pos")))).alias("lock"), F.max_by(F.struct("start", "end", "text"), F.struct("sw", -F.col("pos"))).alias("best"),
        F.sum("w").alias("w"), F.max("score").alias("top"), F.collect_set("source").alias("sources"), F.min("ord").alias("ord"),
    )
    rank = F.struct(F.col("lock").isNotNull().alias("a"), F.col("lock"), F.when(F.col("lock").isNull(), F.col("structured")).alias("b"), F.when(F.col("lock").isNull(), F.round("votes", 9)).alias("c"), -F.col("first"))
    groups = by_type.groupBy("doc_id", *late, "grp").agg(
        F.min("ord").alias("ord"),
        F.max_by(F.struct("entity_type", "best"), rank).alias("e"), F.max("top").alias("top"), (F.sum("votes") / F.sum("w")).alias("mean"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("merged_from"),
    )
    score = F.when(F.col("e.entity_type").isin(GENERIC), F.col("mean")).otherwise(F.col("top"))
    out = groups.withColumn("score", F.least(score, F.lit(1.0))).filter(F.col("score") >= threshold)
    source = F.when(F.size("merged_from") > 1, "merged").otherwise(F.get("merged_from", F.lit(0)))
    return out.select("doc_id", "e.best.start", "e.best.end", "e.entity_type", "e.best.text", "score", source.alias("source"), "merged_from", *late, *(["ord"] if late else []))


def union_languages(first: DataFrame, second: DataFrame, margin: float = 0.05) -> DataFrame:
    """Entities of two detectors in one list without overlaps, as a fold from the left.

    An entity that overlaps the last kept one replaces it if it is structured and that one is not, or if neither or
    both are and its score is over ``margin`` higher; the reach of a replaced span still counts.
    """
    rows = first.select("doc_id", "start", "end", "entity_type", "text", "score").unionByName(second.select("doc_id", "start", "end", "entity_type", "text", "score"))
    kind = "struct<start:int,end:int,entity_type:string,text:string,score:double>"
    grouped = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "entity_type", "text", "score").cast(kind))).alias("es"))
    zero = F.struct(F.lit(0).alias("reach"), F.array().cast(f"array<{kind}>").alias("kept"))

    def step(acc: Column, e: Column) -> Column:
        last = F.element_at(acc.kept, -1)
        free = (F.size(acc.kept) == 0) | (e.start >= acc.reach)
        mine, theirs = ~e.entity_type.isin(GENERIC), ~last.entity_type.isin(GENERIC)
        better = F.when(mine & ~theirs, True).when(~mine & theirs, False).otherwise(e.score > last.score + margin)
        replaced = F.concat(F.slice(acc.kept, F.lit(1), F.greatest(F.size(acc.kept) - 1, F.lit(0))), F.array(e))
        kept = F.when(free, F.concat(acc.kept, F.array(e))).when(better, replaced).otherwise(acc.kept)
        return F.struct(F.greatest(acc.reach, F.when(free | better, e.end).otherwise(acc.reach)).alias("reach"), kept.alias("kept"))

    return grouped.select("doc_id", F.explode(F.aggregate("es", zero, step, lambda acc: acc.kept)).alias("e")).select("doc_id", "e.*")

"""Counts, usage and audit analytics, tenancy, and report chains, over tables of events and logs."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.folds import folded

WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def counts_by(entities: DataFrame, key: str) -> DataFrame:
    """How many entities of each type, source, language or page."""
    return entities.groupBy(key).agg(F.count("*").alias("n"))


def count_map(entities: DataFrame) -> DataFrame:
    """(doc_id, total, by_type): each document's counts by type as a map in order of types."""
    n = entities.groupBy("doc_id", "entity_type").agg(F.count("*").alias("n"))
    return n.groupBy("doc_id").agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("by_type"))


def audit_totals(logs: DataFrame) -> DataFrame:
    """One row: documents, entities, and the share of completed ones in percent."""
    done = F.count_if(F.col("status") == "Completed")
    return logs.agg(F.count("*").alias("documents"), F.sum("entities").alias("entities"), F.round(100.0 * done / F.greatest(F.count("*"), F.lit(1)), 1).alias("success_rate"))


def top_rules(logs: DataFrame, n: int = 8, rules: str = "rules") -> DataFrame:
    """The ``n`` rules applied most often, of an array column; ties by name."""
    return logs.select(F.explode(rules).alias("rule")).groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule").limit(n)


def parsed_rules(column: Column) -> Column:
    return F.from_json(column, "array<string>")


def weekday_volume(logs: DataFrame, at: str) -> DataFrame:
    """(day, n) of all seven weekdays, Monday first; days without rows have 0."""
    days = logs.sparkSession.createDataFrame(list(enumerate(WEEKDAYS)), "i int, day string")
    n = logs.groupBy(F.date_format(at, "E").alias("day")).agg(F.count("*").alias("n"))
    return days.join(n, "day", "left").select("i", "day", F.coalesce("n", F.lit(0)).alias("n")).orderBy("i")


def between(logs: DataFrame, at: str, first: str, last: str) -> DataFrame:
    """Rows of a range of days, both included; null ends are open."""
    day = F.to_date(at)
    return logs.filter((F.lit(first).isNull() | (day >= F.lit(first).cast("date"))) & (F.lit(last).isNull() | (day <= F.lit(last).cast("date"))))


def session_metrics(logs: DataFrame) -> DataFrame:
    """Documents, entities and the last change of each session."""
    return logs.groupBy("session_id").agg(F.count("*").alias("documents"), F.sum("entities").alias("entities"), F.max("created_at").alias("updated_at"))


def latest(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def usage_by_endpoint(usage: DataFrame, since: Column | None = None) -> DataFrame:
    """Requests, mean time and entities of each endpoint."""
    rows = usage if since is None else usage.filter(F.col("used_at") >= since)
    return rows.groupBy("endpoint").agg(F.count("*").alias("requests"), F.avg("processing_ms").alias("avg_ms"), F.sum("entity_count").alias("entities"))


def usage_by_day(usage: DataFrame) -> DataFrame:
    return usage.groupBy(F.to_date("used_at").alias("day")).agg(F.count("*").alias("requests")).orderBy("day")


def delivery_stats(deliveries: DataFrame, most: int = 100) -> DataFrame:
    """Outcomes and mean time of the last ``most`` deliveries."""
    last = deliveries.orderBy(F.desc("at"), F.desc("id")).limit(most)
    return last.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.avg("response_ms"), 2).alias("avg_ms"))


def merged_logs(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Both logs, the later row of each id (of equal times the remote one, then the largest), newest first."""
    both = local.withColumn("_side", F.lit(0)).unionByName(remote.withColumn("_side", F.lit(1)))
    rest = [c for c in local.columns if c not in ("id", "created_at")]
    return latest(both, ["id"], "created_at", "_side", *rest).drop("_side").orderBy(F.desc("created_at"), "id")


def newest(logs: DataFrame, most: int = 50) -> DataFrame:
    """The newest rows of a log, as a page of it shows them."""
    return logs.orderBy(F.desc("created_at"), F.desc("id")).limit(most)


def with_jobs(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents with their jobs (job_id, status); those without any stay."""
    return documents.join(jobs, "doc_id", "left")


def current(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The state after appended updates: the last row of each key, unless that one is a deletion (is_active = 0)."""
    return latest(rows, key, *order).filter("is_active <> 0")


def searched(logs: DataFrame, words: str, skip: int = 0, take: int = 50) -> DataFrame:
    """A page of the rows whose id or name holds ``words``, whatever the case."""
    hit = F.contains(F.lower(F.col("id").cast("string")), F.lit(words.lower())) | F.contains(F.lower("name"), F.lit(words.lower()))
    return logs.filter(hit).orderBy(F.desc("created_at"), "id").offset(skip).limit(take)


def may_see(documents: DataFrame, members: DataFrame, user: int) -> DataFrame:
    """Documents that a user uploaded, or whose organisation has the user as a member; a super admin sees all."""
    mine = members.filter(F.col("user_id") == user).select("org_id", (F.col("role") == "super_admin").alias("admin"))
    seen = documents.join(mine.select("org_id").distinct().withColumn("member", F.lit(True)), "org_id", "left")
    rule = mine.agg(F.coalesce(F.bool_or("admin"), F.lit(False))).scalar()
    return seen.withColumn("_admin", rule).filter((F.col("uploader_id") == user) | F.col("member") | F.col("_admin")).select(*documents.columns)


def members_with_users(members: DataFrame, users: DataFrame) -> DataFrame:
    return members.join(users, "user_id").orderBy("org_id", "user_id")


def over_limit(rows: DataFrame, limits: DataFrame, key: str = "org_id") -> DataFrame:
    """Keys that have as many rows as their plan allows, or more."""
    return rows.groupBy(key).agg(F.count("*").alias("used")).join(limits, key).filter("used >= most").select(key, "used", "most")


def expired(rows: DataFrame, now: Column) -> DataFrame:
    return rows.filter(F.col("expires_at").isNotNull() & (F.col("expires_at") < now))


def subscribed(hooks: DataFrame, event: str) -> DataFrame:
    """Hooks whose comma-separated events hold ``event`` as a whole name."""
    return hooks.filter(F.array_contains(F.transform(F.split("events", ","), lambda e: F.trim(e)), event))


def canonical_json(report: dict) -> str:
    return json.dumps(report, sort_keys=True, separators=(",", ":"), default=str)


def hash_chain(reports: DataFrame) -> DataFrame:
    """``reports`` (session_id, report_id, generated_at string, log_ids array<string>, entity_count) with prev_hash and content_hash.

    Each report's hash is over its canonical JSON, which holds the previous one's: a fold along each session, in the
    order of time and then of ids.
    """

    def chain(last: str | None, r: dict) -> tuple[str, tuple]:
        body = {k: r[k] for k in ("report_id", "session_id", "generated_at", "entity_count")} | {"log_ids": sorted(r["log_ids"]), "prev_hash": last or "GENESIS"}
        now = hashlib.sha256(canonical_json(body).encode()).hexdigest()
        return now, (last or "GENESIS", now)

    return folded(reports, "session_id", ["generated_at", "report_id"], chain, {"prev_hash": "string", "content_hash": "string"})


def broken_links(chain: DataFrame) -> DataFrame:
    """Reports whose prev_hash is not the hash of the report before."""
    w = Window.partitionBy("session_id").orderBy("generated_at", "report_id")
    return chain.withColumn("expected", F.coalesce(F.lag("content_hash").over(w), F.lit("GENESIS"))).filter("prev_hash <> expected")


#: Words that tell what a document is (fixed values).
SIGNALS = {
    "kyc": ["aadhaar", "aadhar", "pan card", "kyc", "know your customer", "date of birth", "dob", "father's name", "mother's name", "permanent address", "identity proof", "address proof", "voter id", "passport number", "driving licence"],
    "invoice": ["invoice", "bill to", "ship to", "gst", "gstin", "tax invoice", "total amount", "subtotal", "payment due", "invoice number", "purchase order", "vendor", "buyer", "seller", "igst", "cgst", "sgst", "amount payable", "due date", "invoice date"],
    "resume": ["curriculum vitae", "resume", "objective", "work experience", "education", "skills", "projects", "internship", "cgpa", "gpa", "references", "hobbies", "certifications", "linkedin", "github", "summary", "profile", "achievements", "publications"],
    "medical": ["patient", "diagnosis", "prescription", "dosage", "medicine", "doctor", "physician", "hospital", "clinic", "blood group", "allergies", "symptoms", "treatment", "discharge summary", "lab report", "radiology", "pathology", "icd", "mg", "tablet"],
    "legal": ["agreement", "contract", "whereas", "hereinafter", "party", "plaintiff", "defendant", "jurisdiction", "arbitration", "governing law", "indemnity", "liability", "breach", "clause", "terms and conditions", "witness", "notary", "affidavit", "memorandum", "deed", "conveyance"],
    "financial": ["account statement", "bank statement", "balance", "credit", "debit", "transaction", "ifsc", "account number", "statement period", "opening balance", "closing balance", "mutual fund", "portfolio", "nav", "units", "folio", "cas", "consolidated account statement"],
    "hr": ["offer letter", "employment", "salary", "ctc", "joining date", "designation", "department", "reporting manager", "probation", "appraisal", "increment", "performance", "leave policy", "notice period", "relieving letter", "experience letter"],
}


def classify(docs: DataFrame, most: int = 2000) -> DataFrame:
    """(doc_id, document_type, confidence) of ``docs`` (doc_id, text, filename): words count 1, phrases 3, the file name 2."""
    sample, name = F.lower(F.substring("text", 1, most)), F.lower(F.coalesce("filename", F.lit("")))
    rows = docs.select("doc_id", F.coalesce(sample, F.lit("")).alias("s"), name.alias("f"))
    scores = []
    for kind, words in SIGNALS.items():
        hit = lambda c, w: F.contains(c, F.lit(w)).cast("int")
        text = sum(((3 if " " in w else 1) * hit(F.col("s"), w) for w in words), F.lit(0))
        file = F.greatest(*(hit(F.col("f"), w) for w in words[:5])) * 2
        scores.append(F.struct((text + file).alias("score"), F.lit(-len(scores)).alias("place"), F.lit(kind).alias("kind")))
    rows = rows.select("doc_id", F.array(*scores).alias("all")).withColumn("best", F.array_max("all")).withColumn("total", F.aggregate("all", F.lit(0), lambda a, x: a + x.score))
    sure = F.col("best.score") >= 3
    return rows.select("doc_id", F.when(sure, F.col("best.kind")).otherwise("unknown").alias("document_type"), F.when(sure, F.round(F.least(F.col("best.score") / F.col("total") * 2, F.lit(1.0)), 3)).otherwise(0.0).alias("confidence"))

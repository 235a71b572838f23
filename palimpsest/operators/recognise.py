"""Recognisers: each finds all spans of a kind in all texts and gives rows of the candidate table.

Candidates are (doc_id, start, end, entity_type, text, score, source, type_locked, ord, before, raw, after); ``ord`` is the
recogniser's place in the fixed order of emission, which settles ties later on, ``raw`` the text as matched, and ``before``
and ``after`` what stands beside it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions import validators as V
from palimpsest.functions.spans import DIGIT, dealt, scanned, stage
from palimpsest.operators import tables, vote

LOCK = 0.80
#: Words that open a gate in a candidate's surroundings (fixed values).
BANK_WORDS = ["account", "a/c", "acc", "bank", "savings", "current", "neft", "rtgs", "imps"]
PHONE_WORDS = ["phone", "mobile", "cell", "contact", "tel", "mob", "+91", "ph", "call", "whatsapp"]
AADHAAR_WORDS = ["aadhaar", "aadhar", "uid", "uidai", "vid"]
PIN_WORDS = [
    "pin", "pincode", "postal", "zip", "post", "पिन", "पिन कोड", "address", "addr", "dist", "district", "city", "state", "taluka", "tal", "village", "road",
    "street", "marg", "lane", "colony", "nagar", "enclave", "sangli", "pune", "mumbai", "delhi", "bangalore", "bengaluru", "hyderabad", "chennai", "kolkata",
    "ahmedabad", "surat", "jaipur", "lucknow", "kanpur", "nagpur", "indore", "thane", "bhopal", "patna", "vadodara", "ghaziabad", "ludhiana", "agra", "nashik",
    "aurangabad", "maharashtra", "gujarat",
]
UPI_WORDS = ["upi", "payment", "pay", "transfer", "gpay", "phonepe", "paytm", "bhim", "send", "receive"]
UPI_BANKS = [
    "okaxis", "okicici", "oksbi", "okhdfcbank", "ybl", "upi", "apl", "axl", "axisbank", "hdfcbank", "icici", "sbi", "kotak", "paytm", "gpay", "ibl", "indus",
    "pnb", "bob", "boi", "cnrb", "federal", "kvb", "rbl", "aubank", "axisb", "waaxis", "waicici", "wasbi", "mahb", "barodampay", "centralbank", "dbs",
    "equitas", "idbi", "idfc", "idfcfirst", "indianbank", "jkb", "jkubank", "kbl", "lvb", "nsdl", "obc", "scb", "syndicate", "tmb", "ubi", "ucb", "ucobank",
    "unionbank", "vijayabank", "yapl", "yesbank", "allbank", "andb", "vijb", "cbin", "dlb", "esaf", "fbl", "hcbl", "hsbc", "icicibankltd", "kccb", "mab",
]
TOP_DOMAINS = ["com", "in", "org", "net", "io", "co", "gov", "edu", "info", "biz", "me", "app"]
BIRTH_WORDS = ["dob", "birth", "born", "जन्म", "d.o.b", "आयु", "age"]
_MONTHS = "(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
#: Dates, and dates after a birth label (fixed values).
DATES = [
    r"\b(?:0?[1-9]|[12]\d|3[01])\s*[\/\-\.]\s*(?:0?[1-9]|1[0-2])\s*[\/\-\.]\s*(?:19|20)\d{2}\b",
    r"\b(?:19|20)\d{2}\s*[\/\-\.]\s*(?:0?[1-9]|1[0-2])\s*[\/\-\.]\s*(?:0?[1-9]|[12]\d|3[01])\b",
    rf"\b(?:0?[1-9]|[12]\d|3[01])\s+{_MONTHS}\s+(?:19|20)\d{{2}}\b",
    rf"\b{_MONTHS}\s+(?:0?[1-9]|[12]\d|3[01]),?\s+(?:19|20)\d{{2}}\b",
    r"\b(?:0?[1-9]|[12]\d|3[01])\s*[\/\-\.]\s*(?:0?[1-9]|1[0-2])\s*[\/\-\.]\s*\d{2}\b",
]
LABELLED_BIRTH = (
    r"(?i)\b(?:date\s+of\s+birth|d\.?o\.?b\.?|birth\s*date|born|year\s+of\s+birth|y\.?o\.?b\.?|जन्म\s*(?:तिथि|दिनांक|तारीख|वर्ष)?)\s*[:\-–—]?\s*"
    r"((?:0?[1-9]|[12]\d|3[01])\s*[\/\-\.]\s*(?:0?[1-9]|1[0-2])\s*[\/\-\.]\s*(?:19|20)\d{2}"
    r"|(?:19|20)\d{2}\s*[\/\-\.]\s*(?:0?[1-9]|1[0-2])\s*[\/\-\.]\s*(?:0?[1-9]|[12]\d|3[01])"
    r"|(?:0?[1-9]|[12]\d|3[01])\s*[\/\-\.]\s*(?:0?[1-9]|1[0-2])\s*[\/\-\.]\s*\d{2}"
    r"|(?:19|20)\d{2}"
    r"|(?:0?[1-9]|[12]\d|3[01])\s+[A-Za-zऀ-ॿ]+\s+(?:19|20)\d{2})"
)
DATE = "(?i)" + "|".join(f"(?:{p})" for p in DATES)


@dataclass(frozen=True)
class Rule:
    """A pattern, the group that is the span, what a match is worth, what a span must look like as a whole, and what every
    text with a candidate holds."""

    id: str
    entity_type: str
    pattern: str
    score: float
    group: int = 0
    keep: str | None = None
    needs: str | None = None


#: English patterns in their order (fixed values).
RULES = [
    Rule("r01", "AADHAAR_NUMBER", r"\b([0-9OoIiLl]{4}[\s\-]?[0-9OoIiLl]{4}[\s\-]?[0-9OoIiLl]{4})\b", 0.85, needs=DIGIT),
    Rule("r02", "PAN_NUMBER", r"\b([A-Z01583]{5}[0-9OoIiLlSsBb]{4}[A-Z01583])\b", 0.95),
    Rule("r03", "GST_NUMBER", r"\b\d{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b", 0.93, needs=DIGIT),
    Rule("r04", "IFSC_CODE", r"\b([A-Z]{4}0[A-Z0-9]{6})\b", 0.92, needs=DIGIT),
    Rule("r05", "VOTER_ID", r"\b([A-Z]{3}[0-9]{7})\b", 0.78, needs=DIGIT),
    Rule("r06", "IN_PASSPORT", r"\b([A-PR-WY][1-9]\d{7})\b", 0.75, needs=DIGIT),
    Rule("r07", "PHONE_NUMBER", r"(?:(?:\+91|0|[OoIiLl])[\s\n\-]*)?(?:[6-9][0-9OoIiLl]{1,4}[\s\n\-]+[0-9OoIiLl]{1,4}[\s\n\-]+[0-9OoIiLl]{1,4}|[6-9][0-9OoIiLl]{1,4}[\s\n\-]+[0-9OoIiLl]{5,8}|[6-9][0-9OoIiLl]{9})\b", 0.85, needs=DIGIT),
    Rule("r08", "PHONE_NUMBER", r"\b([6-9][0-9OoIiLl]{9})\b", 0.80, needs=DIGIT),
    Rule("r09", "EMAIL_ADDRESS", r"\b[a-zA-Z0-9._%+\-]+[\s\n]*@[\s\n]*[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b", 0.98, needs="@"),
    Rule("r10", "BANK_ACCOUNT", r"\b\d{9,18}\b", 0.60, needs=DIGIT),
    Rule("r11", "DRIVING_LICENCE", r"\b[A-Z]{2}[\s\-]?\d{2}[\s\-]?\d{4}[\s\-]?\d{7}\b", 0.78, needs=DIGIT),
    Rule("r12", "IN_VEHICLE_REG", r"\b[A-Z]{2}[\s\-]?\d{1,2}[\s\-][A-Z]{1,3}[\s\-]\d{4}\b", 0.74, needs=DIGIT),
    Rule("r13", "IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.82, needs=DIGIT),
    Rule("r14", "URL", r"https?://[^\s\"'<>]+", 0.90, needs="http"),
    Rule("r15", "CREDIT_CARD", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b", 0.88, needs=DIGIT),
    Rule("r16", "PIN_CODE", r"\b([1-8]\d{5})\b", 0.70, needs=DIGIT),
    Rule("r17", "PIN_CODE", r"\b[A-Z][a-zA-Z]{2,20}\s+([1-8]\d{5})\b", 0.88, 1, needs=DIGIT),
]
#: Surnames, titles, labels and months of the Hindi patterns (fixed values).
_DEVA = r"[ऀ-ॿ]"
_SURNAMES = (
    "शर्मा|वर्मा|गुप्ता|पटेल|सिंह|यादव|कुमार|नायर|मेहता|रेड्डी|चव्हाण|पाटिल|जोशी|शाह|राव|मिश्रा|पांडेय|तिवारी|दुबे|झा|दास|मुखर्जी|बैनर्जी|चौधरी|अग्रवाल|जैन|खान|अहमद|अली|दीक्षित|शुक्ला|सेन|घोष|"
    "कपूर|खन्ना|मल्होत्रा|भट्ट|देशमुख|गांधी|मोदी|नेहरू|नायडू|पिल्लई|नारायण|नाडार|गोयल|बंसल|मित्तल|कौशिक|त्यागी|चौहान|राठौड़|तोमर|जाट|वत्स"
)
_TITLES = r"(?:श्री|श्रीमती|सुश्री|डॉ\.?|कु\.?|कुमार|डॉक्टर)"
_NAME_LABELS = r"(?:(?:पूरा\s*)?नाम|आवेदक(?:\s*का\s*नाम)?|उम्मीदवार(?:\s*का\s*नाम)?|पिता(?:\s*का\s*नाम)?|पति(?:\s*का\s*नाम)?|सत्यापितकर्ता|हस्ताक्षरकर्ता|Full\s*Name|Name|Father'?s\s*Name|Applicant\s*Name)"
_HI_MONTHS = r"(?:जनवरी|फरवरी|मार्च|अप्रैल|मई|जून|जुलाई|अगस्त|सितंबर|अक्टूबर|नवंबर|दिसंबर)"
#: Hindi patterns in their order; all spans are the group after the label (fixed values).
HINDI_RULES = [
    Rule("h01", "AADHAAR_NUMBER", r"आधार(?:\s*संख्या|\s*नं\.?|\s*नंबर)?\s*[:\-]?\s*([2-9]\d{3}[\s\-]?\d{4}[\s\-]?\d{4})", 0.95, 1),
    Rule("h02", "PAN_NUMBER", r"(?i)(?:स्थायी\s*खाता\s*संख्या|पैन(?:\s*कार्ड)?(?:\s*नं\.?|\s*नंबर)?|pan)\s*[:\-]?\s*([A-Z]{5}[0-9]{4}[A-Z])", 0.95, 1),
    Rule("h03", "DATE_OF_BIRTH", rf"(?i)(?:जन्म\s*(?:तिथि|दिनांक|तारीख|वर्ष)?|जन्मतिथि|dob|date\s+of\s+birth)\s*[:\-–—]?\s*(\d{{1,2}}[\/\-\.]\d{{1,2}}[\/\-\.](?:19|20)\d{{2}}|\d{{1,2}}\s+{_HI_MONTHS}\s+(?:19|20)\d{{2}}|\d{{1,2}}[\/\-\.]\d{{1,2}}[\/\-\.]\d{{2}}|(?:19|20)\d{{2}})", 0.94, 1),
    Rule("h04", "PHONE_NUMBER", r"(?:मोबाइल|फोन|दूरभाष|संपर्क)\s*(?:नं\.?|नंबर)?\s*[:\-]?\s*(\+?91[\s\-]?[6-9]\d{4}[\s\-]?\d{5}|[6-9]\d{9})", 0.90, 1),
    Rule("h05", "PIN_CODE", r"पिन\s*(?:कोड)?\s*[:\-]?\s*(\d{6})\b", 0.88, 1),
    Rule("h07", "GST_NUMBER", r"(?i)(?:जीएसटी(?:आईएन)?|gst(?:in)?)\s*[:\-]?\s*(\d{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z])", 0.93, 1),
    Rule("h08", "VOTER_ID", r"(?i)(?:मतदाता\s*पहचान|वोटर\s*(?:आईडी|id))\s*[:\-]?\s*([A-Z]{3}[0-9]{7})", 0.85, 1),
    Rule("h09", "IFSC_CODE", r"(?i)(?:आईएफएससी|ifsc)\s*[:\-]?\s*([A-Z]{4}0[A-Z0-9]{6})", 0.90, 1),
    Rule("h10", "BANK_ACCOUNT", r"(?:खाता\s*(?:संख्या|नं\.?|नंबर)?|बैंक\s*खाता|अकाउंट\s*(?:नं\.?|नंबर)?)\s*[:\-–—]?\s*([०-९0-9]{9,18})", 0.92, 1),
    Rule("h11", "UPI_ID", r"(?i)(?:यूपीआई(?:\s*आईडी)?|upi(?:\s*id)?)\s*[:\-–—]?\s*([a-zA-Z0-9.\-_]{2,64}@[a-zA-Z]{2,20})", 0.92, 1),
    Rule("h12", "PERSON", rf"\b[A-Za-z][a-zA-Z\s]{{1,30}}\s*\(({_DEVA}{{2,25}}(?:\s+{_DEVA}{{2,25}}){{1,3}})(?=\))", 0.96, 1),
    Rule("h13", "PERSON", rf"(?i){_NAME_LABELS}\s*[:\-–—]\s*({_DEVA}{{2,25}}(?:\s+{_DEVA}{{2,25}}){{1,3}})", 0.95, 1),
    Rule("h14", "PERSON", rf"(?<!{_DEVA})({_TITLES}\s+{_DEVA}{{2,25}}(?:\s+{_DEVA}{{2,25}}){{1,3}})(?!{_DEVA})", 0.92),
    Rule("h15", "PERSON", rf"(?<!{_DEVA})({_DEVA}{{2,20}}\s+(?:{_DEVA}{{2,20}}\s+)?(?:{_SURNAMES}))(?!{_DEVA})", 0.88),
]


#: Characters on each side of a span that its surroundings hold, at most.
WIDTH = 80


def _all_spans(docs: DataFrame, rules: list[Rule], unicode: bool = True) -> DataFrame:
    """One scan of the texts for all rules: (doc_id, ord, rule, entity_type, base, start, end, value, raw, before, after)."""
    heads = [F.struct(F.lit(i).alias("ord"), F.lit(r.id).alias("rule"), F.lit(r.entity_type).alias("entity_type"), F.lit(r.score).alias("base")) for i, r in enumerate(rules, 1)]
    rows = scanned(docs, heads, [("(?U)" * unicode + r.pattern, r.group, r.keep, r.needs) for r in rules], WIDTH)
    return rows.select("doc_id", "head.*", "start", "end", "value", F.col("value").alias("raw"), "before", "after")


def around(width: int) -> Column:
    """A candidate with up to ``width`` characters on either side."""
    return F.concat(F.right("before", F.lit(width)), F.col("raw"), F.left("after", F.lit(width)))


def _gate_open() -> Column:
    """Whether a candidate's surroundings allow it: contiguous phone and citizen numbers, accounts and postal codes need a word."""
    kind, value, wide, near = F.col("entity_type"), F.col("value"), F.col("wide"), F.col("near")
    near_plain = F.regexp_replace(near, "[^a-z0-9]", "")
    digits = F.regexp_replace(value, "[^0-9]", "")
    bare = F.length(digits).isin(10, 12) & (F.length(digits) == F.length(F.trim(value)))
    word = lambda words: T.holds_any(near, words) | T.any_in(near_plain, words)
    return (
        F.when(kind == "BANK_ACCOUNT", T.holds_any(wide, BANK_WORDS))
        .when((kind == "PHONE_NUMBER") & bare, word(PHONE_WORDS))
        .when((kind == "AADHAAR_NUMBER") & bare, word(AADHAAR_WORDS))
        .when(F.col("rule") == "r16", T.holds_any(wide, PIN_WORDS))
        .otherwise(True)
    )


#: The checks of kinds that have one.
CHECKS = {"AADHAAR_NUMBER": V.aadhaar_score, "PAN_NUMBER": V.pan_score, "DRIVING_LICENCE": V.licence_score, "IP_ADDRESS": V.ipv4_score, "CREDIT_CARD": V.card_score, "PIN_CODE": V.pin_score}


def validated(kind: Column, value: Column, base: Column, kinds: set[str] | None = None) -> Column:
    """The base score after the check of the candidate's kind, one of ``kinds``; 0 is no candidate."""
    out = F.when(F.lit(False), base)
    for name, check in CHECKS.items():
        if kinds is None or name in kinds:
            out = out.when(kind == name, check(value, base))
    return out.otherwise(base)


def _finish(rows: DataFrame, source: str = "regex", locked: Column | None = None) -> DataFrame:
    locked = F.col("score") >= LOCK if locked is None else locked
    return rows.select("doc_id", "start", "end", "entity_type", F.col("value").alias("text"), "score", F.lit(source).alias("source"), locked.alias("type_locked"), "ord", "before", "raw", "after")


UPI = Rule("r18", "UPI_ID", r"\b[a-zA-Z0-9.\-_]{2,64}@[a-zA-Z]{2,20}\b", 0.72, needs="@")
BIRTHS = [Rule("r19", "DATE_OF_BIRTH", LABELLED_BIRTH, 0.96, 1, needs=DIGIT), Rule("r19b", "DATE_OF_BIRTH", DATE, 0.78, needs=DIGIT)]
_BORN = ["r19", "r19b"]


def _judged(docs: DataFrame, rules: list[Rule], unicode: bool = True) -> DataFrame:
    """Spans of ``rules`` of all kinds in ``docs`` with ``score`` and ``type_locked``; those that are no candidates go.

    Patterns are gated and validated; payment addresses need a known issuer or a short one that is no mail domain; dates
    are surer after a birth label or near a birth word; of spread codes one of mostly single characters needs a word of
    its type near it; values with errors count if a repair makes them valid.
    """
    rule, kind, value, base = F.col("rule"), F.col("entity_type"), F.col("value"), F.col("base")
    wide, plain = F.col("wide"), F.col("plain")
    rows = _all_spans(docs, rules, unicode).withColumn("value", F.when(rule.isin(_BORN), F.trim("value")).otherwise(value))
    # Columns of their own, for the rules that look at them, worked out once: a filter on the score would be moved below them and write them out at each place.
    kept, spread = rows.columns, rule.isin([r.id for r, _ in SPREAD])
    worded = spread | (rule == UPI.id) | (rule == "r16") | (kind == "BANK_ACCOUNT")
    rows = T.with_context(rows, "near", F.when(kind.isin("PHONE_NUMBER", "AADHAAR_NUMBER"), around(35)), value)
    rows = stage(rows, kept, wide=F.when(worded, F.lower(around(80))), near=F.col("near"), born=F.when(rule.isin(_BORN), F.lower(around(60))))
    rows = stage(rows, [*kept, "wide", "near", "born"], plain=F.when(spread, F.regexp_replace("wide", "[^a-z0-9]", "")))
    there = {r.id for r in rules}
    score = None

    def case(ids: list[str], worth: Callable[[], Column]) -> None:
        nonlocal score
        if there & set(ids):
            score = F.when(rule.isin(ids), worth()) if score is None else score.when(rule.isin(ids), worth())

    def upi() -> Column:
        issuer = F.lower(F.substring_index("value", "@", -1))
        known = issuer.isin(UPI_BANKS)
        return F.when(~issuer.isin(TOP_DOMAINS) & (known | (F.length(issuer) <= 10)), F.when(known, 0.88).when(T.holds_any(wide, UPI_WORDS), 0.78).otherwise(0.72))

    def born() -> Column:
        return F.when(rule == "r19", base).when(T.holds_any(F.col("born"), BIRTH_WORDS), 0.90).otherwise(0.78)

    def fragment() -> Column:
        word = reduce(lambda acc, kv: acc | ((rule == kv[0].id) & T.holds_any(plain, kv[1])), SPREAD, F.lit(False))
        packed = F.regexp_replace(F.regexp_replace("value", _BLANK, "\u0001"), r"\s", "")
        spread = F.size(F.split(F.trim("value"), r"\s+")) >= F.length(packed) / 2
        held = ((kind != "AADHAAR_NUMBER") | T.holds_any(wide, AADHAAR_WORDS) | T.holds_any(plain, AADHAAR_WORDS)) & (~spread | word)
        return F.when(held, F.when(spread, base).otherwise(validated(kind, value, base)))

    case([UPI.id], upi)
    case(_BORN, born)
    case([r.id for r, _ in SPREAD], fragment)
    case([REPAIRED[0].id], lambda: V.fuzzy_aadhaar(value))
    case([REPAIRED[1].id], lambda: V.fuzzy_pan(value))
    pattern = F.when(~F.lower(F.trim("value")).isin(T.LABELS) & _gate_open(), validated(kind, value, base, {r.entity_type for r in rules}))
    score = pattern if score is None else score.otherwise(pattern)
    locked = F.when(rule == "r19", True).when(rule == "r19b", F.col("score") >= 0.9).otherwise(F.col("score") >= LOCK)
    rows = stage(rows, kept, score=score).filter(F.when(rule.isin([r.id for r in REPAIRED]), F.col("score") >= 0.9).otherwise(F.col("score") > 0))
    return rows.withColumn("type_locked", locked)


def _uncovered(rows: DataFrame) -> DataFrame:
    """Without dates inside labelled ones, and spread codes inside candidates of their type without gaps: a running
    maximum of the ends of what may cover them, along the starts of a document and type."""
    rule = F.col("rule")
    covers, weak = rule.isin("r19", *(r.id for r in RULES[:4])), rule.isin("r19b", *(r.id for r, _ in SPREAD))
    order = Window.partitionBy("doc_id", "entity_type").orderBy("start", (~covers).cast("int"))
    reach = F.max(F.when(covers, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("reach", reach).filter(~weak | F.coalesce(F.col("reach") < F.col("end"), F.lit(True))).drop("reach")


def scan_patterns(docs: DataFrame, rules: list[Rule] | None = None, unicode: bool = True) -> DataFrame:
    """Candidates of the English patterns, each gated and validated."""
    return _finish(_judged(docs, RULES if rules is None else rules, unicode))


def scan_upi(docs: DataFrame) -> DataFrame:
    """Payment addresses handle@issuer: known issuers, or short ones, better with a payment word near; no mail domains."""
    return detect(docs, ("upi",))


def scan_dates(docs: DataFrame) -> DataFrame:
    """Dates of birth: labelled ones, and any other date, surer with a birth word near; those inside labelled ones are left out."""
    return detect(docs, ("dates",))


def scan_hindi(docs: DataFrame) -> DataFrame:
    """Candidates of the Hindi patterns, on the text with Latin digits (as long as the text itself)."""
    rows = _all_spans(docs.withColumn("text", T.latin_digits(F.col("text"))), HINDI_RULES)
    return _finish(rows.filter(~T.is_hindi_label(F.col("value"))).withColumn("score", F.col("base")), source="hindi_regex")


def scan_custom(docs: DataFrame, rules: dict[str, str], score: float = 0.85, most: int = 20) -> DataFrame:
    """Candidates of a user's patterns by name; unsafe patterns and more than ``most`` of them are an error."""
    if len(rules) > most or (bad := [k for k, p in rules.items() if not V.safe_pattern(p)]):
        raise ValueError(f"too many patterns, or unsafe ones: {bad if len(rules) <= most else len(rules)}")
    rows = _all_spans(docs, [Rule(k, f"CUSTOM_{k}", p, score) for k, p in rules.items()])
    return _finish(rows.withColumn("score", F.col("base")), source="custom", locked=F.lit(False))


#: Patterns of the Hindi model's recognisers in their order; spans with a line feed do not count (fixed values).
HINDI_SHAPES = [
    Rule("m03a", "AADHAAR_NUMBER", r"\b\d{4}[\s\-]\d{4}[\s\-]\d{4}\b", 0.85),
    Rule("m03b", "AADHAAR_NUMBER", r"\b[2-9]\d{11}\b", 0.55),
    Rule("m03c", "PAN_NUMBER", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", 0.95),
    Rule("m03d", "PHONE_NUMBER", r"\+?91[\s\-]?[6-9]\d{4}[\s\-]?\d{5}", 0.88),
    Rule("m03e", "PHONE_NUMBER", r"\b[6-9]\d{9}\b", 0.40),
    Rule("m03f", "GST_NUMBER", r"\b\d{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b", 0.93),
    Rule("m03g", "IFSC_CODE", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", 0.90),
    Rule("m03h", "VOTER_ID", r"\b[A-Z]{3}[0-9]{7}\b", 0.78),
    Rule("m03i", "PIN_CODE", r"\b[1-9]\d{5}\b", 0.72),
]
#: A gap that the dense text leaves out, and one that stays a blank in it.
_GAP, _BLANK = r"[^\S\n]{0,3}", r"(?:[^\S\n]*\n\s*|[^\S\n]{4,})"
_JOINT = rf"(?:{_GAP}-?{_GAP}|{_BLANK})"


def _spread(cls: str, n: int) -> str:
    """A class ``n`` times with gaps between."""
    return f"{cls}(?:{_GAP}{cls}){{{n - 1}}}"


#: The codes that may be spread by blanks, each character with a gap before the next, and words of their type.
SPREAD = [
    (Rule("r21a", "AADHAAR_NUMBER", _JOINT.join([_spread("[0-9OoIiLl]", 4)] * 3), 0.85), AADHAAR_WORDS),
    (Rule("r21b", "PAN_NUMBER", _GAP.join([_spread("[A-Z01583]", 5), _spread("[0-9OoIiLlSsBb]", 4), "[A-Z01583]"]), 0.95), ["pan", "permanentaccount", "incometax"]),
    (Rule("r21c", "GST_NUMBER", _GAP.join([_spread(r"\d", 2), _spread("[A-Z]", 5), _spread("[0-9]", 4), "[A-Z]", "[1-9A-Z]", "Z", "[0-9A-Z]"]), 0.93, needs=DIGIT), ["gst", "gstin", "invoice"]),
    (Rule("r21d", "IFSC_CODE", _GAP.join([_spread("[A-Z]", 4), "0", _spread("[A-Z0-9]", 6)]), 0.92, needs=DIGIT), ["ifsc", "bank", "neft", "rtgs"]),
]


def scan_hindi_shapes(docs: DataFrame) -> DataFrame:
    """Candidates of the Hindi model's pattern recognisers, on the text with Latin digits."""
    rows = _all_spans(docs.withColumn("text", T.latin_digits(F.col("text"))), HINDI_SHAPES)
    rows = rows.filter(~T.is_hindi_label(F.col("value")) & ~F.contains("value", F.lit("\n")))
    return _finish(rows.withColumn("score", F.col("base")), source="presidio", locked=F.lit(False))


def devanagari_segments(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, text): runs of Devanagari with blanks, digits and stops inside, of three characters or more."""
    run = Rule("n10", "SEGMENT", r"[ऀ-ॿ][ऀ-ॿ\s।॥०-९,.\-:]*[ऀ-ॿ]", 1.0)
    rows = _all_spans(docs, [run])
    return rows.filter(F.length(F.trim("value")) >= 3).select("doc_id", "start", "end", F.col("value").alias("text"))


#: Citizen numbers of twelve word characters, of which only those that a repair reads as digits are looked at, and tax ids
#: of ten letters and digits that a repair can read by their places.
REPAIRED = [
    Rule("c15", "AADHAAR_NUMBER", r"\b(?:\w{4}[-\s]?\w{4}[-\s]?\w{4}|\w{12})\b", 0.0, keep=r"^[0-9OoQDIlZzSsbGBgq\s\-]+$"),
    Rule("c16", "PAN_NUMBER", r"\b[A-Za-z012568]{5}[0-9OoQqDdIiZzSsBbGg]{4}[A-Za-z012568]\b", 0.0),
]


def scan_fragments(docs: DataFrame) -> DataFrame:
    """Tax, citizen, GST and bank codes whose characters are spread by blanks.

    A code is found as in a text without blanks, where a gap with a line feed or over three long stays one blank: its
    pattern with such gaps allowed between all characters, in one pass over the text as it is.  A match inside a
    candidate of the same pattern without gaps is left out, and one of mostly single characters needs a word of its type
    near it.
    """
    rows = _uncovered(_judged(docs, RULES[:4] + [r for r, _ in SPREAD]))
    return _finish(rows.filter(F.col("rule").isin([r.id for r, _ in SPREAD])).withColumn("ord", F.col("ord") + 16))


#: The stages of detection in their order: rules, and the place of the first among all candidates.
STAGES = {"upi": ([UPI], 0), "patterns": (RULES, 1), "dates": (BIRTHS, 18), "fragments": ([r for r, _ in SPREAD], 21)}


def _stages(docs: DataFrame, stages: tuple[str, ...], more: list[Rule]) -> DataFrame:
    """Judged spans of some stages' rules and of ``more`` in one scan of texts dealt by document, each with the candidates' order."""
    placed = [(r, first + i) for s in stages for rules, first in [STAGES[s]] for i, r in enumerate(rules)] + [(r, i) for i, r in enumerate(more, 1)]
    order = F.element_at(F.array(*(F.lit(i) for _, i in placed)), F.col("ord"))
    # Dealt before the scan, as a file of few splits would be scanned by few tasks; what follows is at home by document.
    return _uncovered(_judged(dealt(docs), [r for r, _ in placed]).withColumn("ord", order))


def detect(docs: DataFrame, stages: tuple[str, ...] = ("upi", "patterns", "dates", "fragments")) -> DataFrame:
    """All candidates of the chosen stages over ``docs`` (doc_id, text), which is read once; fragments go with patterns."""
    return _finish(_stages(docs, stages, []), locked=F.col("type_locked"))


_ENTITY = ["start", "end", "entity_type", "text", "score", "source"]


_MORE = "array<struct<start:int,end:int,entity_type:string,text:string,score:double,source:string>>"


def _joined(rows: DataFrame) -> DataFrame:
    """Of (doc_id, late, ord, start, end, entity_type, text, score, source): the rows that aren't late, and late ones, in
    order, that meet no span taken before them; a fold along the late spans of a document."""
    entity = F.struct(*_ENTITY)
    known = F.collect_list(F.when(~F.col("late"), entity)).cast(_MORE).alias("known")
    more = F.collect_list(F.when(F.col("late"), F.struct("ord", *_ENTITY)))
    more = F.transform(F.array_sort(more), lambda e: F.struct(*(e[c].alias(c) for c in _ENTITY))).cast(_MORE).alias("more")
    meets = lambda a, b: (a.start < b["end"]) & (a["end"] > b.start)
    joins = lambda out, e: F.when(F.exists(out, lambda o: meets(o, e)), out).otherwise(F.concat(out, F.array(e)))
    grouped = rows.groupBy("doc_id").agg(known, more)
    return grouped.select("doc_id", F.explode(F.aggregate("more", F.col("known"), joins)).alias("e")).select("doc_id", "e.*")


def _table_cells(docs: DataFrame) -> DataFrame:
    """Cells of text tables as late rows; only texts with a pipe or a tab have any."""
    some = docs.filter(F.contains("text", F.lit("|")) | F.contains("text", F.lit("\t")))
    return tables.text_tables(some).select("doc_id", F.lit(True).alias("late"), "ord", *_ENTITY)


def recovered(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (doc_id, start, end, entity_type, text, score, source) and what recognition errors and tables hid from it.

    Citizen numbers of twelve word characters and tax ids of ten that a repair of confused characters makes valid, at
    0.90 or more, and then cells below a table's headers; each only where it meets no span found before it, as a fold
    along the spans of a document.
    """
    late = _judged(docs, REPAIRED).select("doc_id", F.lit(True).alias("late"), "ord", "start", "end", "entity_type", F.col("value").alias("text"), "score", F.lit("fuzzy").alias("source"))
    known = found.select("doc_id", F.lit(False).alias("late"), F.lit(0).alias("ord"), *_ENTITY)
    return _joined(known.unionByName(late).unionByName(_table_cells(docs)))


def entities_of(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """All entities of ``docs`` (doc_id, text): every stage's candidates, scored by context, elected, and what was hidden.

    One scan finds the spans of all stages and those with errors; they are dealt by document once, without the texts, and
    scored, elected and joined there.  Tables are looked for in a second scan, of texts that may have one.
    """
    rows = _stages(docs, ("upi", "patterns", "dates", "fragments"), REPAIRED)
    late = F.col("rule").isin([r.id for r in REPAIRED])
    rows = T.with_context(rows, "near", around(60), F.col("value"))
    scored = F.when(late, F.col("score")).otherwise(vote.adjusted(F.col("score"), F.col("entity_type"), F.col("near")))
    rows = rows.withColumn("score", scored).drop("near").withColumn("late", late).withColumn("source", F.when(late, "fuzzy").otherwise("regex")).withColumnRenamed("value", "text")
    found = vote.elect(rows, threshold).select("doc_id", "late", "ord", *_ENTITY)
    return _joined(found.unionByName(_table_cells(docs)))

"""Text functions on columns: cleaning, scripts, context around spans, dense text."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DEVANAGARI_DIGITS, DIGITS = "०१२३४५६७८९", "0123456789"
#: Labels and headings that are never personal data (fixed values).
LABELS = [
    "mobile", "name", "full name", "dob", "address", "contact", "email", "state", "city", "document ref", "verification date", "upi", "upi id",
    "ifsc", "ifsc code", "pan", "pan number", "gstin", "gst", "gst number", "aadhaar", "aadhaar number", "voter id", "bank account", "driving licence",
]
HINDI_LABELS = [
    "पहचान", "सत्यापन", "अभिलेख", "विवरण", "आवेदक", "पता", "स्थायी", "निवास", "नाम", "संख्या", "दिनांक", "तारीख", "जन्मतिथि", "जन्म", "तिथि", "मोबाइल",
    "दूरभाष", "संपर्क", "वित्तीय", "हस्ताक्षर", "घोषणा", "खाता", "बैंक", "आईडी", "कार्ड", "दस्तावेज", "प्रारूप", "पिन", "पिनकोड", "कोड", "मतदाता", "पहचान पत्र",
    "आवेदक का विवरण", "स्थायी निवास पता", "वित्तीय विवरण", "टिप्पणी एवं घोषणा", "सत्यापितकर्ता", "निवास पता", "हस्ताक्षरकर्ता", "पहचान सत्यापन", "केवाईसी",
]
#: Words of addresses and forms that are no names in Hindi either, and English labels there (fixed values).
HINDI_PLACES = [
    "सिविल", "लाइंस", "सिविल लाइंस", "फ्लैट", "मकान", "सड़क", "मार्ग", "गली", "मोहल्ला", "कॉलोनी", "नगर", "अपार्टमेंट", "सोसायटी", "रेजीडेंसी", "मंदिर",
    "मार्केट", "यार्ड", "अन्य पता", "पता:", "हिंदी पता:",
]
#: Single words that are labels and no values (fixed values).
LABEL_WORDS = [
    "aadhaar", "aadhar", "pan", "ifsc", "gst", "gstin", "passport", "voter", "voterid", "email", "phone", "mobile", "address", "dob", "name", "uid", "uidai",
    "date", "year", "month", "day", "time", "number", "ref", "id", "total", "amount", "kyc", "record", "applicant", "verification", "details", "signature", "declaration",
]


def latin_digits(text: Column) -> Column:
    """Devanagari digits as 0-9, place by place."""
    return F.translate(text, DEVANAGARI_DIGITS, DIGITS)


def clean_ocr(text: Column) -> Column:
    """Repairs frequent recognition errors: digits, O and l beside the other kind, quotes, line ends, blanks.  Offsets shift."""
    out = latin_digits(text)
    for pattern, to in [
        (r"(?U)\b0(?=[A-Z])", "O"),
        (r"(?U)(?<=[A-Z])0\b", "O"),
        (r"(?U)\bl(?=\d)", "1"),
        (r"(?U)(?<=\d)l\b", "1"),
        (r"[`]", "'"),
        (r"[„]", '"'),
        (r"\r\n|\r", "\n"),
        (r"[ \t]{2,}", " "),
    ]:
        out = F.regexp_replace(out, pattern, to)
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def normalise_ocr(text: Column) -> Column:
    """Composed letters, a danda for a double bar, no zero-width marks, single blanks, two line feeds at most."""
    out = F.regexp_replace(F.replace(_nfc(text), F.lit("‖"), F.lit("।")), "[​﻿]", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\r\n?", "\n"), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def is_label(span: Column) -> Column:
    """Whether a span is a form label, a heading or a list mark and no value."""
    s = F.trim(span)
    marks = F.rlike(s, F.lit(r"^(#|---|\*\*|- |\* )"))
    return (s == "") | F.lower(s).isin(LABELS + LABEL_WORDS) | s.isin(HINDI_LABELS) | marks


def is_hindi_label(span: Column) -> Column:
    """The same for Hindi texts, where single characters and words of addresses are no values either."""
    s = F.trim(span)
    return is_label(span) | (F.length(s) < 2) | s.isin(HINDI_PLACES)


def stages(mode: Column) -> Column:
    """The detectors that a text of this script needs, in their order."""
    english, hindi = ["regex", "presidio", "spacy"], ["hindi_regex", "hindi_presidio", "spacy_hi"]
    listed = lambda names: F.array(*map(F.lit, names))
    return F.when(mode == "hindi", listed(hindi)).when(mode == "mixed", listed(english + hindi)).otherwise(listed(english))


def script_label(mode: Column) -> Column:
    return F.when(mode == "hindi", "HINDI").when(mode == "english", "ENGLISH").when(mode == "mixed", "HINDI + ENGLISH").otherwise("UNKNOWN")


def context(text: Column, start: Column, end: Column, width: int = 40) -> Column:
    """The span with up to ``width`` characters on either side."""
    first = F.greatest(start - width, F.lit(0))
    return F.substr(text, (first + 1).cast("int"), (end + width - first).cast("int"))


def _bounded(around: Column, value: Column, lines: Column, lead: Column) -> Column:
    """The line of ``lines`` that holds ``value`` behind ``lead``, or else ``around``, in lower case."""
    # A value without separators stands first in the first line that holds it; no line holds one with a separator.
    rest = F.substr(lines, F.length(lead) + F.length(value) + 1, F.length(lines))
    line = F.concat(F.substring_index(lead, "\n", -1), value, F.substring_index(rest, "\n", 1))
    held = ((lead != lines) | (value == "")) & ~F.contains(value, F.lit("\n"))
    return F.lower(F.when(held, line).otherwise(around))


def bounded_context(around: Column, span: Column) -> Column:
    """The first line or sentence of a context that holds the span, or else the whole, in lower case."""
    value, lines = F.trim(span), F.replace(around, F.lit("."), F.lit("\n"))
    return _bounded(around, value, lines, F.call_function("substring_index", lines, value, F.lit(1)))


def with_context(rows: DataFrame, name: str, around: Column, span: Column) -> DataFrame:
    """``rows`` with the ``bounded_context`` of a span as a column, whose parts are columns too, so that each is worked out
    once for a row; null where ``around`` is."""
    rows = rows.withColumns({"_around": around, "_value": F.trim(span)}).withColumn("_lines", F.replace("_around", F.lit("."), F.lit("\n")))
    rows = rows.withColumn("_lead", F.call_function("substring_index", "_lines", "_value", F.lit(1)))
    near = _bounded(F.col("_around"), F.col("_value"), F.col("_lines"), F.col("_lead"))
    return rows.withColumn(name, near).drop("_around", "_value", "_lines", "_lead")


def any_in(text: Column, words: list[str]) -> Column:
    """Whether any of the words occurs, as a part of the text, by one pattern, which names an expression once."""
    return F.rlike(text, F.lit("|".join(rf"\Q{w}\E" for w in words)))


def holds_any(text: Column, words: list[str]) -> Column:
    """The same of a text that is a column by itself, as it is named for each word: the first that is there is enough, where
    a pattern tries all words at every place."""
    return reduce(lambda found, w: found | F.contains(text, F.lit(w)), words[1:], F.contains(text, F.lit(words[0])))


def count_of(text: Column, letters: str) -> Column:
    """How many characters belong to a class."""
    return F.length(text) - F.length(F.regexp_replace(text, letters, ""))


def script(text: Column) -> Column:
    """``hindi``, ``english``, ``mixed`` or ``unknown``, by shares of all letters."""
    letters = F.greatest(count_of(text, r"\p{L}"), F.lit(1))
    deva, latin = count_of(text, r"[ऀ-ॿ]") / letters, count_of(text, r"[A-Za-z]") / letters
    return F.when((deva > 0.1) & (latin > 0.1), "mixed").when(deva > 0.1, "hindi").when(latin > 0.1, "english").otherwise("unknown")


def is_hindi(text: Column, share: float = 0.05) -> Column:
    """Whether over ``share`` of what is no space is Devanagari."""
    return count_of(text, r"[ऀ-ॿ]") > F.greatest(count_of(text, r"\S"), F.lit(1)) * share


def dense(text: Column) -> Column:
    """The text without white space, but for one blank in gaps that hold a line feed or are longer than three."""
    out = F.regexp_replace(F.trim(text), r"\s*\n\s*|\s{4,}", "\u0001")
    return F.replace(F.regexp_replace(out, r"\s+", ""), F.lit("\u0001"), F.lit(" "))


def scrub(message: Column) -> Column:
    """A message with mail addresses, cards, tax ids, citizen ids and phones replaced by tags, in this order."""
    for pattern, tag in [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
        (r"\b[0-9]{13,19}\b", "[CARD]"),
        (r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", "[PAN]"),
        (r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b", "[AADHAAR]"),
        (r"\b[6-9][0-9]{9}\b", "[PHONE]"),
    ]:
        message = F.regexp_replace(message, pattern, tag)
    return message


def match_key(text: Column) -> Column:
    """Upper case without blanks, hyphens, slashes and stops, for comparing values."""
    return F.upper(F.regexp_replace(text, r"[\s\-_/\\.:,]", ""))


def words(text: Column) -> Column:
    """The number of words."""
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))


_RANGE = r"^\d+(\s*-\s*\d+)?$"


def _ranges(selection: Column) -> Column:
    """(low, high) of the parts of a selection: null where a part is no number or range, or beyond 64 bits."""
    part = lambda p, i: F.trim(F.coalesce(F.get(F.split(p, "-"), F.lit(i)), p)).try_cast("bigint")
    said = lambda p: F.when(F.rlike(p, F.lit(_RANGE)), F.struct(part(p, 0).alias("low"), part(p, 1).alias("high")))
    return F.transform(F.split(selection, ","), lambda p: said(F.trim(p)))


def selected_pages(selection: Column, pages: Column) -> Column:
    """Pages of "all" or "1,3,5-7"; parts that are no numbers are skipped, others clipped to the document."""
    clip = lambda r: F.struct(F.greatest(r.low, F.lit(1)).alias("low"), F.least(r.high, pages.cast("bigint")).alias("high"))
    held = F.filter(F.transform(F.filter(_ranges(selection), lambda r: r.low.isNotNull() & r.high.isNotNull()), clip), lambda r: r.low <= r.high)
    chosen = F.array_sort(F.array_distinct(F.flatten(F.transform(held, lambda r: F.sequence(r.low.cast("int"), r.high.cast("int"))))))
    return F.when(F.lower(F.trim(selection)) == "all", F.when(pages >= 1, F.sequence(F.lit(1), pages)).otherwise(F.array().cast("array<int>"))).otherwise(chosen)


def strict_pages(selection: Column, pages: Column) -> Column:
    """As ``selected_pages``, but null if any part is no page or range of the document."""
    good = F.forall(_ranges(selection), lambda r: F.coalesce((r.low >= 1) & (r.high <= pages) & (r.low <= r.high), F.lit(False)))
    return F.when(good | (F.lower(F.trim(selection)) == "all"), selected_pages(selection, pages))

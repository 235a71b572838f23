"""Checks of identifiers as column expressions; scores are the base score scaled by what a check finds."""

from __future__ import annotations

import hashlib
import hmac
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Tables of the dihedral check (fixed values).
MULTIPLY = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 2, 3, 4, 0, 6, 7, 8, 9, 5], [2, 3, 4, 0, 1, 7, 8, 9, 5, 6], [3, 4, 0, 1, 2, 8, 9, 5, 6, 7],
    [4, 0, 1, 2, 3, 9, 5, 6, 7, 8], [5, 9, 8, 7, 6, 0, 4, 3, 2, 1], [6, 5, 9, 8, 7, 1, 0, 4, 3, 2], [7, 6, 5, 9, 8, 2, 1, 0, 4, 3],
    [8, 7, 6, 5, 9, 3, 2, 1, 0, 4], [9, 8, 7, 6, 5, 4, 3, 2, 1, 0],
]
PERMUTE = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], [5, 8, 0, 3, 7, 9, 6, 1, 4, 2], [8, 9, 1, 6, 0, 4, 3, 5, 2, 7],
    [9, 4, 5, 3, 1, 2, 6, 8, 7, 0], [4, 2, 8, 6, 5, 7, 3, 9, 0, 1], [2, 7, 9, 3, 8, 0, 6, 4, 1, 5], [7, 0, 4, 6, 9, 1, 3, 2, 5, 8],
]
#: Kinds of holder in the fourth letter of a tax id, and states of a driving licence (fixed values).
HOLDERS = ["A", "B", "C", "F", "G", "H", "J", "L", "P", "T", "K", "E"]
STATES = [
    "AP", "AR", "AS", "BR", "CG", "GA", "GJ", "HR", "HP", "JH", "KA", "KL", "MP", "MH", "MN", "ML", "MZ", "NL", "OD", "PB",
    "RJ", "SK", "TN", "TS", "TR", "UP", "UK", "WB", "AN", "CH", "DN", "DD", "DL", "JK", "LA", "LD", "PY",
]


def _table(rows: list[list[int]]) -> Column:
    return F.expr(f"array({', '.join(str(x) for row in rows for x in row)})")


def verhoeff_residue(digits: Column) -> Column:
    """0 if the check digit, the last one, is right; null if a character is no digit."""
    places = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.get(_table(PERMUTE), (i % 8) * 10 + d.cast("int")))
    return F.when(F.rlike(digits, F.lit("^[0-9]+$")), F.aggregate(places, F.lit(0), lambda c, x: F.get(_table(MULTIPLY), c * 10 + x)))


def aadhaar_digits(value: Column) -> Column:
    return F.translate(F.upper(F.regexp_replace(value, r"[^0-9OoIiLl]", "")), "OIL", "011")


def aadhaar_score(value: Column, base: Column) -> Column:
    """Twelve digits, the first not 0, over three distinct; 0.9 for repaired letters, 0.72 for a wrong check digit."""
    digits = aadhaar_digits(value)
    right = verhoeff_residue(digits) == 0
    weight = F.when(right, 1.0).when(F.rlike(value, F.lit("[OoIiLl]")), 0.9).otherwise(0.72)
    bad = (F.length(digits) != 12) | F.startswith(digits, F.lit("0")) | (F.size(F.array_distinct(F.split(digits, ""))) <= 3)
    return F.when(bad, 0.0).otherwise(base * weight)


def repaired_pan(value: Column) -> Column:
    """A tax id with letters for digits, and digits for letters, where the other kind belongs."""
    v = F.replace(F.upper(F.trim(value)), F.lit(" "), F.lit(""))
    letters = lambda s: F.translate(s, "01583", "OISBB")
    return F.concat(letters(F.substring(v, 1, 5)), F.translate(F.substring(v, 6, 4), "OILSB", "01158"), letters(F.substr(v, F.lit(10), F.length(v))))


def is_pan(value: Column) -> Column:
    return F.rlike(value, F.lit("^[A-Z]{5}[0-9]{4}[A-Z]$")) & F.substring(value, 4, 1).isin(HOLDERS)


def pan_score(value: Column, base: Column) -> Column:
    pan = repaired_pan(value)
    return F.when(~F.rlike(pan, F.lit("^[A-Z]{5}[0-9]{4}[A-Z]$")), 0.0).when(~F.substring(pan, 4, 1).isin(HOLDERS), base * 0.4).otherwise(base)


def licence_score(value: Column, base: Column) -> Column:
    return F.when(F.upper(F.substring(value, 1, 2)).isin(STATES), base).otherwise(base * 0.3)


def ipv4_score(value: Column, base: Column) -> Column:
    """0 if an octet is over 255; half for loopback and private networks."""
    octets = F.transform(F.split(value, r"\."), lambda p: p.cast("int"))
    own = F.rlike(value, F.lit(r"^(127\.|10\.|192\.168\.)"))
    return F.when(F.exists(octets, lambda o: o.isNull() | (o > 255)), 0.0).when(own, base * 0.5).otherwise(base)


def luhn_valid(value: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(value, "[^0-9]", ""))


def card_valid(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def card_score(value: Column, base: Column) -> Column:
    return F.when(luhn_valid(value), base).otherwise(0.0)


def pin_score(value: Column, base: Column) -> Column:
    return F.when(F.substring(value, 1, 2).cast("int").between(11, 99), base).otherwise(0.0)


#: Characters that recognition takes for digits, digits for letters, and digits for each other (fixed values).
AS_DIGIT = ("OoQDIl|!][ZzSs$bGB&gq", "000011111122555668899")
AS_LETTER = ("012568", "OIZSGB")
OTHER_DIGIT = {"8": "3", "3": "8", "5": "6", "6": "5", "0": "9", "1": "7", "7": "1"}


def fuzzy_aadhaar(value: Column) -> Column:
    """1.0 as it is, 0.95 after all confused characters are read as digits, 0.90 if just one changed place makes it valid; else 0."""
    v = F.regexp_replace(value, r"[\s\-_/.]", "")
    valid = lambda d: F.coalesce(verhoeff_residue(d) == 0, F.lit(False))
    translated = F.translate(v, *AS_DIGIT)
    confused = F.create_map(*(F.lit(x) for kv in [*zip(*AS_DIGIT, strict=True), *OTHER_DIGIT.items()] for x in kv))
    other = lambda i: F.element_at(confused, F.substr(v, i, F.lit(1)))
    changed = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.substr(v, F.lit(1), i - 1), other(i), F.substr(v, i + 1, F.lit(12))))
    repairs = F.size(F.filter(changed, lambda d: d.isNotNull() & valid(d)))
    return F.when(F.length(v) != 12, 0.0).when(valid(v), 1.0).when(valid(translated), 0.95).when(repairs == 1, 0.9).otherwise(0.0)


def fuzzy_pan(value: Column) -> Column:
    """1.0 for a valid tax id, 0.92 for one that is after repairs by place, else 0."""
    v = F.regexp_replace(F.upper(value), r"[\s\-_/.]", "")
    holders = [h for h in HOLDERS if h not in "KE"]
    good = lambda p: F.rlike(p, F.lit("^[A-Z]{5}[0-9]{4}[A-Z]$")) & F.substring(p, 4, 1).isin(holders)
    letter = lambda s: F.translate(s, *AS_LETTER)
    fixed = F.concat(letter(F.substring(v, 1, 5)), F.translate(F.substring(v, 6, 4), *AS_DIGIT), letter(F.substring(v, 10, 1)))
    return F.when(F.length(v) != 10, 0.0).when(good(v), 1.0).when(good(fixed), 0.92).otherwise(0.0)


def in_compound(before: Column, after: Column) -> Column:
    """Whether a value is a part of a longer code, as a letter or digit stands before or after it, hyphens between."""
    return F.rlike(before, F.lit(r"[A-Za-z0-9]-*\z")) | F.rlike(after, F.lit("^-*[A-Za-z0-9]"))


def half_even(x: Column, places: int) -> Column:
    """``x`` rounded to ``places`` as its decimal digits say, halves to the even digit."""
    return F.bround(x, places)


def half_even_double(x: Column, places: int) -> Column:
    """A double rounded to ``places`` as its exact binary value says, halves to the even digit: 2.675 is below the half.

    The product with the power of ten is split into a double and the exact error of that product, by which a half that only
    seems one is told; beyond 2 ** 52 the value itself is returned, like null, NaN and infinities.
    """
    power = float(10**places)
    split = lambda v: v * 134217729.0 - (v * 134217729.0 - v)
    size = F.abs(x)
    product = size * power
    high = split(size)
    high_power = 134217729.0 * power - (134217729.0 * power - power)
    low, low_power = size - high, power - high_power
    error = ((high * high_power - product) + high * low_power + low * high_power) + low * low_power
    whole = F.floor(product).cast("double")
    beyond = (product - whole) - 0.5
    side = F.when(beyond != 0, beyond).otherwise(error)
    up = F.when(side == 0, whole % 2 == 1).otherwise(side > 0)
    rounded = (whole + up.cast("double")) / power
    return F.when(size.isNull() | F.isnan(size) | (product >= 2.0**52), x).otherwise(F.when(x < 0, -rounded).otherwise(rounded))


def char_shape(value: Column) -> Column:
    """L for each letter, D for each digit, ? for anything else."""
    out = F.regexp_replace(F.regexp_replace(value, r"\p{L}", "\u0001"), r"\p{Nd}", "\u0002")
    return F.translate(F.regexp_replace(out, "[^\u0001\u0002]", "?"), "\u0001\u0002", "LD")


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared length over the hull of two spans that meet, else 0."""
    shared = F.least(a1, b1) - F.greatest(a0, b0)
    return F.when(shared > 0, shared / (F.greatest(a1, b1) - F.least(a0, b0))).otherwise(0.0)


def box_iou(a: Column, b: Column) -> Column:
    """Shared area over the joint area of two boxes (x0, y0, x1, y1)."""
    w = F.greatest(F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.lit(0.0))
    h = F.greatest(F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0), F.lit(0.0))
    both = (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - w * h
    return F.when(both > 0, w * h / both).otherwise(0.0)


#: What may stand between the letters of a recognised value, and letters that are read for one another (fixed values).
SEPARATORS = r"[\s\-_/\\.:,]"
CONFUSED = ("01528", "OISZB")


def ocr_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of upper-cased values without separators; of equally long ones, the places that differ by no confusable pair."""
    a, b = (F.upper(F.regexp_replace(x, SEPARATORS, "")) for x in (a, b))
    places = F.zip_with(*(F.split(F.translate(x, *CONFUSED), "") for x in (a, b)), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(places, F.lit(0), lambda s, x: s + x)).otherwise(F.levenshtein(a, b))


def safe_pattern(pattern: str, most: int = 500) -> bool:
    """Whether a user's pattern may run: short, compiling, without a quantifier on a quantified group."""
    if len(pattern) > most or re.search(r"\([^()]*[+*][^()]*\)\s*[+*{]", pattern):
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def signature(secret: str):  # noqa: ANN201
    """A column function: the HMAC-SHA256 of a payload, in hex."""

    @F.pandas_udf(StringType())
    def sign(payload: pd.Series) -> pd.Series:
        return payload.map(lambda p: None if p is None else hmac.new(secret.encode(), p.encode(), hashlib.sha256).hexdigest())

    return sign


def file_kind(name: Column) -> Column:
    """What a file's name tells of its content; the first hit counts (fixed values)."""
    n, out = F.lower(name), None
    for words, kind in [(["aadhaar", "aadhar"], "Aadhaar"), (["pan"], "PAN"), (["passport"], "Passport"), (["invoice", "bill"], "Invoice"), (["statement", "bank"], "Bank Statement"), (["resume", "cv"], "Resume")]:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(n, F.lit(w))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("Document")

"""What redacted documents still show: the checks against values written by hand, and joins of boxes against brute force."""

import random
from collections import Counter
from pathlib import Path

import pytest

from palimpsest.functions.spans import matched
from palimpsest.operators import spatial, verify

DOCS = "doc_id bigint, text string"
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
PAN = "ABCPE1234F"


def windows(spark, texts, allowed=None):
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    may = None if allowed is None else spark.createDataFrame(allowed, DOCS)
    out = {i: [] for i in range(len(texts))}
    for r in verify.visual_candidates(docs, may).collect():
        out[r.doc_id].append((r.leak_type[:3], r.window))
    return [sorted(v) for v in out.values()]


def test_what_looks_like_a_tax_number(spark):
    shown = [f"Permanent number: {PAN}", f"PAN: ({PAN})", f"Record: [{PAN}], active.", f"{PAN}.", f"-{PAN}", f"{PAN}-", f"---{PAN}---", f"PAN - {PAN} - active", f"Ref: -{PAN}- active", "see ABCPE 1234F", "see ABCPE\n\n1234F"]
    hidden = [f"Item {PAN}-01 packed", f"PART-{PAN} here", f"PART--{PAN} in stock", f"Serial {PAN}--01", f"SKU-{PAN}-01", f"ORDER{PAN}99", f"X{PAN} sent", f"{PAN}9 done", "TOTAL 1234 B", "AR 2363 4532 0 1", "abcpe1234f", "aBcpe1234f", "A B C P E 1 2 3 4 F", "ABCPE" + " " * 25 + "1234F", "", None, "short"]
    got = windows(spark, shown + hidden)
    assert got[: len(shown)] == [[("PAN", PAN)]] * len(shown)
    assert [g for g in got[len(shown) :] if any(k == "PAN" for k, _ in g)] == []


def test_tax_numbers_with_a_wrong_character(spark):
    texts = ["got ABCPEO234F", "say ABCPE O234F", "income tax of ABCPE O234F", "say ABCPEO23SF", "A8CPE1234F", "ABC4E1234F", "12X456Y89012", "AR2363453201", "incometaxes ABCPE O234F", "x" * 119 + " pan" + " " * 3 + "ABCPE O234F", "pan" + "." * 130 + " ABCPE O234F"]
    got = windows(spark, texts)
    # One wrong character at most, and then without a blank or with a word of its context as a word of its own near by.
    assert [bool(g) for g in got] == [True, False, True, False, True, False, False, False, False, True, False]


def test_what_looks_like_a_citizen_number(spark):
    texts = ["num 2363 4532 0151", "num 236345320151", "num 136345320151", "uid 136345320151", "num 1363 45320151", "2 3 6 3 4 5 3 2 0 1 5 1", "num 236345320151345", "x O363 4532 015l", "O3634532015l", "aadhaar O3634532015l", "x OOO3 4532 0151", "23 63 45 32 01 51"]
    assert [bool(g) for g in windows(spark, texts)] == [True, True, False, True, True, False, False, True, False, True, False, False]
    # A blank before a digit parts it, so that windows of more digits in groups overlap.
    assert windows(spark, ["4444 5555 6666 7777"]) == [[("AAD", "444455556666"), ("AAD", "555566667777")]]


def test_what_a_reviewer_rejected_may_stay(spark):
    assert windows(spark, [PAN, "see ABCPE 1234F", PAN], [(0, f" {PAN.lower()} "), (1, PAN), (1, "abcpe 1234f"), (0, None)]) == [[], [], [("PAN", PAN)]]


def test_long_texts_take_time_in_proportion(spark):
    text = ("Order 12345678901234 of ABCPE1234F-01 and x, " * 3000) + "PAN ABCPE1234F"
    assert windows(spark, [text, "9 " * 30_000]) == [[("PAN", PAN)], []]


def test_spread_numbers(spark):
    texts = ["as A B C D E 1 2 3 4 F", "- A B C D E 1 2 3 4 F -", "PART- A B C D E 1 2 3 4 F", "xA B C D E 1 2 3 4 F", "ABCDE 1234 F", "ABCDE  12 34 F", "23 63 45 32 01 51", "2363 - 4532 - 0151", "a b c d e 1 2 3 4 f", "A B C D E 1 2 3 4", None]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: r.leak_type[:3] for r in verify.dense_leaks(docs).collect()}
    assert got == {0: "PAN", 1: "PAN", 2: "PAN", 5: "PAN", 6: "AAD", 7: "AAD", 8: "PAN"}
    assert verify.dense_leaks(docs, spark.createDataFrame([(0, "abcde1234f"), (6, "x")], DOCS)).filter("doc_id in (0, 6)").count() == 1


def test_patterns_that_are_left(spark):
    texts = [
        f"PAN {PAN}", f"line 9\n{PAN}\nnext", PAN.lower(), f"SKU-{PAN}", f"{PAN}--01", f"X{PAN}", f"-{PAN}-", "id 1234 5678 9012", "id 1234-56789012", "4532 0151 1283 0366", "4532015112830367", "call +91-9876543210 or 5876543210",
        "to a.b+c@x-y.co.in.", "none", "", None, "१२३४ ५६७८ ९०१२",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {i: [] for i in range(len(texts))}
    for r in verify.residual_patterns(docs).collect():
        got[r.doc_id].append((r.leak_type[:3], r.text))
    got = {i: sorted(v) for i, v in got.items() if v}
    assert got == {
        0: [("PAN", PAN)], 1: [("PAN", PAN)], 2: [("PAN", PAN.lower())], 6: [("PAN", PAN)], 7: [("AAD", "1234 5678 9012")], 8: [("AAD", "1234-56789012")], 9: [("AAD", "4532 0151 1283"), ("CRE", "4532 0151 1283 0366")],
        11: [("PHO", "91-9876543210")], 12: [("EMA", "a.b+c@x-y.co.in.")], 16: [("AAD", "१२३४ ५६७८ ९०१२")],
    }
    may = spark.createDataFrame([(0, f" {PAN.lower()} "), (7, "1234 5678"), (9, "4532 0151 1283 0366")], DOCS)
    assert sorted((r.doc_id, r.leak_type[:3]) for r in verify.residual_patterns(docs, may).collect() if r.doc_id in (0, 7, 9)) == [(7, "AAD"), (9, "AAD")]


def ends(spark, entities, words=(), pages=(), texts=()):
    e = spark.createDataFrame(entities, f"doc_id bigint, entity_type string, text string, status string, page int, box {BOX}")
    w = spark.createDataFrame(list(words), f"doc_id bigint, page int, ord int, text string, box {BOX}")
    p = spark.createDataFrame(list(pages), "doc_id bigint, page int, rotation int")
    d = spark.createDataFrame(list(texts), DOCS)
    return sorted((r.doc_id, r.side) for r in verify.fragments(e, d, w, p).collect())


def test_ends_of_entities_near_their_boxes(spark):
    at = lambda x, y, w=50.0: (float(x), float(y), float(x) + w, float(y) + 10)
    entity = lambda i, page=1, box=at(200, 100), status="accepted", text="ABCPE 1234F": (i, "PAN_NUMBER", text, status, page, box)
    pages = [(i, 1, 0) for i in range(20) if i != 9] + [(9, 1, 90), (2, 2, 0)]
    entities = [entity(0), entity(1), entity(2), entity(3), entity(4), entity(5, status="rejected"), entity(6, text="ABC 12"), entity(7, box=None), entity(8, page=3), entity(9), entity(10, status=None), entity(11, text="ABC123")]
    words = [
        (0, 1, 0, "(ABCP", at(310, 100)), (1, 1, 0, "ABCP", at(351, 100)), (1, 1, 1, "ABCP", at(200, 126)), (1, 1, 2, "234F", at(99 - 50, 100)),
        # Pieces that only together make an end, in their order; the same on another page.
        (3, 1, 5, "4F", at(290, 100)), (3, 1, 4, "2 3", at(250, 100)), (2, 2, 0, "ABCP", at(200, 100)), (4, 1, 0, "ABC", at(200, 100)), (4, 1, 1, "zP", at(250, 100)),
        (5, 1, 0, "ABCPE1234F", at(200, 100)), (9, 1, 0, "234F", at(2000, 900)), (10, 1, 0, "xABCPEx", at(200, 114)), (11, 1, 0, "C123", at(200, 85)),
    ]
    texts = [(6, "ABC12"), (7, "left A B C\nP E here"), (8, "ends in 12 34 F"), (1, PAN), (0, None)]
    assert ends(spark, entities, words, pages, texts) == [(0, "leading"), (3, "trailing"), (7, "leading"), (8, "trailing"), (9, "trailing"), (10, "leading"), (11, "trailing")]


def test_ends_of_entities_without_boxes(spark):
    e = spark.createDataFrame([(1, "PAN_NUMBER", PAN), (2, "PAN_NUMBER", PAN), (2, "X", "12345"), (3, "Y", None), (4, "Z", "Asha Rao")], "doc_id bigint, entity_type string, text string")
    d = spark.createDataFrame([(1, "left A B C P E here"), (2, "none 12345"), (3, "x"), (4, "As ha a n d haR ao")], DOCS)
    assert sorted((r.doc_id, r.entity_type, r.side) for r in verify.fragments(e, d).collect()) == [(1, "PAN_NUMBER", "leading"), (4, "Z", "leading"), (4, "Z", "trailing")]
    assert verify.fragments(e.limit(0), d).count() == 0 == verify.fragments(e, d.limit(0)).count()


def test_boxes_meet_once_as_by_brute_force(spark):
    random.seed(4)

    def some(n):
        out = []
        for i in range(n):
            x, y, w, h = random.uniform(-300, 3000), random.uniform(-50, 2000), random.choice([0.5, 40, 300, 5000]), random.choice([0.5, 12, 200, 3000])
            out.append((i, i % 3, (x, y, x + w, y + h)))
        return [*out, (n, 0, None), (n + 1, 0, (5.0, 5.0, 5.0, 9.0)), (n + 2, 0, (float("nan"), 0.0, 9.0, 9.0)), (n + 3, 1, (-1e12, -1e12, 1e12, 1e12)), (n + 4, 1, (1e9, 1e9, 2e9, 2e9))]

    one, two = some(60), some(70)
    meets = lambda a, b: a and b and a[0] < a[2] and b[0] < b[2] and a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]
    want = Counter((i, j) for i, p, a in one for j, q, b in two if p == q and meets(a, b))
    left, right = spark.createDataFrame(one, f"i int, page int, a {BOX}"), spark.createDataFrame(two, f"j int, page int, b {BOX}")
    assert Counter((r.i, r.j) for r in spatial.box_join(left, right, ["page"], "a", "b").collect()) == want and len(want) > 100


def test_matches_with_what_stands_beside(spark):
    df = spark.createDataFrame([(1, "aXbXXc"), (2, "none"), (3, None), (4, "X")], DOCS)
    got = sorted((r.doc_id, r.before, r.match, r.after) for r in matched(df, "text", "X", 2, 3).collect())
    assert got == [(1, "Xb", "X", "Xc"), (1, "a", "X", "bXX"), (1, "bX", "X", "c"), (4, "", "X", "")]
    got = sorted((r.before, r.match, r.after) for r in matched(df, "text", "(?=X.)", 2, 2).collect())
    assert got == [("Xb", "", "XX"), ("a", "", "Xb"), ("bX", "", "Xc")]


def test_no_two_test_files_share_a_name():
    names = Counter(p.name for p in Path(__file__).parent.rglob("test_*.py"))
    assert {n: c for n, c in names.items() if c > 1} == {}


@pytest.mark.parametrize("text", ["", " ", "\n\n", "\u0001\u0002\u0003", "é" * 10])
def test_odd_texts_hold_nothing(spark, text):
    assert windows(spark, [text]) == [[]]

"""Operators against values written by hand, and queries without SQL against brute force on small tables."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.spans import spans
from palimpsest.operators import analytics, evaluate, policy, recognise, tables, verify, vote
from palimpsest.streaming import limits

DOCS = "doc_id bigint, text string"
SPAN = "doc_id bigint, start int, end int, entity_type string"
KIND = "doc_id bigint, start int, end int, entity_type string, text string, score double, source string, type_locked boolean, ord int"
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


@pytest.mark.parametrize(
    ("text", "score", "before", "box", "want"),
    [
        ("Total", 0.9, None, None, 0.05), ("Total", 0.9, "Name:", None, 0.99), ("%", 0.9, None, None, 0.05), ("x", 0.9, None, None, 0.02), ("x", 0.9, "Name:", None, 0.02),
        ("Side note", 0.7, None, (5.0, 0.0, 10.0, 80.0), 0.20), ("Side note", 0.7, None, (300.0, 0.0, 305.0, 80.0), 0.7), ("12345678901", 0.5, None, None, 0.95), ("12345678901", 0.5, "mobile", None, 0.85),
        ("Asha Rao", 0.7, None, None, 0.75), ("Asha Rao", 0.98, None, None, 0.95), ("asha rao", 0.7, None, None, 0.7), ("ASHA", 0.7, None, None, 0.7), ("O'Neil", 0.6, None, None, 0.65), ("Ann", 0.6, None, None, 0.6),
    ],
)
def test_benign_rules_in_order(spark, text, score, before, box, want):
    row = spark.createDataFrame([(text, score, before, box)], f"t string, s double, b string, box {BOX}")
    got = row.select(policy.benign_score(F.col("t"), F.col("s"), F.col("b"), F.col("box")).alias("p")).first().p
    assert got == pytest.approx(want)


def test_hindi_context(spark):
    rows = [(1, "आवेदिका: राहुल शर्मा", 10, 21, "PERSON", 0.6), (2, "tracking 2363 4532 0151", 9, 23, "AADHAAR_NUMBER", 0.6), (3, "ref code 411001", 9, 15, "PIN_CODE", 0.6), (4, "यूआईडी 236345320151", 7, 19, "AADHAAR_NUMBER", 0.6), (5, "account 2001", 8, 12, "DATE_TIME", 0.5), (6, "जिला पुणे", 5, 9, "ADDRESS", 0.95)]
    docs = spark.createDataFrame([r[:2] for r in rows], DOCS)
    c = spark.createDataFrame([(i, a, b, k, t[a:b], s, "regex", False, 1) for i, t, a, b, k, s in rows], KIND)
    got = {r.doc_id: round(r.score, 6) for r in vote.score_context(c, docs, 80, hindi=True).collect()}
    assert got == {1: 0.7, 2: 0.35, 3: 0.3, 4: 0.7, 5: 0.0, 6: 1.0}


def test_mixed_sources_and_generic_types(spark):
    rows = [
        # A generic type has more votes, but structured ones come first; its best score lifts the entity.
        (1, 0, 9, "PERSON", "p", 0.95, "presidio", False, 1), (1, 0, 9, "PERSON", "p", 0.9, "spacy", False, 2), (1, 3, 9, "VOTER_ID", "v", 0.78, "regex", False, 3),
        # Generic types alone: the weighted mean.
        (2, 0, 4, "PERSON", "a", 0.8, "presidio", False, 1), (2, 1, 6, "LOCATION", "b", 0.5, "spacy", False, 2),
        # Below the threshold.
        (3, 0, 4, "PERSON", "a", 0.4, "spacy", False, 1),
        # Two structured types, none locked: the weighted sum.
        (4, 0, 9, "BANK_ACCOUNT", "x", 0.6, "regex", False, 1), (4, 0, 9, "PHONE_NUMBER", "y", 0.7, "presidio", False, 2),
    ]
    got = {r.doc_id: (r.entity_type, r.text, round(r.score, 4), r.source) for r in vote.elect(spark.createDataFrame(rows, KIND)).collect()}
    mean = round((0.8 * 1.0 + 0.5 * 0.9) / 1.9, 4)
    assert got == {1: ("VOTER_ID", "v", 0.95, "merged"), 2: ("PERSON", "a", mean, "merged"), 4: ("BANK_ACCOUNT", "x", 0.7, "merged")}


def test_union_of_languages_is_a_fold(spark):
    kind = "doc_id bigint, start int, end int, entity_type string, text string, score double"
    one = [(1, 0, 10, "PERSON", "a", 0.9), (2, 0, 10, "PAN_NUMBER", "a", 0.6), (3, 0, 20, "PERSON", "a", 0.6), (3, 12, 18, "PERSON", "late", 0.61)]
    two = [(1, 5, 12, "PAN_NUMBER", "b", 0.5), (2, 5, 12, "PERSON", "b", 0.99), (3, 2, 8, "PERSON", "b", 0.7)]
    got = vote.union_languages(spark.createDataFrame(one, kind), spark.createDataFrame(two, kind)).collect()
    # In document 3 the replaced span's reach still shadows the last one.
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "b"), (2, "a"), (3, "b")]


def test_spread_codes(spark):
    texts = ["PAN no: A B C P E 1 2 3 4 F end", "A B C P E 1 2 3 4 F end", "pan ABCPE 1234 F", "pan ABCPE\n1234F", "aadhaar 2 3 6 3 4 5 3 2 0 1 5 1", "ifsc S B I N 0 0 0 1 2 3 4", "pan ABCPE1234F", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: (r.start, r.end, r.entity_type) for r in recognise.scan_fragments(docs).collect()}
    assert got == {0: (8, 27, "PAN_NUMBER"), 2: (4, 16, "PAN_NUMBER"), 4: (8, 31, "AADHAAR_NUMBER"), 5: (5, 26, "IFSC_CODE")}


def test_repaired_and_tabular_values_join_what_is_found(spark):
    table = "Name | Account\nAnn Lee | 123456789"
    docs = spark.createDataFrame([(1, "id 2363 4532 O15l kept"), (2, "see A8CPE12O4F"), (3, table), (4, "plain words only")], DOCS)
    none = spark.createDataFrame([], "doc_id bigint, start int, end int, entity_type string, text string, score double, source string")
    got = recognise.recovered(docs, none).collect()
    assert {(r.doc_id, r.entity_type, r.text) for r in got if r.source == "table"} == {(3, "PERSON", "Ann Lee"), (3, "BANK_ACCOUNT", "123456789")}
    assert {(r.doc_id, r.text, r.score) for r in got if r.entity_type == "PAN_NUMBER"} == {(2, "A8CPE12O4F", 0.92)}
    # What is known stays, and nothing that meets it joins.
    known = spark.createDataFrame([(2, 4, 9, "X", "A8CP", 1.0, "regex"), (3, 16, 20, "Y", "n Le", 1.0, "regex")], none.schema)
    got = recognise.recovered(docs, known).collect()
    assert sorted((r.doc_id, r.entity_type) for r in got if r.doc_id > 1) == [(2, "X"), (3, "BANK_ACCOUNT"), (3, "Y")]


def test_all_stages_find_all_kinds(spark):
    text = "Mobile: 98765 43210\nPAN: ABCPE1234F\nPay to asha@okaxis by upi\nDOB: 12/03/1990\nBank account 123456789012\nmail a.b@example.com\nGSTIN 27ABCPE1234F1Z5\nPune 411001"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "nothing here")], DOCS)
    got = {(r.entity_type, r.text) for r in recognise.entities_of(docs).collect()}
    assert {("PAN_NUMBER", "ABCPE1234F"), ("UPI_ID", "asha@okaxis"), ("DATE_OF_BIRTH", "12/03/1990"), ("BANK_ACCOUNT", "123456789012"), ("EMAIL_ADDRESS", "a.b@example.com"), ("GST_NUMBER", "27ABCPE1234F1Z5"), ("PIN_CODE", "411001")} <= got
    assert ("PHONE_NUMBER", "98765 43210") in got


def test_spans_and_groups(spark):
    df = spark.createDataFrame([(1, "é a1 b22 a1"), (2, ""), (3, None), (4, "x\u0001y a9")], DOCS)
    got = {r.doc_id: [(s.start, s.end, s.text) for s in r.s] for r in df.select("doc_id", spans(F.col("text"), r"[a-z]\d+").alias("s")).collect()}
    assert got == {1: [(2, 4, "a1"), (5, 8, "b22"), (9, 11, "a1")], 2: [], 3: [], 4: [(4, 6, "a9")]}
    got = {r.doc_id: [(s.start, s.end, s.text) for s in r.s] for r in df.select("doc_id", spans(F.col("text"), r"[a-z](\d+)", 1).alias("s")).collect()}
    assert got[1] == [(3, 4, "1"), (6, 8, "22"), (10, 11, "1")] and got[4] == [(5, 6, "9")]


def test_matchers_differ(spark):
    e = spark.createDataFrame([(1, 0, 10, "A"), (1, 8, 20, "A"), (2, 0, 4, "A")], SPAN)
    d = spark.createDataFrame([(1, 6, 18, "A"), (1, 18, 22, "A"), (2, 3, 9, "A"), (2, 0, 4, "B")], SPAN)
    said = lambda m: sorted((r.doc_id, r.e_start, r.d_start) for r in m.collect())
    # 6-18 fits 8-20 best (10 / 14); first fit gives it to 0-10, and 18-22 then to 8-20; the optimum takes both pairs too.
    assert said(evaluate.greedy(e, d)) == said(evaluate.best_per_detection(e, d)) == [(1, 8, 6)]
    assert said(evaluate.first_fit(e, d)) == said(evaluate.optimal(e, d)) == [(1, 0, 6), (1, 8, 18), (2, 0, 3)]


def test_boxes_that_do_not_hide(spark):
    kind = f"doc_id bigint, page int, start int, text string, status string, box {BOX}"
    e = [(i, 1, 0, "ABCDE1234F", "accepted", b) for i, b in enumerate([(100.0, 10.0, 160.0, 20.0)] * 6)]
    e += [(6, 1, 0, "ABCDE1234F", "accepted", (100.0, 10.0, 120.0, 20.0)), (7, 1, 0, "ABCDE1234F", "rejected", (100.0, 10.0, 160.0, 20.0)), (8, 1, 0, "ABCDE1234F", "accepted", None), (9, 1, 0, "AB", "accepted", (100.0, 10.0, 101.0, 20.0))]
    w = [(0, 1, 0, "x", (150.0, 12.0, 158.0, 18.0)), (1, 1, 0, "34F", (161.0, 10.0, 175.0, 20.0)), (2, 1, 0, "ABC", (80.0, 10.0, 99.0, 20.0)), (3, 1, 0, "xyz", (161.0, 10.0, 175.0, 20.0)), (4, 1, 0, "34F", (161.0, 60.0, 175.0, 70.0)), (5, 1, 0, "--", (150.0, 12.0, 158.0, 18.0)), (7, 1, 0, "x", (150.0, 12.0, 158.0, 18.0))]
    got = verify.geometry_leaks(spark.createDataFrame(e, kind), spark.createDataFrame(w, f"doc_id bigint, page int, ord int, text string, box {BOX}")).collect()
    assert {r.doc_id: r.leak for r in got} == {0: "inside", 1: "after", 2: "before", 6: "narrow"}


def test_redactions_by_brute_force(spark):
    docs = spark.createDataFrame([(1, "ab abc ab"), (2, "x"), (3, None)], DOCS)
    e = spark.createDataFrame([(1, 0, 2, "A", "ab"), (1, 3, 6, "B", "abc")], SPAN + ", text string")
    # In the order of the entities: once "ab" is gone nothing of "abc" is left but its end.
    assert {r.doc_id: r.redacted_text for r in policy.redact_everywhere(docs, e).collect()} == {1: "██ ██c ██", 2: "x", 3: None}
    kinds = ["PERSON", "GST_NUMBER", "VOTER_ID", "IN_PASSPORT", "CREDIT_CARD", "DATE_OF_BIRTH", "URL", "PAN_NUMBER", "OTHER"]
    shapes = [r"[A-Z][a-z]+ [A-Z][a-z]+", r"\d{2}[A-Z]{5}\d{4}[A-Z]\dZ[A-Z]", r"[A-Z]{3}\d{7}", r"[A-Z]\d{7}", r"(\d{4} ){3}\d{4}", r"\d{2}/\d{2}/(19[7-9]\d|2000)", r"https://example\.com/[0-9a-f]{8}", r"[A-Z]{5}\d{4}[A-Z]", r"\[OTHER\]"]
    rows = spark.createDataFrame([(k, v, s) for k, s in zip(kinds, shapes, strict=True) for v in ("One ", "one", "two")], "k string, v string, s string")
    got = rows.withColumn("x", policy.synthetic(F.col("k"), F.col("v"))).withColumn("ok", F.expr("x rlike concat('^', s, '$')")).collect()
    assert all(r.ok for r in got), [(r.k, r.x) for r in got if not r.ok]
    by = {(r.k, r.v): r.x for r in got}
    assert all(by[k, "One "] == by[k, "one"] for k in kinds) and by["VOTER_ID", "one"] != by["VOTER_ID", "two"]
    cards = spark.createDataFrame([(x,) for (k, _), x in by.items() if k == "CREDIT_CARD"], "x string").selectExpr("luhn_check(replace(x, ' ', '')) as ok").collect()
    assert all(r.ok for r in cards)


def test_folds_stream_along_keys(spark):
    rows = [(u, i, f"2024-01-01 00:00:{s:02d}", k) for i, (u, s, k) in enumerate([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 11, "d"), (2, 5, "e"), (None, 6, "f"), (2, 5, "g")])]
    events = spark.createDataFrame(rows, "user_id bigint, event_id bigint, t string, k string").withColumn("ts", F.to_timestamp("t"))
    got = {r.event_id: r.allowed for r in limits.rate_limited(events, limit=2, span=10.0).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True, 6: True}
    tries = spark.createDataFrame([("a", i, i in (3,)) for i in range(8)], "email string, s int, success boolean").withColumn("attempted_at", F.timestamp_seconds("s"))
    got = {r.s: r.locked for r in limits.locked_out(tries, most=3, span=2.0).collect()}
    assert got == {0: False, 1: False, 2: False, 3: True, 4: False, 5: False, 6: False, 7: True}
    reports = events.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("report_id"), F.col("t").alias("generated_at"), F.array("k", F.lit("0")).alias("log_ids"), F.lit(1).alias("entity_count"))
    chain = analytics.hash_chain(reports)
    last, want = {}, {}
    for u, i, t, k in sorted(rows, key=lambda r: (r[2], r[1])):
        body = {"report_id": i, "session_id": u, "generated_at": t, "log_ids": sorted([k, "0"]), "entity_count": 1, "prev_hash": last.get(u, "GENESIS")}
        if u is not None:
            last[u] = want[i] = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert {r.report_id: r.content_hash for r in chain.filter("session_id is not null").collect()} == want
    assert analytics.broken_links(chain.filter("session_id is not null")).count() == 0


def test_small_lists(spark):
    df = spark.createDataFrame([("hindi",), ("mixed",), ("unknown",)], "m string")
    assert [r.n for r in df.select(F.size(T.stages(F.col("m"))).alias("n")).collect()] == [3, 6, 3]
    e = spark.createDataFrame([(1, 0, 10, "PHONE_NUMBER"), (1, 20, 30, "PHONE_NUMBER"), (1, 40, 50, "PERSON")], SPAN)
    c = spark.createDataFrame([(1, 5, 9, "BANK_ACCOUNT"), (1, 22, 25, "PERSON"), (1, 41, 45, "PAN_NUMBER")], SPAN)
    assert [r.entity_type for r in tables.overridden(e, c).orderBy("start").collect()] == ["BANK_ACCOUNT", "PHONE_NUMBER", "PERSON"]
    seen = verify.visual_candidates(spark.createDataFrame([(1, "see ABCPE 1234 F."), (2, "XABCPE1234F"), (3, "2363 4532 0151"), (4, None)], DOCS)).collect()
    assert ("PAN_NUMBER", "ABCPE1234F") not in {(r.leak_type, r.window) for r in seen if r.doc_id == 2} and (3, "AADHAAR_NUMBER", "236345320151") in {(r.doc_id, r.leak_type, r.window) for r in seen}
    docs = spark.createDataFrame([(1, 5, 1), (2, 6, 2), (3, 7, 3)], "id bigint, uploader_id bigint, org_id bigint")
    members = spark.createDataFrame([(5, 2, "member"), (9, 1, "super_admin")], "user_id bigint, org_id bigint, role string")
    assert [sorted(r.id for r in analytics.may_see(docs, members, u).collect()) for u in (5, 9, 4)] == [[1, 2], [1, 2, 3], []]

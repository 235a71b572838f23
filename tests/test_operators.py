"""Operators on small hand-made tables: nulls, empty tables, overlaps and ties."""

import pytest

from palimpsest.operators import policy, recognise, vote

KIND = "doc_id bigint, start int, end int, entity_type string, text string, score double, source string, type_locked boolean, ord int"


def test_boosts_and_penalties_are_bounded(spark):
    docs = spark.createDataFrame([(1, "pan number ABCPE1234F"), (2, "order ref 2363 4532 0151"), (3, None)], "doc_id bigint, text string")
    c = spark.createDataFrame([(1, 11, 21, "PAN_NUMBER", "ABCPE1234F", 0.95, "regex", True, 2), (2, 10, 24, "AADHAAR_NUMBER", "2363 4532 0151", 0.1, "regex", False, 1)], KIND)
    got = {r.doc_id: round(r.score, 6) for r in vote.score_context(c, docs).collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_overlap_elects_one_and_touching_spans_stay_apart(spark):
    rows = [(1, 0, 10, "PHONE_NUMBER", "a", 0.8, "regex", True, 8), (1, 5, 12, "BANK_ACCOUNT", "b", 0.6, "regex", False, 10), (1, 12, 20, "PAN_NUMBER", "c", 0.95, "regex", True, 2)]
    got = vote.elect(spark.createDataFrame(rows, KIND)).orderBy("start").collect()
    assert [(r.start, r.end, r.entity_type) for r in got] == [(0, 10, "PHONE_NUMBER"), (12, 20, "PAN_NUMBER")]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    chosen = policy.decide(vote.elect(vote.score_context(recognise.scan_patterns(docs), docs)))
    assert policy.redact_typed(docs, policy.active(chosen)).count() == 0


def test_custom_patterns(spark):
    docs = spark.createDataFrame([(1, "Ticket T-123 and T-9"), (2, None), (3, "")], "doc_id bigint, text string")
    got = recognise.scan_custom(docs, {"ticket": r"T-[0-9]+"}).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.end, r.text) for r in got] == [(1, 7, 12, "T-123"), (1, 17, 20, "T-9")]
    with pytest.raises(ValueError):
        recognise.scan_custom(docs, {str(i): "a" for i in range(21)})

"""Operators on boxes against values written by hand."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import validators as V
from palimpsest.operators import boxes

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
E = f"doc_id bigint, id bigint, entity_type string, page int, text string, start int, end int, box {BOX}, is_ocr boolean"
D = f"doc_id bigint, id bigint, entity_type string, page int, text string, start int, end int, box {BOX}"
A, P, N = "AADHAAR_NUMBER", "PAN_NUMBER", "PERSON"
NAN = float("nan")


def box(x0, x1, y0=0.0, y1=10.0):
    return (float(x0), float(y0), float(x1), float(y1))


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("2363 4532-0151", "23634532O15I", 0), ("ABCPE1234F", "abcpe1234f", 0), ("LOT", "IOT", 1), ("G6", "66", 1), ("ABC", "ABCD", 1), ("ABC", "XYZ", 3), ("S/B:Z", "582", 0), ("", "", 0), ("", "AB", 2)],
)
def test_distance_of_recognised_values(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(V.ocr_distance(F.col("a"), F.col("b")).alias("d")).first().d == want


def test_dual_channel(spark):
    e = [
        (1, 1, P, 1, "ABCPE1234F", 0, 10, None, False), (1, 2, P, 1, "ABCPE9999F", 20, 30, None, False), (1, 3, A, 1, "236345320151", 40, 52, None, None),
        (2, 1, A, 1, "236345320151", None, None, box(0, 100), True), (2, 2, A, 2, "236345320151", None, None, box(0, 100), True), (2, 3, N, 1, "Asha Iyer", None, None, box(0, 100, 50, 60), True),
        (2, 4, N, 1, "Ravi", None, None, (0.0, 90.0, NAN, 99.0), True), (2, 5, N, 1, "Tara", None, None, None, True),
        (3, 1, N, 1, "Asha Iyer", 0, 10, None, False), (3, 2, N, 1, "Iyer Rao", 6, 16, None, False),
    ]
    d = [
        (1, 1, P, 1, "ABCPE1234F", 0, 10, None), (1, 2, P, 1, "ABCPE9", 20, 26, None), (1, 3, P, 1, "236345320151", 40, 52, None), (1, 4, A, 2, "236345320151", 40, 52, None), (1, 5, P, 1, "x", -1, 10, None),
        (2, 1, A, 1, "23634532O1SI", None, None, box(5, 100)), (2, 3, A, 1, "236345320152", None, None, box(0, 100)), (2, 6, N, 1, "Asha lyr", None, None, box(0, 90, 50, 60)),
        (2, 4, N, 1, "Ravi", None, None, (0.0, 90.0, NAN, 99.0)), (3, 7, N, 1, "a", 4, 14, None), (3, 8, N, 1, "b", 7, 17, None),
    ]
    got = {(r.doc_id, r.e_id): (r.d_id, r.method, round(r.iou, 4), r.exact, r.residual) for r in boxes.dual_channel(spark.createDataFrame(e, E), spark.createDataFrame(d, D), 0.4).collect()}
    # Greedy would give (3, 2) the span 8, which also is the best total only with (3, 1) at 7.
    assert got == {
        (1, 1): (1, "exact_span", 1.0, True, 0), (1, 2): (2, "span", 0.6, False, 4), (2, 1): (1, "box", 0.95, True, 0), (2, 3): (6, "box", 0.9, False, 2),
        (3, 1): (7, "span", 0.4286, False, 3), (3, 2): (8, "span", 0.8182, False, 0),
    }
    none = spark.createDataFrame([], D)
    assert boxes.dual_channel(spark.createDataFrame(e, E), none).count() == 0


def test_fragments(spark):
    e = [
        (1, 1, A, 1, "236345320151", None, None, box(0, 120), True),
        (2, 1, A, 1, "236345320151", None, None, box(0, 120), True),
        (3, 1, A, 1, "236345320151", None, None, box(0, 120), True), (3, 2, P, 1, "ABCPE1234F", None, None, box(80, 200), True),
        (4, 1, A, 1, "236345320151", None, None, box(0, 120), False),
        (5, 1, A, 1, "236345320151", None, None, box(0, 120), True), (5, 2, A, 2, "111111111111", None, None, box(0, 130), True),
        (6, 1, A, 1, "236345320151", None, None, box(0, 120), True),
    ]
    d = [
        (1, 11, A, 1, "4532 0151", None, None, box(42, 120)), (1, 10, A, 1, "2363", None, None, box(0, 40)),
        (2, 20, A, 1, "2363", None, None, box(0, 38)), (2, 21, A, 1, "4532", None, None, box(40, 78)), (2, 22, A, 1, "O1S1", None, None, box(80, 120)),
        (3, 30, A, 1, "2363", None, None, box(0, 40)), (3, 31, A, 1, "45320151", None, None, box(42, 120)),
        (4, 40, A, 1, "2363", None, None, box(0, 40)), (4, 41, A, 1, "45320151", None, None, box(42, 120)),
        (5, 50, A, 1, "2363", None, None, box(0, 40)), (5, 51, A, 1, "45320151", None, None, box(42, 120)),
        (6, 60, A, 1, "2363", None, None, box(0, 40)), (6, 61, A, 1, "45320199", None, None, box(42, 120)),
    ]
    e, d = spark.createDataFrame(e, E), spark.createDataFrame(d, D)
    got = {(r.doc_id, r.e_id): (r.d_ids, round(r.iou, 4), r.exact, r.residual) for r in boxes.fragments(e, d, boxes.dual_channel(e, d)).collect()}
    # 3: a fragment touches a neighbour; 4: not recognised; 5: another open entity fits the hull; 6: another number.
    assert got == {(1, 1): ([10, 11], 1.0, True, 0), (2, 1): ([20, 21, 22], 1.0, True, 0)}


def test_duplicates(spark):
    d = [(1, 1, P, 1, "a", 0, 10, None), (1, 2, P, 1, "a", 2, 10, None), (1, 3, P, 1, "a", 8, 18, None), (1, 4, A, 1, "a", 0, 10, None), (1, 5, P, 2, "a", 0, 10, None), (1, 6, P, 1, "a", None, None, box(0, 9)), (1, 7, P, 1, "a", None, None, box(0, 10))]
    matched = spark.createDataFrame([(1, 1), (1, 7)], "doc_id bigint, d_id bigint")
    assert {r.d_id: r.duplicate_of for r in boxes.duplicates(spark.createDataFrame(d, D), matched).collect()} == {2: 1, 6: 7}


def test_shapes(spark):
    word = f"doc_id bigint, ord int, text string, start_index int, end_index int, box {BOX}, symbols array<{BOX}>"
    words = spark.createDataFrame(
        [
            (1, 0, "Asha", 0, 4, box(0, 40), None), (1, 1, "Iyer,", 5, 10, box(50, 100, 2, 12), None), (1, 2, "Pune", 11, 15, box(0, 40, 20, 30), None), (1, 3, "far", 16, 19, box(80, 110, 20, 30), None),
            (2, 0, "x:ABC", 0, 5, box(0, 50), [box(0, 9), box(9, 12), box(12, 25, 1, 9), box(25, 40), box(40, 50)]), (3, 0, "tall", 0, 4, box(0, 40, 0, 100), None),
        ],
        word,
    )
    spans = spark.createDataFrame([(1, 0, 9, N), (1, 0, 19, N), (2, 2, 4, P), (3, 0, 4, N), (3, 4, 9, N)], "doc_id bigint, start int, end int, entity_type string")
    got = sorted((r.doc_id, r.end, r.x, r.y, r.width, r.height) for r in boxes.shapes(spans, words).collect())
    assert got == [
        (1, 9, -1.0, -1.0, 92.0, 14.0),
        (1, 19, -1.0, -1.0, 102.0, 14.0), (1, 19, -1.0, 19.0, 42.0, 12.0), (1, 19, 79.0, 19.0, 32.0, 12.0),
        (2, 4, 11.0, -1.0, 30.0, 12.0), (3, 4, -4.0, -3.0, 48.0, 106.0),
    ]
    assert boxes.shapes(spans.limit(0), words).count() == 0

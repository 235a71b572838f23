"""Values that stand in released texts, rounding, ranks over all documents, recognised pages, and limits on a stream."""

import random
import struct
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import validators as V
from palimpsest.operators import boxes, policy, recognise, tables, verify
from palimpsest.streaming import limits

DOCS = "doc_id bigint, text string"
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def residual(value, text):
    """By all windows."""
    v, body = value.strip().replace(" ", ""), text.strip().replace(" ", "")
    if v in body:
        return ("CONFIRMED_LEAK", 0, v)
    for i in range(len(body) - len(v) + 1):
        w = body[i : i + len(v)]
        if sum(a != b for a, b in zip(v, w, strict=True)) <= 1:
            return ("FUZZY_CANDIDATE", 1, w)
    return ("CLEAN", None, None)


def test_residual_values_by_all_windows(spark):
    random.seed(2)
    some = lambda n: "".join(random.choice("ab1. \\E$é") for _ in range(n))
    values = [(i, some(random.choice([1, 2, 3, 4, 5]))) for i in range(60) for _ in range(3)]
    texts = [(i, some(random.choice([0, 3, 20, 60]))) for i in range(60)]
    values += [(100, "ABCPE1234F"), (101, "ABCPE1234F"), (102, "ABCPE1234F"), (103, "x"), (104, None), (105, "1234\n5678")]
    texts += [(100, "AB CPE 1234 F"), (101, "see ABCPEI234F."), (102, "ABCPEI2B4F ABCPE234F"), (104, "x"), (105, "0 1234\n5679")]
    body = dict(texts)
    got = {(r.doc_id, r.value): (r.status, r.distance, r.matched) for r in verify.residual_values(spark.createDataFrame(values, "doc_id bigint, value string"), spark.createDataFrame(texts, DOCS)).collect()}
    assert got == {(d, v): residual(v, body[d]) for d, v in values if v is not None and d in body}
    assert {s for s, _, _ in got.values()} == {"CONFIRMED_LEAK", "FUZZY_CANDIDATE", "CLEAN"}


@pytest.mark.parametrize("places", [0, 1, 2, 4])
def test_rounding_is_that_of_binary_values(spark, places):
    random.seed(places)
    xs = [2.675, 0.125, 0.375, 2.5, 3.5, -2.675, -0.125, 1.005, 0.285, 1e15 + 0.5, 2.0**60, 1e300, 5e-324, 0.0, 0.049999999999999996, 0.5, 0.49999999999999994, 1234567.885]
    xs += [random.randrange(10**6) / 200 for _ in range(2000)] + [random.uniform(-1000, 1000) for _ in range(1000)] + [random.randrange(10**5) / 2**k for k in (1, 3, 7) for _ in range(300)]
    # Neighbours of halves.
    xs += [struct.unpack("<d", struct.pack("<q", struct.unpack("<q", struct.pack("<d", x))[0] + d))[0] for x in xs if 0.01 < x < 1e6 for d in (-1, 1)]
    df = spark.createDataFrame([(x,) for x in [*xs, None, float("nan"), float("inf")]], "x double").select("x", V.half_even_double(F.col("x"), places).alias("y"))
    wrong = [(r.x, r.y) for r in df.collect() if r.x is not None and r.x == r.x and abs(r.x) < 2.0**52 / 10**places and r.y != round(r.x, places)]
    assert wrong == []
    assert df.filter("x is null and y is not null or isnan(x) and not isnan(y)").count() == 0


def test_ranks_over_all_documents(spark):
    random.seed(3)
    rows = [(random.randrange(300), s, k, random.choice(["Ann", "ann", "Bo", "Cy"]) + str(random.randrange(80))) for s in range(400) for k in ("A", "B")]
    df = spark.createDataFrame(rows, "doc_id bigint, start int, entity_type string, text string")
    want, order = {}, Counter()
    for d, s, k, t in sorted(rows):
        if (k, t.lower()) not in want:
            order[k] += 1
            want[k, t.lower()] = f"[{k}_{order[k]}]"
    got = policy.pseudonyms(df, ()).collect()
    assert len(got) == len(rows) and all(r.pseudonym == want[r.entity_type, r.text.lower()] for r in got)
    assert policy.pseudonyms(df.limit(0), ()).count() == 0


def test_recognised_pages(spark):
    at = lambda x, y: (float(x), float(y), x + 10.0, y + 5.0)
    words = [(1, 1, 2, "Rao", 80.0, at(30, 0)), (1, 1, 1, " Asha ", 91.0, at(10, 2)), (1, 1, 3, "  ", 99.0, at(500, 0)), (1, 1, 4, "é-1", -1.0, at(0, 40)), (1, 2, 5, "..", -1.0, at(0, 0)), (2, 1, 0, None, 5.0, at(0, 0))]
    blocks = tables.ocr_blocks(spark.createDataFrame(words, f"doc_id bigint, page int, ord int, text string, conf double, box {BOX}"))
    assert sorted((r.page, r.text, r.start_index, r.end_index) for r in blocks.collect()) == [(1, "Asha", 0, 4), (1, "Rao", 5, 8), (1, "é-1", 9, 12), (2, "..", 0, 2)]
    got = {(r.doc_id, r.page): (r.text, r.word_count, r.mean_conf, r.alnum, r.chars, tuple(r.box)) for r in tables.ocr_pages(blocks).collect()}
    assert got == {(1, 1): ("Asha Rao é-1", 3, 85.5, 9, 12, (0.0, 0.0, 40.0, 45.0)), (1, 2): ("..", 1, None, 0, 2, (0.0, 0.0, 10.0, 5.0))}
    # Blocks are what entities are put on.
    spans = spark.createDataFrame([(1, 0, 8, "PERSON")], "doc_id bigint, start int, end int, entity_type string")
    page = blocks.filter("page = 1").withColumn("symbols", F.lit(None).cast(f"array<{BOX}>"))
    assert [(r.x, r.width) for r in boxes.shapes(spans, page).collect()] == [(9.0, 32.0)]


def test_a_stream_admits_as_the_batch_does(spark, tmp_path):
    random.seed(5)
    begin = datetime(2024, 1, 1)
    events = [(i, random.randrange(4), begin + timedelta(seconds=random.randrange(600))) for i in range(200)]
    # In files by time and up to two minutes late; then one that moves the watermark past all others.
    events.sort(key=lambda e: e[2] + timedelta(seconds=random.randrange(120)))
    last = [(1000 + k, k, begin + timedelta(days=1)) for k in range(4)]
    kind = "event_id bigint, user_id bigint, ts timestamp"
    source = tmp_path / "in"
    for i, part in enumerate([events[j : j + 40] for j in range(0, 200, 40)] + [last, [(2000, 9, begin + timedelta(days=2))]]):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{source}/{i}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    allowed = limits.rate_limited_stream(stream, limit=3, span=60.0, late="5 minutes")
    query = allowed.writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = Counter((r.event_id, r.allowed) for r in spark.table("admitted").collect() if r.event_id < 1000)
    batch = limits.rate_limited(spark.createDataFrame(events, kind), limit=3, span=60.0)
    assert got == Counter((r.event_id, r.allowed) for r in batch.collect()) and 20 < sum(1 for _, a in got if not a)


EXACT = {
    1: "Mobile: 98765 43210\nPAN: ABCPE1234F\nPay to asha@okaxis by upi\nDOB: 12/03/1990\nmail a.b@example.com\nPune 411001",
    2: "nothing here, 12 apples and 3 pears", 3: None, 4: "", 5: "pan A B C P E 1 2 3 4 F and order 9876543210", 6: "see A8CPE12O4F", 7: "Name | Mobile\nAnn Lee | 9876543210\n\nx | 9876543210",
    8: "Born 01/02/1980, seen 03/04/2001", 9: "aadhaar 2363 4532 0151, ref 2363 4532 0152",
}
WANT = {
    (1, 8, 19, "PHONE_NUMBER"), (1, 25, 35, "PAN_NUMBER"), (1, 43, 54, "UPI_ID"), (1, 67, 77, "DATE_OF_BIRTH"), (1, 83, 98, "EMAIL_ADDRESS"), (1, 104, 110, "PIN_CODE"),
    (5, 4, 23, "PAN_NUMBER"), (6, 4, 14, "PAN_NUMBER"), (7, 14, 21, "PERSON"), (7, 24, 34, "PHONE_NUMBER"),
    (8, 5, 15, "DATE_OF_BIRTH"), (8, 22, 32, "DATE_OF_BIRTH"),
    # Citizen numbers with a wrong check digit score too little to lock their type, so the phone pattern's shorter match wins.
    (9, 10, 22, "PHONE_NUMBER"), (9, 30, 42, "PHONE_NUMBER"),
}


def test_all_stages_find_just_these(spark):
    got = recognise.entities_of(spark.createDataFrame(list(EXACT.items()), DOCS)).collect()
    assert {(r.doc_id, r.start, r.end, r.entity_type) for r in got} == WANT
    assert all(r.text == EXACT[r.doc_id][r.start : r.end] for r in got) and len(got) == len(WANT)


def test_texts_are_read_once_for_all_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plan = recognise.entities_of(docs)._jdf.queryExecution().executedPlan().toString()
    # Once for patterns of all kinds, once for the lines of tables.
    assert plan.count("Scan parquet") == 2
    rows = spark.createDataFrame([(1, ("x " * 50_000) + "PAN ABCPE1234F" + (" 12/03/1990" * 2_000))], DOCS)
    assert recognise.entities_of(rows).count() == 2001

"""Plans that hold for larger tables: how work is dealt, read and joined."""

import re

from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import boxes, evaluate, policy, recognise, tables, vote
from palimpsest.operators.spatial import box_join
from palimpsest.plans import carriers, registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_made_of_one_small_file_are_dealt(spark):
    assert carriers.carriers(spark, SF).rdd.getNumPartitions() == 8
    assert carriers.more(spark, SF).rdd.getNumPartitions() == 8


def test_scan_of_a_single_partition_is_dealt(spark):
    docs = spark.range(100).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("Mobile: 9876543210").alias("text"))
    scan = plan(recognise.detect(docs)).split("Generate")[-1]  # what stands below the lowest step of the scan
    assert "hashpartitioning(doc_id" in scan


def test_scores_are_not_written_into_filters(spark):
    filters = [line for line in plan(registry.candidates(spark, SF)).splitlines() if "Filter" in line]
    assert filters and not any("RLIKE" in line or "lower(" in line for line in filters)


def test_entities_read_again_are_detected_once(spark):
    assert "customer.parquet" not in plan(registry.queries()["t02_overridden_types"](spark, SF))


def test_growing_sides_are_not_broadcast(spark):
    e = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("PERSON").alias("entity_type"), F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit("Asha").alias("text"))
    docs = e.select("doc_id", "text")
    box = F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (0, 0, 9, 9), strict=True)))
    full = e.withColumns({"id": F.lit(1), "page": F.lit(1), "box": box, "is_ocr": F.lit(False)})
    for df in [evaluate.greedy(e, e), evaluate.document_rates(e, e, evaluate.pairs(e, e), docs), evaluate.diagnostics(e, e, evaluate.pairs(e, e)), boxes.dual_channel(full, full), policy.redact_typed(docs, e), policy.redact_everywhere(docs, e), tables.overridden(e, e)]:
        assert "Broadcast" not in plan(df)
    rules = spark.createDataFrame([("PERSON", True, "mask")], "rule_type string, is_active boolean, action string")
    assert plan(policy.redact_by_rules(docs, e, rules)).count("BroadcastHashJoin") <= 1  # the rules themselves


def test_a_stripe_down_a_page_is_one_cell_of_a_column(spark):
    blocks = spark.createDataFrame([(1, 1, i, t, (100.0, 20.0 * i, 160.0, 20.0 * i + 10)) for i, t in enumerate(["Mobile", "9876543210", "soon", "9876543211"])], "doc_id int, page int, block int, text string, box struct<x0:double,y0:double,x1:double,y1:double>")
    found = tables.below_headers(blocks)
    assert sorted(r.block for r in found.collect()) == [1, 3]
    assert "AS _1" not in plan(found) and "_1#" not in plan(found)
    other = blocks.select("doc_id", "page", F.col("block").alias("other"), F.col("box").alias("k"))
    pairs = [sorted((r.block, r.other) for r in box_join(blocks, other, ["doc_id", "page"], "box", "k", axes=axes).collect()) for axes in [(0,), (0, 1)]]
    assert pairs[0] == pairs[1] == [(i, i) for i in range(4)]


def test_matches_are_cut_out_without_lambdas(spark):
    docs = spark.createDataFrame([(1, "Mobile: 9876543210")], "doc_id bigint, text string")
    below = plan(recognise._all_spans(docs, registry.MAIN)).splitlines()
    # One that leaves out patterns without a match, and those for the places of pieces of texts with many.
    assert sum("lambdafunction" in line for line in below if "Project" in line or "Generate" in line) <= 2
    near = F.lower("text")
    assert "lambdafunction" not in plan(docs.select(vote.adjusted(F.col("doc_id") * 0.5, F.lit("PAN_NUMBER"), near), text.bounded_context(near, near)))


def test_texts_of_many_matches_have_the_same_spans_and_surroundings(spark):
    texts = {i: ("é" * (i % 5) + "ab ") * i + "x" * 200 + "b" * (i % 90) for i in (1, 16, 17, 33, 300, 5000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rules = [recognise.Rule("p", "P", "[ab]", 1.0), recognise.Rule("q", "Q", "a(b)", 1.0, 1), recognise.Rule("s", "S", "[a-é]+", 1.0, 0, "é")]
    found = sorted((r.rule, r.doc_id, r.start, r.end, r.value, r.before, r.after) for r in recognise._all_spans(docs, rules).collect())
    want = []
    for r in rules:
        for k, t in texts.items():
            for m in re.finditer(r.pattern, t):
                (a, b), w = m.span(r.group), recognise.WIDTH
                if r.keep is None or re.search(r.keep, m.group(r.group)):
                    want.append((r.id, k, a, b, m.group(r.group), t[max(a - w, 0) : a], t[b : b + w]))
    assert found == sorted(want)


def test_lines_of_candidates_are_worked_out_once_and_plain_marks_go_without_patterns(spark):
    steps = plan(registry.candidates(spark, SF))
    # The steps of a score and of a gate find a line once each.
    assert "translate(concat" not in steps and steps.count("substring_index(_lines") == 2
    assert r"\Qpincode\E|\Qpostal\E|\Qzip\E|\Qpost\E|\Qपिन\E|\Qपिन कोड\E" not in steps
    docs = spark.createDataFrame([(1, "Mobile: 9876543210")], "doc_id bigint, text string")
    assert "\u0003" not in plan(recognise._all_spans(docs, registry.MAIN)).split("Generate")[1]


def test_context_in_columns_is_the_context(spark):
    around = ["One. Two 12 three\nfour", "", "12", "a.12.b", "x12\n12", "Éà. 😀 12 end. 12", "no such value", None]
    rows = spark.createDataFrame([(a, s) for a in around for s in ("12", " 12 ", "", "2 t", "12.b", "12\n12", "Two 12 three\nfour", None)], "around string, span string")
    rows = text.with_context(rows, "near", F.col("around"), F.col("span")).withColumn("want", text.bounded_context(F.col("around"), F.col("span")))
    found = {(r.around, r.span): r.near for r in rows.filter("near <=> want").collect()}
    assert len(found) == 64 and found["One. Two 12 three\nfour", " 12 "] == " two 12 three" and found["a.12.b", "12.b"] == "a.12.b" and found["x12\n12", ""] == "x12"


def test_patterns_of_a_scan_are_run_once(spark):
    steps = plan(registry.candidates(spark, SF))
    assert all(steps.count(r.pattern + ",") == 1 for r in registry.MAIN)


def test_a_match_is_placed_by_its_marks_beside_patterns_with_a_group(spark):
    text = "a1 " * 40 + "x\u0001y\u0002z\u0003 a2 b3"
    docs = spark.createDataFrame([(1, text), (2, "b4 a5 b6")], "doc_id bigint, text string")
    rules = [recognise.Rule("p", "P", "[ab][0-9]", 1.0), recognise.Rule("q", "Q", "a([0-9])", 1.0, 1)]
    found = sorted((r.rule, r.doc_id, r.start, r.value) for r in recognise._all_spans(docs, rules).collect())
    want = [(r.id, k, m.start(r.group), m.group(r.group)) for r in rules for k, t in ((1, text), (2, "b4 a5 b6")) for m in re.finditer(r.pattern, t)]
    assert found == sorted(want)


def test_a_decision_is_worked_out_once(spark):
    steps = plan(policy.active(registry.decided(spark, SF)))
    filters = [line for line in steps.splitlines() if "Filter" in line]
    assert any("rejected" in line for line in filters) and not any("INSET" in line or "RLIKE" in line or "regexp_replace" in line for line in filters)


def test_entities_read_again_are_elected_without_sets_of_sources(spark):
    found = registry.settled(spark, SF)
    assert found.columns == ["doc_id", "start", "end", "entity_type", "text", "score"]
    assert "ObjectHashAggregate" not in plan(registry.entities(spark, SF).select(found.columns))

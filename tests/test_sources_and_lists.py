"""Reading and writing documents, selections of pages, reviews and lists, against values written by hand."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import analytics, policy, tables, verify
from palimpsest.sources import files

DOCS = "doc_id bigint, text string"


def word_file(*paragraphs):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<w:document>" + "".join(f'<w:p w:x="1"><w:r><w:t xml:space="preserve">{p[:2]}</w:t></w:r><w:r><w:t>{p[2:]}</w:t></w:r></w:p>' for p in paragraphs) + "</w:document>")
    return out.getvalue()


def test_files_of_all_kinds(spark, tmp_path):
    held = {
        "a.txt": "line\nनाम".encode(), "b.md": b"# x\xff y", "c.docx": word_file("Asha &amp; Rao", "PAN &lt;ABCPE1234F&gt;"), "d.docx": b"no zip", "e.pdf": b"%PDF", "f.png": b"\x89PNG", "g": b"", "h.json": b'{"a": 1}', "i.csv": b"a,b\n1,2", "j.txt": b"x" * 100,
    }
    for name, content in held.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "k.HTML").write_bytes(b"<p>")
    got = {r.path.rpartition("/")[2]: (r.format, r.text, r.error) for r in files.read_documents(spark, tmp_path.as_uri(), {"pdf": lambda b: b.decode().lower()}, most_bytes=99 + 400).collect()}
    assert got["a.txt"] == ("text", "line\nनाम", None) and got["b.md"] == ("md", "# x y", None) and "g" not in got and got["k.HTML"] == ("text", "<p>", None)
    assert got["c.docx"] == ("docx", "Asha & Rao\nPAN <ABCPE1234F>", None) and got["e.pdf"] == ("pdf", "%pdf", None)
    # What can't be read never passes as it is.
    assert got["d.docx"][1] is None and got["d.docx"][2].startswith("BadZipFile") and got["f.png"] == ("image", None, "no extractor for image")
    short = {r.path.rpartition("/")[2]: r.error for r in files.read_documents(spark, tmp_path.as_uri(), most_bytes=50).collect()}
    assert short["j.txt"] == "too long" and short["a.txt"] is None and short["e.pdf"] == "no extractor for pdf"


def test_blocks_and_limits(spark):
    docs = spark.createDataFrame([(1, "ab\n\ncde"), (2, ""), (3, "x" * 100_001)], DOCS)
    got = sorted((r.doc_id, r.block, r.text, r.start_index, r.end_index) for r in files.as_blocks(docs.filter("doc_id < 3")).collect())
    assert got == [(1, 0, "ab", 0, 2), (1, 1, "", 3, 3), (1, 2, "cde", 4, 7), (2, 0, "", 0, 0)]
    fits, long = files.within_limit(docs, "language")
    assert [sorted(r.doc_id for r in df.collect()) for df in (fits, long)] == [[1, 2], [3]]


@pytest.mark.parametrize("kind", ["json", "csv", "parquet", "orc"])
def test_results_are_read_back_as_written(spark, tmp_path, kind):
    rows = [(1, 'say "hi", twice'), (2, "नाम [PERSON_1]"), (3, "plain")]
    path = f"{tmp_path}/out"
    files.write_texts(spark.createDataFrame(rows, "doc_id bigint, redacted_text string"), path, kind)
    reader = spark.read.schema("doc_id bigint, redacted_text string")
    back = reader.option("header", "true").option("quote", '"').option("escape", '"').csv(path) if kind == "csv" else reader.format(kind).load(path)
    assert sorted(tuple(r) for r in back.collect()) == rows
    with pytest.raises(ValueError):
        files.write_texts(back, path, "xml")


def test_suites_and_reports(spark, tmp_path):
    suite = [{"id": "d1", "type": "clean", "content": "PAN ABCPE1234F", "expected_entities": [{"type": "PAN_NUMBER", "value": "ABCPE1234F"}]}, {"id": "d2", "type": "x", "content": "none", "expected_entities": []}]
    (tmp_path / "suite.json").write_text(json.dumps(suite))
    got = {r.id: (r.type, r.content, [tuple(e) for e in r.expected_entities]) for r in files.read_suite(spark, f"{tmp_path}/suite.json").collect()}
    assert got == {"d1": ("clean", "PAN ABCPE1234F", [("PAN_NUMBER", "ABCPE1234F")]), "d2": ("x", "none", [])}
    logs = spark.createDataFrame([(1, "Scan A", "done", 3, ["PAN", "EMAIL"], "2024-01-02 03:04:05"), (2, "b", "new", 0, [], "2024-01-01 00:00:00")], "id int, name string, status string, entities int, rules array<string>, t string").withColumn("created_at", F.to_timestamp("t"))
    assert [tuple(r) for r in files.compliance_rows(logs).orderBy("id").collect()] == [(1, "Scan A", "done", 3, "PAN; EMAIL", "2024-01-02 03:04:05"), (2, "b", "new", 0, "", "2024-01-01 00:00:00")]
    assert [r.id for r in analytics.searched(logs, "scan").collect()] == [1] and [r.id for r in analytics.searched(logs, "").collect()] == [1, 2] and [r.id for r in analytics.searched(logs, "", 1, 1).collect()] == [2]
    rules = spark.createDataFrame([('["PAN", "EMAIL"]',), ("[]",), ("broken",), (None,)], "r string").select(analytics.parsed_rules(F.col("r")).alias("r"))
    assert [r.r for r in rules.collect()] == [["PAN", "EMAIL"], [], None, None]
    users = spark.createDataFrame([(1, "asha"), (2, "ravi")], "user_id int, name string")
    members = spark.createDataFrame([(2, 7), (1, 7), (3, 7), (1, 5)], "user_id int, org_id int")
    assert [(r.org_id, r.name) for r in analytics.members_with_users(members, users).collect()] == [(5, "asha"), (7, "asha"), (7, "ravi")]


@pytest.mark.parametrize(
    ("selection", "pages", "loose", "strict"),
    [
        ("all", 3, [1, 2, 3], [1, 2, 3]), (" ALL ", 2, [1, 2], [1, 2]), ("all", 0, [], []), ("1,3,5-7", 6, [1, 3, 5, 6], None), ("1, 3 , 5-6", 6, [1, 3, 5, 6], [1, 3, 5, 6]), ("3-1", 5, [], None), ("2,2,1-2", 5, [1, 2], [1, 2]), ("x,2", 5, [2], None), ("", 5, [], None),
        ("0-2", 5, [1, 2], None), ("-3", 5, [], None), ("1-2-3", 5, [], None), ("1-2000000000", 4, [1, 2, 3, 4], None), ("99999999999999999999,2", 4, [2], None), ("9", 4, [], None),
    ],
)
def test_selections_of_pages(spark, selection, pages, loose, strict):
    row = spark.createDataFrame([(selection, pages)], "s string, n int").select(T.selected_pages(F.col("s"), F.col("n")).alias("a"), T.strict_pages(F.col("s"), F.col("n")).alias("b")).first()
    assert (row.a, row.b) == (loose, strict)


def test_scripts(spark):
    df = spark.createDataFrame([("नाम Rao Asha Iyer Menon",), ("plain",), ("",), ("a" * 30 + "न",), ("आधार",)], "t string")
    assert [r.h for r in df.select(T.is_hindi(F.col("t")).alias("h")).collect()] == [True, False, False, False, True]


def test_reviews_and_scores(spark):
    e = spark.createDataFrame([(1, "pending"), (2, "accepted"), (3, "rejected")], "id int, status string")
    reviews = spark.createDataFrame([(1, "accepted", 5), (1, "rejected", 9), (1, "accepted", 7), (3, "accepted", 1), (9, "accepted", 1)], "id int, status string, at int")
    assert {r.id: r.status for r in policy.reviewed(e, reviews).collect()} == {1: "rejected", 2: "accepted", 3: "accepted"}
    df = spark.createDataFrame([(0.9, 0.5), (0.9, None), (0.0, 1.0)], "p double, s double")
    assert [round(r.x, 6) for r in df.select(policy.blended(F.col("p"), F.col("s")).alias("x")).collect()] == [0.64, 0.705, 0.65]


def test_boxes_of_less_confidence_give_way(spark):
    at = lambda x: (float(x), 0.0, x + 10.0, 10.0)
    boxes = spark.createDataFrame([(1, at(0), 0.9), (1, at(2), 0.8), (1, at(5), 0.7), (1, at(40), 0.1), (2, at(0), 0.2)], "doc_id int, box struct<x0:double,y0:double,x1:double,y1:double>, conf double")
    got = sorted((r.doc_id, r.box.x0, r.conf) for r in tables.non_maximum(boxes).collect())
    # 2 shares two thirds with 0; 5 a third, and 2, with which it shares more, is gone.
    assert got == [(1, 0.0, 0.9), (1, 5.0, 0.7), (1, 40.0, 0.1), (2, 0.0, 0.2)]


def test_all_checks_of_a_text(spark):
    """What is left of the first value is seen by its pattern, of the second by the spread one."""
    docs = spark.createDataFrame([(1, "left ABCPE1234F"), (2, "A B C P E 1 2 3 4 F"), (3, "ends in 34 F and m@x.org"), (4, "clean"), (5, None)], DOCS)
    entities = spark.createDataFrame([(3, "PAN_NUMBER", "XYZPE1234F"), (4, "PAN_NUMBER", "XYZPE1234F")], "doc_id bigint, entity_type string, text string")
    got = sorted({(r.doc_id, r.leak_type, r.text) for r in verify.leak_verdict(docs, entities).collect()})
    assert got == [(1, "PAN_NUMBER", "ABCPE1234F"), (2, "PAN_NUMBER", "A B C P E 1 2 3 4 F"), (3, "EMAIL_ADDRESS", "m@x.org")]


def test_cells_below_headers(spark):
    at = lambda x, y, w=60.0: (float(x), float(y), float(x) + w, float(y) + 10)
    rows = [
        (1, 1, 0, "Mobile", at(100, 0)), (1, 1, 1, "9876543210", at(100, 20)), (1, 1, 2, "9876543210", at(144, 40)), (1, 1, 3, "9876543210", at(146, 60)), (1, 1, 4, "9876543210", at(90, 80, 140.0)), (1, 1, 5, "soon", at(100, 100)),
        (1, 1, 6, "Account", at(100, 200)), (1, 1, 7, "123456789", at(100, 900)), (1, 2, 8, "9876543210", at(100, 20)), (1, 1, 9, "9876543210", at(100, 5)), (2, 1, 0, "9876543210", at(100, 20)), (1, 1, 10, "9876543210", None),
    ]
    blocks = spark.createDataFrame(rows, "doc_id int, page int, block int, text string, box struct<x0:double,y0:double,x1:double,y1:double>")
    found = tables.below_headers(blocks)
    # Beside the stripe's edge, too wide, no number, above the header's end, or on another page: none.
    assert sorted((r.block, r.entity_type) for r in found.collect()) == [(1, "PHONE_NUMBER"), (2, "PHONE_NUMBER"), (7, "BANK_ACCOUNT")]
    known = spark.createDataFrame([(1, 1, at(155, 25)), (1, 2, at(144, 40)), (1, 1, None)], "doc_id int, page int, box struct<x0:double,y0:double,x1:double,y1:double>")
    assert sorted(r.block for r in tables.uncovered(found, blocks, known).collect()) == [2, 7]

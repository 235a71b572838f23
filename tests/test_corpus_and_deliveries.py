"""Made-up documents, audits of corpora, and deliveries from a stream."""

import hashlib
from pathlib import Path

from pyspark.sql import functions as F

from palimpsest.operators import corpus, evaluate, recognise
from palimpsest.sources import files
from palimpsest.streaming import deliveries

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
NOTES = f"document_id string, sha256 string, total_pages int, entities array<struct<page_num:int,box:{BOX},start:int,end:int,confidence:double>>"


def test_every_span_holds_its_value(spark):
    templates = ["Name: {name}\nPAN: {pan} of {name}", "{email}{phone} {note} {missing}", "nothing"]
    rows = [(0, "Asha", "ABCPE1234F", "a@b.com", "98", "x"), (1, "Бо", "P", "c@d.in", "9876543210", "n{name}"), (2, "", "", "", "", ""), (3, None, "Q", "", "", ""), (4, "z", "", "", "", ""), (5, "", "", "é", "7", None)]
    df = spark.createDataFrame(rows, "id int, name string, pan string, email string, phone string, note string").withColumn("missing", F.lit(None).cast("string"))
    got = {r.id: (r.text, [tuple(e) for e in r.entities]) for r in corpus.expanded(df, templates, F.col("id") % 3 + F.when(F.col("id") == 4, 9).otherwise(0)).collect()}
    assert got[0] == ("Name: Asha\nPAN: ABCPE1234F of Asha", [(6, 10, "PERSON", "Asha"), (16, 26, "PAN_NUMBER", "ABCPE1234F"), (30, 34, "PERSON", "Asha")])
    assert got[1] == ("c@d.in9876543210 n{name} ", [(0, 6, "EMAIL_ADDRESS", "c@d.in"), (6, 16, "PHONE_NUMBER", "9876543210")])
    assert got[2] == ("nothing", []) and got[3] == ("Name: \nPAN: Q of ", [(12, 13, "PAN_NUMBER", "Q")]) and 4 not in got and got[5] == ("nothing", [])
    for text, spans in got.values():
        assert all(text[a:b] == v for a, b, _, v in spans)


def test_made_up_documents_measure_the_detectors(spark):
    rows = [(i, f"ABCPE{i:04d}F", f"u{i}@example.com", f"98765{i:05d}") for i in range(30)]
    df = spark.createDataFrame(rows, "id int, pan string, email string, phone string")
    made = corpus.expanded(df, ["PAN: {pan}\nMail {email}", "Mobile: {phone}\nPAN: {pan}"], F.col("id") % 2)
    expected = made.select(F.col("id").alias("doc_id"), F.explode("entities").alias("e")).select("doc_id", "e.start", "e.end", "e.entity_type")
    detected = recognise.entities_of(made.select(F.col("id").alias("doc_id"), "text")).select("doc_id", "start", "end", "entity_type")
    got = {r.entity_type: (r.tp, r.fp, r.fn) for r in evaluate.by_type(expected, detected, evaluate.greedy(expected, detected)).collect()}
    assert got["PAN_NUMBER"] == (30, 0, 0) and got["EMAIL_ADDRESS"] == (15, 0, 0) and got["PHONE_NUMBER"] == (15, 0, 0)


def test_audit_of_a_folder_with_one_changed_file(spark, tmp_path):
    texts = {f"d{i}": f"text {i}" for i in range(5)}
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_text(text)
    sha = {n: hashlib.sha256(t.encode()).hexdigest() for n, t in texts.items()}
    good = (1, (0.0, 0.0, 5.0, 5.0), 0, 4, 0.5)
    manifest = [(n, f"{n}.txt", "A", "plain", sha[n]) for n in texts] + [("d9", "d9.txt", "A", "hard_negative", "0" * 64)]
    notes = [(n, sha[n], 1, [good]) for n in texts] + [("d9", "0" * 64, 1, [])]
    kind = "id string, file_name string, tier string, category string, sha256 string"
    (tmp_path / "d9.txt").write_text("x")
    manifest[5] = ("d9", "d9.txt", "A", "hard_negative", hashlib.sha256(b"x").hexdigest())
    notes[5] = ("d9", manifest[5][4], 1, [])

    def audit(manifest, notes, quotas=None):
        there = files.checksums(spark, tmp_path.as_uri()).select(F.substring_index("path", "/", -1).alias("name"), "sha256")
        return sorted(tuple(r) for r in corpus.corpus_faults(spark.createDataFrame(manifest, kind), spark.createDataFrame(notes, NOTES), there, quotas).collect())

    quotas = spark.createDataFrame([("plain", 5), ("hard_negative", 1)], "category string, n int")
    assert audit(manifest, notes, quotas) == []
    (tmp_path / "d3.txt").write_text("text 3 changed")
    (tmp_path / "d4.txt").unlink()
    notes[1] = ("d1", sha["d1"], 2, [good, (3, (5.0, -1.0, 5.0, 9.0), 7, 4, 1.5)])
    notes[5] = ("d9", manifest[5][4], None, [good])
    del notes[2]
    manifest.append(("d0", "other.txt", "A", "extra", sha["d0"]))
    want = [
        ("box off the page", "d1"), ("box out of order", "d1"), ("confidence out of range", "d1"), ("digest twice", "d0"), ("digest twice", "d0"), ("entities in a hard negative", "d9"), ("file changed", "d3"),
        ("id twice", "d0"), ("id twice", "d0"), ("no annotation", "d2"), ("no file", "d0"), ("no file", "d4"), ("no pages", "d9"), ("page out of range", "d1"), ("page out of range", "d9"), ("quota missed", "extra"), ("span out of order", "d1"),
    ]
    got = audit(manifest, notes, quotas)
    assert got == want
    told = {r.fault: (r.n, r.example) for r in corpus.audited(spark.createDataFrame(got, "fault string, id string")).collect()}
    assert told["id twice"] == (1, "d0") and told["page out of range"] == (2, "d1")
    manifested = spark.createDataFrame([("d0.txt", sha["d0"]), ("d3.txt", sha["d3"]), ("d4.txt", sha["d4"])], "name string, sha256 string")
    assert {r.name: r.status for r in files.verify_manifest(files.checksums(spark, tmp_path.as_uri()), manifested).collect()} == {"d0.txt": "ok", "d3.txt": "changed", "d4.txt": "missing"}


def test_a_replayed_batch_sends_nothing_twice(spark, tmp_path):
    sent = tmp_path / "sent"
    sent.mkdir()

    def send(delivery, payload, folder=str(sent)):
        done = len([p for p in Path(folder).iterdir() if p.name.startswith(f"{delivery}-")])
        (Path(folder) / f"{delivery}-{done}").write_text(payload)
        if payload == "raise":
            raise TimeoutError("slow")
        return 500 if payload == "down" or (payload == "late" and done == 0) else 204

    tries = lambda: sorted(p.name for p in sent.iterdir())
    ledger, clock = f"file://{tmp_path}/ledger", {"now": "2024-01-01 00:00:00"}
    run = deliveries.deliverer(ledger, send, lambda: clock["now"])
    for i, rows in enumerate([[(1, "ok"), (2, "down"), (2, "down")], [(3, "raise"), (4, "late"), (1, "ok")]]):
        spark.createDataFrame(rows, "delivery_id long, payload string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("delivery_id long, payload string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert tries() == ["1-0", "2-0", "3-0", "4-0"]
    # The same batches again, as after a failure between the ledger and the checkpoint.
    for name in (0, 1):
        run(spark.read.parquet(f"{tmp_path}/in/*"), name)
    assert len(tries()) == 4
    got = {r.delivery_id: (r.status, r.http_status, r.error) for r in deliveries.last_attempts(deliveries.ledger_of(spark, ledger)).collect()}
    assert got == {1: ("success", 204, None), 2: ("failed", 500, "HTTP 500"), 3: ("failed", None, "TimeoutError: slow"), 4: ("failed", 500, "HTTP 500")}
    due = lambda now: sorted((r.delivery_id, r.attempt) for r in deliveries.due_retries(deliveries.ledger_of(spark, ledger), now).collect())
    assert due("2024-01-01 00:00:09") == [] and due("2024-01-01 00:00:10") == [(2, 2), (3, 2), (4, 2)]
    for at, wait in (("2024-01-01 00:00:10", "a"), ("2024-01-01 00:00:40", "b"), ("2024-01-01 00:05:00", "c")):
        clock["now"] = at
        run(deliveries.due_retries(deliveries.ledger_of(spark, ledger), at), wait)
    # Three attempts at most, and none after a success.
    assert tries() == ["1-0", "2-0", "2-1", "2-2", "3-0", "3-1", "3-2", "4-0", "4-1"]
    last = {r.delivery_id: (r.status, r.attempt) for r in deliveries.last_attempts(deliveries.ledger_of(spark, ledger)).collect()}
    assert last == {1: ("success", 1), 2: ("failed", 3), 3: ("failed", 3), 4: ("success", 2)}

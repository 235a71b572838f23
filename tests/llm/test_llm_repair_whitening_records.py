"""Conversation repair, whitening and binary records against brute force, and their edge cases."""

import hashlib
import heapq
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm.queries import damaged, op11_conversation_repair, op12_embedding_whitening, op13_binary_output
from palimpsest.llm.records import SHARD, frame, masked, payloads, write_records
from palimpsest.llm.repair import Determinised, END, repair_conversations, repaired_turns, summarise_repairs
from palimpsest.llm.whitening import fit_whitening, integer_vectors, whiten

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\v\f\r"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), hashlib.md5(r[2].encode()).hexdigest()))


def brute(rows):
    """The summary of one conversation's rows (turn, role, text) by a search of all edits, cheapest first, then by letters."""
    rows, seen, faults = ordered(rows), set(), []
    for _, role, text in rows:
        end = text.rstrip(WHITE)[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            break
        new = "a" if last == "u" else "u"
        who = {"u": "user", "a": "assistant"}[new]
        heapq.heappush(heap, (cost + 2, audit + "I", i, new, (*out, f"{who}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, out))
            if faults[i] not in ("blank", "duplicate"):
                cost += faults[i] == "truncated"
                heapq.heappush(heap, (cost + 2, audit + "R", i + 1, new, (*out, f"{who}:{text}")))
                if role[:1] == new or (role[:1] == "s" and last == ""):
                    heapq.heappush(heap, (cost, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts = {f: faults.count(f) for f in ("blank", "duplicate", "truncated")}
    return {"gaps": gaps, **counts, "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def by_conversation(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(row)
    return out


def summaries(df):
    return {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


@pytest.mark.parametrize("rows", [4096, 3, 1])
def test_repair_is_the_cheapest_however_conversations_are_cut(spark, rows):
    random.seed(rows)
    roles, texts = ["user", "assistant", "system", "tool", "", "sys", "u"], ["a.", "b.", "c", "", " \n", "d!", "e", "f?", "Ünd.", "g\x1c"]
    table = [(c, random.choice([None, 1, 2, 3, 5, 11]), random.choice(roles), random.choice(texts)) for c in [None, *range(30)] for _ in range(random.choice([1, 2, 5, 9, 40]))]
    df = conversations(spark, table).withColumns({"at": F.lit("x"), "chunk": F.lit(1), "edge": F.lit(None)}).repartition(3)
    assert summaries(summarise_repairs(repair_conversations(df, rows=rows))) == {c: brute(r) for c, r in by_conversation(table).items()}


def test_repair_of_the_hand(spark):
    table = [(1, 1, "user", "Hi."), (1, 2, "user", "You there?"), (2, 1, "system", "Be kind."), (3, 1, "assistant", "Yes."), (3, 2, "user", "And"), (4, 5, "user", ""), (4, 9, None, None)]
    got = summaries(summarise_repairs(repair_conversations(conversations(spark, table))))
    # Two users: an answer in between and one behind, or the second as the answer; that is cheaper.
    assert (got[1]["audit"], got[1]["cost"], got[1]["illegal"]) == ("KR", 2, 1)
    assert (got[2]["audit"], got[2]["cost"]) == ("D", 3)
    # An answer without a question and then a cut question: a question is put before, an answer behind.
    assert (got[3]["audit"], got[3]["cost"], got[3]["truncated"]) == ("IKD", 5, 1)
    assert (got[4]["audit"], got[4]["cost"], got[4]["blank"], got[4]["gaps"]) == ("DD", 6, 2, 3)


def test_repaired_turns_are_the_audit_without_deletions(spark):
    table = [(c, t, random.choice(["user", "assistant", "system"]), random.choice(["a.", "b", "", "c?"])) for c in range(8) for t in range(6)]
    pieces = repair_conversations(conversations(spark, table), rows=2)
    turns = {}
    for r in sorted(repaired_turns(pieces).collect(), key=lambda r: (r.conv_id, r.chunk, r.place)):
        turns.setdefault(r.conv_id, []).append(r)
    for conv, told in summaries(summarise_repairs(pieces)).items():
        rows = turns.get(conv, [])
        assert "".join(r.edit for r in rows) == told["audit"].replace("D", "")
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in rows).encode()).hexdigest() == told["repaired_sha256"]
        letters = "".join(r.role[0] for r in rows).removeprefix("s")
        assert letters == "ua" * (len(letters) // 2)


def test_states_are_few_and_found_in_tables():
    random.seed(1)
    table = Determinised()
    codes = bytes(random.choice([*range(16)]) for _ in range(20_000))
    states, _ = table.scan(codes, table.state(END)[0])
    made = len(table.vectors)
    assert made < 100 and len(states) == 20_001
    table.scan(codes[::-1] * 3, table.state(END)[0])
    assert len(table.vectors) < 100


def test_repair_of_nothing_and_of_equal_rows(spark):
    assert repair_conversations(conversations(spark, [])).count() == 0
    assert summarise_repairs(repair_conversations(conversations(spark, []))).count() == 0
    same = [(7, 1, "user", "x" * 5000 + ".")] * 300 + [(8, 1, "user", "y.")]
    got = summaries(summarise_repairs(repair_conversations(conversations(spark, same), rows=50, chars=20_000)))
    assert got == {c: brute(r) for c, r in by_conversation(same).items()}


def test_repair_query_against_brute_force(spark):
    rows = damaged(spark.read.parquet(f"{SF}/conversations.parquet")).collect()
    own = {r.conv_id for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    expected = {c: brute(r) for c, r in by_conversation([tuple(r) for r in rows]).items()}
    assert summaries(op11_conversation_repair(spark, SF)) == {c: expected.get(c, brute([])) for c in own}


def test_damage_reads_nulls_as_a_space(spark):
    table = conversations(spark, [(None, None, None, None), (5, None, "user", "A. B!")])
    kinds = {c: zlib.crc32(f"{' ' if c is None else c}: ".encode()) % 20 for c in (None, 5)}
    got = [tuple(r) for r in damaged(table).collect()]
    expected = {None: (None, None, " ", " "), 5: (5, None, "user", "A. B!")}
    for c, row in expected.items():
        if kinds[c] == 0:
            assert not [r for r in got if r[0] == c]
        elif kinds[c] > 4:
            assert [r for r in got if r[0] == c] == [row]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def check_whitening(rows, x, got, components=8):
    """Rows of ``whiten`` against numpy on the integers ``x``, in order of vec_id."""
    n, sums = len(x), [int(s) for s in x.astype(object).sum(axis=0)]
    y = x - x.mean(axis=0)
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    w = y @ v / np.sqrt(e)
    assert [r.vec_id for r in got] == np.repeat(rows, len(e)).tolist()
    assert {r.n for r in got} == {n}
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    assert [r.deviation_exact for r in got[:: len(e)]] == exact
    assert [r.deviation for r in got[:: len(e)]] == [d if d < 2**63 else None for d in exact]
    mine = np.array([r.whitened for r in got]).reshape(n, -1)
    for j in range(len(e)):
        assert min(np.abs(mine[:, j] - w[:, j]).max(), np.abs(mine[:, j] + w[:, j]).max()) < 1e-6
    assert np.allclose([r.explained for r in got[: len(e)]], e / np.trace(y.T @ y / n), rtol=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-8
    assert np.abs(np.cov(mine.T, bias=True) - np.eye(len(e))).max() < 1e-8


def test_whitening_query(spark):
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    x = np.floor(1024 * np.array([r.embedding for r in rows], float)).astype(np.int64) + 100_000
    got = op12_embedding_whitening(spark, SF).orderBy("vec_id", "component").collect()
    check_whitening([r.vec_id for r in rows], x, got)


def test_whitening_drops_what_is_no_vector_and_takes_large_ones(spark):
    good = [(i, [float(i % 7), i * 0.25, float(i * i % 11)]) for i in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 0.0, 0.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0])]
    table = vectors(spark, good + bad).withColumns({"x": F.lit("a"), "component": F.lit(1)})
    x = np.floor(1024 * np.array([v for _, v in good])).astype(np.int64) + 100_000
    check_whitening([i for i, _ in good], x, whiten(table).orderBy("vec_id", "component").collect())
    large = [(i, [i * 1e9, -(i % 5) * 3e8]) for i in range(30)]
    x = np.floor(1024 * np.array([v for _, v in large])).astype(np.int64) + 100_000
    got = whiten(vectors(spark, large)).orderBy("vec_id", "component").collect()
    assert got[0].deviation is None and got[0].deviation_exact > 2**63
    check_whitening([i for i, _ in large], x, got)


def test_whitening_without_variance_or_rows(spark):
    assert whiten(vectors(spark, [])).count() == 0
    assert whiten(vectors(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    flat = [(i, [float(i), float(i), 5.0]) for i in range(10)]
    got = whiten(vectors(spark, [*flat, (None, [3.0, 3.0, 5.0])])).collect()
    assert {r.component for r in got} == {1} and len(got) == 11 and got[0].explained == pytest.approx(1)


def test_sums_are_exact_beyond_doubles(spark):
    table = vectors(spark, [(1, [2.0**41 + 0.25]), (2, [2.0**41 + 0.5]), (3, [-(2.0**41)])])
    assert fit_whitening(integer_vectors(table)).sums == (2**51 + 256 + 2**51 + 512 - 2**51 + 300_000,)


def expected_records(docs):
    tokenizer, start, out = Tokenizer.from_file(TOKENIZER), 0, []
    tokenizer.no_truncation(), tokenizer.no_padding()
    for doc, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, start, len(ids), ids.tobytes()))
        start += len(ids)
    return out


def test_binary_output_query(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = sorted(tuple(r) for r in op13_binary_output(spark, SF).collect())
    assert got == [(d, s, n, zlib.crc32(ids)) for d, s, n, ids in expected_records(docs)]


ODD = ["It's a dog's life, isn't it?", "<|endoftext|> and <|ENDOFTEXT|>", "a\x1cb \x85 c d　e", "Été İ ΣΑΣ. ΟΔΟΣ", "́x ſ K ﬃ", "1234 56.7 a1b2", "नमस्ते दुनिया। हाँ!", "日本語 テスト。", "😀😃 ok!!! ...", "WORD word. Word,word;WORD! w'", "", None, " \n\t ", "x" * 5000, "don’t “quote” – dash", "İstanbul. ISTANBUL?", "a.b. c.. d!? e."]


def test_records_of_odd_texts_are_those_of_the_library(spark, tmp_path):
    docs = list(enumerate(ODD * 2, 10)) + [(None, "none"), (3, "three")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"shard": F.lit(1), "content": F.lit("x"), "at": F.lit(0)})
    records = write_records(table.coalesce(1), TOKENIZER, f"file://{tmp_path}/r", end=2, shard=300)
    got = [tuple(r) for r in records.documents().orderBy("start").collect()]
    assert got == expected_records(sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)))
    index = records.index().orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in index] == [g[:3] for g in got]
    # The index leads to the frames.
    for r in index[:5]:
        with open(r.path.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            ((_, body),) = payloads(f.read(r.length) + b"\n")
        assert struct.unpack_from("<HHIq", body)[2] == r.n_tokens
    shuffled = [(r.doc_id, r.start, r.n_tokens, r.ids) for r in records.shuffled(seed=5).collect()]
    assert sorted(shuffled, key=lambda r: r[1]) == got and shuffled != got
    assert shuffled != [tuple(r)[1:] for r in records.shuffled(seed=6).collect()]
    some = records.shuffled(1, spark.createDataFrame([(12,), (12,), (99,)], "doc_id long")).collect()
    assert [(r.doc_id, r.start) for r in some] == [(12, next(s for d, s, *_ in got if d == 12))]


def test_records_that_share_ids_and_no_records(spark, tmp_path):
    docs = [(1, "a b c")] * 40 + [(1, "d e"), (2, "f")]
    records = write_records(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), TOKENIZER, f"file://{tmp_path}/r", shard=100)
    got = records.documents().orderBy("start").collect()
    starts = np.cumsum([0, *(r.n_tokens for r in got)]).tolist()
    assert [r.start for r in got] == starts[:-1] and got[-1].doc_id == 2 and sorted(r.doc_id for r in got) == [1] * 41 + [2]
    none = write_records(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER, f"file://{tmp_path}/n")
    assert none.documents().count() == 0 and none.index().count() == 0 and none.shuffled(1).count() == 0


def test_frames_tell_damage():
    data = frame(b"one") + frame(b"") + frame(b"two" * 1000) + b"\n"
    assert [(at, bytes(body)) for at, body in payloads(data)] == [(0, b"one"), (19, b""), (35, b"two" * 1000)]
    for i in range(0, 60):
        broken = bytearray(data)
        broken[i] ^= 1
        with pytest.raises(ValueError):
            list(payloads(bytes(broken)))
    for cut in (1, 2, 500, len(data) - 3):
        with pytest.raises(ValueError):
            list(payloads(data[:-cut]))
    # The masked sum of public record formats, by hand.
    crc = zlib.crc32(b"abc")
    assert masked(b"abc") == ((crc >> 15) + ((crc << 17) & 0xFFFFFFFF) + 0xA282EAD8) % 2**32 and SHARD >= 1 << 20

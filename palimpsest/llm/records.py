"""Token ids as length-delimited binary records with masked checksums, in shard files that have an offset index.

A shard file is a run of frames and then one line feed.  A frame is the length of its payload (8 bytes), the masked
checksum of those 8 bytes (4), the payload, and the payload's masked checksum (4); all numbers are little-endian.  The
first frame tells the shard's place: the mark, the part, the number in its part, and the ids of the part before it.  Every
other one is a document: 1 or 0 (2 bytes, whether it has a doc_id), the bytes of an id (2), the number of ids (4), the doc_id
(8), and its ids, unsigned, in 2 bytes each where all are below 65,536, else in 4.  Parts and numbers ascend with the documents.  A checksum is CRC-32, turned right by 15 bits and raised by a fixed number, as one
of data that hold checksums would be weak.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from itertools import islice
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.bpe import _byte_letters, _check
from palimpsest.llm.scratch import trimmed

MARK = b"palimpsest ids 1"
#: Bytes of a shard, about: a task holds a file whole, some times over, so executors of much memory may take larger ones.
#: A longer document has one of its own.
SHARD = 8 << 20
#: Added to turned checksums (fixed value, that of public record formats of this kind).
_RAISE = 0xA282EAD8
#: Words whose ids a worker remembers, about.
_WORDS = 300_000
_STOPS = ".,;:!?"
#: Printable words without capitals, apostrophes (which tie letters to what stands before) and marks of special tokens, and
#: the parts that the tokenizer cuts them into.
_ASCII = re.compile(r"(?:(?!<\|)[!-&(-@\[-~])+")
_PARTS = re.compile("[a-z]+|[0-9]|[^a-z0-9]+")
_ID = attrgetter("id")
#: Texts that are encoded together.
_CHUNK = 512
_INDEX = "part long, number long, doc_id long, offset long, length long, start_in_part long, n_tokens long"


def masked(data: bytes) -> int:
    """The checksum that stands in a frame for ``data``."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _RAISE) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def payloads(data: bytes | memoryview, checked: bool = True) -> Iterator[tuple[int, memoryview]]:
    """The place and payload of each frame; a wrong checksum or a cut frame raises an error, and so does the end's absence."""
    at, data = 0, memoryview(data)
    while len(data) - at > 1:
        head = data[at : at + 8]
        size = struct.unpack("<Q", head)[0] if len(data) - at >= 12 else len(data)
        if at + size + 16 > len(data) or struct.unpack_from("<I", data, at + 8)[0] != masked(head):
            raise ValueError(f"a broken frame at {at}")
        body = data[at + 12 : at + 12 + size]
        if checked and struct.unpack_from("<I", data, at + 12 + size)[0] != masked(body):
            raise ValueError(f"a wrong checksum at {at}")
        yield at, body
        at += size + 16
    if bytes(data[at:]) != b"\n":
        raise ValueError("a shard without its end")


class _Numbers(dict):
    """Numbers of words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class _Encoder:
    """Whole texts by the tokenizers library, each distinct word between ASCII white space once: the tokenizer of such a
    file lowers letters and drops white space, and nothing that it does reaches over it."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        _check(told)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.others: dict[str, list[int]] = {}
        suffix, vocab = told["model"]["end_of_word_suffix"], self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        # Words of letters that normalising leaves alone; none below this code point is put together with another one.
        letters = [c for c in map(chr, range(0x1100)) if c.isalpha() and self.tokenizer.normalizer.normalize_str(c) == c]
        self.steady = re.compile(f"[{''.join(letters)}]+[{_STOPS}]?")
        self.byte_letter = dict(enumerate(_byte_letters()))
        self.number = _Numbers()
        self.ids, self.first = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _forget(self) -> None:
        """All words but the first, among which are the common ones."""
        keep = min(len(self.number), _WORDS // 2)
        self.number = _Numbers(zip(islice(self.number, keep), range(keep), strict=True))
        self.ids, self.first = self.ids[: self.first[keep]].copy(), self.first[: keep + 1].copy()

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, end to end, and how many each has."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for g in got for i in g], np.uint32), np.array([len(g) for g in got], np.int64)

    def _simple(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that normalising leaves as they are and that are cut between letters, digits and other
        characters alone: the library's model gets these parts, in the letters of their bytes.  Parts without letters are
        few and remembered."""
        ids: list[int] = []
        ends, tokenize, others = [], self.model.tokenize, self.others
        for w in words:
            for part in _PARTS.findall(w) if w.isascii() else (w,) if w.isalpha() else (w[:-1], w[-1]):
                if part in others:
                    ids += others[part]
                    continue
                own = map(_ID, tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(self.byte_letter)))
                if part.isalpha():
                    ids.extend(own)
                else:
                    ids += others.setdefault(part, list(own))
            ends.append(len(ids))
        if len(others) > 10_000:
            others.clear()
        return np.array(ids, np.uint32), np.diff(np.array(ends, np.int64), prepend=0)

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters, with a stop behind or without, which the library gets in lines: it cuts them into
        one or two parts at least, so that each has just these where there are as many ends of parts as expected."""
        parts = np.fromiter((1 if w.isalpha() else 2 for w in words), np.int64, len(words))
        got = [e.ids for e in self.tokenizer.encode_batch_fast([" ".join(words[i : i + 64]) for i in range(0, len(words), 64)], add_special_tokens=False)]
        ids = np.array([i for g in got for i in g], np.uint32)
        ends = np.flatnonzero(self.ends_word[ids])
        if len(ends) != parts.sum():
            return self._words(words)
        return ids, np.diff(ends[np.cumsum(parts) - 1], prepend=-1)

    def _learn(self, new: list[str]) -> None:
        kinds: tuple[list[int], ...] = ([], [], [])
        for i, w in enumerate(new):
            if not w:  # what stands before the first white space of a text
                continue
            letters = w.isalpha() or (w[-1] in _STOPS and w[:-1].isalpha())
            kinds[0 if self.steady.fullmatch(w) or _ASCII.fullmatch(w) else 1 if letters else 2].append(i)
        told = [(np.array(at, np.int64), *f([new[i] for i in at])) for f, at in zip((self._simple, self._plain, self._words), kinds, strict=True)]
        count = np.zeros(len(new), np.int64)
        for at, _, n in told:
            count[at] = n
        first = np.cumsum(count) - count
        ids = np.empty(count.sum(), np.uint32)
        for at, own, n in told:
            ids[np.arange(len(own)) + np.repeat(first[at] - np.cumsum(n) + n, n)] = own
        self.first = np.concatenate([self.first, self.first[-1] + first + count])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, end to end, and where each one's begin."""
        if len(self.number) > _WORDS:
            self._forget()
        known = len(self.number)
        texts = texts.fill_null("")
        # Special tokens are told by their case; in other texts capitals of the alphabet need not make words distinct.
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        words = lists.flatten().dictionary_encode()
        number = np.fromiter(map(self.number.__getitem__, words.dictionary.to_pylist()), np.int64, len(words.dictionary))
        if len(self.number) > known:
            self._learn(list(islice(self.number, known, None)))
        word = number[words.indices.to_numpy()]
        count = self.first[word + 1] - self.first[word]
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.first[word] - ends[:-1], count)]
        return ids, ends[np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()), dtype=np.int64)])]


@lru_cache(2)
def _encoder(path: str) -> _Encoder:
    """One for each Python worker."""
    return _Encoder(path)


@trimmed
def _shards(batches: Iterator[pa.RecordBatch], path: str, end: int, most: int) -> Iterator[pa.RecordBatch]:
    """The shards of one part, whose documents come in order."""
    encoder, part = _encoder(path), TaskContext.get().partitionId()
    frames: list[bytes] = []
    size = number = before = held = 0

    def shard() -> pa.RecordBatch:
        head = frame(MARK + struct.pack("<qqq", part, number, before))
        return pa.RecordBatch.from_arrays([pa.array([b"".join([head, *frames])], pa.binary())], ["shard"])

    for batch in batches:
        for i in range(0, len(batch), _CHUNK):
            some = batch.slice(i, _CHUNK)
            ids, first = encoder.encode(some.column("text"))
            ids = np.insert(ids, first[1:], end)
            first = first + np.arange(len(first))
            for name, a, b in zip(some.column("doc_id").to_pylist(), first.tolist(), first[1:].tolist(), strict=False):
                if frames and size + 2 * (b - a) > most:
                    yield shard()
                    frames, size, number, before, held = [], 0, number + 1, before + held, 0
                frames.append(frame(_document(name, ids[a:b])))
                size += len(frames[-1])
                held += b - a
    if frames:
        yield shard()


def _document(name: int | None, ids: np.ndarray) -> bytes:
    width = 2 if ids.max() < 2**16 else 4
    return struct.pack("<HHIq", name is not None, width, len(ids), name or 0) + ids.astype(f"<u{width}").tobytes()


def _ids_of(body: memoryview) -> bytes:
    """A document's ids as little-endian unsigned 32-bit numbers."""
    return np.frombuffer(body[16:], f"<u{struct.unpack_from('<H', body, 2)[0]}").astype("<u4").tobytes()


def _place(body: memoryview) -> tuple[int, int, int]:
    if bytes(body[: len(MARK)]) != MARK:
        raise ValueError("no shard of token ids")
    return struct.unpack_from("<qqq", body, len(MARK))


@trimmed
def _read(batches: Iterator[pa.RecordBatch], ids: bool) -> Iterator[pa.RecordBatch]:
    """The documents of shard files, with their ids (and all checksums verified) or only their places."""
    for batch in batches:
        for content in batch.column("content"):
            data = content.as_buffer()
            part = number = start = 0
            rows: list[tuple] = []
            for at, body in payloads(data, checked=ids):
                if not at:
                    part, number, start = _place(body)
                    continue
                there, _, n, name = struct.unpack_from("<HHIq", body)
                rows.append((part, number, name if there else None, at, len(body) + 16, start, n, *[_ids_of(body)] * ids))
                start += n
                if len(rows) == _CHUNK:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [*(f.split()[0] for f in _INDEX.split(", ")), "ids"][: len(rows[0])]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if c == "ids" else pa.int64()) for c, x in zip(names, zip(*rows, strict=True), strict=True)], names)


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The frames at some offsets of each shard."""
    for batch in batches:
        for row, content in zip(batch.column("picks").to_pylist(), batch.column("content"), strict=True):
            data = memoryview(content.as_buffer())
            out = []
            for pick in row:
                a = pick["offset"]
                ((_, body),) = payloads(bytes(data[a : a + pick["length"]]) + b"\n")
                out.append((pick["place"], pick["doc_id"], pick["start"], pick["n_tokens"], _ids_of(body)))
            names, kinds = ["place", "doc_id", "start", "n_tokens", "ids"], [*[pa.int64()] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else ((),) * 5, kinds, strict=True)], names)


@dataclass(frozen=True)
class Records:
    """A folder of shards (``shards``), their offsets (``index``) and the ids before each part (``parts``)."""

    spark: SparkSession
    folder: str

    def _files(self) -> DataFrame:
        return self.spark.read.format("binaryFile").load(f"{self.folder}/shards").filter("length > 1")

    def _with_start(self, rows: DataFrame) -> DataFrame:
        # One row for each part: as many as the writing stage had tasks.
        parts = F.broadcast(self.spark.read.parquet(f"{self.folder}/parts"))
        return rows.join(parts, "part").withColumn("start", F.col("ids_before") + F.col("start_in_part"))

    def documents(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids) of all documents, read from the shards with every checksum verified: ``start``
        counts the ids of all documents before it, ``ids`` are little-endian unsigned 32-bit numbers."""
        read = self._files().select("content").mapInArrow(partial(_read, ids=True), f"{_INDEX}, ids binary")
        return self._with_start(read).select("doc_id", "start", "n_tokens", "ids")

    def index(self) -> DataFrame:
        """(doc_id, path, offset, length, start, n_tokens): the frame of each document."""
        return self._with_start(self.spark.read.parquet(f"{self.folder}/index")).select("doc_id", "path", "offset", "length", "start", "n_tokens")

    def shuffled(self, seed: int, wanted: DataFrame | None = None) -> DataFrame:
        """(place, doc_id, start, n_tokens, ids) of all documents, or of those of ``wanted`` (doc_id), in an order that
        depends on ``seed`` alone: rows lie in partitions and inside them by ``place``.

        Only frames at the index's offsets are looked at.  The index of the shards meets them by their paths; where few
        documents are wanted Spark sends these offsets to the shards, and shards without any are dropped.
        """
        index = self.index().withColumn("place", F.xxhash64("start", F.lit(seed)))
        if wanted is not None:
            index = index.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
        picks = index.groupBy("path").agg(F.collect_list(F.struct("offset", "length", "place", "doc_id", "start", "n_tokens")).alias("picks"))
        met = self._files().select("path", "content").join(picks, "path").select("picks", "content")
        found = met.mapInArrow(_picked, "place long, doc_id long, start long, n_tokens long, ids binary")
        return found.repartitionByRange("place").sortWithinPartitions("place")


def write_records(docs: DataFrame, path: str, folder: str, end: int = 2, shard: int = SHARD) -> Records:
    """Writes the ids of every ``docs`` (doc_id long, text string) into new files under ``folder``, in ascending order.

    A document is its whole text's ids under the tokenizer file at ``path``, as the tokenizers library gives them without
    special tokens added, and then the id ``end``; a null or empty text is the end id alone.  Null ids come first;
    repeated rows and rows that share an id are documents of their own, in the order of the input; an empty table gives
    no shards; other columns are not read.

    Documents are sorted by ranges of their ids (and places, so that an id of many rows is split too), one shuffle of the
    texts.  Each range is a part, written as shards of about ``shard`` bytes, which tasks build in memory one at a time.
    Spark's own sink writes them, one row a file, so that a lost task leaves no file behind and any store will do that
    Spark can write to.  The index is made from the files, and can be made anew from them.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("at"))
    rows = rows.repartitionByRange("doc_id", "at").sortWithinPartitions("doc_id", "at").drop("at")
    shards = rows.mapInArrow(partial(_shards, path=path, end=end, most=shard), "shard binary")
    shards.select(F.col("shard").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(f"{folder}/shards")
    records = Records(spark, folder)
    files = records._files()
    read = files.select("path", "content").mapInArrow(_indexed, f"path string, {_INDEX}")
    read.write.parquet(f"{folder}/index")
    counts = sorted(spark.read.parquet(f"{folder}/index").groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    parts = [(part, at) for (part, _), at in zip(counts, before[:-1], strict=True)]
    spark.createDataFrame(parts, "part long, ids_before long").coalesce(1).write.parquet(f"{folder}/parts")
    return records


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            for out in _read(iter([batch.slice(i, 1)]), ids=False):
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("path")[i].as_py()] * len(out), pa.string()), *out.columns], ["path", *out.schema.names])

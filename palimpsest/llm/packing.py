"""Best-fit packing of token sequences, in partitions first and then in rounds over their underfull bins."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.bpe import tokenizer
from palimpsest.llm.scratch import cut, trimmed

LENGTH = 2048
#: Texts that are encoded together.
TEXTS = 2048
#: Underfull bins that meet in one task, about; more are dealt to several tasks, round by round.
HELD = 20_000
_ITEM = "doc_id long, piece int, start long, length long, ids_crc32 long, offset long"
_FIELDS = [f.split()[0] for f in _ITEM.split(", ")]
_BIN = f"node long, level int, sequence_id long, fill long, full boolean, items array<struct<{_ITEM.replace(' ', ':').replace(',:', ',')}>>"


def best_fit(length: np.ndarray, room: int) -> np.ndarray:
    """A bin for each item: longest first, each into the fullest bin that still has room for it."""
    out = np.empty(len(length), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(room + 1)]
    there, bins = 0, 0
    for i in np.argsort(-length, kind="stable").tolist():
        need = int(length[i])
        # The lowest set bit from ``need`` on is the least room that is enough.
        fits = there >> need
        if fits:
            left = need + (fits & -fits).bit_length() - 1
            b = open_bins[left].pop()
            if not open_bins[left]:
                there ^= 1 << left
        else:
            left, b, bins = room, bins, bins + 1
        out[i] = b
        left -= need
        if not open_bins[left]:
            there |= 1 << left
        open_bins[left].append(b)
    return out


def _bins(columns: dict[str, np.ndarray], first: np.ndarray, null: np.ndarray, room: int, slack: int, node: int, level: int) -> pa.RecordBatch:
    """Packs groups of items (first tells where each one's items begin) and writes a row for each bin."""
    size = np.concatenate([[0], np.cumsum(columns["length"])])[first]
    b = best_fit(np.diff(size), room)
    order = np.argsort(b, kind="stable")
    counts = np.diff(first)[order]
    item = np.arange(counts.sum()) + np.repeat(first[:-1][order] - (np.cumsum(counts) - counts), counts)
    bins = int(b.max()) + 1 if len(b) else 0
    owner = np.repeat(b[order], counts)
    length = columns["length"][item]
    fill = np.bincount(owner, length, bins).astype(np.int64)
    begin = np.searchsorted(owner, np.arange(bins + 1))
    columns = {k: v[item] for k, v in columns.items()}
    columns["offset"] = np.cumsum(length) - length - np.repeat(np.cumsum(fill) - fill, np.diff(begin))
    kinds = {"piece": pa.int32()}
    struct = pa.StructArray.from_arrays([pa.array(columns[c], kinds.get(c, pa.int64()), mask=null[item] if c == "doc_id" else None) for c in _FIELDS], _FIELDS)
    full = fill > room - slack
    names = np.int64(level) << 57 | np.int64(node) << 25 | np.arange(bins)
    return pa.RecordBatch.from_arrays([pa.array(np.full(bins, node)), pa.array(np.full(bins, level, np.int32)), pa.array(names), pa.array(fill), pa.array(full), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), struct)], ["node", "level", "sequence_id", "fill", "full", "items"])


@trimmed
def _tokenised(batches: Iterator[pa.RecordBatch], path: str, end: int, room: int, slack: int) -> Iterator[pa.RecordBatch]:
    """The pieces of a partition's documents, packed among themselves."""
    bpe = tokenizer(path)
    parts: list[dict[str, np.ndarray]] = []
    nulls = []
    for batch in (b.slice(i, TEXTS) for b in batches for i in range(0, len(b), TEXTS)):
        ids, first = bpe.encode(batch.column("text").to_pylist())
        ids = np.insert(ids, first[1:], end).astype("<u4")
        first = first + np.arange(len(first))
        total = np.diff(first)
        pieces = -(-total // room)
        doc = np.repeat(np.arange(len(total)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * room
        length = np.minimum(room, total[doc] - start)
        at = first[doc] + start
        crc = np.fromiter((zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)), np.int64, len(at))
        name = batch.column("doc_id")
        parts.append({"doc_id": name.fill_null(0).to_numpy()[doc], "piece": piece, "start": start, "length": length, "ids_crc32": crc})
        nulls.append(np.asarray(name.is_null())[doc])
    if parts:
        columns = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        yield _bins(columns, np.arange(len(columns["length"]) + 1), np.concatenate(nulls), room, slack, TaskContext.get().partitionId(), 0)


def _merged(key: tuple, bins: pa.Table, room: int, slack: int, level: int) -> pa.Table:
    bins = bins.sort_by("sequence_id")
    lists = bins.column("items").combine_chunks()
    items = lists.flatten()
    first = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
    columns = {c: items.field(c) for c in _FIELDS}
    null = np.asarray(columns["doc_id"].is_null())
    columns = {c: v.fill_null(0).to_numpy() for c, v in columns.items()}
    # The bins are taken apart, so that their pieces may meet others; as they were if that takes no more bins.
    ways = (_bins(columns, f, null, room, slack, key[0].as_py(), level) for f in (first, np.arange(len(null) + 1)))
    return pa.Table.from_batches([min(ways, key=len)])


def _merge_step(**step: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def merged(key: tuple, bins: pa.Table) -> pa.Table:
        return _merged(key, bins, **step)

    return merged


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = 0, slack: int = 16, held: int = HELD) -> DataFrame:
    """A row for each piece of ``docs`` (doc_id long, text string): (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A document is its ids under the tokenizer file at ``path`` and then the id ``end``; one longer than ``length`` is
    cut into pieces of ``length`` and a rest.  ``start`` counts the document's ids before the piece, ``ids_crc32`` is
    over its little-endian 32-bit ids, and ``offset`` is the piece's place in sequence ``sequence_id``, gapless from 0.
    A null or empty text is the end id alone; repeated rows and null ids are packed like any others; ties go by the
    order of the input; an empty table gives no rows.  Other columns are not read.

    Each partition packs its pieces by best fit (longest first, into the fullest bin with room) and emits bins with
    less than ``slack`` tokens of room.  The underfull bins go to the next round, which deals them by a hash that
    differs from round to round to tasks of about ``held`` bins, each with a mix of all; a task takes its bins apart
    and packs their pieces by best fit.  Rounds go on while one saves a hundredth of the bins.  Of two bins that a task
    leaves, no two fit into one, so at most one in a task is half empty; of ``s`` half empty bins in all, each can only
    join one of the ``s`` or one of the ``s`` emptiest others (if it fits into any bin it fits into those), so just
    these go to further rounds, until one task holds them all.  In the end no two bins with ``slack`` or more tokens of
    room fit into one.  Each round is written to the shared folder, so the tokens are made once.
    """
    step = {"room": length, "slack": slack}
    level = cut(docs.select("doc_id", "text").mapInArrow(partial(_tokenised, path=path, end=end, **step), _BIN), "bins")
    done, left, k = [level.filter("full")], level.filter("not full"), 0
    n, held = left.count(), max(4, held)
    while n > 1:
        k, tasks = k + 1, -(-n // held)
        dealt = left.withColumn("node", F.pmod(F.xxhash64("sequence_id", F.lit(k)), F.lit(tasks))).groupBy("node")
        level = cut(dealt.applyInArrow(_merge_step(level=k, **step), _BIN), "bins")
        done.append(level.filter("full"))
        left = level.filter("not full")
        if tasks == 1:
            break
        before, n = n, level.count()
        fell, n = (before - n) * 100 >= before, left.count()
        most = 2 * left.filter(F.col("fill") * 2 <= length).count()
        if not fell and most < n:
            # The half empty bins, and as many others; the rest can take none of them that these could not.
            order = cut(left.select("fill", "sequence_id").orderBy("fill", "sequence_id").limit(most), "emptiest")
            done.append(left.join(order.select("sequence_id"), "sequence_id", "left_anti").select(*level.columns))
            left, n = left.join(order.select("sequence_id"), "sequence_id", "left_semi").select(*level.columns), most
    out = left
    for part in done:
        out = out.union(part)
    return out.select("sequence_id", F.explode("items").alias("x")).select("x.doc_id", "x.piece", "x.start", "x.length", "x.ids_crc32", "sequence_id", "x.offset")

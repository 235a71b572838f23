"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.components import connected_components, union_find
from palimpsest.llm.scratch import cut, trimmed
from palimpsest.llm.words import U, mix, of_text, split_words, windows

SLOTS, BANDS = 512, 64
#: Documents of a tile's side.
TILE = 256
_FULL = U(2**64 - 1)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the shingles of each text, end to end, and where each text's begin.

    A text of fewer than ``k`` words has its whole word sequence as its one shingle; one without words has none.
    """
    words = split_words(column, lower=True)
    h, n = words.hashes(), np.diff(words.first)
    text = of_text(words.first)
    run = windows(h, k)
    inside = np.flatnonzero(text[: len(run)] == text[k - 1 :]) if len(run) else np.empty(0, np.int64)
    shingle, owner = run[inside], text[inside]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.array([int(mix(np.add.reduce(h[a:b] * mix(np.arange(1, b - a + 1, dtype=U))) + np.full(1, b - a, U))[0]) for a, b in zip(words.first[short], words.first[short + 1], strict=True)], U)
        shingle, owner = np.concatenate([shingle, whole]), np.concatenate([owner, short])
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    shingle, owner = shingle[new], owner[new]
    return shingle, np.searchsorted(owner, np.arange(len(n) + 1))


def super_min_hash(items: np.ndarray, first: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """A row of ``slots`` values for each set items[first[d]:first[d + 1]]; an empty set's row is all ones.

    Every item has a random permutation of the slots, drawn step by step (Fisher-Yates), and fresh random fractions.
    In round j it offers j + fraction to the j-th slot of its permutation; each slot keeps the least offer.  A set is
    ready as soon as all its slots are taken, as later rounds only offer more.
    """
    size = np.diff(first)
    out = np.full((len(size), slots), _FULL)
    if not len(items):
        return out
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    bounds = np.cumsum(size[order])
    at = 0
    while at < len(order):
        most = 8192 if size[order[at]] < slots // 2 else 131_072
        to = max(at + 1, int(np.searchsorted(bounds, (bounds[at - 1] if at else 0) + most)))
        sets = order[at:to]
        span = size[sets]
        local = np.repeat(np.arange(len(sets)), span)
        starts = np.cumsum(span) - span
        x = items[np.arange(len(local)) - np.repeat(starts - first[sets], span)]
        out[sets] = _rounds(x, local, len(sets), slots, dense=int(span.max()) < slots // 2)
        at = to
    return out


def _rounds(x: np.ndarray, owner: np.ndarray, n: int, slots: int, dense: bool) -> np.ndarray:
    sketch = np.full(n * slots, _FULL)
    perm = np.tile(np.arange(slots, dtype=np.uint16), (len(x), 1)) if dense else None
    drawn: list[np.ndarray] = []
    held: list[np.ndarray] = []
    j = 0
    while j < slots:
        draw = mix(x + U((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        k = (((draw & U(0xFFFFFFFF)) * U(slots - j)) >> U(32)).astype(np.int64) + j
        if dense:
            row = np.arange(len(x))
            slot = perm[row, k].astype(np.int64)
            perm[row, k] = perm[:, j]
        else:
            # What earlier swaps have left at k, and at j itself, which goes to place k.
            slot, mine = k.copy(), np.full(len(x), j)
            for at, was in zip(drawn, held, strict=True):
                slot = np.where(at == k, was, slot)
                mine = np.where(at == j, was, mine)
            drawn.append(k)
            held.append(mine)
        np.minimum.at(sketch, owner * slots + slot, (draw >> U(16)) | U(j << 48))
        j += 1
        if j == slots or not dense or j % max(1, len(x) and 2048 // max(1, len(x) // max(1, n)) // 16) == 0:
            ready = sketch.reshape(n, slots).max(axis=1) != _FULL
            left = ~ready[owner]
            if not left.any():
                break
            if left.mean() < 0.7:
                x, owner = x[left], owner[left]
                if dense:
                    perm = perm[left]
                drawn, held = [d[left] for d in drawn], [d[left] for d in held]
    return sketch.reshape(n, slots)


def bands_of(sketch: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of a row."""
    part = sketch.reshape(len(sketch), bands, -1)
    key = mix(np.arange(1, bands + 1, dtype=U) * U(0x9E3779B97F4A7C15))[None, :]
    for r in range(part.shape[2]):
        key = mix(key * U(3) + part[:, :, r])
    return key


@trimmed
def _signatures(batches: Iterator[pa.RecordBatch], k: int, slots: int, bands: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in (whole.slice(i, 512) for i in range(0, len(whole), 512)):
            items, first = shingle_sets(batch.column(1), k)
            n = np.diff(first)
            both = np.concatenate([items, np.zeros(1, U)])
            digest = [np.where(n > 0, np.add.reduceat(mix(both ^ U(c)), first[:-1]), U(0)).view(np.int64) for c in (1, 2**63 + 7)] if len(n) else [np.empty(0, np.int64)] * 2
            keys = bands_of(super_min_hash(items, first, slots), bands).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(n) + 1) * bands, bands, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), *map(pa.array, digest), lists, batch.column(2)], ["row", "n_shingles", "d1", "d2", "bands", "doc_id"])


@trimmed
def _sets(batches: Iterator[pa.RecordBatch], k: int, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The sets of rows whose hashed number is in the bitmap (a superset of those asked for)."""
    for batch in batches:
        h = batch.column(2).to_numpy()
        there = np.flatnonzero((bits[h >> 6] >> (h & 63)) & 1)
        for i in range(0, len(there), 512):
            some = batch.take(pa.array(there[i : i + 512]))
            items, first = shingle_sets(some.column(1), k)
            yield pa.RecordBatch.from_arrays([some.column(0), pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer((first * 8).astype(np.int64)), pa.py_buffer(items)]).cast(pa.binary())], ["id", "items"])


@trimmed
def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets share enough: 100 * intersection >= percent * union."""
    for batch in batches:
        keep = np.zeros(len(batch), bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
            both = np.sort(np.concatenate([x, y]), kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            keep[i] = 100 * shared >= percent * (len(both) - shared)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))


def _bitmap(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of hashed ids, gathered as 64-bit words: 16 bits an id, but never over 2**27 bits (16 MB)."""
    n = ids.count()
    size = min(1 << 27, max(1 << 14, 1 << (16 * n).bit_length()))
    h = F.pmod(F.xxhash64("id"), F.lit(size))
    words = ids.select(F.shiftright(h, 6).alias("w"), F.expr(f"shiftleft(1L, int(pmod(xxhash64(id), {size}) & 63))").alias("x")).groupBy("w").agg(F.bit_or("x").alias("x")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[words.column("w").to_numpy()] = words.column("x").to_numpy()
    return bits, size


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _links_in_tile(rows: pa.Table, percent: int) -> pa.Table:
    """Ties each document of a tile to the least that it reaches by links between the tile's two sides."""
    rows = rows.combine_chunks().sort_by("id")
    ids, first_side = rows.column("id").to_numpy(), rows.column("x").to_numpy(zero_copy_only=False)
    sets = [np.frombuffer(v.as_buffer(), U) for v in rows.column("items")]
    sizes = np.array([len(v) for v in sets], np.int64)
    x, y = np.flatnonzero(first_side), np.flatnonzero(~first_side)
    owner = np.repeat(np.arange(len(sets)), sizes)
    items = np.concatenate(sets) if sets else np.empty(0, U)
    kept = np.isin(items, np.intersect1d(items[first_side[owner]], items[~first_side[owner]]))
    value, at = np.unique(items[kept], return_inverse=True)
    owner = owner[kept]
    shared = np.zeros((len(x), len(y)), np.int64)
    for i in range(0, len(value), 8192):
        held = np.zeros((len(sets), min(8192, len(value) - i)), np.float32)
        inside = (at >= i) & (at < i + 8192)
        held[owner[inside], at[inside] - i] = 1
        shared += (held[x] @ held[y].T).astype(np.int64)
    linked = 100 * shared >= percent * (sizes[x][:, None] + sizes[y][None, :] - shared)
    a, b = np.nonzero(linked & (ids[x][:, None] != ids[y][None, :]))
    node, least = union_find(ids[x[a]], ids[y[b]])
    return pa.table({"a": pa.array(node, pa.int64()), "b": pa.array(least, pa.int64())})


def _tiled(unsettled: DataFrame, sets: DataFrame, percent: int, side: int = TILE) -> DataFrame:
    """All links that could still join two components, as ties (a, b).

    Documents that share buckets, however indirectly, form a cluster; those outside its largest component are held
    against all its members, in tiles of about ``side`` by ``side`` documents, so no pairs are written out.
    """
    clusters = cut(connected_components(unsettled, "id", "centre"), "clusters")
    docs = unsettled.select("id", "part").distinct().join(clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id")
    main = docs.groupBy("cluster", "part").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.sum("n").alias("ny"), F.max("n").alias("n"))
    sides = main.select("cluster", "main", F.ceil((F.col("ny") - F.col("n")) / side).alias("sx"), F.ceil(F.col("ny") / side).alias("sy"))
    docs = cut(docs.join(sides, "cluster"), "clustered")
    tiles = []
    for x, own, other in ((True, "sx", "sy"), (False, "sy", "sx")):
        mine, theirs = F.pmod(F.xxhash64("id"), F.col(own)).alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias("theirs")
        placed = (docs.filter("part <> main") if x else docs).select("id", "cluster", mine, theirs)
        tiles.append(placed.select("id", "cluster", *(F.col(c).alias(v) for c, v in zip(("mine", "theirs") if x else ("theirs", "mine"), "ij", strict=True)), F.lit(x).alias("x")))

    def tile(rows: pa.Table) -> pa.Table:
        return _links_in_tile(rows, percent)

    return cut(tiles[0].union(tiles[1]).join(sets, "id").groupBy("cluster", "i", "j").applyInArrow(tile, "a long, b long"), "links")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number ``row`` of its own for each row, written to the shared folder so that it stays."""
    return cut(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, slots: int = SLOTS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id long, text string); other columns are not read.

    ``kept`` says that a row's id is its component's, so of rows that share an id all are or none; ``near_duplicate_rows``
    tells which one row of a component stays.
    """
    rows = near_duplicate_rows(numbered(docs.select("doc_id", "text")), k, percent, slots, bands)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_duplicate_rows(table: DataFrame, k: int = 5, percent: int = 80, slots: int = SLOTS, bands: int = BANDS) -> DataFrame:
    """(row, doc_id, n_shingles, component_id, kept) for every row of ``table`` (row, as of ``numbered``, doc_id, text).

    A document's set holds its distinct ``k``-word shingles, lower-cased (A-Z); two documents are linked if
    100 * intersection >= percent * union.  Every row is a document of its own, whether or not others have its id or
    none has one.  Documents without words and null texts are linked with nothing; each is kept, and its id is its
    component's.  A component's name is its smallest id, null if no row has one; the row of that id, of several the one
    of least number, is the only one kept.

    Documents with equal sets fold to one representative first, so large groups of copies cost one row.  The rest
    share a band with probability 1 - (1 - s ** (slots / bands)) ** bands at similarity s (over 0.99999 at 0.8).
    Each document is first compared with one or two centres of its buckets.  Only where buckets then still hold
    several components are the documents outside the largest one compared with all others of the cluster, in tiles of
    bounded size; no link is lost to the shortcut, and no pairs of a group are written out.  All comparisons use the
    full sets.
    """
    spark = table.sparkSession
    table = table.select("row", "text", F.col("doc_id").cast("long").alias("doc_id"))
    signed = cut(table.mapInArrow(partial(_signatures, k=k, slots=slots, bands=bands), "row long, n_shingles long, d1 long, d2 long, bands array<long>, doc_id long"), "signatures")
    some = signed.filter("n_shingles > 0")
    same = some.groupBy("n_shingles", "d1", "d2")
    rows = same.agg(F.min("row").alias("id"), F.min_by("bands", "row").alias("bands")).select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    centres = rows.groupBy("key").agg(F.min(F.struct("id", "n")).alias("c"), F.max(F.struct("id", "n")).alias("d"), F.count("*").alias("members")).filter("members > 1").select("key", "c", "d")
    members = cut(rows.join(centres, "key"), "members")
    # The sets of documents that share a bucket: a bitmap of bounded size keeps other texts out of the shuffle.
    bits, size = _bitmap(members.select("id").distinct())
    shared = spark.sparkContext.broadcast(bits)
    asked = table.select("row", "text", F.pmod(F.xxhash64("row"), F.lit(size)).alias("h"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sets(batches, k, shared.value)

    sets = cut(asked.mapInArrow(sets_of, "id long, items binary"), "sets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        found = pairs.select("a", "b").distinct()
        found = found.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
        return cut(found.select("a", "b", "x", "y").mapInArrow(partial(_linked, percent=percent), "a long, b long"), name)

    # Each document is held against one centre, the least of its buckets', and then, where that left two components
    # in a bucket, against another one.
    centred = members.filter((F.col("id") != F.col("c.id")) & _sizes_fit("n", "c.n", percent)).groupBy("id").agg(F.min("c.id").alias("a"))
    links = verified(centred.select("a", F.col("id").alias("b")), "links")
    parts = cut(connected_components(links), "parts")
    apart = _unsettled(members, parts).filter((F.col("part") != F.col("part_d")) & (F.col("id") != F.col("d.id")) & _sizes_fit("n", "d.n", percent))
    links = links.union(verified(apart.groupBy("id").agg(F.max("d.id").alias("a")).select("a", F.col("id").alias("b")), "links"))
    parts = cut(connected_components(links), "parts")
    more = _tiled(cut(_unsettled(members, parts).select("id", "part", F.col("c.id").alias("centre")), "unsettled"), sets, percent)
    if not more.isEmpty():
        parts = cut(connected_components(links.union(more)), "parts")
    # The row that stays of each component: that of the least id, rows without one last.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    named = same.agg(F.min("row").alias("node"), first)
    tied = parts.join(named.select("node", "first"), "node")
    tied = tied.join(tied.groupBy("component").agg(F.min("first").alias("best")), "component").select("node", "best")
    named = named.join(tied, "node", "left").select("n_shingles", "d1", "d2", F.coalesce("best", "first").alias("best"))
    out = signed.select("row", "doc_id", "n_shingles", "d1", "d2").join(named, ["n_shingles", "d1", "d2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("best.doc_id"))
    kept = (F.col("n_shingles") == 0) | (F.col("row") == F.col("best.row"))
    return out.select("row", "doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def _unsettled(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with their own component and that of the bucket's largest id."""
    part = parts.select(F.col("node").alias("id"), F.col("component").alias("part"))
    own = members.join(part, "id", "left").withColumn("part", F.coalesce("part", "id"))
    mixed = own.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.max_by("part", "id").alias("part_d")).filter("p <> q")
    return own.join(mixed.select("key", "part_d"), "key")

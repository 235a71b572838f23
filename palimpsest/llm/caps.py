"""Near-duplicate vectors by spherical-cap filters from random product codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.components import connected_components
from palimpsest.llm.scratch import cut

#: Filters that a vector falls into on average and at least, vectors that a filter holds on average, and vectors of a
#: tile's side.
LISTED, LEAST, HELD, TILE = 12, 6, 512, 2048


@lru_cache(16)
def _code(d: int, words: int, listed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Two codes of ``words`` random unit directions, for the halves of a vector, and the score that ``listed`` of their products reach."""
    rng = np.random.default_rng([d, words, 20160110])
    halves = []
    for size in (d // 2, d - d // 2):
        c = rng.standard_normal((words if size else 1, size))
        halves.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300))
    x = rng.standard_normal((256, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = x[:, : d // 2] @ halves[0].T, x[:, d // 2 :] @ halves[1].T
    share = min(0.5, listed / (len(halves[0]) * len(halves[1])))
    # Quantiles of all sums of a sample vector's two score lists, over the sample.
    edge = float(np.mean([np.quantile(np.add.outer(p, q), 1 - share) if len(p) * len(q) < 10**6 else _tail(p, q, share) for p, q in zip(a[:64], b[:64], strict=True)]))
    return halves[0], halves[1], edge


def _tail(p: np.ndarray, q: np.ndarray, share: float) -> float:
    """The value that a ``share`` of all sums of the two lists exceed, by bisection over sorted lists."""
    q = np.sort(q)
    low, high, want = -2.0, 2.0, share * len(p) * len(q)
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if (len(q) - np.searchsorted(q, mid - p)).sum() > want else (low, mid)
    return low


def unit(lists: pa.ListArray, d: int) -> np.ndarray:
    """The rows of a list column of equal lengths as unit vectors in double precision."""
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _filters(batches: Iterator[pa.RecordBatch], words: int, listed: int) -> Iterator[pa.RecordBatch]:
    """List-decodes each vector: all pairs of directions whose summed score reaches the edge, by the sorted second list."""
    for batch in batches:
        lengths = np.asarray(batch.column("embedding").value_lengths())
        for d in np.unique(lengths).tolist():
            part = batch.filter(pa.array(lengths == d))
            one, two, edge = _code(d, words, listed)
            x = unit(part.column("embedding"), d)
            a, b = x[:, : d // 2] @ one.T, x[:, d // 2 :] @ two.T
            order = np.argsort(-b, axis=1, kind="stable")
            down = -np.take_along_axis(b, order, axis=1)
            out, down_best = [], -down[:, :LEAST]
            for i in range(len(part)):
                first = np.flatnonzero(a[i] - down[i, 0] >= edge)
                n = np.searchsorted(down[i], a[i, first] - edge, side="right")
                second = order[i, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                got = np.repeat(first, n) * len(two) + second
                if len(got) < LEAST:
                    # The best products of its best directions, so that no vector has next to no filters.
                    best = np.argsort(-a[i], kind="stable")[:LEAST]
                    sums = (a[i, best][:, None] + down_best[i]).ravel()
                    top = np.argsort(-sums, kind="stable")[:LEAST]
                    got = np.union1d(got, best[top // down_best.shape[1]] * len(two) + order[i, top % down_best.shape[1]])
                out.append(np.sort(got) + (d << 44))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.list_(pa.int64()))], [*part.schema.names, "filters"])


def _tile(key: tuple, rows: pa.Table, cosine: float) -> pa.Table:
    """Links between the two sides of a tile of one filter's vectors, unless an earlier filter holds both ends."""
    f, a, b = (k.as_py() for k in key)
    rows = rows.combine_chunks().sort_by("id")
    empty = pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "least": pa.array([], pa.int64())})
    if len(rows) < 2:
        return empty
    ids, side, copies = (rows.column(c).to_numpy() for c in ("id", "side", "copies"))
    vectors = rows.column("embedding").combine_chunks()
    x = unit(vectors, len(vectors[0]))
    near = (x @ x.T) >= cosine
    np.fill_diagonal(near, False)
    if a != b:
        near &= side[:, None] != side[None, :]
    some = np.flatnonzero(near.any(axis=1))
    if not len(some):
        return empty
    near, ids, copies = near[np.ix_(some, some)], ids[some], copies[some]
    lists = rows.column("filters").combine_chunks().take(pa.array(some))
    owner = np.repeat(np.arange(len(some)), np.asarray(lists.value_lengths()))
    flat = lists.flatten().to_numpy()
    owner, flat = owner[flat < f], flat[flat < f]
    if len(flat):
        value, at, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[at] > 1
        owner, at = owner[shared], at[shared]
        value, at = np.unique(at, return_inverse=True)
        for i in range(0, len(value), 4096):
            held = np.zeros((len(some), min(4096, len(value) - i)), np.float32)
            inside = (at >= i) & (at < i + 4096)
            held[owner[inside], at[inside] - i] = 1
            near &= (held @ held.T) == 0
    links = near @ copies
    label = np.arange(len(some))
    while True:
        least = np.minimum(label, np.where(near, label[None, :], len(some)).min(axis=1))
        least = least[least]
        if (least == label).all():
            break
        label = least
    keep = links > 0
    return pa.table({"id": ids[keep], "links": links[keep].astype(np.int64), "least": ids[label[keep]]})


def near_vectors(vectors: DataFrame, cosine: float = 0.95, listed: int = LISTED, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id long, embedding array of numbers).

    Rows are linked if their cosine in double precision is ``cosine`` or more and a filter holds both.  Vectors that
    are null, zero, empty or hold null or non-finite components, and rows without an id, link with nothing; vectors
    of different lengths do not link.  Equal vectors (repeated rows too) fold to one with its number of copies, which
    all count as links of one another.  Nothing is dropped or capped.

    A vector's halves are scored against two random codes; the pairs of directions whose product code word it exceeds
    are its filters (``listed`` on average, list-decoded from the sorted scores; a vector with fewer than ``LEAST`` takes its
    best ones).  Near vectors share most of their filters, others few.  A filter's vectors are compared in tiles of bounded size, however many it holds, and a pair
    counts in the first filter that it shares, so neither pairs nor links are ever written out.
    """
    numbers = "exists(embedding, x -> x <> 0) and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    fit = f"vec_id is not null and embedding is not null and coalesce({numbers}, false)"
    rows = vectors.select("vec_id", "embedding")
    same = rows.filter(fit).groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    kind = rows.schema["embedding"].dataType.simpleString()
    words = max(16, math.ceil(math.sqrt(rows.count() * listed / HELD)))
    coded = cut(same.select("id", "copies", "embedding").mapInArrow(partial(_filters, words=words, listed=listed), f"id long, copies long, embedding {kind}, filters array<long>"), "caps")
    held = coded.select("id", F.explode("filters").alias("f"))
    sides = held.groupBy("f").agg(F.count("*").alias("n")).filter("n > 1").select("f", F.ceil(F.col("n") / tile).alias("sides"))
    side = F.pmod(F.xxhash64("id", "f"), F.col("sides"))
    placed = held.join(sides, "f").withColumn("side", side).select("id", "f", "side", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)).alias("other"))
    placed = placed.select("id", "f", "side", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"))

    def tiled(key: tuple, rows: pa.Table) -> pa.Table:
        return _tile(key, rows, cosine)

    found = cut(placed.join(coded, "id").groupBy("f", "a", "b").applyInArrow(tiled, "id long, links long, least long"), "links")
    parts = connected_components(found, "id", "least")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = same.join(counts, "id", "left").join(parts.select(F.col("node").alias("id"), "component"), "id", "left")
    named = named.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = rows.filter(fit).join(named, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter(f"not ({fit})").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

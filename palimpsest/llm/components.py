"""Connected components of an edge table, by union-find in each partition and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.scratch import cut


#: A node with over one in so many of all edges is a hub.
HUBS = 1000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges (a, b), sorted, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return nodes, nodes[np.fromiter((root(x) for x in range(len(nodes))), np.int64, len(nodes))]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a partition's edges, every node tied to its smallest; folded whenever many edges have gathered."""
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy()])
        b = np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > 200_000:
            a, b = union_find(a, b)
    if len(a):
        node, least = union_find(a, b)
        keep = node != least
        yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(least[keep])], ["a", "b"])


def _told(rows: DataFrame, least: DataFrame, most: float) -> DataFrame:
    """``rows`` (a, b) with the ``m`` that ``least`` (a, m, n) tells of ``a``.

    Nodes of more than ``most`` edges, of which there are few, are told by broadcast, so that the edges of a hub stay
    where they are; the others by a shuffled join.
    """
    hubs = F.broadcast(least.filter(F.col("n") > most).select("a", F.col("m").alias("h")))
    tagged = rows.join(hubs, "a", "left")
    others = tagged.filter("h is null").select("a", "b").join(least.filter(F.col("n") <= most).select("a", "m"), "a")
    return tagged.filter("h is not null").select("a", "b", F.col("h").alias("m")).union(others.select("a", "b", "m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` reaches.

    Columns ``a`` and ``b`` are longs; edges may repeat, run either way or tie a node to itself.  Each partition first
    folds its edges to a forest by union-find.  While a node hangs on several others, or on one that hangs itself,
    rounds of large-star and small-star contraction tie every node to its component's least one; each round shuffles
    only the forest, and its result is written to the shared folder.  A node with over a ``HUBS``th of all edges is a
    hub; there are at most 2 * ``HUBS``, which is what is broadcast.  No link or component reaches the driver, which
    reads two counts a round.
    """
    now = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null").mapInArrow(_stars, "a long, b long"), "forest")
    while True:
        ends = now.select("a", F.lit(1).alias("out"), F.lit(0).alias("in")).union(now.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("a").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
        tangled, n = ends.agg(F.count_if(F.expr("`out` > 1 or (`out` > 0 and `in` > 0)")), F.sum("out")).first()
        if not tangled:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = _told(both.filter("b > a"), least, n / HUBS).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Every edge now runs from its larger end; the small star ties these ends' other neighbours to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _told(large, least, n / HUBS).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "forest")

"""Exact top-k by inner product, by a three-phase uniform threshold over lists of partial scores."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.scratch import cut

#: Vectors of a block, and queries of one; a task holds one block of each.
BLOCK, QUERIES = 1024, 512
#: One block in so many gives the first lists, from which the cutoffs come.
FIRST = 8
#: Below this share of open vectors what is missing of a query's is resolved pair by pair, above it in dense products.
SPARSE = 0.1
_LEAST = np.iinfo(np.int64).min
_ENTRY = ["query_id", "vec_id", "score", "met", "computed", "resolved"]
_KIND = "d long, bucket long, first boolean, ids binary, cutoffs binary, width int, matrix binary"


def _blocks(rows: int, buckets: int, copies: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs (id, v, cutoff) rows into matrices of vectors of equal length and like norm; with ``copies`` one for every
    bucket, else each for one.  A block stores its components in as few bytes as they need; every ``FIRST``th of its kind is marked."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, list[tuple]] = {}
        made, part, count = 0, TaskContext.get().partitionId(), defaultdict(int)

        def emit(key: tuple) -> pa.RecordBatch:
            nonlocal made
            now = kept.pop(key)
            at = range(buckets) if copies else [(part * 7919 + made) % buckets]
            first = (part + count[key]) % FIRST == 0
            made += 1
            count[key] += 1
            matrix = np.array([r[1] for r in now], np.int64).reshape(len(now), key[0])
            most = int(np.abs(matrix).max(initial=0))
            width = 2 if most < 2**15 else 4 if most < 2**31 else 8
            columns = [np.array([r[0] for r in now], np.int64).tobytes(), np.array([r[2] for r in now], np.int64).tobytes()]
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(at), pa.int64()), pa.array(list(at), pa.int64()), pa.array([first] * len(at)), *(pa.array([c] * len(at), pa.binary()) for c in columns),
                 pa.array([width] * len(at), pa.int32()), pa.array([matrix.astype(f"<i{width}").tobytes()] * len(at), pa.binary())],
                ["d", "bucket", "first", "ids", "cutoffs", "width", "matrix"],
            )

        for batch in batches:
            column = batch.column(1)
            first = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))])
            flat = column.flatten().to_numpy()
            for i, (name, cutoff) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                v = flat[first[i] : first[i + 1]]
                key = (len(v), 0 if copies else int(np.linalg.norm(v.astype(np.float64))).bit_length())
                kept.setdefault(key, []).append((name, v, cutoff))
                if len(kept[key]) == rows:
                    yield emit(key)
        for key in list(kept):
            yield emit(key)

    return pack


class _Met:
    """A block of vectors and one of queries, their components divided among lists."""

    def __init__(self, row: dict, lists: int) -> None:
        d = row["d"]
        self.ids, self.queries, self.cutoffs = (np.frombuffer(row[c], np.int64) for c in ("ids", "q_ids", "q_cutoffs"))
        v, q = (np.frombuffer(row[f"{c}matrix"], f"<i{row[f'{c}width']}").reshape(-1, d) for c in ("", "q_"))
        bound = float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(d, 1)
        # Doubles are exact up to 2 ** 53, and far faster.
        self.v, self.q = (x.astype(np.float64 if bound < 2**53 else np.int64) for x in (v, q))
        self.edges = np.linspace(0, d, lists + 1).astype(int)
        self.lists, self.others = lists, self.ids[None, :] != self.queries[:, None]
        self.pairs = self.others.sum(axis=1)

    def scores(self, j: int, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The score of every vector in one list, for some queries."""
        a, b = self.edges[j], self.edges[j + 1]
        return (self.q[some, a:b] @ self.v[:, a:b].T).astype(np.int64)

    def norms(self, x: np.ndarray) -> np.ndarray:
        """Norms of the rows in each list (list by row), rounded up."""
        return np.array([np.sqrt((x[:, a:b].astype(np.float64) ** 2).sum(axis=1)) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]) * (1 + 1e-12)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best entries, ties to the smaller id."""
    at = np.arange(len(ids))
    if len(at) > k:
        at = np.flatnonzero(score >= np.partition(score, len(at) - k)[len(at) - k])
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def _local_lists(batches: Iterator[pa.RecordBatch], k: int, lists: int) -> Iterator[pa.RecordBatch]:
    """Phase 1: each query's ``k`` best entries of a block, all of whose lists are read."""
    for batch in batches:
        for row in batch.to_pylist():
            met = _Met(row, lists)
            total = sum(met.scores(j) for j in range(lists))
            yield _found(met.queries, met.ids, total, met.others, k)
            yield _work(met, met.pairs * lists, met.pairs)


def _found(queries: np.ndarray, ids: np.ndarray, total: np.ndarray, open_: np.ndarray, k: int) -> pa.RecordBatch:
    """The ``k`` best open entries of each query."""
    places = [np.flatnonzero(o) for o in open_]
    places = [some[_best(total[i, some], ids[some], k)] for i, some in enumerate(places)]
    who = np.repeat(np.arange(len(queries)), [len(p) for p in places])
    at = np.concatenate([np.empty(0, np.int64), *places])
    none = pa.nulls(len(at), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(queries[who]), pa.array(ids[at]), pa.array(total[who, at]), none, none, none], _ENTRY)


def _work(met: _Met, computed: np.ndarray, resolved: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(met.queries), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(met.queries), none, none, *map(pa.array, (met.pairs, computed, resolved))], _ENTRY)


def _sufficient(batches: Iterator[pa.RecordBatch], k: int, lists: int) -> Iterator[pa.RecordBatch]:
    """Phases 2 and 3 on a block: entries that may reach the cutoff, read list by list, and their missing scores.

    A pair of whole score >= cutoff has a list in which it scores cutoff / lists or more, and what it has so far plus
    the product of norms of what is missing is never below the cutoff.  A pair that can do neither is dropped; once few
    are open, only what is missing of these is computed.  A row with a null ``vec_id`` tells of each query the number
    of pairs met, of list scores computed for them, and of pairs resolved to the end.
    """
    for batch in batches:
        for row in batch.to_pylist():
            met = _Met(row, lists)
            n, cutoff = len(met.ids), met.cutoffs.astype(np.float64)
            nv, nq = met.norms(met.v), met.norms(met.q)
            # Norms of what is missing after each list, and the largest of its lists.
            rest_v, rest_q = (np.sqrt(np.cumsum(x[::-1] ** 2, axis=0)[::-1]) * (1 + 1e-9) for x in (nv, nq))
            most_v, most_q = (np.maximum.accumulate(x[::-1], axis=0)[::-1] * (1 + 1e-9) for x in (nv, nq))
            # Block by block: queries whose cutoff no vector of the block can reach are not read at all.
            asked = np.flatnonzero((nq.T @ nv.max(axis=1, initial=0)) * (1 + 1e-9) >= cutoff) if n else np.empty(0, np.int64)
            computed, resolved = np.zeros(len(met.queries), np.int64), np.zeros(len(met.queries), np.int64)
            met.q, met.others, rest_q, most_q = met.q[asked], met.others[asked], rest_q[:, asked], most_q[:, asked]
            open_, total, reached = met.others.copy(), np.zeros((len(asked), n), np.int64), np.zeros((len(asked), n), bool)
            cut_ = cutoff[asked][:, None]
            least = np.ceil(cut_ / lists)
            # Queries that are still read in dense products, and the open pairs of the others.
            dense, pairs = np.arange(len(asked)), np.empty((2, 0), np.int64)
            for j in range(lists):
                a, b, more = met.edges[j], met.edges[j + 1], j + 1 < lists
                one, two = pairs
                total[one, two] += np.einsum("ij,ij->i", met.q[one, a:b], met.v[two, a:b]).astype(np.int64)
                computed[asked] += np.bincount(one, minlength=len(asked))
                keep = total[one, two] + (rest_q[j + 1][one] * rest_v[j + 1][two] if more else 0) >= cut_[one, 0]
                open_[one, two] = keep
                pairs = pairs[:, keep]
                score = met.scores(j, dense)
                computed[asked[dense]] += met.others[dense].sum(axis=1)
                total[dense] += score
                reached[dense] |= score >= least[dense]
                stay = total[dense] + (rest_q[j + 1][dense][:, None] * rest_v[j + 1] if more else 0) >= cut_[dense]
                if not more:
                    stay &= reached[dense]
                elif (most_q[j + 1].max(initial=0) * most_v[j + 1].max(initial=0) < least).any():
                    stay &= reached[dense] | (most_q[j + 1][dense][:, None] * most_v[j + 1] >= least[dense])
                open_[dense] &= stay
                few = open_[dense].mean(axis=1) < SPARSE
                if more and few.any():
                    one, two = np.nonzero(open_[dense[few]])
                    pairs = np.concatenate([pairs, [dense[few][one], two]], axis=1)
                    dense = dense[~few]
            resolved[asked] = open_.sum(axis=1)
            yield _found(met.queries[asked], met.ids, total, open_, k)
            yield _work(met, computed, resolved)


def searched(vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int = 8) -> DataFrame:
    """(query_id, vec_id, score, met, computed, resolved): the entries that the three phases leave to ``exact_top_k``, and
    rows with a null ``vec_id`` that count a query's work in a block: pairs met, list scores computed, pairs resolved."""
    spark = vectors.sparkSession
    whole = "id is not null and v is not null and not exists(v, x -> x is null)"
    asked = queries.select("id", "v").filter(whole).dropDuplicates()
    table = vectors.select("id", "v").filter(whole).dropDuplicates().withColumn("cutoff", F.lit(0).cast("long"))
    # A bucket for every block at most, so that few vectors do not have queries copied to all partitions.
    buckets = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // BLOCK)))
    blocks = cut(table.mapInArrow(_blocks(BLOCK, buckets, copies=False), _KIND).select("d", "bucket", "first", "ids", "width", "matrix"), "blocks")
    kind = ", ".join(f"{c} long" for c in _ENTRY)

    def met(blocks: DataFrame, queries: DataFrame, read: Callable) -> DataFrame:
        copies = queries.mapInArrow(_blocks(QUERIES, buckets, copies=True), _KIND)
        copies = copies.select("d", "bucket", *(F.col(c).alias(f"q_{c}") for c in ("ids", "cutoffs", "width", "matrix")))
        return blocks.join(copies, ["d", "bucket"]).mapInArrow(partial(read, k=k, lists=lists), kind)

    gathered = cut(met(blocks.filter("first"), asked.withColumn("cutoff", F.lit(_LEAST)), _local_lists), "gathered")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    cutoffs = gathered.filter("vec_id is not null").withColumn("r", F.row_number().over(order)).filter(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("cutoff"))
    told = asked.join(cutoffs, "id", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(_LEAST)))
    return gathered.union(met(blocks.filter("not first"), told, _sufficient))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` with the highest inner product for each query.

    Both tables have id (long) and v (array<long>); other columns are not read.  A query's own id is no candidate; ties
    go to the smaller id; a query with fewer candidates gets all of them.  Rows with a null id, a null vector or a null
    component take no part, repeated rows count once, vectors are only compared with vectors of their length, and empty
    tables give no rows.  Where one id has several vectors, each is an entry, and each is a query.

    Each vector's components are divided among ``lists``, each of which orders all vectors by its share of the score.
    1. One block of vectors in eight reads all lists; its ``k`` best entries are gathered and give each query a safe
       cutoff, their k-th best score.
    2. The cutoff travels to all other blocks with the queries.  Blocks that can't reach it are skipped; the others are
       read list by list, and only entries stay that can still reach the cutoff, and cutoff / ``lists`` in some list.
    3. The missing scores of the few that are left are resolved exactly, and the best ``k`` of all blocks kept.

    ``searched`` tells which share of the products was computed.  Blocks of queries meet every block of vectors in
    dense products of bounded size; only the queries are copied, once for each bucket of blocks, never broadcast, and
    the blocks are packed once.  An id with several vectors can be found twice, as an entry of two scores.
    """
    found = searched(vectors, queries, k, lists).filter("vec_id is not null").select("query_id", "vec_id", "score").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

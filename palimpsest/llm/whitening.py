"""Whitening of embeddings: exact integer means, a covariance of centred vectors summed in a tree, and its eigenvectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that one matrix product takes together.
BLOCK = 4096
#: What lies below this share of the largest eigenvalue is rounding, not a component.
RANK = 1e-12
_OUT = "vec_id long, component int, n long, deviation long, deviation_exact decimal(38,0), whitened double"


@dataclass(frozen=True)
class Whitening:
    """What the fit of ``n`` vectors gives: exact sums for each dimension, and a projection of each component."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    explained: np.ndarray
    projection: np.ndarray  # dimensions by components, divided by the roots of the eigenvalues


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their vectors as a matrix of integers."""
    for batch in batches:
        for i in range(0, len(batch), BLOCK):
            some = batch.slice(i, BLOCK)
            x = some.column("x")
            yield some, x.flatten().to_numpy().reshape(len(some), -1)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S / n: the whole part of the mean is taken away in integers, the rest, below 1, in doubles."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return (x - whole) - rest


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each dimension, the high and low halves' sums of a partition's integers: no sum can overflow."""
    n, high, low = 0, 0, 0
    for _, x in _blocks(batches):
        n, high, low = n + len(x), high + (x >> 31).sum(axis=0), low + (x & (2**31 - 1)).sum(axis=0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high)), pa.int32()), pa.array(np.full(len(high), n)), pa.array(high), pa.array(low)], ["dimension", "n", "high", "low"])


def _products(batches: Iterator[pa.RecordBatch], n: int, sums: tuple[int, ...], projection: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The sum of a partition's outer products of centred vectors, projected ones where a projection is given."""
    total = None
    for _, x in _blocks(batches):
        y = _centred(x, n, sums)
        y = y if projection is None else y @ projection
        y = np.column_stack([y, np.ones(len(y))])  # the last column sums the vectors themselves
        total = y.T @ y if total is None else total + y.T @ y
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["products"])


def _covariance(vectors: DataFrame, n: int, sums: tuple[int, ...], projection: np.ndarray | None = None) -> np.ndarray:
    """The covariance of ``vectors`` with divisor ``n``: one matrix for each partition, added up in a tree."""
    rows = vectors.select("x").mapInArrow(partial(_products, n=n, sums=sums, projection=projection), "products binary")
    zero = np.zeros(1)
    add = lambda a, b: a + b
    total = rows.rdd.treeAggregate(zero, lambda acc, row: acc + np.frombuffer(row.products), add, depth=3)
    side = int(np.sqrt(total.size))
    total = total.reshape(side, side)
    mean = total[-1, :-1] / n
    out = total[:-1, :-1] / n - np.outer(mean, mean)  # the mean is 0 but for rounding
    return (out + out.T) / 2


def integer_vectors(table: DataFrame, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """(vec_id, x) of ``table`` (vec_id, embedding): x = floor(scale * c) + shift for every component c, as double.

    Rows whose vector is null or empty, or holds a null or non-finite component, are left out, and so are those with a
    component beyond 2 ** 52 after scaling, which a double does not hold to a whole number.
    """
    c = F.transform("embedding", lambda x: x.cast("double") * scale)
    fine = "embedding is not null and size(embedding) > 0 and not exists(c, x -> x is null or isnan(x) or abs(x) > 4503599627370496D)"
    rows = table.select("vec_id", "embedding", c.alias("c")).filter(fine)
    return rows.select("vec_id", F.transform("c", lambda x: F.floor(x).cast("long") + shift).alias("x"))


def fit_whitening(vectors: DataFrame, components: int = 8) -> Whitening | None:
    """The whitening of ``vectors`` (x array<long>, all of one length): None without vectors or without any variance.

    The first pass sums integers exactly and gives the mean; the second one centres every vector and adds up outer
    products by matrix products, a matrix for each partition, merged in a tree.  The driver gets the sums and one matrix,
    both as large as the vectors are long, however many there are, and takes the eigenvectors of the symmetric matrix by
    LAPACK.  Components come by falling eigenvalue; fewer than ``components`` where the vectors span fewer dimensions.
    """
    rows = vectors.select("x").mapInArrow(_sums, "dimension int, n long, high long, low long")
    got = rows.groupBy("dimension").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low"))).orderBy("dimension").collect()
    if not got:
        return None
    n, sums = int(got[0]["n"]), tuple(int(r["high"]) * 2**31 + int(r["low"]) for r in got)
    covariance = _covariance(vectors, n, sums)
    value, vector = np.linalg.eigh(covariance)
    value, vector = value[::-1], vector[:, ::-1]
    k = int((value[:components] > max(value[0], 0) * RANK).sum())
    if not k:
        return None
    # One sign of the two for each component, whatever LAPACK gives: its largest entry is positive.
    turn = np.sign(vector[np.abs(vector[:, :k]).argmax(axis=0), np.arange(k)])
    return Whitening(n, sums, value[:k], value[:k] / np.trace(covariance), vector[:, :k] * turn / np.sqrt(value[:k]))


def _projected(batches: Iterator[pa.RecordBatch], fit: Whitening) -> Iterator[pa.RecordBatch]:
    k = fit.projection.shape[1]
    whole, rest = np.array([s // fit.n for s in fit.sums], np.int64), [s % fit.n for s in fit.sums]
    for some, x in _blocks(batches):
        w = _centred(x, fit.n, fit.sums) @ fit.projection
        # n * x - S is n * (x - whole) - rest: in 64 bits where no sum of squares can leave them, else of any size.
        y = x - whole
        if (fit.n * (int(np.abs(y).max()) + 1)) ** 2 * x.shape[1] < 2**63:
            d = ((fit.n * y - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        else:
            d = [sum((fit.n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in y.tolist()]
        at = pa.array(np.repeat(np.arange(len(x)), k))
        short = pa.array([v if v < 2**63 else None for v in d], pa.int64())
        wide = pa.array([v if v < 10**38 else None for v in d], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays(
            [some.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), fit.n)), short.take(at), wide.take(at), pa.array(w.ravel())],
            ["vec_id", "component", "n", "deviation", "deviation_exact", "whitened"],
        )


def whiten(table: DataFrame, components: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, deviation_exact, whitened, explained, identity_error) of ``table`` (vec_id long,
    embedding array<float or double>): a row for each vector that ``integer_vectors`` keeps, and each component.

    ``n`` vectors are fitted; ``deviation`` is the exact sum over dimensions of (n * x - S) ** 2, null where a long can't
    hold it, ``deviation_exact`` the same as a decimal, null from 10 ** 38.  ``whitened`` is x - S / n projected on the
    component's unit eigenvector, over the root of its eigenvalue; ``explained`` the share of the trace;
    ``identity_error`` the largest absolute entry of the whitened vectors' covariance, taken from the data in a pass of
    its own, minus the identity.

    Where vectors differ in length, those of the commonest length (of two the longer) are fitted and returned, others
    are left out.  Repeated rows, ids and null ids are vectors of their own; other columns are not read.  Components
    without variance are left out, so that vectors which are all alike, and an empty table, give no rows.

    The table is read four times (five times with its lengths) and never shuffled; the fit travels with the tasks, and
    no vector reaches the driver.
    """
    vectors = integer_vectors(table)
    lengths = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    vectors = vectors.filter(F.size("x") == (lengths["d"] if lengths else 0))
    fit = fit_whitening(vectors, components) if lengths else None
    if fit is None:
        return table.sparkSession.createDataFrame([], f"{_OUT}, explained double, identity_error double")
    k = len(fit.eigenvalues)
    error = float(np.abs(_covariance(vectors, fit.n, fit.sums, fit.projection) - np.eye(k)).max())
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(partial(_projected, fit=fit), _OUT)
    explained = F.get(F.array(*(F.lit(float(e)) for e in fit.explained)), F.col("component") - 1)
    return out.withColumn("explained", explained).withColumn("identity_error", F.lit(error))

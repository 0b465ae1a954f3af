"""Centroid clustering of vectors in exact integers, screened by float32 matrix products.

A vector's components x become integers floor(256 * x). Each round assigns every vector to the centroid at the least squared
distance (of equal ones the lower number) and moves each centroid to the floor of its vectors' mean; an empty one stays.

Screening: with d = |c|^2 - 2 v.c (the squared distance without |v|^2), the product v.c comes from a float32 matrix product of
values rounded to float32. Whatever the order of its additions, it is off by at most g * |v| * |c| with
g = m u / (1 - m u), u = 2^-24 and m the number of components and six more for the roundings of both factors and of the bound
itself. That gives each centroid an interval; those that reach below the least upper end are the shortlist. Where it holds
more than one centroid, their distances are computed in integers.

A round is a scan of the vectors without a shuffle of them: tasks return sums and counts of their vectors by centroid, which
Spark adds up; only the centroids (``count`` of them) reach the driver. Sums are added in limbs of 32 bits, so that they are exact
at any size.

Edge cases: vectors that are null, have another number of components, or hold null or non-finite ones are left out; ids may
repeat (equal ids order by vector as starting centroids) or be null (last as starting centroids); with fewer vectors than
centroids every vector starts one; no vectors give an empty result. A squared distance or a sum of them beyond 64 bits is null, while
assignments and centroids stay exact. Columns named like results are replaced, others stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldloom.llm.common import without

#: Components of a vector, centroids and rounds of the registered query; steps to a unit.
SIZE, COUNT, ROUNDS, STEPS = 64, 40, 5, 256
#: Below it, squared distances of 64 components fit 64-bit integers; below the other, float32 products don't overflow.
_PLAIN, _FLOAT = 1 << 27, 1 << 60
_LONG = 1 << 63
RESULT = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole(vector: Column, size: int = SIZE) -> Column:
    """Whether a vector has its number of components, none null or non-finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) == size) & fine, F.lit(False))


def integers(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) of finite doubles: 64-bit integers, or Python's where one is larger than 2^60."""
    if not len(x) or np.abs(x).max() < _FLOAT / STEPS:
        return np.floor(x * STEPS).astype(np.int64)
    large = np.abs(x) >= 2.0**53  # such doubles are whole numbers
    return np.array([[int(v) * STEPS if b else int(np.floor(v * STEPS)) for v, b in zip(r, s, strict=True)] for r, s in zip(x, large, strict=True)], object).reshape(x.shape)


def _largest(v: np.ndarray) -> int:
    return int(np.abs(v).max()) if v.size else 0


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    if max(_largest(a), _largest(b)) >= _PLAIN or a.shape[1] > SIZE:
        a, b = a.astype(object), b.astype(object)
    return ((a - b) ** 2).sum(1)


def nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, exact squared distance) of each row; of equal distances the lower number."""
    if max(_largest(v), _largest(c)) >= _FLOAT:
        far = np.stack([_squares(v, np.broadcast_to(k, v.shape)) for k in c.astype(object)], 1)
        at = np.array([min(range(len(c)), key=r.__getitem__) for r in far.tolist()], np.int64)
        return at, far[np.arange(len(v)), at]
    w, k = v.astype(np.float64), c.astype(np.float64)
    lengths, norms = np.sqrt((w * w).sum(1)), (k * k).sum(1)
    m = (v.shape[1] + 6) * 2.0**-24
    reach = lengths[:, None] * np.sqrt(norms)
    middle = norms - 2.0 * (v.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    error = 2 * (m / (1 - m)) * reach + 1e-12 * (norms + 2 * reach) + 1e-30
    short = middle - error <= (middle + error).min(1)[:, None]
    at = short.argmax(1)
    row, number = np.nonzero(short & (short.sum(1) > 1)[:, None])
    if len(row):
        exact = _squares(v[row], c[number])
        # In order of row and number: a row's first least distance.
        head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        least = np.minimum.reduceat(exact, head)
        hit = np.flatnonzero(exact == np.repeat(least, np.diff(np.append(head, len(row)))))
        hit = hit[np.append(True, row[hit][1:] != row[hit][:-1])]
        at[row[hit]] = number[hit]
    return at, _squares(v, c[at])


def _vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are whole, their integers) of an Arrow list column."""
    lists = column.cast(pa.list_(pa.float64()))
    long_enough = np.flatnonzero(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == size)
    flat = lists.take(pa.array(long_enough)).flatten()
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, size)  # null becomes NaN
    fine = np.isfinite(x).all(1)
    return long_enough[fine], integers(x[fine])


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(number, limb) of an integer in limbs of 32 bits that carry its sign."""
    sign, value, k = (-1 if value < 0 else 1), abs(value), 0
    while value:
        if value & 0xFFFFFFFF:
            yield k, sign * (value & 0xFFFFFFFF)
        value, k = value >> 32, k + 1


def _totals(vectors: DataFrame, centroids: np.ndarray, size: int) -> dict[int, dict[int, int]]:
    """By centroid and component the sum of its vectors, their number at -1, and the sum of their squared distances at -2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            _, v = _vectors(batch.column(0), size)
            if not len(v):
                continue
            at, far = nearest(v, centroids)
            small = _largest(v) < 1 << 40 and far.dtype != object and _largest(far) < 1 << 50
            for k in np.unique(at).tolist():
                mine = at == k
                part = v[mine] if small else v[mine].astype(object)
                now = sums.setdefault(k, [0, 0, [0] * size])
                now[0] += int(mine.sum())
                now[1] += int(far[mine].sum()) if small else sum(map(int, far[mine]))
                now[2] = [a + int(b) for a, b in zip(now[2], part.sum(0), strict=True)]
        rows = [(k, dim, *limb) for k, (n, d, parts) in sums.items() for dim, value in [(-1, n), (-2, d), *enumerate(parts)] for limb in _limbs(value)]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "dim", "limb", "value"])

    parts = vectors.mapInArrow(run, "cluster int, dim int, limb int, value long").groupBy("cluster", "dim", "limb").agg(F.sum("value").alias("value"))
    out: dict[int, dict[int, int]] = {}
    for r in parts.collect():  # a few rows for each component of a centroid
        of = out.setdefault(r["cluster"], {})
        of[r["dim"]] = of.get(r["dim"], 0) + (r["value"] << (32 * r["limb"]))
    return out


def _tight(rows: list[list[int]]) -> np.ndarray:
    """Integers as 64-bit ones where they are small enough."""
    large = max((abs(x) for r in rows for x in r), default=0) >= _FLOAT
    return np.array(rows, object if large else np.int64)


def learn(vectors: DataFrame, start: Column, vector: str = "embedding", count: int = COUNT, rounds: int = ROUNDS, size: int = SIZE) -> np.ndarray:
    """Centroids after some rounds, first the vectors with the least ``start``, in its order."""
    first = vectors.where(whole(F.col(vector), size)).select(start.alias("_start"), F.col(vector).cast("array<double>").alias("_vector"))
    chosen = first.orderBy(F.col("_start").asc_nulls_last(), "_vector").limit(count).collect()
    centroids = [list(map(int, r)) for r in integers(np.array([r["_vector"] for r in chosen], float).reshape(-1, size))]
    only = vectors.select(vector)
    for _ in range(rounds if centroids else 0):
        for k, total in _totals(only, _tight(centroids), size).items():
            centroids[k] = [total.get(d, 0) // total[-1] for d in range(size)]
    return _tight(centroids)


def assign(vectors: DataFrame, centroids: np.ndarray, vector: str = "embedding", size: int = SIZE) -> DataFrame:
    """Rows with a whole vector, without it, with the nearest centroid's figures."""
    own = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    rest = without(vectors, vector, *own)
    names = rest.columns
    given = vectors.select(*[vectors[c] for c in names], vectors[vector].alias("_centroid_vector"))
    out = StructType([*rest.schema.fields, *StructType.fromDDL(RESULT).fields])
    if not len(centroids):
        return given.sparkSession.createDataFrame([], out)
    fits = lambda x: x if x < _LONG else None
    totals = _totals(vectors.select(vector), centroids, size)
    by_cluster = [fits(totals[k].get(-2, 0)) if k in totals else 0 for k in range(len(centroids))]
    all_ = fits(sum(t.get(-2, 0) for t in totals.values()))
    prints = [hashlib.sha256(",".join(map(str, map(int, c))).encode()).hexdigest() for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, v = _vectors(batch.column(len(names)), size)
            at, far = nearest(v, centroids) if len(v) else (np.zeros(0, np.int64), [])
            mine = [
                pa.array(at.astype(np.int32)),
                pa.array([fits(int(d)) for d in far], pa.int64()),
                pa.array([by_cluster[k] for k in at], pa.int64()),
                pa.array([all_] * len(at), pa.int64()),
                pa.array([prints[k] for k in at], pa.string()),
            ]
            left = batch.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*left.columns[: len(names)], *mine], [*names, *own])

    return given.mapInArrow(run, out)


def cluster(vectors: DataFrame, start: Column, vector: str = "embedding", count: int = COUNT, rounds: int = ROUNDS, size: int = SIZE) -> DataFrame:
    """Rows with a whole vector, without it, with cluster, squared distance, sums of distances and the centroid's digest."""
    return assign(vectors, learn(vectors, start, vector, count, rounds, size), vector, size)

"""Centroid clustering of integer vectors over a pivot table (LAESA).

Every vector's distances to a few fixed pivots are measured once and kept beside it. In each round a
centroid's distances to the same pivots give, by the triangle inequality, a lower bound on its distance
to every vector: max over pivots of |d(v, p) - d(c, p)|. The centroid with the least bound is measured
first; only centroids whose bound does not exceed that distance are measured as well. Bounds are
floating point and taken a little low; every distance that decides is an exact integer.

What crosses the network per round is one row per task, cluster and component. Nothing but k centroids,
their sums and the pivots is ever on the driver.

Taken are vectors with exactly ``dims`` components, none null or non-finite; a component x becomes
floor(scale * x). Rows that repeat an id are vectors of their own. A null id takes part, but seeds no
centroid unless ids run out. With fewer than k vectors there are fewer centroids, with none no rows.
Components too large for 64-bit sums are handled as whole numbers of any size; distances and inertias
that exceed a long are reported as the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.store import keep

PIVOTS = 8
CANDIDATE_PIVOTS = 64
SAFE = 1 << 26  # components up to here cannot overflow 64-bit distances of 64 components
LONGEST = (1 << 63) - 1
LIMB = 40
ROWS = 4096

KEPT = "vec_id bigint, vector array<double>, pivots array<double>"


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles: int64 where that is safe, Python numbers otherwise."""
    if not x.size or np.abs(x).max() * scale <= SAFE:
        return np.floor(x * scale).astype(np.int64)
    exact = [int(v) * scale if abs(v) >= 2.0**52 else int(np.floor(v * scale)) for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows."""
    if a.dtype == object or b.dtype == object:
        a, b = a.astype(object), b.astype(object)
    gap = a - b
    return (gap * gap).sum(axis=1)


def _matrix(centroids: list[list[int]]) -> np.ndarray:
    small = all(abs(x) <= SAFE for c in centroids for x in c)
    return np.array(centroids, np.int64 if small else object)


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([_roots(_squares(x, np.broadcast_to(p, x.shape))) for p in pivots], axis=1)


def nearest(x: np.ndarray, table: np.ndarray, centroids: np.ndarray, to_pivots: np.ndarray):
    """Cluster and exact squared distance of each row of ``x``, and how many distances were measured.

    ``table`` has the rows' pivot distances, ``to_pivots`` those of the centroids. Of equally near
    centroids the one with the smaller number is taken.
    """
    n, k = len(x), len(centroids)
    gaps = np.abs(table[:, None, :] - to_pivots[None, :, :])
    # Each stored distance is right to a few parts in 2**52 of its size.
    bound = (gaps - 1e-12 * (table[:, None, :] + to_pivots[None, :, :])).max(axis=2)
    bound = np.maximum(bound, 0.0)
    first = bound.argmin(axis=1)
    found = _squares(x, centroids[first])
    reach = _roots(found) * (1 + 1e-12)
    survive = bound <= reach[:, None]
    survive[np.arange(n), first] = False
    rows, others = np.nonzero(survive)
    wide = x.dtype == object or centroids.dtype == object
    every = np.full((n, k), None if wide else LONGEST, object if wide else np.int64)
    every[np.arange(n), first] = found
    every[rows, others] = _squares(x[rows], centroids[others])
    if wide:
        cluster = np.array([min(range(k), key=lambda j: (r[j] is None, r[j] or 0, j)) for r in every], np.int64)
    else:
        cluster = every.argmin(axis=1)
    return cluster, every[np.arange(n), cluster], n + len(rows)


def _vectors(batch: pa.RecordBatch, column: str) -> np.ndarray:
    values = batch[column]
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), ROWS):
            yield batch.slice(start, ROWS)


def _tabled(batches, pivots: list[list[int]], scale: int) -> Iterator[pa.RecordBatch]:
    fixed = _matrix(pivots)
    for batch in _parts(batches):
        near = pivot_distances(_whole(_vectors(batch, "vector"), scale), fixed)
        yield pa.RecordBatch.from_arrays(
            [batch["vec_id"], batch["vector"], pa.array(list(near), pa.list_(pa.float64()))],
            ["vec_id", "vector", "pivots"],
        )


def _limbs(total: int) -> list[int]:
    """``total`` in digits of 40 bits, the last one signed: sums of digits stay within a long."""
    digits = []
    while not -(1 << LIMB) < total < 1 << LIMB:
        total, digit = divmod(total, 1 << LIMB)
        digits.append(digit)
    return [*digits, total]


SUMS = "cluster int, place int, limb int, value bigint"


def _summed(batches, centroids: list[list[int]], to_pivots: list[list[float]], scale: int):
    middle, ways = _matrix(centroids), np.array(to_pivots)
    k, dims = len(centroids), len(centroids[0])
    sums = [[0] * dims for _ in range(k)]
    counts, measured = [0] * k, 0
    for batch in _parts(batches):
        x = _whole(_vectors(batch, "vector"), scale)
        cluster, _, done = nearest(x, _vectors(batch, "pivots"), middle, ways)
        measured += done
        for j in np.unique(cluster).tolist():
            mine = x[cluster == j]
            counts[j] += len(mine)
            sums[j] = [a + b for a, b in zip(sums[j], mine.sum(axis=0).tolist(), strict=True)]
    rows = [(j, -1, 0, counts[j]) for j in range(k)] + [(-1, -1, 0, measured)]
    for j in range(k):
        for place, total in enumerate(sums[j]):
            rows += [(j, place, i, digit) for i, digit in enumerate(_limbs(total)) if digit]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
        ["cluster", "place", "limb", "value"],
    )


def _assigned(batches, centroids: list[list[int]], to_pivots: list[list[float]], scale: int):
    middle, ways = _matrix(centroids), np.array(to_pivots)
    for batch in _parts(batches):
        x = _whole(_vectors(batch, "vector"), scale)
        cluster, distance, _ = nearest(x, _vectors(batch, "pivots"), middle, ways)
        far = [min(int(d), LONGEST) for d in distance.tolist()]
        yield pa.RecordBatch.from_arrays(
            [batch["vec_id"], pa.array(cluster, pa.int32()), pa.array(far, pa.int64())],
            ["vec_id", "cluster", "distance"],
        )


def taken(vectors: DataFrame, vector: str, dims: int) -> DataFrame:
    """``vec_id, vector`` (doubles) of the vectors that take part."""
    x = F.col(vector).cast("array<double>")
    # No null, NaN or infinity: x - x is zero for finite numbers only.
    whole = F.forall(x, lambda c: F.coalesce((c - c) == 0.0, F.lit(False)))
    fits = F.coalesce(F.size(x) == dims, F.lit(False)) & F.coalesce(whole, F.lit(False))
    return vectors.filter(fits).select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("vector"))


def first_by_hash(kept: DataFrame, count: int, prefix: str) -> list[list[float]]:
    """The ``count`` vectors with the smallest sha256 of prefix and id; equal ids go by their vector."""
    name = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256)
    rows = kept.select(name.alias("name"), "vector").orderBy(F.col("name").asc_nulls_last(), "vector").limit(count)
    return [r["vector"] for r in rows.collect()]


def spread_pivots(candidates: list[list[int]], count: int) -> list[list[int]]:
    """Of the candidates those that lie far from the ones before, starting with the first."""
    x = _matrix(candidates)
    chosen = [0]
    far = _squares(x, np.broadcast_to(x[0], x.shape))
    while len(chosen) < min(count, len(x)):
        following = max(range(len(x)), key=lambda i: far[i])
        chosen.append(following)
        far = np.minimum(far, _squares(x, np.broadcast_to(x[following], x.shape)))
    return [candidates[i] for i in chosen]


class Clustering:
    """``rows``: vec_id, cluster, distance of every vector; the final ``centroids``; and per round the
    share of distances that were ``measured``."""

    def __init__(self, rows: DataFrame, centroids: list[list[int]], measured: list[float]):
        self.rows, self.centroids, self.measured = rows, centroids, measured


def cluster(
    vectors: DataFrame, vector: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10,
    scale: int = 1024, prefix: str = "3:",
) -> Clustering:
    """Lloyd's rounds in whole numbers from the ``k`` vectors that come first by hash.

    A round moves each centroid to floor(sum / count) of its vectors; one without vectors stays. The
    vectors are assigned once more after the last round.
    """
    spark = vectors.sparkSession
    kept = taken(vectors, vector, dims)
    found = first_by_hash(kept, max(k, CANDIDATE_PIVOTS), prefix)
    if not found:
        return Clustering(spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), [], [])
    seeds = _whole(np.array(found), scale).tolist()
    pivots, centroids = spread_pivots(seeds, PIVOTS), seeds[:k]
    table = keep(kept.mapInArrow(lambda b: _tabled(b, pivots, scale), KEPT), "pivot-table")

    def ways(middle: list[list[int]]) -> list[list[float]]:
        return pivot_distances(_matrix(middle), _matrix(pivots)).tolist()

    measured = []
    for _ in range(rounds):
        now, to_pivots = centroids, ways(centroids)
        sums = table.mapInArrow(lambda b, now=now, w=to_pivots: _summed(b, now, w, scale), SUMS)
        # At most k x dims sums of a few digits each, whatever the number of vectors.
        total: dict[tuple[int, int], int] = {}
        for r in sums.groupBy("cluster", "place", "limb").agg(F.sum("value").alias("value")).collect():
            at = (r["cluster"], r["place"])
            total[at] = total.get(at, 0) + (r["value"] << (LIMB * r["limb"]))
        counts = [total[j, -1] for j in range(len(centroids))]
        measured.append(total[-1, -1] / (sum(counts) * len(centroids)))
        centroids = [
            [total.get((j, place), 0) // counts[j] for place in range(dims)] if counts[j] else centroids[j]
            for j in range(len(centroids))
        ]
    to_pivots = ways(centroids)
    rows = table.mapInArrow(
        lambda b: _assigned(b, centroids, to_pivots, scale), "vec_id bigint, cluster int, distance bigint"
    )
    return Clustering(rows, centroids, measured)


def with_inertia(result: Clustering) -> DataFrame:
    """Per vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    rows = keep(result.rows, "clusters")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    each = {r["cluster"]: int(r["d"]) for r in sums}  # one row per centroid
    whole = min(sum(each.values()), LONGEST)
    facts = [
        (j, min(d, LONGEST), whole, hashlib.sha256(",".join(map(str, result.centroids[j])).encode()).hexdigest())
        for j, d in sorted(each.items())
    ]
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    about = F.broadcast(rows.sparkSession.createDataFrame(facts, schema))  # at most k rows
    return rows.join(about, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )

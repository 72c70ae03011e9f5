"""Nearest neighbours by collision-counting hashing.

Every vector gets one coordinate more, so that all have one length and the largest inner product is
the smallest distance. Each hash function is a single projection, and its index a sorted array. The
directions come as whole orthogonal bases: over one basis the squared gaps add up to the squared
distance, so the count of collisions strays less than over directions drawn one by one.

A window around the query in every array stands for a radius: it reaches REACH times as far, and a
vector at that radius is expected to collide in most of the arrays. The places next to the query
in some arrays give a first bound for the k-th distance; virtual rehashing starts below it and widens
all windows by GROWTH. Vectors that have collided THRESHOLD of the times are verified at once, on the
original vectors in double precision. Once the radius has reached the k-th distance found, the threshold
goes down until it lies SPREADS standard deviations below the counts of the k nearest, which ends the
search. Wide windows are counted by what lies outside.

Vectors and queries are hashed into blocks, and every pair of blocks is one group: a stated query set
against all rows. Equal vectors of a block are indexed once, so copies do not fill up the candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.llm.store import keep
from tablewarden.llm.words import mix

PROJECTIONS = 128  # at least; rounded up to whole bases
REACH = 1.4
THRESHOLD = 0.83
SPREADS = 1.2  # standard deviations from the mean count of the nearest down to the threshold
GROWTH = 1.08
FIRST_ROUNDS = 3  # rounds between the first radius and the first bound
FIRST_VERIFIED = 64
BLOCK, QUERY_BLOCK = 16384, 4096

FOUND = "query_id bigint, query_row bigint, vec_id bigint, row bigint, score double"


def _directions(least: int, size: int) -> np.ndarray:
    """Fixed orthogonal bases side by side, scaled so that a gap is as large as the distance on average."""
    bases = -(-least // size)
    total = bases * size * size
    with np.errstate(over="ignore"):
        bits = mix(np.arange(1, 2 * total + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    unit = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    normal = np.sqrt(-2 * np.log(unit[:total])) * np.cos(2 * np.pi * unit[total:])  # Box-Muller
    return np.concatenate([np.linalg.qr(m)[0] for m in normal.reshape(bases, size, size)], axis=1) * np.sqrt(size)


class Index:
    """Sorted projections of different vectors, all of length ``norm`` after one more coordinate."""

    def __init__(self, vectors: np.ndarray, norm: float, projections: int = PROJECTIONS):
        rest = np.sqrt(np.maximum(norm**2 - (vectors**2).sum(axis=1), 0))
        self.vectors, self.norm, self.n = vectors, norm, len(vectors)
        self.directions = _directions(projections, vectors.shape[1] + 1)
        along = (np.concatenate([vectors, rest[:, None]], axis=1) @ self.directions).T
        self.order = np.argsort(along, axis=1, kind="stable").ravel()
        # All arrays in one: each lies a span further on, so that one search finds a place in every array.
        self.farthest = norm * np.sqrt(len(self.directions))
        self.shift = np.arange(len(along)) * (3 * self.farthest)
        self.sorted = (np.sort(along, axis=1) + self.shift[:, None]).ravel()
        self.begin = np.arange(len(along)) * self.n

    def _scores(self, places: np.ndarray, query: np.ndarray) -> np.ndarray:
        # Row by row, so that equal vectors have equal scores wherever they are.
        return (self.vectors[places] * query).sum(axis=1)

    def _places(self, along: np.ndarray) -> np.ndarray:
        """Where a number per array would be put, as places of ``order``."""
        inside = np.clip(along, -1.1 * self.farthest, 1.1 * self.farthest) + self.shift
        return np.clip(np.searchsorted(self.sorted, inside), self.begin, self.begin + self.n)

    def _windows(self, centre: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        return self._places(centre - REACH * radius), self._places(centre + REACH * radius)

    def _count(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """How often each vector lies in the ranges [first, last) of ``order``."""
        parts = [self.order[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True) if a < b]
        return np.bincount(np.concatenate(parts), minlength=self.n) if parts else np.zeros(self.n, np.int64)

    def search(self, query: np.ndarray, k: int, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the verified vectors, the ``k`` nearest found among them."""
        if self.n <= max(k, FIRST_VERIFIED):
            places = np.arange(self.n)
            return places, self._scores(places, query)
        scale = self.norm / np.sqrt((query**2).sum())
        centre = np.append(query * scale, 0.0) @ self.directions
        arrays, enough = len(centre), int(np.ceil(threshold * len(centre)))
        spread = -(-max(k, FIRST_VERIFIED) // arrays)
        near = np.clip(self._places(centre) - spread, self.begin, self.begin + self.n - 2 * spread)
        first = self.order[(near[:, None] + np.arange(2 * spread)).ravel()]
        _, at = np.unique(first, return_index=True)
        places = first[np.sort(at)][: max(k, FIRST_VERIFIED)]
        scores = self._scores(places, query)
        done = np.zeros(self.n, bool)
        done[places] = True

        def bound() -> float:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf
            return float(np.sqrt(max(2 * self.norm * (self.norm - scale * kth), 0)))

        kth = bound()
        radius = kth / GROWTH**FIRST_ROUNDS if np.isfinite(kth) else 2 * self.norm
        low, high = self._windows(centre, radius)
        end = self.begin + self.n
        if 2 * (high - low).sum() > arrays * self.n:
            met = arrays - self._count(np.concatenate([self.begin, high]), np.concatenate([low, end]))
        else:
            met = self._count(low, high)
        while True:
            new = np.flatnonzero((met >= enough) & ~done)
            done[new] = True
            places = np.concatenate([places, new])
            scores = np.concatenate([scores, self._scores(new, query)])
            kth = bound()
            if kth <= radius:
                # Directions suit one query better than another: the threshold must clear the counts of the k nearest.
                counts = met[places[np.argpartition(-scores, k - 1)[:k]]]
                if enough <= counts.mean() - SPREADS * counts.std():
                    return places, scores
                enough -= 1
                continue
            radius = min(radius * GROWTH, kth)
            before, after = low, high
            low, high = self._windows(centre, radius)
            met = met + self._count(np.concatenate([low, after]), np.concatenate([before, high]))


def _searcher(k: int, norms: dict[int, float], threshold: float, projections: int):
    def search(key, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found = [[], [], [], [], []]
        if len(vectors) and len(queries):
            size = key[0].as_py()
            flat = vectors["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            ids, rows = vectors["vec_id"].to_numpy(), vectors["row"].to_numpy()
            order = np.lexsort((rows, ids))
            ids, rows, table = ids[order], rows[order], flat.reshape(-1, size)[order]
            unique, group = np.unique(table, axis=0, return_inverse=True)
            group = group.ravel()
            by_group = np.argsort(group, kind="stable")  # ids stay in ascending order inside a group
            sizes = np.bincount(group, minlength=len(unique))
            begin = np.cumsum(sizes) - sizes
            index = Index(unique, norms[size], projections)
            asked = queries["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            keys = zip(queries["vec_id"].to_pylist(), queries["row"].to_pylist(), asked, strict=True)
            for query_id, query_row, query in keys:
                near, score = index.search(query, k + 1, threshold)
                kth = np.sort(score)[max(len(score) - k - 1, 0)]
                best = np.flatnonzero(score >= kth)
                each = np.minimum(sizes[near[best]], k + 1)  # more copies of one vector cannot be among the k
                at = np.repeat(begin[near[best]] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
                members, points = by_group[at], np.repeat(score[best], each)
                other = rows[members] != query_row
                members, points = members[other], points[other]
                top = np.lexsort((members, -points))[:k]  # members are in the order of ids and rows
                for column, values in zip(
                    found,
                    (np.full(len(top), query_id), np.full(len(top), query_row), ids[members[top]], rows[members[top]],
                     points[top]),
                    strict=True,
                ):
                    column.append(values)
        names = [c.split()[0] for c in FOUND.split(", ")]
        columns = [np.concatenate(c) if c else np.zeros(0) for c in found]
        kinds = [np.int64] * 4 + [np.float64]
        return pa.table({n: pa.array(c.astype(t)) for n, c, t in zip(names, columns, kinds, strict=True)})

    return search


def usable(embedding: Column) -> Column:
    """Not null, finite in every component, and not zero."""
    finite = F.forall(
        embedding,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    threshold: float = THRESHOLD,
    projections: int = PROJECTIONS,
    block: int = BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: per query the ``k`` found with the largest inner product.

    Ties go to the smaller vec_id. Null, zero and non-finite vectors and rows without vec_id take no
    part. Rows that repeat a vec_id are rows like others: each may be found, by one another too, and each
    query among them has its own ranks. Only vectors of one length are compared, other columns are left
    out, and an empty table has no result. ``is_query`` is a condition on ``vec_id``.
    """
    usable_rows = (
        vectors.select(
            F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
        )
        .filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        .withColumn("size", F.size("embedding"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    rows = keep(usable_rows, "neighbour-rows")  # so that rows keep their numbers
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    # One row per length of vector.
    stats = rows.groupBy("size").agg(
        F.max(squares).alias("square"),
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(is_query, F.lit(1))).alias("queries"),
    ).collect()
    norms = {r["size"]: float(np.sqrt(r["square"])) * (1 + 1e-9) for r in stats}

    def blocks(column: str, each: int) -> Column:
        count = F.lit(1)
        for r in stats:
            count = F.when(F.col("size") == r["size"], F.lit(max(1, -(-r[column] // each)))).otherwise(count)
        return count

    data_blocks, query_blocks = blocks("n", block), blocks("queries", query_block)
    data = rows.select(
        "size",
        F.pmod(F.xxhash64("row"), data_blocks).cast("int").alias("data_block"),
        F.explode(F.sequence(F.lit(0), query_blocks - 1)).alias("query_block"),
        "vec_id",
        "row",
        "embedding",
    )
    asked = rows.filter(is_query).select(
        "size",
        F.explode(F.sequence(F.lit(0), data_blocks - 1)).alias("data_block"),
        F.pmod(F.xxhash64(F.lit(1), "row"), query_blocks).cast("int").alias("query_block"),
        "vec_id",
        "row",
        "embedding",
    )
    keys = ["size", "data_block", "query_block"]
    found = (
        data.groupBy(*keys)
        .cogroup(asked.groupBy(*keys))
        .applyInArrow(_searcher(k, norms, threshold, projections), FOUND)
    )
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )

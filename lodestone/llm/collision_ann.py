"""Approximate nearest neighbours by collision counting.

Every vector is projected on single directions, and each projection keeps its vectors sorted.  A
query opens a window around its own projection in every sorted array; windows widen together with
the radius (virtual rehashing), so no array is built twice.  A vector that falls into enough windows
is verified by its exact distance.  Once ``k`` are verified, the windows widen to the radius at which
any vector as near as the k-th collides often enough, by a margin of standard deviations, and no further.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """``half_width`` x radius is half a window; at distance = radius a vector is in a window with probability 0.5.

    ``share`` of the projections must collide; a vector as near as the k-th found is expected to collide
    ``margin`` standard deviations more often than that when the search ends.  Radii start at ``first_radius``
    of the median distance at which ``pilots`` vectors of a block have their k-th neighbour there, and grow by
    ``growth``.  ``block`` vectors are indexed and ``query_block``
    queries answered by one group of rows.
    """

    k: int = 10
    projections: int = 160
    half_width: float = 0.6745
    share: float = 0.70
    margin: float = 1.0
    growth: float = 1.15
    first_radius: float = 0.5
    pilots: int = 32
    block: int = 8192
    query_block: int = 1024
    seed: int = 5


def usable(vector: Column) -> Column:
    """True for vectors that are not null, empty or zero and hold finite numbers only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def directions(dim: int, s: Settings) -> np.ndarray:
    """Stacked random rotations (rows), scaled so that the mean squared difference of projections is the squared distance."""
    rng, rows = np.random.Generator(np.random.PCG64([s.seed, dim])), []
    while sum(map(len, rows)) < max(s.projections, 1):
        rows.append(np.linalg.qr(rng.standard_normal((dim, dim)))[0])
    return np.vstack(rows)[: max(s.projections, 1)] * math.sqrt(dim)


class SortedProjections:
    """The index of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, s: Settings):
        self.ids, self.vectors, self.s = ids, vectors, s
        self.turn = directions(vectors.shape[1], s)
        projected = vectors @ self.turn.T
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy()
        values = np.sort(projected, axis=0).T
        self.apart = 4 * float(np.abs(values).max(initial=1.0))  # the sorted arrays follow each other in one, shifted so far
        self.shift = np.arange(len(self.turn)) * self.apart
        self.flat = (values + self.shift[:, None]).ravel()
        self.least = max(1, int(len(self.turn) * s.share))
        sure = min(s.share + s.margin * math.sqrt(s.share * (1 - s.share) / len(self.turn)), 1 - 1e-6)
        self.reach = NormalDist().inv_cdf((1 + sure) / 2) / s.half_width  # radius in distances of the k-th vector
        self.verified = 0  # distances computed so far
        spread = max(float(np.abs(vectors).max(initial=0.0)) * math.sqrt(vectors.shape[1]), 1e-300)
        self.unit = max(self.typical() * s.first_radius, spread * 0.01)
        self.steps = 2 + int(math.log(max(4 * self.reach * spread / self.unit, 1.0)) / math.log(s.growth))

    def typical(self) -> float:
        """The median distance to the k-th neighbour of a few vectors, evenly picked; 0 if there are not so many."""
        n, k = len(self.ids), self.s.k
        if n <= k:
            return 0.0
        some = self.vectors[np.linspace(0, n - 1, min(n, self.s.pilots)).astype(int)]
        square = (self.vectors**2).sum(axis=1)
        d = np.partition((some**2).sum(axis=1)[:, None] + square - 2 * (some @ self.vectors.T), k, axis=1)[:, k]
        return math.sqrt(max(float(np.median(d)), 0.0))

    def search(self, own: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of up to k nearest, without the vector whose id is ``own``."""
        s, n = self.s, len(self.ids)
        at = self.turn @ query
        radii = self.unit * s.growth ** np.arange(self.steps)

        first = np.arange(len(at)) * n

        def windows(some) -> tuple[np.ndarray, np.ndarray]:
            """Places in each sorted array where the windows of these radii begin and end."""
            half = np.minimum(s.half_width * np.atleast_1d(some), self.apart / 4)
            middle = (np.clip(at, -self.apart / 4, self.apart / 4) + self.shift)[:, None]
            return tuple(np.searchsorted(self.flat, middle + sign * half, side) - first[:, None] for sign, side in ((-1, "left"), (1, "right")))

        counts, seen = np.zeros(n, np.int32), self.ids == own
        found, distance = np.zeros(0, np.int64), np.zeros(0)
        left = right = windows(0.0)[0][:, 0]

        def widen(to_left: np.ndarray, to_right: np.ndarray, every: bool = False) -> float:
            """Count the collisions of wider windows, verify, and say at which radius the k-th vector found is sure to have collided."""
            nonlocal left, right, found, distance
            new = [o[a:b] for o, a, b in zip(self.order, to_left, left, strict=True) if a < b]
            new += [o[a:b] for o, a, b in zip(self.order, right, to_right, strict=True) if a < b]
            left, right = to_left, to_right
            if new:
                np.add(counts, np.bincount(np.concatenate(new), minlength=n), out=counts, casting="unsafe")
            fresh = np.flatnonzero(~seen if every else (counts >= self.least) & ~seen)
            if len(fresh):
                seen[fresh] = True
                found = np.concatenate([found, fresh])
                distance = np.concatenate([distance, np.sqrt(((self.vectors[fresh] - query) ** 2).sum(axis=1))])
            return np.partition(distance, s.k - 1)[s.k - 1] * self.reach if len(distance) >= s.k else math.inf

        for step in range(self.steps):
            if step % 8 == 0:
                low, high = windows(radii[step : step + 8])
            wanted = widen(low[:, step % 8], high[:, step % 8])
            if wanted <= radii[step] or seen.all():
                break
            if step + 1 < self.steps and wanted < radii[step + 1]:
                widen(*(side[:, 0] for side in windows(wanted)))
                break
        else:  # every window is full: verify what is left
            widen(left, right, every=True)
        self.verified += len(found)
        best = np.lexsort((self.ids[found], distance))[: s.k]
        return self.ids[found[best]], distance[best]


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", settings: Settings | None = None) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the ``k`` nearest rows of ``vectors`` found for each row of ``queries``.

    Score is the Euclidean distance in double precision; ties go to the smaller id.  A row with the
    query's id is not its candidate.  Unusable vectors (see :func:`usable`), null ids and vectors of
    another length than the query's take no part; with fewer candidates than ``k`` all are returned.
    Rows that share an id are separate candidates.  Blocks of vectors meet blocks of queries in
    separate groups, so neither side is gathered or broadcast, and every pair of blocks is searched
    through its own index.
    """
    s = settings or Settings()

    def clean(df: DataFrame) -> DataFrame:
        own = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        return own.where(F.col("id").isNotNull() & usable(F.col("v")))

    data, asked = clean(vectors), clean(queries)
    blocks, query_blocks = max(1, -(-data.count() // s.block)), max(1, -(-asked.count() // s.query_block))
    left = data.withColumns({"b": F.pmod(F.xxhash64("id", "v"), F.lit(blocks)), "q": F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<long>"))})
    right = asked.withColumns({"q": F.pmod(F.xxhash64("id", "v"), F.lit(query_blocks)), "b": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))})
    cells = [x.withColumn("d", F.size("v")).groupBy("b", "q", "d") for x in (left, right)]

    def match(key_, rows, asks):
        out = [[], [], []]
        if rows.num_rows and asks.num_rows:
            dim = key_[2].as_py()
            x, y = (np.array(t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim) for t in (rows, asks))
            index = SortedProjections(rows.column("id").to_numpy(), x, s)
            for own, query in zip(asks.column("id").to_pylist(), y, strict=True):
                ids, distance = index.search(own, query)
                out[0] += [own] * len(ids)
                out[1] += ids.tolist()
                out[2] += distance.tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    near = cells[0].cogroup(cells[1]).applyInArrow(match, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")

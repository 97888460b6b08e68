"""Neighbour graphs built from neighbours of neighbours, and the choice of diverse edges.

A graph starts from the nearest rows inside blocks that random hyperplanes deal out.  Then, round by
round, the rows around each row (its neighbours and those that have it as a neighbour) are compared with
each other, and each keeps the best of what it is offered.  A round's work is a bounded number of
comparisons for each row; rounds end when few edges change.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.functions.blocks import largest, matrix
from lodestone.functions.stored import stored
from lodestone.operators.nearest import DECIMALS, ranked, with_group

BUCKET_ROWS = 256  # rows whose surroundings a task compares in one call
SAMPLE = 10_000  # rows on which the middles of projections are estimated


def _in_blocks(unit: DataFrame, count: int, pool: int, block: int, seed: int) -> DataFrame:
    """(src, dst, score): the ``pool`` best within blocks of rows on the same sides of random hyperplanes.

    A side's border is the middle of a sample of at most about ``SAMPLE`` rows.  A block that is too large
    (copies of one vector, say) is dealt into several by a hash.
    """
    planes = max(0, math.ceil(math.log2(max(1.0, count / block))))
    share = min(1.0, SAMPLE / max(1, count))
    some = matrix(unit.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) <= F.lit(int(share * (1 << 20)))).select("vector").toArrow().column("vector"))
    normals = np.random.default_rng(seed).standard_normal((some.shape[1], planes)) if len(some) else np.zeros((1, 0))
    borders = np.median(some @ normals, axis=0) if planes and len(some) else np.zeros(planes)

    def sides(batches):
        for batch in batches:
            if batch.num_rows:
                bits = (matrix(batch.column(1)) @ normals > borders) if planes else np.zeros((batch.num_rows, 0), bool)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits @ (1 << np.arange(planes, dtype=np.int64)))], names=["id", "vector", "cell"])

    celled = unit.mapInArrow(sides, "id long, vector array<double>, cell long")
    sizes = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (2 * block)).cast("int").alias("parts"))
    dealt = with_group(celled, sizes, ["cell"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("parts")).cast("int"))

    def compare(key, table):
        table = table.sort_by("id")
        ids, x = table.column("id").to_numpy(), matrix(table.column("vector"))
        out = []
        for first in range(0, len(x), 1024):
            score = np.round(x[first : first + 1024] @ x.T, DECIMALS)
            score[np.arange(len(score)), np.arange(first, first + len(score))] = -np.inf
            row, at = largest(score, pool)
            out.append((ids[first + row], ids[at], score[row, at]))
        return pa.table({n: np.concatenate(v) for n, v in zip(("src", "dst", "score"), zip(*out, strict=True), strict=True)})

    return dealt.groupBy("cell", "part").applyInArrow(compare, "src long, dst long, score double")


def _offers(edges: DataFrame, unit: DataFrame, count: int, pool: int) -> DataFrame:
    """(src, dst, score): what rows around the same row offer each other, if it is no worse than the worst that a row has.

    Around a row are its neighbours and the ``pool`` best that have it as one.  Two that were both there
    in the round before are not compared again.  Of one row's surroundings another takes ``pool`` at most.
    """
    back = ranked(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score", "fresh"), ["src"], [F.desc("score"), "dst"], pool).drop("rank")
    around = edges.select("src", "dst", "fresh").union(back.select("src", "dst", "fresh")).groupBy("src", "dst").agg(F.max("fresh").alias("fresh"))
    worst = edges.groupBy(F.col("src").alias("id")).agg(F.when(F.count(F.lit(1)) >= pool, F.min("score")).otherwise(F.lit(-2.0)).alias("worst"))
    known = unit.join(worst, "id", "left").select(F.col("id").alias("dst"), "vector", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
    bucket = F.pmod(F.xxhash64("src"), F.lit(max(1, -(-count // BUCKET_ROWS)))).cast("int").alias("bucket")
    full = around.join(known, "dst").select(bucket, "src", "dst", "fresh", "vector", "worst")

    def exchange(key, table):
        table = table.sort_by([("src", "ascending"), ("dst", "ascending")])
        src, ids, worst, fresh, x = table.column("src").to_numpy(), table.column("dst").to_numpy(), table.column("worst").to_numpy(), np.asarray(table.column("fresh")).astype(bool), matrix(table.column("vector"))
        cuts = [0, *(np.flatnonzero(src[1:] != src[:-1]) + 1).tolist(), len(src)]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            new = fresh[a:b]
            if b - a < 2 or not new.any():
                continue
            score = np.round(x[a:b] @ x[a:b].T, DECIMALS)
            score[~(new[:, None] | new)] = -np.inf
            np.fill_diagonal(score, -np.inf)
            score[score < worst[a:b, None]] = -np.inf
            row, at = largest(score, pool)
            out.append((ids[a:b][row], ids[a:b][at], score[row, at]))
        if not out:
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        s, d, v = (np.concatenate(c) for c in zip(*out, strict=True))
        order = np.lexsort((d, s))
        s, d, v = s[order], d[order], v[order]
        first = np.r_[True, (s[1:] != s[:-1]) | (d[1:] != d[:-1])]
        return pa.table({"src": s[first], "dst": d[first], "score": v[first]})

    return full.groupBy("bucket").applyInArrow(exchange, "src long, dst long, score double")


def neighbour_graph(rows: DataFrame, m: int, pool: int = 40, block: int = 512, deals: int = 2, rounds: int = 12, still: float = 0.002, seed: int = 1) -> DataFrame:
    """(src, dst, ordinal, score): about the ``m`` nearest other rows, by cosine, of each row of (id, vector).

    ``pool`` neighbours are held while the graph is built; recall grows with it.  Rounds end when fewer than
    ``still`` of the edges are new, or after ``rounds``.  State is written each round, so a lost executor
    costs a round at most.  Recall is measured, not promised.  Ids are distinct, vectors not null.
    """
    pool = max(pool, m)
    unit = stored(rows.select(F.col("id").cast("long").alias("id"), V.normalized(F.col("vector")).alias("vector")), "unit")
    count = unit.count()
    order = [F.desc("score"), F.asc("dst")]
    begun = _in_blocks(unit, count, pool, block, seed)
    for deal in range(1, deals if count > block else 1):
        begun = begun.union(_in_blocks(unit, count, pool, block, seed + deal))
    edges = stored(ranked(begun.distinct(), ["src"], order, pool).drop("rank").withColumn("fresh", F.lit(True)), "edges")
    for _ in range(rounds if count > block else 0):  # up to a block all rows have met
        offered = _offers(edges, unit, count, pool).withColumn("old", F.lit(False))
        both = edges.select("src", "dst", "score", F.lit(True).alias("old")).union(offered).groupBy("src", "dst").agg(F.max("score").alias("score"), F.max("old").alias("old"))
        edges = stored(ranked(both, ["src"], order, pool).select("src", "dst", "score", (~F.col("old")).alias("fresh")), "edges")
        if edges.where("fresh").count() <= still * count * pool:
            break
    return ranked(edges, ["src"], order, m, "ordinal").select("src", "dst", "ordinal", "score")


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, numbers added in order: the same numbers give the same bits, so equal distances compare as equal."""
    total = np.zeros(len(a))
    for n in range(a.shape[1]):
        total += a[:, n] * b[..., n]
    return total


def select_diverse(candidates: DataFrame, rows: DataFrame, m: int) -> DataFrame:
    """(src, dst, ordinal): of (src, dst, ordinal), nearest first, those nearer to ``src`` than to any kept before; at most ``m``.

    A row has a bounded number of candidates: an argument of the caller.
    """
    vectors = rows.select("id", V.normalized(F.col("vector")).alias("vector"))
    full = candidates.select("src", "dst", "ordinal").join(vectors.select(F.col("id").alias("src"), F.col("vector").alias("a")), "src").join(vectors.select(F.col("id").alias("dst"), F.col("vector").alias("b")), "dst")
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4)
    bucket = F.pmod(F.xxhash64("src"), F.lit(parts)).cast("int").alias("bucket")

    def pick(batches):
        """Rows of one source stand together; a source that goes beyond a batch waits for the rest."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            src = table.column("src").to_numpy()
            cut = int(np.flatnonzero(src != src[-1])[-1]) + 1 if len(src) and (src != src[-1]).any() else 0
            if cut:
                yield chosen(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held and (table := pa.Table.from_batches(held)).num_rows:
            yield chosen(table)

    def chosen(table: pa.Table) -> pa.RecordBatch:
        src, dst, own, near = table.column("src").to_numpy(), table.column("dst").to_numpy(), matrix(table.column("a")), matrix(table.column("b"))
        to_own = 1 - in_order(own, near)
        cuts = [0, *(np.flatnonzero(src[1:] != src[:-1]) + 1).tolist(), len(src)]
        at: list[int] = []
        ordinal: list[int] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            kept: list[int] = []
            able = np.ones(b - a, bool)  # not nearer to any kept than to the source
            for c in range(b - a):
                if len(kept) == m:
                    break
                if able[c]:
                    kept.append(c)
                    able &= 1 - in_order(near[a:b], near[a + c]) >= to_own[a:b]
            at += [a + c for c in kept]
            ordinal += range(len(kept))
        return pa.RecordBatch.from_arrays([pa.array(src[at]), pa.array(dst[at]), pa.array(ordinal, pa.int32())], names=["src", "dst", "ordinal"])

    together = full.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("src", "ordinal", "dst").select("src", "dst", "a", "b")
    return together.mapInArrow(pick, "src long, dst long, ordinal int")


def capped_both_ways(edges: DataFrame, rows: DataFrame, cap: int, considered: int | None = None) -> DataFrame:
    """(src, dst, ordinal): every edge (src, dst, score) both ways; rows over ``cap`` choose again by :func:`select_diverse`.

    A row over the cap chooses among its ``considered`` best edges (four times the cap by default), so a row
    that very many have as a neighbour is a bounded group.  Other rows keep all their edges.
    """
    considered = considered or 4 * cap
    both = edges.select("src", "dst", "score").union(edges.select("dst", "src", "score")).distinct()
    best = stored(ranked(both, ["src"], [F.desc("score"), "dst"], considered, "ordinal"), "both")
    over = best.where(F.col("ordinal") == cap).select("src")
    kept = best.join(over, "src", "left_anti").select("src", "dst", F.col("ordinal").cast("int").alias("ordinal"))
    return kept.union(select_diverse(best.join(over, "src", "left_semi"), rows, cap))

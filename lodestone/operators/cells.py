"""Top-k search in a two-level index of cells with byte codes.

Vectors of unit length lie in cells around centres.  A cell keeps the largest distance of its members to
the centre, so by the triangle inequality no member scores more than ``query . centre + radius``: a cell
that cannot beat the k-th hit is not visited.  Members are kept as bytes with the error of their code;
a product of codes bounds the true score from both sides, and only vectors whose upper bound reaches the
k-th lower bound are read and scored exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.functions.blocks import byte_codes, centres_of, code_products, largest, lists, matrix, nearest_centre
from lodestone.functions.stored import stored
from lodestone.operators.nearest import DECIMALS, ranked

UNIT_ROWS = 16_384  # members that are compared with queries at once
TOP_ROWS = 50_000  # members of an upper cell that are placed at once
LEAVES, PIECES = 4096, 1 << 20  # leaves of an upper cell and units of it are numbered below these
QUERY_ROWS = 16_384  # queries that meet a unit at once
SLACK = 1e-6  # for rounding, in bounds


@dataclass
class CellIndex:
    """``tops``: centres and radii of the upper level, at most ``most_tops`` of them; ``leaves`` and ``rows`` are tables.

    leaves (leaf, top, centre, radius, n, chunks), rows (leaf, unit, id, codes, step, error, vector).  An upper cell's
    rows lie in as many units as ``pieces`` says.
    """

    tops: np.ndarray
    top_radius: np.ndarray
    leaves: DataFrame
    rows: DataFrame
    units: int
    count: int
    pieces: dict[int, int]


def build_cells(vectors: DataFrame, leaf_rows: int = 64, sample: int = 50_000, most_tops: int = 1024, seed: int = 1) -> CellIndex:
    """Index (id, vector) in cells of about ``leaf_rows`` members.

    Centres are fitted on samples: the upper ones on at most about ``sample`` rows, on the driver, those
    of each upper cell on about 16 rows a leaf, at most 32,768, in a task.  Every row is placed.  Ids are
    distinct, vectors neither null nor of different lengths; a zero vector stays zero; no rows give no hits.
    """
    unit = stored(vectors.select(F.col("id").cast("long").alias("id"), V.normalized(F.col("vector")).alias("vector")), "unit")
    count = unit.count()
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20))
    part = unit.where(draw < F.lit(max(1, int(min(1.0, sample / max(1, count)) * (1 << 20))))).select("vector")
    points = matrix(part.toArrow().column("vector"))
    if not len(points):
        points = matrix(unit.limit(1).select("vector").toArrow().column("vector"))
    wide = points.shape[1] if len(points) else 1
    tops = centres_of(points, max(1, min(most_tops, round((count / leaf_rows) ** 0.5))), np.random.default_rng(seed)) if len(points) else np.zeros((0, wide))

    def to_top(batches):
        for batch in batches:
            if batch.num_rows:
                at, far = nearest_centre(matrix(batch.column(1)), tops)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(far)], names=["id", "vector", "top", "top_far"])

    placed = stored(unit.mapInArrow(to_top, "id long, vector array<double>, top int, top_far double"), "tops")
    sizes = {r["top"]: (r["n"], r["far"]) for r in placed.groupBy("top").agg(F.count(F.lit(1)).alias("n"), F.max("top_far").alias("far")).collect()}  # a row for each upper cell
    most = {t: max(1, min(2048, round(n / leaf_rows))) for t, (n, _) in sizes.items()}
    share = {t: min(1.0, 16 * most[t] / n, 32_768 / n) for t, (n, _) in sizes.items()}
    salts = {t: -(-n // TOP_ROWS) for t, (n, _) in sizes.items()}

    def by_top(values: dict, kind: str):
        items = [F.lit(x) for item in values.items() for x in item]
        return F.element_at(F.create_map(*items), F.col("top")).cast(kind) if items else F.lit(1).cast(kind)

    def fit(key, table):
        top = key[0].as_py()
        found = centres_of(matrix(table.sort_by("id").column("vector")), most[top], np.random.default_rng(seed + top), 4)
        n = len(found)
        return pa.table({"top": pa.array([top] * n, pa.int32()), "slot": pa.array(range(n), pa.int32()), "centre": lists(found)})

    chosen = placed.where(F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1 << 20)) <= by_top({t: int(s * (1 << 20)) for t, s in share.items()}, "long"))
    slots = stored(chosen.select("top", "id", "vector").groupBy("top").applyInArrow(fit, "top int, slot int, centre array<double>"), "slots")
    dealt = placed.select("top", F.pmod(F.xxhash64("id"), by_top(salts, "int")).cast("int").alias("salt"), "id", "vector")
    centres = slots.withColumn("salt", F.explode(F.sequence(F.lit(0), by_top(salts, "int") - 1)))

    def to_leaf(key, members, own):
        top = key[0].as_py()
        x = matrix(members.column("vector"))
        if not len(x):
            return pa.table({n: pa.array([], t) for n, t in (("top", pa.int32()), ("slot", pa.int32()), ("id", pa.int64()), ("far", pa.float64()), ("codes", pa.binary()), ("step", pa.float64()), ("error", pa.float64()), ("vector", pa.list_(pa.float64())))})
        own = own.sort_by("slot")
        grid = matrix(own.column("centre")) if own.num_rows else tops[[top]]
        at, far = nearest_centre(x, grid)
        codes, step, error = byte_codes(x)
        return pa.table({
            "top": pa.array(np.full(len(x), top), pa.int32()), "slot": pa.array(at.astype(np.int32)), "id": members.column("id"), "far": far,
            "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "step": step, "error": error, "vector": members.column("vector"),
        })

    pieces = {t: -(-n // UNIT_ROWS) for t, (n, _) in sizes.items()}
    leaf = (F.col("top").cast("long") * LEAVES + F.col("slot")).alias("leaf")
    made = dealt.groupBy("top", "salt").cogroup(centres.groupBy("top", "salt")).applyInArrow(to_leaf, "top int, slot int, id long, far double, codes binary, step double, error double, vector array<double>")
    members = stored(made.select("top", "slot", leaf, "id", "far", "codes", "step", "error", "vector"), "members")
    stats = members.groupBy("leaf", "top", "slot").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n"))
    chunks = by_top(pieces, "int")
    leaves = stats.join(slots, ["top", "slot"], "left").select("leaf", "top", F.coalesce("centre", F.array(*[F.lit(0.0)] * wide)).alias("centre"), "radius", "n", chunks.alias("chunks"))
    rows = members.select("leaf", _unit(F.col("leaf"), F.pmod(F.xxhash64("id"), chunks)).alias("unit"), "id", "codes", "step", "error", "vector")
    radius = np.array([sizes.get(t, (0, 0.0))[1] for t in range(len(tops))])
    return CellIndex(tops, radius, stored(leaves, "leaves"), rows, max(1, sum(pieces.values())), count, pieces)


def _unit(leaf, chunk):
    """Members meet queries in units of about ``UNIT_ROWS``: the rows of an upper cell, dealt over several if there are more."""
    return F.floor(leaf / LEAVES).cast("long") * PIECES + chunk


def _with_tops(queries: DataFrame, index: CellIndex, first: int | None, units: bool = False) -> DataFrame:
    """(query_id, vector, floor, cut, top): the upper cells of which a member can reach a query's floor; with ``units`` top is a unit.

    With ``first`` only as many upper cells, nearest first, as hold four times so many leaves.
    """
    counts = {r["top"]: r["n"] for r in index.leaves.groupBy("top").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = np.array([counts.get(t, 0) for t in range(len(index.tops))])
    pieces = np.array([index.pieces.get(t, 0) for t in range(len(index.tops))], np.int64)
    tops, radius = index.tops, index.top_radius

    def to_tops(batches):
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            x = matrix(batch.column(1))
            if not len(x) or not len(tops):
                continue
            near = x @ tops.T
            order = np.argsort(-near, axis=1, kind="stable")
            before = np.cumsum(size[order], axis=1) - size[order]
            able = np.take_along_axis(near + radius, order, axis=1) + SLACK >= batch.column(2).to_numpy()[:, None]
            row, place = np.nonzero(able & ((before < 4 * first) if first else True))
            top = order[row, place]
            if units:
                row, top, times = np.repeat(row, pieces[top]), np.repeat(top, pieces[top]), pieces[top]
                top = top * PIECES + np.arange(len(top)) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row)) for k in range(4)), pa.array(top.astype(np.int64))], names=["query_id", "vector", "floor", "cut", "top"])

    cut = F.col("cut") if "cut" in queries.columns else F.lit(-2.0).alias("cut")
    return queries.select("query_id", "vector", "floor", cut).mapInArrow(to_tops, "query_id long, vector array<double>, floor double, cut double, top long")


def cell_bounds(queries: DataFrame, index: CellIndex, first: int | None = None) -> DataFrame:
    """(query_id, leaf, chunks, n, floor, most): leaves by the score of their centres, with the most that a member can score.

    ``queries`` is (query_id, vector, floor) of unit vectors.  Upper cells and leaves of which no member can
    reach a query's floor are left out where they are compared.  With ``first`` a query sees only that many
    leaves, taken from as many upper cells, nearest first, as hold four times so many; else all that are left.
    """
    salted = _with_tops(queries, index, first).withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(8)).cast("int"))
    leaves = index.leaves.withColumns({"top": F.col("top").cast("long"), "salt": F.explode(F.sequence(F.lit(0), F.lit(7)))})
    empty = {"query_id": pa.int64(), "leaf": pa.int64(), "chunks": pa.int32(), "n": pa.int64(), "floor": pa.float64(), "near": pa.float64(), "most": pa.float64()}

    def score(key, asked, own):
        if not asked.num_rows or not own.num_rows:
            return pa.table({n: pa.array([], t) for n, t in empty.items()})
        own = own.sort_by("leaf")
        near = matrix(asked.column("vector")) @ matrix(own.column("centre")).T
        most = near + own.column("radius").to_numpy()
        able = np.where(most + SLACK >= asked.column("floor").to_numpy()[:, None], near, -np.inf)
        row, at = np.nonzero(np.isfinite(able)) if first is None else largest(able, first)
        take = pa.array(at)
        return pa.table({"query_id": asked.column("query_id").take(pa.array(row)), **{c: own.column(c).take(take) for c in ("leaf", "chunks", "n")}, "floor": asked.column("floor").take(pa.array(row)), "near": near[row, at], "most": most[row, at]})

    found = salted.groupBy("top", "salt").cogroup(leaves.groupBy("top", "salt")).applyInArrow(score, "query_id long, leaf long, chunks int, n long, floor double, near double, most double")
    if first is None:
        return found.drop("near")
    return ranked(found, ["query_id"], [F.desc("near"), "leaf"], first, "place").drop("near", "place")


def code_candidates(queries: DataFrame, visits: DataFrame, index: CellIndex, k: int, other: bool = False) -> DataFrame:
    """(query_id, id, low, high) of the members of visited leaves (query_id, leaf, chunks, floor) that may be among the k best.

    ``low`` and ``high`` bound the score.  A member goes if its ``high`` is under ``floor`` or under the k-th
    ``low`` of its leaf.  Only codes are read.
    """
    sent = visits.join(queries.select("query_id", "vector"), "query_id").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    sent = sent.select(_unit(F.col("leaf"), F.col("chunk")).alias("unit"), "leaf", "query_id", "vector", "floor")
    members = index.rows.select("unit", "leaf", "id", "codes", "step", "error")
    empty = {"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "low": pa.array([], pa.float64()), "high": pa.array([], pa.float64())}

    def compare(key, asked, own):
        if not asked.num_rows or not own.num_rows:
            return pa.table(empty)
        asked, own = (t.sort_by([("leaf", "ascending"), (c, "ascending")]) for t, c in ((asked, "query_id"), (own, "id")))
        pair = np.stack([asked.column("leaf").to_numpy(), asked.column("query_id").to_numpy()])
        asked = asked.take(pa.array(np.flatnonzero(np.r_[True, (pair[:, 1:] != pair[:, :-1]).any(axis=0)])))  # two chunks of a leaf in one unit
        x = matrix(asked.column("vector"))
        q_codes, q_step, q_error = byte_codes(x)
        q_size = np.linalg.norm(x, axis=1)
        codes = np.frombuffer(b"".join(own.column("codes").to_pylist()), np.int8).reshape(own.num_rows, -1)
        step, error, ids = (own.column(c).to_numpy() for c in ("step", "error", "id"))
        qid, floor = asked.column("query_id").to_numpy(), asked.column("floor").to_numpy()
        q_leaf, leaf = asked.column("leaf").to_numpy(), own.column("leaf").to_numpy()
        out: list[list[np.ndarray]] = [[], [], [], []]
        for number in np.unique(q_leaf):
            mine = slice(*np.searchsorted(leaf, [number, number + 1]))
            theirs = np.arange(*np.searchsorted(q_leaf, [number, number + 1]))
            if mine.start == mine.stop:
                continue
            for part in np.array_split(theirs, -(-len(theirs) // 512)):
                score = code_products(q_codes[part], codes[mine]) * (q_step[part][:, None] * step[mine])
                # q . x - q^ . x^ = q . (x - x^) + (q - q^) . x^, and x^ is no longer than 1 + error
                spread = q_size[part][:, None] * error[mine] + q_error[part][:, None] * (1 + error[mine]) + SLACK
                if other:
                    score = np.where(qid[part][:, None] == ids[mine], -np.inf, score)
                low = score - spread
                least = floor[part] - SLACK
                if low.shape[1] >= k:
                    least = np.maximum(least, np.partition(low, -k, axis=1)[:, -k])
                row, at = np.nonzero((score + spread >= least[:, None]) & np.isfinite(score))
                for values, more in zip(out, (qid[part][row], ids[mine][at], low[row, at], (score + spread)[row, at]), strict=True):
                    values.append(more)
        return pa.table(dict(zip(empty, (np.concatenate(v) if v else pa.array([], empty[n].type) for n, v in zip(empty, out, strict=True)), strict=True)))

    return sent.groupBy("unit").cogroup(members.groupBy("unit")).applyInArrow(compare, "query_id long, id long, low double, high double")


def _floors(candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, floor): the k-th largest lower bound, for queries with k candidates."""
    return ranked(candidates, ["query_id"], [F.desc("low"), "id"], k).groupBy("query_id").agg(F.count(F.lit(1)).alias("m"), F.min("low").alias("floor")).where(F.col("m") == k).drop("m")


def search_cells(queries: DataFrame, index: CellIndex, k: int, probes: int | float | None = None, first: int = 4, other: bool = False) -> DataFrame:
    """(query_id, rank from 0, id, score) of each query's ``k`` nearest by cosine among the members of the cells it visits.

    Ties go to the smaller id.  ``probes``: so many cells, or such a share of them, nearest first; None: every
    cell that the triangle inequality does not rule out, which gives the exact ranking.  The ``first`` cells are
    visited before the others, whose bounds must then reach the k-th hit.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), V.normalized(F.col("vector")).alias("vector"))
    found = candidates(asked, index, k, probes, first, other)
    return _exact(asked, found, index, k)


def candidates(asked: DataFrame, index: CellIndex, k: int, probes: int | float | None, first: int, other: bool) -> DataFrame:
    """(query_id, id): the vectors that :func:`search_cells` reads in full."""
    limit = max(1, round(probes * index.leaves.count())) if isinstance(probes, float) else probes
    near = stored(cell_bounds(asked.withColumn("floor", F.lit(-2.0)), index, min(first, limit or first)), "near")
    begun = code_candidates(asked, near, index, k, other)
    floors = stored(_floors(begun, k), "floors")
    bounded = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    if limit is not None:
        bounded = bounded.join(leaf_cuts(bounded, index, limit), "query_id", "left").withColumn("cut", F.coalesce("cut", F.lit(-2.0)))
    found = stored(unit_candidates(bounded, index, k, limit, other), "found")
    return found.join(_floors(found, k), "query_id", "left").where(F.col("floor").isNull() | (F.col("high") >= F.col("floor"))).select("query_id", "id")


def leaf_cuts(queries: DataFrame, index: CellIndex, limit: int) -> DataFrame:
    """(query_id, cut): the score of the centre of the ``limit``-th nearest leaf that can reach a query's floor (query_id, vector, floor).

    A leaf is a number in an array, not a row; queries with fewer leaves are left out.
    """
    salted = _with_tops(queries, index, limit).withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(8)).cast("int"))
    leaves = index.leaves.withColumns({"top": F.col("top").cast("long"), "salt": F.explode(F.sequence(F.lit(0), F.lit(7)))})

    def score(key, asked, own):
        if not asked.num_rows or not own.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "near": pa.array([], pa.list_(pa.float32()))})
        own = own.sort_by("leaf")
        near = matrix(asked.column("vector")) @ matrix(own.column("centre")).T
        able = near + own.column("radius").to_numpy() + SLACK >= asked.column("floor").to_numpy()[:, None]
        return pa.table({"query_id": asked.column("query_id"), "near": pa.array([n[a].astype(np.float32) for n, a in zip(near, able, strict=True)], pa.list_(pa.float32()))})

    parts = salted.groupBy("top", "salt").cogroup(leaves.groupBy("top", "salt")).applyInArrow(score, "query_id long, near array<float>")
    near = F.sort_array(F.flatten(F.collect_list("near")), False)
    return parts.groupBy("query_id").agg(F.get(near, F.lit(limit - 1)).cast("double").alias("cut")).where("cut IS NOT NULL").withColumn("cut", F.col("cut") - SLACK / 10)


def unit_candidates(queries: DataFrame, index: CellIndex, k: int, limit: int | None = None, other: bool = False) -> DataFrame:
    """(query_id, id, low, high) of the members that may be among the k best of each of (query_id, vector, floor, cut).

    A query goes once to each unit of the upper cells that can reach its floor; which leaves it visits there (no
    bound under the floor, no centre under the ``cut``) is decided beside their members, so no leaf and query are ever
    a row.  A member goes if its ``high`` is under the floor or under the k-th ``low`` of its unit.
    """
    salts = max(1, -(-queries.count() // QUERY_ROWS))
    sent = _with_tops(queries, index, limit, units=True).withColumnRenamed("top", "unit").withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(salts)).cast("int"))
    none = lambda *kinds: [F.lit(None).cast(kind).alias(name) for name, kind in kinds]
    members = index.rows.select("unit", "leaf", "id", "codes", "step", "error", *none(("centre", "array<double>"), ("radius", "double")))
    chunk = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    leaves = index.leaves.select("leaf", "centre", "radius", chunk).select(_unit(F.col("leaf"), F.col("chunk")).alias("unit"), "leaf", *none(("id", "long"), ("codes", "binary"), ("step", "double"), ("error", "double")), "centre", "radius")
    own_side = members.union(leaves).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    empty = {"query_id": np.int64, "id": np.int64, "low": np.float64, "high": np.float64}

    def compare(key, asked, own):
        out = [[np.zeros(0, t)] for t in empty.values()]
        if asked.num_rows and own.num_rows:
            is_leaf = np.asarray(own.column("id").is_null())
            around, own = (own.filter(pa.array(m)).sort_by([("leaf", "ascending"), ("id", "ascending")]) for m in (is_leaf, ~is_leaf))
            x = matrix(asked.column("vector"))
            floor, cut, qid = (asked.column(c).to_numpy() for c in ("floor", "cut", "query_id"))
            codes = np.frombuffer(b"".join(own.column("codes").to_pylist()), np.int8).reshape(own.num_rows, -1)
            step, error, ids = (own.column(c).to_numpy() for c in ("step", "error", "id"))
            near = x @ matrix(around.column("centre")).T
            visit = (near + around.column("radius").to_numpy() + SLACK >= floor[:, None]) & (near >= cut[:, None])
            of = np.searchsorted(around.column("leaf").to_numpy(), own.column("leaf").to_numpy())
            q_codes, q_step, q_error = byte_codes(x)
            q_size = np.linalg.norm(x, axis=1)
            for at in range(0, len(x), 256):
                part = slice(at, at + 256)
                mine = np.flatnonzero(visit[part].any(axis=0)[of])
                if not len(mine):
                    continue
                score = code_products(q_codes[part], codes[mine]) * (q_step[part][:, None] * step[mine])
                # q . x - q^ . x^ = q . (x - x^) + (q - q^) . x^, and x^ is no longer than 1 + error
                spread = q_size[part][:, None] * error[mine] + q_error[part][:, None] * (1 + error[mine]) + SLACK
                score[~visit[part][:, of[mine]]] = -np.inf
                if other:
                    score[qid[part][:, None] == ids[mine]] = -np.inf
                low = score - spread
                least = floor[part] - SLACK
                if low.shape[1] >= k:
                    least = np.maximum(least, np.partition(low, -k, axis=1)[:, -k])
                row, col = np.nonzero((score + spread >= least[:, None]) & np.isfinite(score))
                for values, more in zip(out, (qid[part][row], ids[mine[col]], low[row, col], (score + spread)[row, col]), strict=True):
                    values.append(more)
        return pa.table(dict(zip(empty, map(np.concatenate, out), strict=True)))

    return sent.groupBy("unit", "salt").cogroup(own_side.groupBy("unit", "salt")).applyInArrow(compare, "query_id long, id long, low double, high double")


def _exact(asked: DataFrame, found: DataFrame, index: CellIndex, k: int) -> DataFrame:
    full = found.join(asked.select("query_id", F.col("vector").alias("q")), "query_id").join(index.rows.select("id", "vector"), "id")
    scored = full.select("query_id", "id", F.round(V.dot(F.col("q"), F.col("vector")), DECIMALS).alias("score"))
    return ranked(scored, ["query_id"], [F.desc("score"), "id"], k).select("query_id", "rank", "id", "score")

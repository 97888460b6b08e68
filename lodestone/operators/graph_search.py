"""Neighbour graphs over vectors, and searches that use quantised hints, cells or edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.functions.blocks import largest, matrix
from lodestone.operators.cells import build_cells, search_cells
from lodestone.operators.nearest import DECIMALS, nearest, ranked
from lodestone.operators.neighbour_joins import capped_both_ways, neighbour_graph, select_diverse  # noqa: F401


def knn_graph(rows: DataFrame, m: int, metric: str = "cosine", exact: bool = False, **how) -> DataFrame:
    """(src, dst, ordinal, score): the ``m`` nearest other rows of each row of (id, vector).

    Built by :func:`neighbour_graph`, whose arguments ``how`` are, with work in proportion to the rows and a
    recall that is measured, not promised.  ``exact`` compares all rows with all rows, for any metric.
    """
    if exact:
        near = nearest(rows.select(F.col("id").alias("query_id"), "vector"), rows.select("id", "vector"), m, metric, other=True)
        return near.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.col("rank").alias("ordinal"), "score")
    if metric != "cosine":
        raise ValueError("neighbour joins go by cosine")
    return neighbour_graph(rows, m, **how)


def diverse_neighbours(rows: DataFrame, candidates: int, m: int, **how) -> DataFrame:
    """(src, dst, ordinal): of each row's nearest ``candidates``, those nearer to it than to any neighbour kept before, at most ``m``."""
    return select_diverse(knn_graph(rows, candidates, **how), rows, m)


def bidirectional(edges: DataFrame, cap: int) -> DataFrame:
    """(src, dst, score): every edge both ways, then the ``cap`` best of each row; :func:`capped_both_ways` chooses diverse ones."""
    both = edges.select("src", "dst", "score").union(edges.select("dst", "src", "score")).distinct()
    return ranked(both, ["src"], [F.desc("score"), "dst"], cap, "ordinal")


def direction_hints(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """(src, dst, scale, codes): the four-bit packed direction from each row to its neighbours."""
    vectors = rows.select("id", V.doubles(F.col("vector")).alias("vector"))
    full = edges.select("src", "dst").join(vectors.select(F.col("id").alias("src"), F.col("vector").alias("a")), "src").join(vectors.select(F.col("id").alias("dst"), F.col("vector").alias("b")), "dst")
    packed = V.quantize_4bit(V.normalized(F.zip_with("b", "a", lambda x, y: x - y)))
    return full.withColumn("hint", packed).select("src", "dst", F.col("hint.scale").alias("scale"), F.col("hint.codes").alias("codes"))


def packed_codes(rows: DataFrame) -> DataFrame:
    """(id, scale, packed, error) of (id, vector): four-bit codes, two in a byte, and how far what they stand for is from the vector."""
    coded = rows.select("id", V.doubles(F.col("vector")).alias("vector"), V.quantize_4bit(F.col("vector")).alias("q"))
    digits = F.array_join(F.transform("q.codes", lambda c: F.hex(c.cast("long"))), "")
    even = F.when(F.size("q.codes") % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits)
    return coded.select("id", F.col("q.scale").alias("scale"), F.unhex(even).alias("packed"), V.l2(F.col("vector"), V.dequantize_4bit(F.col("q"))).alias("error"))


def code_search(queries: DataFrame, codes: DataFrame, ef: int, other: bool = False, block: int = 65_536, query_block: int = 2048) -> DataFrame:
    """(query_id, id, hint, error): the ``ef`` rows of :func:`packed_codes` of the largest products with each of (query_id, vector).

    Hints are rounded as scores are; ties go to the smaller id.  Blocks of codes, not of vectors, travel to
    the queries: half a byte for a number.
    """
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), V.doubles(F.col("vector")).alias("vector"))
    nb, nq = max(1, -(-codes.count() // block)), max(1, -(-q.count() // query_block))
    deal = lambda col, n: F.pmod(F.xxhash64(col), F.lit(n)).cast("int")
    q = q.withColumns({"_q": deal("query_id", nq), "_b": F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))})
    c = codes.select(F.col("id").cast("long").alias("id"), "scale", "packed", "error").withColumns({"_b": deal("id", nb), "_q": F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))})

    def match(asked, own):
        out = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.float64, np.float64)]
        if asked.num_rows and own.num_rows:
            own = own.sort_by("id")
            x, qid, ids = matrix(asked.column("vector")), asked.column("query_id").to_numpy(), own.column("id").to_numpy()
            scale, error = own.column("scale").to_numpy(), own.column("error").to_numpy()
            raw = np.frombuffer(b"".join(own.column("packed").to_pylist()), np.uint8).reshape(len(ids), -1)
            grid = np.stack([raw >> 4, raw & 15], axis=2).reshape(len(ids), -1)[:, : x.shape[1]].astype(np.float64)
            for at in range(0, len(x), 256):
                part = x[at : at + 256]
                hint = np.round(scale * ((part @ grid.T) / 7.5 - part.sum(axis=1, keepdims=True)), DECIMALS)
                if other:
                    hint[qid[at : at + 256, None] == ids] = -np.inf
                row, col = largest(hint, ef)
                for values, more in zip(out, (qid[at + row], ids[col], hint[row, col], error[col]), strict=True):
                    values.append(more)
        return pa.table(dict(zip(("query_id", "id", "hint", "error"), map(np.concatenate, out), strict=True)))

    found = q.groupBy("_b", "_q").cogroup(c.groupBy("_b", "_q")).applyInArrow(match, "query_id long, id long, hint double, error double")
    return ranked(found, ["query_id"], [F.desc("hint"), "id"], ef).drop("rank")


def two_phase_search(queries: DataFrame, corpus: DataFrame, ef: int, k: int, other: bool = False, codes: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, id, score): the ``ef`` best by four-bit codes, then the ``k`` best of them by cosine.

    ``codes`` are those of ``corpus`` if they are kept beside it (:func:`packed_codes`).  The first phase reads
    codes only, the second the vectors of ``ef`` rows for each query.
    """
    if ef < k:
        raise ValueError("ef must be at least k")
    first = code_search(queries, packed_codes(corpus) if codes is None else codes, ef, other)
    return _rescored(first.select("query_id", "id"), queries, corpus, k)


def certain_queries(queries: DataFrame, codes: DataFrame, hits: DataFrame, ef: int, other: bool = False) -> DataFrame:
    """(query_id, certain): whether ``ef`` was enough for the k hits (query_id, id, score) of a search among unit vectors.

    A row that the first phase left out has a hint no larger than the last that it kept, and a true product at
    most the length of the query times the largest error of any code above that; if that is less than the
    k-th score, no row left out can be among the k best.
    """
    kept = code_search(queries, codes, ef, other).groupBy("query_id").agg(F.min("hint").alias("last"), F.count(F.lit(1)).alias("n"))
    worst = codes.agg(F.max("error").alias("most"))  # one row
    least = hits.groupBy("query_id").agg(F.min("score").alias("least"))
    full = queries.select("query_id", V.norm(F.col("vector")).alias("size")).join(kept, "query_id").join(least, "query_id").join(F.broadcast(worst))
    beaten = F.col("last") + F.col("size") * F.col("most") < F.col("least") * F.col("size")
    return full.select("query_id", ((F.col("n") < ef) | beaten).alias("certain"))


def _rescored(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    full = pairs.join(queries.select("query_id", F.col("vector").alias("q")), "query_id").join(corpus.select("id", F.col("vector").alias("c")), "id")
    scored = full.select("query_id", "id", F.round(V.cosine(F.col("q"), F.col("c")), DECIMALS).alias("score"))
    return ranked(scored, ["query_id"], [F.desc("score"), "id"], k).select("query_id", "rank", "id", "score")


def cell_search(queries: DataFrame, corpus: DataFrame, k: int, probes: int | float | None = None, other: bool = False, **how) -> DataFrame:
    """Top-k by an index of cells that is built for the search; see :func:`build_cells`, whose arguments ``how`` are, and :func:`search_cells`.

    Exact unless ``probes`` limits the cells that a query visits.
    """
    return search_cells(queries, build_cells(corpus, **how), k, probes, other=other)


def expand_hits(hits: DataFrame, edges: DataFrame, queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """One round of hits (query_id, id) along edges (src, dst), re-ranked by cosine together with the hits."""
    reached = hits.select("query_id", "id").union(hits.join(edges.select(F.col("src").alias("id"), "dst"), "id").select("query_id", F.col("dst").alias("id"))).distinct()
    return _rescored(reached, queries, corpus, k)


def tenant_search(queries: DataFrame, corpus: DataFrame, tenants: DataFrame, k: int, other: bool = False) -> DataFrame:
    """Top-k where a query (query_id, tenant_id, vector) sees only rows of its tenant.

    A tenant that is not in ``tenants`` is an error; a known one without rows gives no rows.
    """
    known = tenants.select(F.col("tenant_id"), F.lit(True).alias("known")).distinct()
    checked = queries.join(known, "tenant_id", "left")
    tenant = F.when(F.col("known"), F.col("tenant_id")).otherwise(F.raise_error(F.concat(F.lit("unknown tenant "), F.coalesce(F.col("tenant_id").cast("string"), F.lit("null")))).cast(queries.schema["tenant_id"].dataType))
    return nearest(checked.select(tenant.alias("tenant_id"), "query_id", "vector"), corpus, k, by=["tenant_id"], other=other)

"""Cells, byte codes, four-bit codes and neighbour joins against exact search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import blocks
from lodestone.functions import vectors as V
from lodestone.operators import cells, graph_search, neighbour_joins, ranking
from lodestone.operators.nearest import nearest

RNG = np.random.default_rng(5)


def table(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>").repartition(4)


def asked_of(rows, every):
    return rows.where(F.col("id") % every == 0).withColumnRenamed("id", "query_id")


def hits(found):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in found.collect())


@pytest.fixture(scope="module")
def clustered(spark):
    centres = RNG.standard_normal((40, 32)) * 3
    x = (centres[:, None] + RNG.standard_normal((40, 60, 32))).reshape(-1, 32)
    return table(spark, x)


@pytest.fixture(scope="module")
def spread(spark):
    """Uniform directions, twenty rows that are the same, and zero vectors."""
    x = RNG.standard_normal((900, 24))
    x[100:120] = x[100]
    x[[7, 50]] = 0
    return table(spark, x)


def test_cells_give_the_exact_ranking(clustered, spread, monkeypatch):
    for rows in (clustered, spread):
        asked = asked_of(rows, 25)
        index = cells.build_cells(rows, leaf_rows=30)
        assert index.rows.count() == index.count == rows.count()
        want = hits(nearest(asked, rows, 7, other=True))
        assert hits(cells.search_cells(asked, index, 7, other=True)) == want
        assert hits(cells.search_cells(asked, index, 7, first=1, other=True)) == want
    monkeypatch.setattr(cells, "UNIT_ROWS", 16)  # leaves are dealt over units
    monkeypatch.setattr(cells, "TOP_ROWS", 50)
    index = cells.build_cells(spread, leaf_rows=30)
    assert index.units > 50 and index.leaves.agg(F.max("chunks")).first()[0] > 1
    assert hits(cells.search_cells(asked, index, 7, other=True)) == want


def test_bounds_spare_most_of_a_clustered_table(clustered):
    asked = asked_of(clustered, 50).select("query_id", V.normalized(F.col("vector")).alias("vector"))
    index = cells.build_cells(clustered, leaf_rows=30)
    queries, n = asked.count(), index.count
    full = cells.candidates(asked, index, 10, None, 4, True).count()
    assert full < 0.02 * queries * n  # vectors read in full
    near = cells.cell_bounds(asked.withColumn("floor", F.lit(-2.0)), index, 4)
    floors = cells._floors(cells.code_candidates(asked, near, index, 10, True), 10)
    later = cells.cell_bounds(asked.join(floors, "query_id"), index).join(near, ["query_id", "leaf"], "left_anti")
    seen = near.agg(F.sum("n")).first()[0] + (later.agg(F.sum("n")).first()[0] or 0)
    assert seen < 0.2 * queries * n  # codes read
    assert later.count() < 0.2 * queries * index.leaves.count()  # and few leaves are named at all


def test_recall_of_limited_probes(clustered):
    asked = asked_of(clustered, 25)
    exact = nearest(asked, clustered, 10, other=True)
    found = graph_search.cell_search(asked, clustered, 10, probes=0.1, other=True)
    assert ranking.overlap(found, exact, 10).agg(F.avg("overlap")).first()[0] >= 0.90


def test_few_rows_and_none(spark):
    rows = table(spark, RNG.standard_normal((3, 8)))
    asked = asked_of(rows, 1)
    assert hits(graph_search.cell_search(asked, rows, 5, other=True)) == hits(nearest(asked, rows, 5, other=True))
    assert graph_search.cell_search(asked, rows.where("id < 0"), 5).count() == 0
    assert graph_search.cell_search(asked.where("query_id < 0"), rows, 5).count() == 0
    assert neighbour_joins.neighbour_graph(rows.where("id < 0"), 5).count() == 0
    assert {(r["src"], r["dst"]) for r in neighbour_joins.neighbour_graph(rows, 5).collect()} == {(a, b) for a in range(3) for b in range(3) if a != b}


def test_byte_code_bounds_hold():
    x = RNG.standard_normal((50, 33)) * RNG.random((50, 1)) * 9
    x[3] = 0
    codes, step, error = blocks.byte_codes(x)
    assert np.allclose(np.linalg.norm(x - step[:, None] * codes, axis=1), error) and codes.dtype == np.int8
    exact = blocks.code_products(codes, codes)
    assert (exact == codes.astype(int) @ codes.astype(int).T).all()


def test_largest_breaks_ties_by_place():
    score = RNG.integers(0, 4, (30, 200)).astype(float)
    score[0] = -np.inf
    for k in (1, 5, 49, 60, 300):
        row, at = blocks.largest(score, k)
        want = [(r, c) for r in range(30) for c in sorted(range(200), key=lambda c: (-score[r, c], c))[:k] if np.isfinite(score[r, c])]
        assert list(zip(row.tolist(), at.tolist(), strict=True)) == want


def recall(found, exact):
    edges = lambda g: {(r["src"], r["dst"]) for r in g.collect()}
    want, got = edges(exact), edges(found)
    assert all(a != b for a, b in got)
    return len(want & got) / len(want)


def test_neighbour_joins_find_the_neighbours(clustered, spread):
    for rows in (clustered, spread):
        exact = graph_search.knn_graph(rows, 6, exact=True)
        assert recall(neighbour_joins.neighbour_graph(rows, 6, pool=24, block=64), exact) >= 0.93
    assert recall(graph_search.knn_graph(spread.where("id < 500"), 6), graph_search.knn_graph(spread.where("id < 500"), 6, exact=True)) == 1.0
    with pytest.raises(ValueError):
        graph_search.knn_graph(spread, 5, "l2")


def test_joins_improve_on_blocks(spread):
    exact = graph_search.knn_graph(spread, 6, exact=True)
    begun = recall(neighbour_joins.neighbour_graph(spread, 6, pool=24, block=64, rounds=0), exact)
    assert begun < 0.8 < recall(neighbour_joins.neighbour_graph(spread, 6, pool=24, block=64), exact)


def test_rows_over_the_cap_choose_diverse_edges(spread):
    x = np.array([r["vector"] for r in spread.orderBy("id").collect()])
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    edges = graph_search.knn_graph(spread, 6)
    both: dict[int, dict[int, float]] = {}
    for r in edges.collect():
        both.setdefault(r["src"], {})[r["dst"]] = both.setdefault(r["dst"], {})[r["src"]] = r["score"]
    want = {}
    for a, near in both.items():
        order = sorted(near, key=lambda b: (-near[b], b))
        if len(order) > 9:
            kept: list[int] = []
            for c in order[:36]:
                if len(kept) < 9 and all(1 - unit[c] @ unit[s] >= 1 - unit[a] @ unit[c] for s in kept):
                    kept.append(c)
            order = kept
        want[a] = order
    got: dict[int, list[int]] = {}
    for r in neighbour_joins.capped_both_ways(edges, spread, 9).orderBy("src", "ordinal").collect():
        got.setdefault(r["src"], []).append(r["dst"])
    apart = [a for a in want if got.get(a) != want[a]]  # comparisons of equal distances may fall either way
    assert set(got) == set(want) and all(a in (7, 50) or a in range(100, 120) or set(want[a]) & {7, 50, *range(100, 120)} for a in apart) and max(map(len, got.values())) <= 9


def test_four_bit_codes(spread):
    rows, asked = spread.where("id <> 7 and id <> 50"), asked_of(spread, 45).where("query_id > 0")
    codes = graph_search.packed_codes(rows)
    assert len(codes.first()["packed"]) == 12
    hints = {(r["query_id"], r["id"]): r["hint"] for r in graph_search.code_search(asked, codes, 2000).collect()}
    slow = asked.crossJoin(rows.select("id", F.col("vector").alias("v"))).select("query_id", "id", F.round(V.hint_score(V.quantize_4bit(F.col("v")), F.col("vector")), 9).alias("hint")).collect()
    assert len(slow) == len(hints) and all(abs(hints[r["query_id"], r["id"]] - r["hint"]) < 2e-9 for r in slow)
    found = graph_search.two_phase_search(asked, rows, 2000, 5)
    assert hits(found) == hits(nearest(asked, rows, 5))


def test_certain_queries_are_right(clustered):
    rows = clustered.select("id", V.normalized(F.col("vector")).alias("vector"))
    asked = asked_of(rows, 40)
    codes = graph_search.packed_codes(rows)
    found = graph_search.two_phase_search(asked, rows, 90, 5, codes=codes)
    sure = {r["query_id"] for r in graph_search.certain_queries(asked, codes, found, 90).where("certain").collect()}
    want = [h for h in hits(nearest(asked, rows, 5)) if h[0] in sure]
    assert len(sure) > 10 and [h for h in hits(found) if h[0] in sure] == want


def test_stored_tables_can_be_cleared(spark):
    from pathlib import Path

    from lodestone.functions import stored

    table = stored.stored(spark.range(5), "five")
    folder = Path(stored._own_dir(spark).removeprefix("file:"))
    assert table.count() == 5 and folder.exists()
    stored.clear_stored(spark)
    assert not folder.exists()

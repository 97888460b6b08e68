"""Registered queries against their SQL on small tables with what the tables on disk do not hold."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest


def values(rows, columns):
    plain = lambda x: (x is None, round(x, 6) + 0.0 if isinstance(x, float) else "" if x is None else x)
    return sorted(tuple(plain(r[c]) for c in columns) for r in rows)


def equal(spark, folder, query, **tables):
    """The rows of a query on tables that are written to ``folder``, and those of its SQL."""
    import duckdb

    from lodestone import plans

    con = duckdb.connect()
    for name, rows in tables.items():
        pq.write_table(rows, f"{folder}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    want = con.sql(plans.oracle_sql()[query]).to_arrow_table().to_pylist()
    columns = list(want[0])
    got, want = values(plans.queries()[query](spark, str(folder)).select(*columns).collect(), columns), values(want, columns)
    return got, want


def texts(*values):
    return pa.table({"doc_id": pa.array(range(1, len(values) + 1), pa.int64()), "text": pa.array(values, pa.string())})


def test_first_letters_with_long_capitals(spark, tmp_path):
    letters = [chr(c) for c in (0x61, 0xDF, 0x149, 0x19B, 0x1F80, 0x1F88, 0x1FB3, 0x1FB7, 0xFB03, 0x1C6, 0x10D70, 0x10428, 0x1F600)]
    got, want = equal(spark, tmp_path, "p07_normalize", documents=texts(*[f"{c}x \t y" for c in letters], "a. ", "a!\u0085", " b? \n", "", " ", None))
    assert len(got) == 19 and got == want


def test_empty_and_missing_texts(spark, tmp_path):
    got, want = equal(spark, tmp_path, "p04_drop_empty", documents=texts("a", "", " \n\t", None, *"bcdefgh"))
    assert got == want == [((False, 1), (False, 10))]
    from lodestone.operators.corpus import without_empty

    rows = spark.createDataFrame([("a",), (" \n\t\x0b",), ("",), (None,), ("\u00a0",)], "text string")
    kept, counts = without_empty(rows)
    assert sorted(r["text"] for r in kept.collect()) == ["a", "\u00a0"] and tuple(counts.first()) == (3, 2)


def scalars_by_hand(corpus, asked, k):
    """Distances rounded half away from zero, ties to the smaller id."""
    import math

    def away(q, c):
        y = abs(q - c) * 1e9
        return (math.floor(y) + (y - math.floor(y) >= 0.5)) / 1e9

    return {(q, n): (i, d) for q, v in asked for n, (d, i) in enumerate(sorted((away(v, c), i) for i, c in corpus)[:k])}


def test_scalars_that_tie_after_rounding(spark):
    """Ten values closer to each other than the ninth place, of which the smallest ids are farthest; copies; ends of ranges."""
    from lodestone.operators.nearest import nearest_scalar

    corpus = [(100 - i, 0.5 + i * 3e-11) for i in range(10)] + [(200 + i, i / 7) for i in range(60)] + [(300 + i, 0.25) for i in range(9)] + [(400, 1.25e-8)]
    asked = [(1, 0.4999), (2, 0.25), (3, 0.0), (4, -9.0), (5, 99.0), (6, 0.4999), (7, 0.5)]
    for ranges in (1, 6):
        found = nearest_scalar(spark.createDataFrame(asked, "query_id long, value double"), spark.createDataFrame(corpus, "id long, value double"), 4, ranges)
        assert {(r["query_id"], r["rank"]): (r["id"], r["distance"]) for r in found.collect()} == scalars_by_hand(corpus, asked, 4)
    none = spark.createDataFrame(corpus, "id long, value double").where("id < 0")
    assert nearest_scalar(spark.createDataFrame(asked, "query_id long, value double"), none, 4).count() == 0


def test_frequency_matching_makes_no_row_for_each_hit(spark, tmp_path, monkeypatch):
    """Words that occur as often as very many others: equal to SQL, and each share is searched once."""
    from lodestone.operators import audits

    words = " ".join([f"w{n}" for n in range(300)] + ["a"] * 3 + ["b"] * 3 + ["c"] * 7)
    table = pa.table({"conv_id": pa.array([1, 1, 2], pa.int64()), "turn": pa.array([0, 1, 0], pa.int32()), "role": pa.array(["u"] * 3), "text": pa.array([words, words + " d e f a", "w5 a b z"])})
    seen, search = [], audits.scalar_hits
    monkeypatch.setattr(audits, "scalar_hits", lambda *a: seen.append(search(*a)) or seen[-1])
    got, want = equal(spark, tmp_path, "a08_frequency_matching", conversations=table)
    assert got == want and seen[0].count() < 10


def test_ranks_are_limited_before_the_shuffle(spark):
    from lodestone.operators.nearest import ranked

    plan = ranked(spark.range(100).selectExpr("id % 3 AS g", "id"), ["g"], ["id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def embeddings(n, seed=3):
    """Directions in eight dimensions, some of them copies, as the table of embeddings."""
    import numpy as np

    x = np.random.default_rng(seed).standard_normal((n, 8)).astype(np.float32)
    x[n // 2 : n // 2 + 12] = x[5]
    return pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array(x.tolist(), pa.list_(pa.float32())), "label": pa.array([i % 4 for i in range(n)], pa.int32())})


GRAPHS = ("j02_knn_graph", "j03_diverse_neighbours", "j04_bidirectional", "j04_bidirectional_diverse", "j05_direction_hints", "j08_expand_hits")


@pytest.mark.parametrize("query", GRAPHS)
def test_graphs_beyond_one_block_are_exact(spark, tmp_path, query):
    rows = embeddings(1300)
    if query == "j05_direction_hints":  # copies have no direction
        rows = rows.slice(0, 640)
    got, want = equal(spark, tmp_path, query, embeddings=rows)
    assert len(got) > 50 and got == want


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_what_is_left_out_cannot_be_among_the_best(metric):
    """Tiles against a plain ranking: many copies, values of no order and in order, zero vectors and some that are not finite."""
    import numpy as np

    from lodestone.operators import nearest

    rng = np.random.default_rng(4)
    for n in (300, 9000):
        x, y = rng.standard_normal((9, 7)), rng.standard_normal((n, 7))
        y[n // 2 :] = y[n // 2 :][np.argsort(y[n // 2 :, 0])]
        y[20:90], y[n - 5000 :: 7], x[0], y[3], x[1], y[8] = y[0], y[0], y[0], 0, 0, np.nan
        row, at, score = nearest._best(x, y, np.arange(9), np.arange(n), 5, metric, True)
        for q in range(9):
            away = nearest.exact_scores(np.repeat(x[q : q + 1], n, axis=0), y, metric)
            want = [i for i in sorted(range(n), key=lambda i: (away[i] if metric == "l2" else -away[i], i) if away[i] == away[i] else (np.inf, i)) if i not in (q, 8)][:5]
            assert at[row == q].tolist() == want and score[row == q].tolist() == away[want].tolist()


def test_blocks_are_few():
    """Rows that are sent grow with the input to a power near 1 until blocks are full."""
    from lodestone.operators import nearest

    for n in (50_000, 500_000):
        nq, nb = nearest.dealt(n, n)
        assert nq * nb >= nearest.TASKS and n / nb <= nearest.BLOCK and n / nq <= nearest.QUERY_BLOCK and nq + nb <= 2 + n / 20_000 + 16
    assert nearest.dealt(12_000, 600_000)[0] == 1


def test_scores_of_all_pairs_are_not_shuffled(spark, tmp_path):
    from lodestone import plans
    from lodestone.operators.nearest import zscores

    rows = embeddings(230)
    got, want = equal(spark, tmp_path, "v20_row_zscore", embeddings=rows)
    assert got == want
    table = spark.read.parquet(f"{tmp_path}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    blocks = zscores(table.where("id % 50 = 0").withColumnRenamed("id", "query_id"), table, True, block=17)
    assert sorted((r[0], r[1], round(r[2], 6) + 0.0) for r in blocks.collect()) == sorted(tuple(x for _, x in r) for r in want)
    plan = plans.queries()["v20_row_zscore"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("probes", [None, 0.8])
def test_cells_name_few_leaves_and_stay_whole(spark, monkeypatch, probes):
    """No row for a query and a leaf beyond the first ones; units and blocks of queries of any size give the same."""
    import numpy as np

    from lodestone.operators import cells
    from lodestone.operators.nearest import nearest

    x = np.random.default_rng(6).standard_normal((700, 16))
    x[30:60] = x[30]
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>")
    asked = rows.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    listed = lambda found: sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in found.collect())
    index = cells.build_cells(rows, leaf_rows=16)
    made, bounds = [], cells.cell_bounds
    monkeypatch.setattr(cells, "cell_bounds", lambda *a: made.append(bounds(*a)) or made[-1])
    found = listed(cells.search_cells(asked, index, 5, probes, other=True))
    assert 0 < sum(m.count() for m in made) <= 4 * asked.count()
    monkeypatch.setattr(cells, "UNIT_ROWS", 40)
    monkeypatch.setattr(cells, "QUERY_ROWS", 10)
    again = cells.build_cells(rows, leaf_rows=16)
    assert again.units > 12 and listed(cells.search_cells(asked, again, 5, probes, other=True)) == found
    want = listed(nearest(asked, rows, 5, other=True))
    assert found == want if probes is None else len(set(found) & set(want)) > 0.8 * len(want)


def test_shared_vectors_are_searched_once(spark, tmp_path, monkeypatch):
    from lodestone.operators import knowledge_graph as K

    lines = [(o, p, (p * 7 + o) % 11) for o in range(90) for p in (o % 37, o * 5 % 41)]
    lineitem = pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("l_orderkey", "l_partkey", "l_suppkey"), zip(*lines, strict=True), strict=True)})
    sizes, search = [], K.nearest
    monkeypatch.setattr(K, "nearest", lambda q, c, *a: sizes.append(c.count()) or search(q, c, *a))
    got, want = equal(spark, tmp_path, "g16_hybrid_query", embeddings=embeddings(12), lineitem=lineitem)
    assert got == want and len(set(lines)) > 30 and max(sizes) <= 12

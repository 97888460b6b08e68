"""Audits against brute force: signatures, votes, Gram blocks, clusters over ranges, ridge, invariants, spectra, percentiles."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import audits, corpus, knowledge_graph, model_outputs, ranking, telemetry
from lodestone.operators import nearest as near_module

RNG = np.random.default_rng(12)


def vectors(spark, x, **more):
    rows = [(i, r.tolist(), *(m[i] for m in more.values())) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join(["id long", "vec array<double>", *(f"{n} long" for n in more)])).repartition(3)


# A10


def signatures(sequences):
    counts: dict = {}
    for s in sequences:
        for a, b in zip(s, s[1:]):
            counts.setdefault(a, Counter())[b] += 1
    return {a: sorted(c.values(), reverse=True) for a, c in counts.items()}


def far(a, b):
    n = max(len(a), len(b))
    return sum((x - y) ** 2 for x, y in zip(a + [0] * (n - len(a)), b + [0] * (n - len(b)), strict=True))


@pytest.mark.parametrize("block", [4096, 7])
def test_substitution_by_whole_signatures(spark, monkeypatch, block):
    monkeypatch.setattr(audits, "NORM_ROWS", block)
    zipf = 1 / np.arange(1, 121)
    draw = lambda n, base: [[int(t) + base for t in RNG.choice(120, RNG.integers(0, 60), p=zipf / zipf.sum())] for _ in range(n)]
    known, seen = [*draw(60, 0), [0] * 50 + list(range(100))], draw(45, 1000)
    a, b = signatures(seen), signatures(known)
    want = {t: min(b, key=lambda g: (far(a[t], b[g]), g)) for t in a}
    frame = lambda x: spark.createDataFrame(list(enumerate(x)), "prompt long, tokens array<long>")
    near = audits.nearest_signatures(audits.bigram_signatures(frame(seen)), audits.bigram_signatures(frame(known))).collect()
    assert {r["token"]: r["guess"] for r in near} == want
    assert all(r["distance2"] == far(a[r["token"]], b[r["guess"]]) for r in near)
    out = {r["prompt"]: r["tokens"] for r in audits.bigram_substitution(frame(seen), frame(known)).collect()}
    assert out == {i: [want.get(t, t) for t in s] for i, s in enumerate(seen) if s}


def test_pool(spark):
    rows = spark.createDataFrame([([3, 1, 1, 2],), ([2, 5],), ([],)], "tokens array<long>")
    assert [tuple(r) for r in audits.token_pool(rows, 3).collect()] == [(0, 1, 2, 2 / 6), (1, 2, 2, 2 / 6), (2, 3, 1, 1 / 6)]


# A17


def test_votes_without_pairs_equal_votes_with_pairs(spark):
    sources = [(vectors(spark, RNG.standard_normal((40, 32)) * s), vectors(spark, RNG.standard_normal((60, 32)) * s + s)) for s in (1, 3)]
    flat = vectors(spark, np.ones((40, 32)))
    sources.append((flat, vectors(spark, np.ones((60, 32)))))  # no feature at all: every score is 0
    slow = audits.vote_match([audits.feature_scores(a, b) for a, b in sources], 4)
    pick = lambda f: {(r["query_id"], r["rank"]): (r["id"], pytest.approx(r["score"], abs=1e-6)) for r in f.collect()}
    assert {k: (i, v.expected) for k, (i, v) in pick(audits.vote_search(sources, 4)).items()} == pick(slow)
    assert audits.vote_search([(flat.where("id < 0"), flat)], 2).count() == audits.vote_search([(flat, flat.where("id < 0"))], 2).count() == 0


# A21


def test_gram_errors_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(audits, "GRAM_ROWS", 5)
    x = RNG.standard_normal((1600, 7))
    y = x + 0.1 * RNG.standard_normal(x.shape)
    group = [0 if i < 1500 else 1 if i < 1599 else None for i in range(1600)]
    observed, plain = vectors(spark, y, g=group), vectors(spark, x, g=group)
    for cap in (None, 3):
        got = {r["g"]: r["error"] for r in audits.column_gram_error(observed, plain.union(plain.limit(1).select("id", "vec", F.lit(9).cast("long"))), ["g"], cap).collect()}
        assert set(got) == {0, 1, None}
        for g in got:
            own = [i for i in range(1600) if group[i] == g]
            a, b = y[own][:, :cap], x[own][:, :cap]
            assert got[g] == pytest.approx(np.linalg.norm(a.T @ a - b.T @ b) / np.linalg.norm(b.T @ b))


# A31 to A33


@pytest.mark.parametrize("ranges", [1, 6, 64])
def test_gaps_across_ranges(spark, monkeypatch, ranges):
    monkeypatch.setattr(audits, "RANGES", ranges)
    values = {g: np.round(RNG.random(n) * 50, 1) for g, n in (("a", 300), ("b", 1), (None, 40))} | {"c": np.repeat(2.0, 90)}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None), ("d", None)], "g string, v double").repartition(4)
    got: dict = {}
    for r in audits.gap_numbers(rows, ["g"], "v", 0.35, ranges).collect():
        got.setdefault(r["g"], []).append((r["v"], r["n"], r["cluster"]))
    assert set(got) == set(values)
    for g, vs in values.items():
        line, number, want = sorted(Counter(vs.tolist()).items()), 0, []
        for i, (v, n) in enumerate(line):
            number += i > 0 and v - line[i - 1][0] > 0.35
            want.append((v, n, number))
        assert sorted(got[g]) == want
        clusters = sorted((r["cluster"], r["size"], r["low"], r["high"]) for r in audits.gap_clusters(rows.where(F.col("g").eqNullSafe(F.lit(g))), ["g"], "v", 0.35).collect())
        assert [c[1] for c in clusters] == [sum(n for _, n, k in want if k == c[0]) for c in clusters] and sum(c[1] for c in clusters) == len(vs)


def test_spans_across_pieces(spark):
    rows = [(g, round(float(v), 2)) for g in ("a", "b") for v in RNG.random(400) * 30]
    got: dict = {}
    for r in audits.span_clusters(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", 0.5).collect():
        got.setdefault(r["g"], {})[r["cluster"]] = (r["size"], r["low"])
    for g in got:
        vs, want = sorted(v for h, v in rows if h == g), []
        while vs:
            own = [v for v in vs if v - vs[0] <= 0.5]
            want.append((len(own), vs[0]))
            vs = vs[len(own) :]
        assert [got[g][k] for k in range(len(want))] == want and len(got[g]) == len(want)


# A15, A16, A18, A19, A22, A24


def test_ridge_inversion_recovers_a_linear_map(spark):
    y = RNG.standard_normal((300, 6))
    x = y @ RNG.standard_normal((6, 6)) + 0.01 * RNG.standard_normal((300, 6)) + 3
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist(), i) for i, (a, b) in enumerate(zip(x, y, strict=True))], "row long, x array<double>, y array<double>, token long")
    pool = rows.select("token", F.col("y").alias("vec")).where("token % 2 = 0")  # the truths are added
    got = audits.ridge_inversion(rows, pool).first()
    assert got["alpha"] in (1e-4, 1e-2, 1.0) and got["validation_top1"] > 0.95 and got["top1"] > 0.95 and got["top10"] == 1.0
    noise = rows.withColumn("x", F.array(*[F.rand(k) for k in range(6)]))
    assert audits.ridge_inversion(noise, pool).first()["top1"] < 0.2


def test_anchored_ridge(spark):
    groups, want = [], {}
    for g in (0, 1):
        y = RNG.standard_normal((60, 5))
        x = y @ RNG.standard_normal((5, 5)) + (0 if g == 0 else 5) * RNG.standard_normal((60, 5))
        anchor = np.arange(60) % 3 == 0
        w = np.linalg.solve(x[anchor].T @ x[anchor] + 1e-2 * np.eye(5), x[anchor].T @ y[anchor])
        guess, truth = x[~anchor] @ w, y[~anchor]
        want[g] = np.percentile(np.abs((guess * truth).sum(1) / np.linalg.norm(guess, axis=1) / np.linalg.norm(truth, axis=1)), 95)
        groups += [(g, a.tolist(), b.tolist(), bool(c)) for a, b, c in zip(x, y, anchor, strict=True)]
    groups.append((2, [1.0] * 5, [1.0] * 5, True))  # nothing but anchors
    out = {r["g"]: r["p95"] for r in audits.anchored_ridge(spark.createDataFrame(groups, "g int, x array<double>, y array<double>, anchor boolean").repartition(4), "g").collect()}
    assert out[2] is None and out[0] == pytest.approx(want[0]) and out[1] == pytest.approx(want[1]) and out[0] > 0.99


def test_invariants(spark):
    x, m = RNG.standard_normal((30, 8)), RNG.standard_normal((8, 20))
    rows, p = vectors(spark, x), x @ m
    assert {r["id"]: pytest.approx(r["value"]) for r in audits.scalar_invariants(rows, m).collect()} == dict(enumerate(p.mean(axis=1)))
    got = {r["id"]: r["vector"] for r in audits.block_energies(rows, m, 16).collect()}
    for i in range(30):
        assert got[i] == pytest.approx([(p[i, :16] ** 2).sum(), (p[i, 16:] ** 2).sum()])


def test_spectra_and_signatures(spark):
    x = RNG.standard_normal((4, 9, 6))
    turn = np.linalg.qr(RNG.standard_normal((6, 6)))[0]
    table = lambda y: spark.createDataFrame([(0, b, i, r.tolist()) for b in range(4) for i, r in enumerate(y[b])], "layer int, block long, row_idx int, vec array<double>").repartition(3)
    turned, scaled = table(x @ turn), table(x * 2)
    assert all(r["error"] < 1e-9 for r in audits.spectrum_error(turned, table(x), ["block"]).collect())
    assert all(r["error"] == pytest.approx(3) for r in audits.spectrum_error(scaled, table(x), ["block"]).collect())
    values = {r["block"]: r["vector"] for r in audits.singular_values(table(x), ["layer", "block"], 4).collect()}
    assert all(values[b] == pytest.approx((np.linalg.svd(x[b], compute_uv=False)[:4] ** 2).tolist()) for b in range(4))
    hit = audits.signature_hits(audits.singular_values(turned, ["layer", "block"], 4), audits.singular_values(table(x), ["layer", "block"], 4), ["layer"]).first()
    assert (hit["n"], hit["hit_rate"]) == (4, 1.0)


# A38, G07, M04, P01, E10, T01


def test_repetition_and_leaks(spark):
    rows = spark.createDataFrame([(i, i % 7 if i < 70 else 100 + i) for i in range(100)], "row long, token long")
    got = audits.label_repetition(rows, "token").first()
    assert (got["total"], got["distinct"], got["max"], list(got["largest"])) == (100, 37, 10, [10] * 7 + [1] * 3)
    leaks = {r["seed"]: (r["n"], r["leak"]) for r in audits.split_leakage(rows, "row", "token", seeds=(0, 1)).collect()}
    for seed in (0, 1):
        split = {r["row"]: r["split"] for r in audits.split_rows(rows, "row", seed=seed).collect()}
        token = lambda i: i % 7 if i < 70 else 100 + i
        train, test = {token(i) for i, s in split.items() if s == "train"}, [i for i, s in split.items() if s == "test"]
        assert leaks[seed] == (len(test), pytest.approx(np.mean([token(i) in train for i in test])))


def test_extraction_report(spark):
    raw = [
        ("c0", '("entity"<|>A<|>x<|>a)##("relationship"<|>A<|>B<|>r<|>k<|>1)##bad<|COMPLETE|>'), ("c1", '("entity"<|>B<|>x<|>b)##("relationship"<|>B<|>A<|>r<|>k<|>1)##("relationship"<|>A<|>Z<|>r<|>k<|>1)'),
        ("c2", "\n 　 "), ("c3", None), ("c4", "<|COMPLETE|>"),
    ]
    rows = spark.createDataFrame(raw, "chunk_id string, raw string")
    report = knowledge_graph.extraction_report(rows).first().asDict()
    assert report == {"processed": 3, "skipped_empty": 2, "truncated": 1, "malformed": 1, "entities": 2, "relations": 3, "dangling": 1}
    per = {r["chunk_id"]: tuple(r)[1:] for r in knowledge_graph.chunk_counts(rows).collect()}
    assert per == {"c0": (False, False, 1, 1, 1), "c1": (False, True, 0, 1, 2), "c2": (True, False, 0, 0, 0), "c3": (True, False, 0, 0, 0), "c4": (False, False, 0, 0, 0)}


def test_empty_keywords(spark):
    rows = spark.createDataFrame([("abc", "", 4, True), ("abc", "", 5, False), ("İx", "İ", 1, True), ("aAa", "AA", 1, True)], "t string, word string, number int, want boolean")
    holds = model_outputs.instruction_holds(F.col("t"), F.lit("keyword_frequency"), F.lit("at least"), F.col("number"), F.array("word"))
    assert all(r["got"] == r["want"] for r in rows.select("want", holds.alias("got")).collect())


def test_blank_texts_of_any_white_space_have_no_chunks(spark):
    rows = spark.createDataFrame([(0, "　 \n"), (1, " x"), (2, "\x1c"), (3, "")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus.chunk_documents(rows).collect()) == [1, 2]


def test_queries_without_a_hit_count(spark):
    base = spark.createDataFrame([(q, r, r) for q in (1, 2) for r in range(4)], "query_id long, rank int, id long")
    found = base.where("query_id = 1")
    assert {r["query_id"]: r["overlap"] for r in ranking.overlap(found, base, 4).collect()} == {1: 1.0, 2: 0.0}


def test_percentiles_by_either_way(spark, monkeypatch):
    rows = spark.createDataFrame([(g, float(v)) for g, n in (("a", 900), (None, 31), ("b", 1)) for v in RNG.integers(0, 200, n)] + [("z", None)], "g string, value double").repartition(3)
    whole = sorted(map(repr, telemetry.rounded_percentiles(rows, ["g"]).orderBy("g").collect()))
    monkeypatch.setattr(telemetry, "WHOLE", 100)
    sketched = telemetry.rounded_percentiles(rows, ["g"]).orderBy("g").collect()
    exact = telemetry._sorted_percentiles(rows, ["g"], "value", (0.5, 0.95, 0.99)).orderBy("g").collect()
    assert len(whole) == len(sketched) == 3
    for a, b in zip(sketched, exact, strict=True):
        assert a["n"] == b["n"] and all(a[c] == pytest.approx(b[c]) for c in ("mean", "std", "p50", "p95", "p99"))


def test_groups_met_by_broadcast_and_by_shuffle(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 40 if k % 9 else None, k) for k in range(400)], "g long, k long")
    groups = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    near = sorted(map(tuple, near_module.with_group(rows, groups, ["g"]).select("k", "n").collect()))
    monkeypatch.setattr(near_module, "FEW", 3)
    assert sorted(map(tuple, near_module.with_group(rows, groups, ["g"]).select("k", "n").collect())) == near and len(near) == 400

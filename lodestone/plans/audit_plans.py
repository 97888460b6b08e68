"""Queries on leakage audits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import audits as A
from lodestone.operators.nearest import nearest
from lodestone.plans import fixtures as X
from lodestone.plans.registry import query, r6, sql6, table
from lodestone.plans.vector_plans import TOP, snapshots

GUESS = "g AS (SELECT o_orderkey, o_custkey % 7 AS truth, (o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) % 7 AS predicted FROM orders)"


def guesses(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 7).alias("truth"), ((F.col("o_custkey") + (F.col("o_orderkey") % 3 == 0).cast("int")) % 7).alias("predicted"))


@query("a01_top1_rate", f"WITH {GUESS} SELECT {sql6('avg(CASE WHEN truth = predicted THEN 1 ELSE 0 END)')} AS top1 FROM g")
def a01(spark, sf):
    return A.top1_rate(guesses(spark, sf)).withColumn("top1", r6("top1"))


TRUTH = "tr AS (SELECT query_id, arg_min(id, rank) AS truth FROM ranked WHERE rank = query_id % 12 GROUP BY query_id)"


def truths(spark, sf, near):
    return near.where("rank = query_id % 12").select("query_id", F.col("id").alias("truth"))


@query("a02_topk_rate", f"{TOP}, {TRUTH} SELECT count(*) AS n, {sql6('avg(CASE WHEN rank < 1 THEN 1 ELSE 0 END)')} AS top1, {sql6('avg(CASE WHEN rank < 10 THEN 1 ELSE 0 END)')} AS top10 FROM tr JOIN ranked r ON r.query_id = tr.query_id AND r.id = truth")
def a02(spark, sf):
    near = nearest(X.queries(spark, sf), X.corpus(spark, sf), 20, other=True)
    return A.topk_rate(near, truths(spark, sf, near)).withColumns({"top1": r6("top1"), "top10": r6("top10")})


@query("a03_risk_level", "SELECT c_custkey, CASE WHEN r IS NULL THEN 'unknown' WHEN r >= 0.3 THEN 'high' WHEN r >= 0.1 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal / 20000 END AS r FROM customer)")
def a03(spark, sf):
    rate = F.when(F.col("c_custkey") % 10 == 0, None).otherwise(F.col("c_acctbal") / 20000)
    return table(spark, sf, "customer").select("c_custkey", A.risk_level(rate).alias("risk"))


def split_sql(source: str, key: str, sizes: str, names: tuple[str, ...] = ("train", "validation", "test"), seed: int = 0) -> str:
    """SQL: (key, split) of the distinct-key table ``source``; ``sizes`` are the sizes of all splits but the last, of the total n."""
    order = f"row_number() OVER (ORDER BY ('0x' || substr(md5('{seed}|' || {key}), 1, 15))::BIGINT, {key})"
    sizes = sizes.split(";")
    cases = " ".join(f"WHEN k <= {' + '.join(sizes[: i + 1])} THEN '{name}'" for i, name in enumerate(names[:-1]))
    return f"SELECT {key}, CASE {cases} ELSE '{names[-1]}' END AS split FROM (SELECT {key}, {order} AS k, count(*) OVER () AS n FROM {source})"


THREE = "greatest(floor(n * 0.7), least({0}, n - 2));greatest(floor(n * 0.15), 1)"


@query("a04_split_rows", split_sql("documents", "doc_id", THREE.format(4)))
def a04(spark, sf):
    return A.split_rows(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("a05_split_by_label", f"WITH d AS (SELECT DISTINCT c_nationkey FROM customer), s AS ({split_sql('d', 'c_nationkey', THREE.format(2))}) SELECT c_custkey, c_nationkey, split FROM customer JOIN s USING (c_nationkey)")
def a05(spark, sf):
    return A.split_by_label(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey")


def conversations(spark, sf):
    """(prompt, tokens): words of each turn as numbers, which are the word's CRC32 modulo 2^31."""
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("prompt"), F.split("text", " ").alias("w"))
    return rows.select("prompt", F.transform("w", lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long")).alias("tokens"))


def swapped(rows):
    return rows.withColumn("tokens", F.transform("tokens", lambda t: t * 3 + 7))


TOKENS = "k AS (SELECT conv_id * 100 + turn AS prompt, list_transform(string_split(text, ' '), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT) AS tokens FROM conversations)"


@query("a06_split_by_prompt", f"WITH {TOKENS}, s AS ({split_sql('k', 'prompt', 'greatest(floor(n * 0.75), 1)', ('train', 'test'))}) SELECT prompt, split FROM s JOIN k USING (prompt) WHERE len(tokens) > 0")
def a06(spark, sf):
    return A.split_by_prompt(conversations(spark, sf), "prompt", "tokens").select("prompt", "split")


@query("a07_token_frequencies", f"WITH {TOKENS}, t AS (SELECT unnest(tokens) AS token FROM k) SELECT token, count(*) AS n, {sql6('count(*) / (SELECT count(*) FROM t)')} AS share FROM t GROUP BY token")
def a07(spark, sf):
    return A.token_frequencies(conversations(spark, sf)).withColumn("share", r6("share"))


FREQ = f"WITH {TOKENS}, t AS (SELECT unnest(tokens) AS token, prompt FROM k), r AS (SELECT token AS id, round(count(*) / (SELECT count(*) FROM t), 12) AS b FROM t GROUP BY token), o AS (SELECT token * 3 + 7 AS query_id, token AS truth, round(count(*) / (SELECT count(*) FROM t WHERE prompt % 2 = 0), 12) AS a FROM t WHERE prompt % 2 = 0 GROUP BY token), d AS (SELECT query_id, truth, id, row_number() OVER (PARTITION BY query_id ORDER BY round(abs(a - b), 9), id) - 1 AS rank FROM o, r), p AS (SELECT o.query_id, d.rank FROM o LEFT JOIN d ON d.query_id = o.query_id AND d.id = o.truth AND d.rank < 100)"


@query("a08_frequency_matching", f"{FREQ} SELECT count(*) AS n, {', '.join(f'''{sql6(f'avg(CASE WHEN rank < {k} THEN 1 ELSE 0 END)')} AS top{k}''' for k in (1, 10, 100))} FROM p")
def a08(spark, sf):
    rows = conversations(spark, sf)
    observed = swapped(rows.where("prompt % 2 = 0"))
    mapping = A.token_frequencies(rows).select((F.col("token") * 3 + 7).alias("observed"), F.col("token").alias("reference"))
    return A.frequency_matching(observed, rows, mapping).select("n", *[r6(f"top{k}").alias(f"top{k}") for k in (1, 10, 100)])


@query("a09_bigram_counts", f"WITH {TOKENS}, b AS (SELECT unnest(list_zip(tokens[:len(tokens) - 1], tokens[2:])) AS p FROM k WHERE len(tokens) > 1) SELECT p[1] AS first, p[2] AS second, count(*) AS n FROM b GROUP BY ALL")
def a09(spark, sf):
    return A.bigram_counts(conversations(spark, sf))


@query("a07_token_pool", f"WITH {TOKENS}, t AS (SELECT unnest(tokens) AS token FROM k), c AS (SELECT token, count(*) AS n, {sql6('count(*) / (SELECT count(*) FROM t)')} AS share, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS rank FROM t GROUP BY token) SELECT rank, token, n, share FROM c WHERE rank < 500")
def a07_pool(spark, sf):
    return A.token_pool(conversations(spark, sf), 500).withColumn("share", r6("share"))


def observed(rows):
    """Other numbers for the tokens, of which every fifth is lost."""
    return rows.withColumn("tokens", F.transform("tokens", lambda t, i: F.when(i % 5 == 4, F.lit(7).cast("long")).otherwise(t * 3 + 7)))


SIGNATURES = """o AS (SELECT prompt, list_transform(range(len(tokens)), lambda i: CASE WHEN i % 5 = 4 THEN 7 ELSE tokens[i + 1] * 3 + 7 END) AS tokens FROM k),
 s AS (SELECT side, token, list(n ORDER BY n DESC) AS v FROM (SELECT side, p[1] AS token, p[2] AS after, count(*) AS n FROM (SELECT 'o' AS side, unnest(list_zip(tokens[:len(tokens) - 1], tokens[2:])) AS p FROM o WHERE len(tokens) > 1 UNION ALL SELECT 'r', unnest(list_zip(tokens[:len(tokens) - 1], tokens[2:])) FROM k WHERE len(tokens) > 1) GROUP BY ALL) GROUP BY ALL),
 q AS (SELECT DISTINCT v FROM s WHERE side = 'o'), c AS (SELECT v, min(token) AS id FROM s WHERE side = 'r' GROUP BY v),
 d AS (SELECT q.v, c.id, list_sum(list_transform(range(greatest(len(q.v), len(c.v))), lambda i: (coalesce(q.v[i + 1], 0) - coalesce(c.v[i + 1], 0)) * (coalesce(q.v[i + 1], 0) - coalesce(c.v[i + 1], 0)))) AS far FROM q, c),
 g AS (SELECT v, first(id ORDER BY far, id) AS guess FROM d GROUP BY v),
 m AS (SELECT token, guess FROM s JOIN g USING (v) WHERE side = 'o'),
 x AS (SELECT prompt, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM o)"""


@query("a10_bigram_substitution", f"WITH {TOKENS}, {SIGNATURES} SELECT prompt, count(*) AS n, md5(string_agg(coalesce(guess, token)::VARCHAR, ' ' ORDER BY pos)) AS digest FROM x LEFT JOIN m USING (token) GROUP BY prompt")
def a10(spark, sf):
    rows = conversations(spark, sf)
    return A.bigram_substitution(observed(rows), rows).select("prompt", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join(F.col("tokens").cast("array<string>"), " ")).alias("digest"))


GRAM = lambda n: f"SELECT prompt, array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS g, side, {n} AS n FROM (SELECT *, unnest(range(1, len(w) - {n - 2})) AS i FROM s)"
BLEU = f"WITH {TOKENS}, s AS (SELECT prompt, 'c' AS side, list_transform(range(len(tokens)), lambda i: CASE WHEN i % 5 = 4 THEN 0 ELSE tokens[i + 1] END) AS w FROM k UNION ALL SELECT prompt, 'r', tokens FROM k), g AS ({' UNION ALL '.join(GRAM(n) for n in range(1, 5))}), c AS (SELECT n, prompt, g, count(*) FILTER (side = 'c') AS a, count(*) FILTER (side = 'r') AS b FROM g GROUP BY ALL), o AS (SELECT n, sum(least(a, b)) AS hit, sum(a) AS every FROM c GROUP BY n)"


@query("a11_bleu", f"{BLEU} SELECT {sql6('100 * exp(avg(ln(hit / every)))')} AS bleu, 'elevated' AS risk FROM o")
def a11(spark, sf):
    rows = conversations(spark, sf).select("prompt", F.col("tokens").alias("reference"), F.transform("tokens", lambda t, i: F.when(i % 5 == 4, F.lit(0).cast("long")).otherwise(t)).alias("candidate"))
    return A.corpus_bleu(rows).withColumn("bleu", r6("bleu"))


def protected(spark, sf):
    """Rows with x = the plain vector reversed, scaled and shifted, y = the plain vector."""
    return X.vectors(spark, sf).select(F.col("vec_id").alias("row"), F.transform(F.reverse("v"), lambda x: x * 2 + 0.1).alias("x"), F.col("v").alias("y"), F.col("vec_id").alias("token"), "label")


INVERT = f"WITH {X.E_SQL}, q AS (SELECT vec_id, list_transform(v, lambda x: x + 0.1) AS w, v FROM e WHERE vec_id % 5 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_dot_product(w, e.v) / (sqrt(list_dot_product(w, w)) * sqrt(list_dot_product(e.v, e.v))), 9) AS score FROM q, e), r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM s)"


@query("a12_nearest_inversion", f"{INVERT} SELECT count(*) AS n, {sql6('avg(CASE WHEN rank < 1 THEN 1 ELSE 0 END)')} AS top1, {sql6('avg(CASE WHEN rank < 10 THEN 1 ELSE 0 END)')} AS top10 FROM r WHERE query_id = id")
def a12(spark, sf):
    rows = X.vectors(spark, sf)
    observed = rows.where("vec_id % 5 = 0").select(F.col("vec_id").alias("row"), F.transform("v", lambda x: x + 0.1).alias("vec"), F.col("vec_id").alias("token"))
    out = A.nearest_inversion(observed, rows.select(F.col("vec_id").alias("token"), F.col("v").alias("vec")))
    return out.withColumns({"top1": r6("top1"), "top10": r6("top10")})


@query("a13_ridge_fit", f"WITH {X.E_SQL} SELECT dim, round(2 * regr_slope(v[dim], v[dim] * 2 + 0.1), 4) + 0.0 AS weight FROM e, range(1, 65) r(dim) GROUP BY dim")
def a13(spark, sf):
    """Weights from the reversed dimension, times 2: one for each dimension, as x is that times 2."""
    weights, _ = A.Ridge(protected(spark, sf)).solve(1e-9)
    rows = [(i + 1, float(weights[63 - i, i])) for i in range(64)]
    return spark.createDataFrame(rows, "dim long, w double").select("dim", (F.round(F.col("w") * 2, 4) + F.lit(0.0)).alias("weight"))


@query("a14_ridge_predict", f"WITH {X.E_SQL} SELECT vec_id AS row, round(list_sum(v), 4) + 0.0 AS total FROM e")
def a14(spark, sf):
    from lodestone.functions.vectors import total

    guess = A.ridge_predict(protected(spark, sf), *A.Ridge(protected(spark, sf)).solve(1e-9))
    return guess.select("row", (F.round(total(F.col("predicted")), 4) + F.lit(0.0)).alias("total"))


@query("a15_ridge_inversion")
def a15(spark, sf):
    rows = protected(spark, sf)
    return A.ridge_inversion(rows, rows.select("token", F.col("y").alias("vec")))


@query("a16_anchored_ridge")
def a16(spark, sf):
    rows = protected(spark, sf).withColumns({"anchor": F.col("row") % 2 == 0, "grp": F.col("label") % 3})
    return A.anchored_ridge(rows, "grp")


def two_sides(spark, sf):
    rows = X.vectors(spark, sf).select(F.col("vec_id").alias("id"), F.col("v").alias("vec"))
    return rows.withColumn("vec", F.reverse("vec")), rows


VOTE = f"WITH {X.E_SQL}, l AS (SELECT vec_id, list_sort(v) AS v FROM e), p AS (SELECT vec_id, list_transform(range(16), lambda i: v[round(i * 63 / 15)::INT + 1]) AS w FROM l), f AS (SELECT vec_id, list_transform(w, lambda x: x - list_sum(w) / 16) AS w FROM p), s AS (SELECT a.vec_id AS r, b.vec_id AS c, round(list_dot_product(a.w, b.w) / sqrt(list_dot_product(a.w, a.w) * list_dot_product(b.w, b.w)), 9) AS score FROM f a, f b), z AS (SELECT r, c, (score - avg(score) OVER w) / stddev_pop(score) OVER w AS z FROM s WINDOW w AS (PARTITION BY r)), k AS (SELECT r, c, row_number() OVER (PARTITION BY r ORDER BY round(2 * z, 9) DESC, c) - 1 AS rank FROM z)"


@query("a17_vote_match", f"{VOTE} SELECT r AS query_id, c AS id FROM k WHERE rank = 0")
def a17(spark, sf):
    left, right = two_sides(spark, sf)
    return A.vote_search([(left, right), (left, right)], 1).select("query_id", "id")


def secret_matrix():
    """A full 64 by 64 matrix by a rule that SQL can follow."""
    i, j = np.meshgrid(np.arange(64), np.arange(64), indexing="ij")
    return np.sin(1 + 12.9898 * i + 78.233 * j)


PROJECTED = f"WITH {X.E_SQL}, p AS (SELECT vec_id, list_transform(range(64), lambda j: list_sum(list_transform(range(64), lambda i: v[i + 1] * sin(1 + 12.9898::DOUBLE * i + 78.233::DOUBLE * j)))) AS p FROM e)"
SCALARS = "s AS (SELECT vec_id, list_sum(p) / 64 AS x FROM p), k AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(abs(q.x - c.x), 9) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(abs(q.x - c.x), 9), c.vec_id) - 1 AS rank FROM s q, s c)"


@query("a18_scalar_invariants", f"{PROJECTED}, {SCALARS} SELECT query_id, rank, id, {sql6('distance')} AS distance FROM k WHERE rank < 3")
def a18(spark, sf):
    from lodestone.operators.nearest import nearest_scalar

    left, right = two_sides(spark, sf)
    m = secret_matrix()
    near = nearest_scalar(A.scalar_invariants(left, m[::-1].copy()).select(F.col("id").alias("query_id"), "value"), A.scalar_invariants(right, m), 3)
    return near.withColumn("distance", r6("distance"))


ENERGIES = "b AS (SELECT vec_id, list_transform(range(4), lambda b: list_sum(list_transform(p[16 * b + 1:16 * b + 16], lambda x: x * x))) AS e FROM p), k AS (SELECT q.vec_id AS query_id, c.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, c.e), c.vec_id) - 1 AS rank FROM b q, b c)"


@query("a19_block_energies", f"{PROJECTED}, {ENERGIES} SELECT query_id, rank, id FROM k WHERE rank < 3")
def a19(spark, sf):
    left, right = two_sides(spark, sf)
    m = secret_matrix()
    return nearest(A.block_energies(left, m[::-1].copy()).withColumnRenamed("id", "query_id"), A.block_energies(right, m), 3, "l2").select("query_id", "rank", "id")


BY = ["prompt_idx", "layer", "kind"]
SNAP = f"WITH {X.E_SQL}, o AS (SELECT vec_id, vec_id // 10 AS p, label % 2 AS kd, v, list_transform(range(64), lambda i: v[i + 1] * (1 + i % 3)) AS w FROM e)"
GRAMS = f"{SNAP}, g AS (SELECT a.p, a.kd, list_dot_product(a.w, b.w) AS x, list_dot_product(a.v, b.v) AS y FROM o a JOIN o b ON a.p = b.p AND a.kd = b.kd), d AS (SELECT p, kd, sqrt(greatest(2 - 2 * sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 0)) AS distance FROM g GROUP BY ALL)"


def stretched(spark, sf):
    return snapshots(spark, sf).withColumn("vec", F.transform("vec", lambda x, i: x * (1 + i % 3)))


@query("a20_gram_fingerprints", f"{GRAMS} SELECT p AS prompt_idx, 'k' || kd AS kind, {sql6('distance')} AS distance FROM d")
def a20(spark, sf):
    return A.gram_fingerprints(stretched(spark, sf), snapshots(spark, sf), BY).select("prompt_idx", "kind", r6("distance").alias("distance"))


@query("a21_column_gram_error", f"{SNAP}, c AS (SELECT p, kd, i, j, sum(v[i] * v[j]) AS y, sum(w[i] * w[j]) AS x FROM o, range(1, 65) r(i), range(1, 65) s(j) GROUP BY ALL) SELECT p AS prompt_idx, 'k' || kd AS kind, {sql6('sqrt(sum((x - y) * (x - y)) / sum(y * y))')} AS error FROM c GROUP BY p, kd")
def a21(spark, sf):
    return A.column_gram_error(stretched(spark, sf), snapshots(spark, sf), BY).select("prompt_idx", "kind", r6("error").alias("error"))


@query("a22_spectrum_error")
def a22(spark, sf):
    return A.spectrum_error(stretched(spark, sf), snapshots(spark, sf), BY).select("prompt_idx", "kind", "error")


@query("a23_fingerprint_risk", f"{GRAMS}, m AS (SELECT 'k' || kd AS kind, median(distance) AS m FROM d GROUP BY 1) SELECT kind, {sql6('m')} AS median, CASE WHEN 1 - m / sqrt(2) >= 0.3 THEN 'high' WHEN 1 - m / sqrt(2) >= 0.1 THEN 'medium' ELSE 'low' END AS risk FROM m")
def a23(spark, sf):
    d = A.gram_fingerprints(stretched(spark, sf), snapshots(spark, sf), BY)
    return A.fingerprint_risk(d, ["kind"]).withColumn("median", r6("median"))


@query("a24_group_signatures")
def a24(spark, sf):
    blocks = lambda rows: A.singular_values(rows.withColumn("block", F.col("prompt_idx")), ["layer", "block"], 4)
    return A.signature_hits(blocks(stretched(spark, sf)), blocks(snapshots(spark, sf)), ["layer"])


@query("a25_magnitude_signatures", f"{SNAP} SELECT p AS prompt_idx, {sql6('sum((vec_id % 10 + 1) * sqrt(list_dot_product(w, w)))')} AS weighted FROM o GROUP BY 1")
def a25(spark, sf):
    from lodestone.functions.vectors import total

    sig = A.magnitude_signatures(stretched(spark, sf), ["prompt_idx"])
    return sig.select("prompt_idx", r6(total(F.transform("vector", lambda x, i: x * (i + 1)))).alias("weighted"))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")  # the conditions are all there are


def matrix(spark, sf):
    seg = table(spark, sf, "customer")
    parts = {s: seg.where(F.col("c_mktsegment") == s) for s in SEGMENTS}
    def broken(df):
        raise ValueError("no such audit")
    return A.audit_matrix(parts, {"mean": lambda d: d.agg(F.avg("c_acctbal").alias("value")), "least": lambda d: d.agg(F.min("c_acctbal").alias("value")), "broken": broken}, {("MACHINERY", "least")})


@query("a26_audit_matrix", f"WITH m AS (SELECT c_mktsegment AS condition, avg(c_acctbal) AS a, min(c_acctbal) AS b FROM customer GROUP BY 1) SELECT condition, 'mean' AS audit, 'ok' AS status, {sql6('a')} AS value FROM m UNION ALL SELECT condition, 'least', CASE condition WHEN 'MACHINERY' THEN 'not_applicable' ELSE 'ok' END, CASE WHEN condition <> 'MACHINERY' THEN {sql6('b')} END FROM m UNION ALL SELECT condition, 'broken', 'unknown: ValueError', NULL FROM m")
def a26(spark, sf):
    return matrix(spark, sf).withColumn("value", r6("value"))


@query("a27_acceptance_gate", "WITH m AS (SELECT c_mktsegment AS condition, avg(c_acctbal) AS a, min(c_acctbal) AS b FROM customer GROUP BY 1) SELECT condition, (a <= 5000)::VARCHAR AS mean_ok, 'false' AS broken_ok, CASE WHEN condition <> 'MACHINERY' THEN (b BETWEEN -1000 AND 0)::VARCHAR END AS least_in_band FROM m")
def a27(spark, sf):
    gate = A.acceptance_gate(matrix(spark, sf), {"mean": 5000.0, "broken": 1.0}, {"least": (-1000.0, 0.0)})
    return gate.select("condition", *[F.col(c).cast("string").alias(c) for c in gate.columns[1:]])


@query("a28_seed_summary", f"SELECT s_nationkey, count(*) AS seeds, {sql6('avg(s_acctbal)')} AS mean, {sql6('coalesce(stddev_samp(s_acctbal), 0)')} AS std FROM supplier GROUP BY 1")
def a28(spark, sf):
    return A.seed_summary(table(spark, sf, "supplier"), ["s_nationkey"], "s_acctbal").withColumns({"mean": r6("mean"), "std": r6("std")})


FEATURES = "f AS (SELECT c_nationkey, avg(c_acctbal) AS mean, stddev_pop(c_acctbal) AS std, min(c_acctbal) AS min, max(c_acctbal) AS max, median(c_acctbal) AS median FROM customer GROUP BY 1), t AS (SELECT c_nationkey, avg(c_acctbal) AS top5 FROM (SELECT c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS n FROM customer) WHERE n <= 5 GROUP BY 1)"
NAMES = ("mean", "std", "min", "max", "median", "top5")


@query("a29_feature_aggregates", f"WITH {FEATURES} SELECT c_nationkey, {', '.join(f'{sql6(n)} AS {n}' for n in NAMES)} FROM f JOIN t USING (c_nationkey)")
def a29(spark, sf):
    return A.feature_aggregates(table(spark, sf, "customer"), ["c_nationkey"], "c_acctbal").select("c_nationkey", *[r6(n).alias(n) for n in NAMES])


@query("a30_feature_correlations", f"WITH {FEATURES}, j AS (SELECT * FROM f JOIN t USING (c_nationkey)) {' UNION ALL '.join(f'''SELECT '{n}' AS feature, {sql6(f'corr({n}, c_nationkey)')} AS r FROM j''' for n in NAMES)}")
def a30(spark, sf):
    rows = A.feature_aggregates(table(spark, sf, "customer"), ["c_nationkey"], "c_acctbal")
    return A.feature_correlations(rows, list(NAMES), "c_nationkey").withColumn("r", r6("r"))


@query("a31_gap_clusters", f"WITH m AS (SELECT c_nationkey, c_acctbal AS v, CASE WHEN c_acctbal - lag(c_acctbal) OVER w > 400 THEN 1 ELSE 0 END AS new FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal)), n AS (SELECT c_nationkey, v, sum(new) OVER (PARTITION BY c_nationkey ORDER BY v ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM m) SELECT c_nationkey, cluster, count(*) AS size, {sql6('min(v)')} AS low, {sql6('max(v)')} AS high FROM n GROUP BY ALL")
def a31(spark, sf):
    rows = A.gap_clusters(table(spark, sf, "customer"), ["c_nationkey"], "c_acctbal", 400)
    return rows.select("c_nationkey", "cluster", "size", r6("low").alias("low"), r6("high").alias("high"))


SPANS = """WITH RECURSIVE v AS (SELECT c_nationkey AS g, c_acctbal::DOUBLE AS v FROM customer),
 s AS (SELECT g, min(v) AS low, 0::BIGINT AS cluster FROM v GROUP BY g
       UNION ALL SELECT s.g, min(v.v), any_value(s.cluster) + 1 FROM s JOIN v ON v.g = s.g AND v.v - s.low > 400 GROUP BY s.g)
 SELECT s.g AS c_nationkey, cluster, count(*) AS size, round(low, 6) + 0.0 AS low FROM s JOIN v ON v.g = s.g AND v.v >= low AND v.v - low <= 400 GROUP BY ALL"""


@query("a32_span_clusters", SPANS)
def a32(spark, sf):
    return A.span_clusters(table(spark, sf, "customer"), ["c_nationkey"], "c_acctbal", 400).withColumns({"cluster": F.col("cluster").cast("long"), "low": r6("low")})


COVERAGE = f"""WITH RECURSIVE
 p AS (SELECT l_quantity AS g, eps, (l_discount + l_tax) / 2 AS m, abs(l_discount - l_tax) < eps AS same
       FROM (SELECT l_quantity, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax, unnest([0.01, 0.05, 0.1, 0.25]::DOUBLE[]) AS eps FROM lineitem)),
 v AS (SELECT g, eps, m, count(*) AS c FROM p WHERE same GROUP BY ALL),
 s AS (SELECT g, eps, min(m) AS low FROM v GROUP BY g, eps
       UNION ALL SELECT s.g, s.eps, min(v.m) FROM s JOIN v ON v.g = s.g AND v.eps = s.eps AND v.m - s.low > s.eps GROUP BY s.g, s.eps),
 k AS (SELECT s.g, s.eps, s.low, sum(c) AS size FROM s JOIN v ON v.g = s.g AND v.eps = s.eps AND v.m >= s.low AND v.m - s.low <= s.eps GROUP BY ALL),
 h AS (SELECT g, eps, sum(size) AS held FROM k WHERE size >= 8 GROUP BY ALL),
 q AS (SELECT g, eps, 100 * avg(same::INT) AS shared, 100.0 * coalesce(any_value(held), 0) / count(*) AS coverage FROM p LEFT JOIN h USING (g, eps) GROUP BY ALL)
 SELECT g AS l_quantity, eps, {sql6("shared")} AS symmetric, {sql6("coverage")} AS coverage,
        CASE WHEN coverage >= 50 THEN 'viable' WHEN coverage >= 25 THEN 'marginal' ELSE 'dead' END AS verdict FROM q"""


@query("a33_cluster_coverage", COVERAGE)
def a33(spark, sf):
    """Pairs of a line's discount and tax, which are multiples of 0.01, by quantity."""
    pairs = table(spark, sf, "lineitem").select("l_quantity", F.col("l_discount").alias("a"), F.col("l_tax").alias("b"))
    return A.pair_coverage(pairs, ["l_quantity"]).withColumns({"symmetric": r6("symmetric"), "coverage": r6("coverage")})


EPS = "unnest([0.01, 0.05, 0.1, 0.25]::DOUBLE[])"


@query("a33_symmetric_pairs", f"SELECT l_quantity, eps, {sql6('100 * avg(CASE WHEN abs(l_discount - l_tax) < eps THEN 1 ELSE 0 END)')} AS symmetric FROM (SELECT l_quantity, l_discount, l_tax, {EPS} AS eps FROM lineitem) GROUP BY ALL")
def a33_pairs(spark, sf):
    return a33(spark, sf).select("l_quantity", "eps", r6("symmetric").alias("symmetric"))


@query("a34_paired_cosines", f"WITH {X.E_SQL}, p AS (SELECT list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS c FROM e a JOIN e b ON b.vec_id = a.vec_id + 1) SELECT {sql6('avg(c)')} AS mean, {sql6('stddev_pop(c)')} AS std, {sql6('quantile_cont(c, 0.1)')} AS p10, {sql6('quantile_cont(c, 0.9)')} AS p90 FROM p")
def a34(spark, sf):
    from lodestone.plans.vector_plans import pairs

    return A.paired_cosines(pairs(spark, sf)).select(*[r6(c).alias(c) for c in ("mean", "std", "p10", "p90")])


CELLS = "c AS (SELECT l_orderkey AS prompt, l_linenumber AS head, l_linenumber % 3 AS q, l_quantity % 3 AS kv, l_quantity AS value FROM lineitem)"


def cells(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("prompt"), F.col("l_linenumber").alias("head"), (F.col("l_linenumber") % 3).alias("q"), (F.col("l_quantity") % 3).alias("kv"), F.col("l_quantity").alias("value"))


@query("a35_flatten_heads", f"WITH {CELLS}, n AS (SELECT prompt, q, value, row_number() OVER (PARTITION BY prompt, q ORDER BY head, kv, value) AS k FROM c) SELECT prompt, q, {sql6('sum(CASE WHEN k <= 4 THEN k * value ELSE 0 END)')} AS weighted FROM n GROUP BY ALL")
def a35(spark, sf):
    from lodestone.functions.vectors import total

    flat = A.flatten_heads(cells(spark, sf), 4)
    return flat.select("prompt", "q", r6(total(F.transform("vector", lambda x, i: x * (i + 1)))).alias("weighted"))


@query("a36_head_summary", f"WITH {CELLS}, h AS (SELECT head, avg(value) AS v FROM c GROUP BY 1) SELECT {sql6('min(v)')} AS min, {sql6('median(v)')} AS median, {sql6('avg(v)')} AS mean, {sql6('quantile_cont(v, 0.9)')} AS p90, {sql6('max(v)')} AS max, (SELECT head FROM h ORDER BY v DESC, head LIMIT 1) AS best_head FROM h")
def a36(spark, sf):
    return A.head_summary(cells(spark, sf)).select(*[r6(c).alias(c) for c in ("min", "median", "mean", "p90", "max")], "best_head")


STATS = ("plain_mean", "plain_std", "plain_min", "plain_max", "protected_mean", "protected_std", "protected_min", "protected_max", "max_diff", "median_diff", "r", "equal")


@query("a37_compare_values", f"WITH x AS (SELECT l_orderkey % 50 AS prompt, l_extendedprice / 1000 AS plain, l_extendedprice / 1000 + l_tax AS protected FROM lineitem) SELECT prompt, {', '.join(f'{sql6(f)} AS {n}' for n, f in zip(STATS, [f'{f}({s})' for s in ('plain', 'protected') for f in ('avg', 'stddev_pop', 'min', 'max')] + ['max(abs(plain - protected))', 'median(abs(plain - protected))', 'corr(plain, protected)', 'avg(CASE WHEN abs(plain - protected) <= 1e-4 THEN 1 ELSE 0 END)'], strict=True))} FROM x GROUP BY 1")
def a37(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).alias("prompt"), (F.col("l_extendedprice") / 1000).alias("plain"), (F.col("l_extendedprice") / 1000 + F.col("l_tax")).alias("protected"))
    return A.compare_values(rows, "prompt").select("prompt", *[r6(c).alias(c) for c in STATS])


@query("a38_label_repetition", f"WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT sum(n)::BIGINT AS total, count(*) AS \"distinct\", {sql6('median(n)')} AS median, {sql6('avg(n)')} AS mean, max(n) AS max, array_to_string(list_reverse_sort(list(n))[1:10], ',') AS largest FROM n")
def a38(spark, sf):
    return A.label_repetition(table(spark, sf, "orders"), "o_custkey").withColumns({"median": r6("median"), "mean": r6("mean"), "largest": F.array_join(F.col("largest").cast("array<string>"), ",")})


LEAK = " UNION ALL ".join(f"SELECT {seed} AS seed, split, o_custkey FROM ({split_sql('orders', 'o_orderkey', THREE.format(4), seed=seed)}) JOIN orders USING (o_orderkey)" for seed in range(3))


@query("a38_split_leakage", f"WITH t AS ({LEAK}), r AS (SELECT DISTINCT seed, o_custkey FROM t WHERE split = 'train') SELECT t.seed, count(*) AS n, {sql6('avg(CASE WHEN r.seed IS NULL THEN 0.0 ELSE 1.0 END)')} AS leak FROM t LEFT JOIN r ON r.seed = t.seed AND r.o_custkey = t.o_custkey WHERE split = 'test' GROUP BY t.seed")
def a38_leak(spark, sf):
    return A.split_leakage(table(spark, sf, "orders"), "o_orderkey", "o_custkey", seeds=(0, 1, 2)).withColumn("leak", r6("leak"))

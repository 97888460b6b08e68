"""Queries on reranking and ranking measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.operators import ranking as R
from lodestone.operators.graph_search import cell_search, two_phase_search
from lodestone.operators.nearest import nearest
from lodestone.plans import fixtures as X
from lodestone.plans.registry import query, r6, sql6, table
from lodestone.plans.vector_plans import CODES, DEQ, TOP

RULES = f"{TOP}, {X.QRELS_SQL}"
DCG = "SELECT r.query_id, sum((2.0 ** coalesce(j.rel, 0) - 1) / log2(r.rank + 2)) AS dcg FROM ranked r LEFT JOIN qrels j ON j.query_id = r.query_id AND j.doc_id = r.id WHERE r.rank < 10 GROUP BY 1"
IDEAL = "SELECT query_id, sum((2.0 ** rel - 1) / log2(n + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS n FROM qrels) WHERE n <= 10 GROUP BY 1"
ALL = "all_q AS (SELECT DISTINCT query_id FROM ranked)"
NDCG = f"nd AS (SELECT d.query_id, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END AS ndcg FROM ({DCG}) d LEFT JOIN ({IDEAL}) i USING (query_id))"
RECALL = "rc AS (SELECT a.query_id, coalesce((SELECT count(*) FROM ranked r JOIN qrels j ON j.query_id = r.query_id AND j.doc_id = r.id WHERE r.rank < 10 AND r.query_id = a.query_id) / nullif((SELECT count(*) FROM qrels j WHERE j.query_id = a.query_id), 0), 0.0) AS recall FROM all_q a)"
MRR = "mr AS (SELECT a.query_id, coalesce(1.0 / (min(r.rank) + 1), 0.0) AS mrr FROM all_q a LEFT JOIN (SELECT r.query_id, r.rank FROM ranked r JOIN qrels j ON j.query_id = r.query_id AND j.doc_id = r.id WHERE r.rank < 10) r USING (query_id) GROUP BY 1)"
HINT = f"hinted AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY hint DESC, id) - 1 AS rank FROM (SELECT q.vec_id AS query_id, t.vec_id AS id, round(list_dot_product({DEQ}, q.v), 9) AS hint FROM t JOIN e q ON {X.asked('q', 't')}))"
WITH_HINT = f"{CODES}, {X.RANK_SQL}, {HINT}"


def ranking(spark, sf, k=10):
    return nearest(X.queries(spark, sf), X.corpus(spark, sf), k, other=True)


def hinted(spark, sf, k=10):
    coded = X.corpus(spark, sf).select("id", V.dequantize_4bit(V.quantize_4bit(F.col("vector"))).alias("vector"))
    return nearest(X.queries(spark, sf), coded, k, "dot", other=True)


@query("r01_rerank", f"{TOP}, s AS (SELECT r.query_id, r.id, round(score + CASE WHEN q.label = c.label THEN 1 ELSE 0 END, 9) AS score FROM ranked r JOIN e q ON q.vec_id = r.query_id JOIN e c ON c.vec_id = r.id WHERE rank < 30), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM s) SELECT query_id, rank, id, {sql6('score')} AS score FROM o WHERE rank < 10")
def r01(spark, sf):
    score = lambda rows: rows["first_score"] + (rows["q_label"] == rows["label"]).cast("int")
    return R.retrieve_then_rerank(X.queries(spark, sf), X.corpus(spark, sf), 30, 10, score, other=True).withColumn("score", r6("score"))


@query("r02_yes_no", f"SELECT c_custkey, {sql6('exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b)))')} AS score FROM (SELECT c_custkey, c_acctbal / 1000 AS a, c_nationkey / 10 AS b FROM customer)")
def r02(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", r6(R.yes_no_score(F.col("c_acctbal") / 1000, F.col("c_nationkey") / 10)).alias("score"))


@query("r03_rank_ties", "WITH s AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'nan'::DOUBLE ELSE floor(o_totalprice / 100000) END AS score FROM orders) SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY isnan(score), score DESC, md5('key|' || o_orderkey), o_orderkey) - 1 AS rank FROM s")
def r03(spark, sf):
    score = F.when(F.col("o_orderkey") % 13 == 0, F.lit(float("nan"))).otherwise(F.floor(F.col("o_totalprice") / 100000).cast("double"))
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", score.alias("score"))
    return R.rank_with_shuffled_ties(rows, ["o_custkey"], "score", "o_orderkey", "key").drop("score")


@query("r04_top_k_check", f"{TOP} SELECT query_id, id FROM ranked WHERE rank < 3")
def r04(spark, sf):
    R.check_top_k(3, 10)
    return ranking(spark, sf, 3).select("query_id", "id")


@query("r05_padded_results", f"{TOP} SELECT query_id, rank, id, {sql6('score')} AS score FROM ranked WHERE rank < query_id % 5")
def r05(spark, sf):
    key = b"0123456789abcdef"
    padded = R.padded_results(ranking(spark, sf, 5).where("rank < query_id % 5"), X.queries(spark, sf), 8, key)
    return R.opened_results(padded, key).withColumn("score", r6("score"))


@query("e01_dcg", f"{RULES} SELECT query_id, {sql6('dcg')} AS dcg FROM ({DCG})")
def e01(spark, sf):
    return R.dcg(ranking(spark, sf), X.qrels(spark, sf), 10).withColumn("dcg", r6("dcg"))


@query("e02_ideal_dcg", f"{RULES} SELECT query_id, {sql6('idcg')} AS idcg FROM ({IDEAL})")
def e02(spark, sf):
    return R.ideal_dcg(X.qrels(spark, sf), 10).withColumn("idcg", r6("idcg"))


@query("e03_ndcg", f"{RULES}, {NDCG} SELECT query_id, {sql6('ndcg')} AS ndcg FROM nd")
def e03(spark, sf):
    return R.ndcg(ranking(spark, sf), X.qrels(spark, sf), 10).withColumn("ndcg", r6("ndcg"))


@query("e04_recall", f"{RULES}, {ALL}, {RECALL} SELECT query_id, {sql6('recall')} AS recall FROM rc")
def e04(spark, sf):
    return R.recall(ranking(spark, sf), X.qrels(spark, sf), 10).withColumn("recall", r6("recall"))


@query("e05_mrr", f"{RULES}, {ALL}, {MRR} SELECT query_id, {sql6('mrr')} AS mrr FROM mr")
def e05(spark, sf):
    return R.reciprocal_rank(ranking(spark, sf), X.qrels(spark, sf), 10).withColumn("mrr", r6("mrr"))


@query("e06_top1_agreement", f"{WITH_HINT} SELECT h.query_id, CASE WHEN h.id = r.id THEN 1 ELSE 0 END AS agrees FROM hinted h JOIN ranked r USING (query_id) WHERE h.rank = 0 AND r.rank = 0")
def e06(spark, sf):
    return R.top1_agreement(hinted(spark, sf), ranking(spark, sf))


@query("e07_overlap", f"{WITH_HINT} SELECT h.query_id, {sql6('count(r.id) / 10')} AS overlap FROM hinted h LEFT JOIN ranked r ON r.query_id = h.query_id AND r.id = h.id AND r.rank < 10 WHERE h.rank < 10 GROUP BY 1")
def e07(spark, sf):
    return R.overlap(hinted(spark, sf), ranking(spark, sf), 10).withColumn("overlap", r6("overlap"))


@query("e08_macro_average", f"{RULES}, {ALL}, {NDCG}, {RECALL}, {MRR} SELECT count(*) AS queries, {sql6('avg(ndcg)')} AS ndcg, {sql6('avg(recall)')} AS recall, {sql6('avg(mrr)')} AS mrr FROM nd JOIN rc USING (query_id) JOIN mr USING (query_id) WHERE query_id IN (SELECT query_id FROM qrels)")
def e08(spark, sf):
    means = R.macro_average(ranking(spark, sf), X.qrels(spark, sf))
    return means.select("queries", *[r6(c).alias(c) for c in ("ndcg", "recall", "mrr")])


@query("e09_group_accuracy", f"{TOP} SELECT {sql6('avg(CASE WHEN c.label = q.label THEN 1 ELSE 0 END)')} AS accuracy FROM ranked JOIN e q ON q.vec_id = query_id JOIN e c ON c.vec_id = id WHERE rank = 0")
def e09(spark, sf):
    expected = X.queries(spark, sf).select("query_id", F.col("label").alias("expected"))
    return R.top1_group_accuracy(ranking(spark, sf), X.corpus(spark, sf), expected).select(r6("accuracy").alias("accuracy"))


@query("e10_ann_recall")
def e10(spark, sf):
    found = cell_search(X.queries(spark, sf), X.corpus(spark, sf), 10, probes=0.8, other=True)
    return R.overlap(found, ranking(spark, sf), 10).agg(F.avg("overlap").alias("recall"))


@query("e11_compare", f"{WITH_HINT}, {X.QRELS_SQL}, p AS (SELECT 'exact' AS configuration, query_id, id, rank FROM ranked UNION ALL SELECT 'hints', query_id, id, rank FROM hinted), g AS (SELECT configuration, avg(CASE WHEN rel > 0 THEN 1.0 ELSE 0.0 END) AS value FROM p LEFT JOIN qrels j ON j.query_id = p.query_id AND j.doc_id = p.id WHERE rank < 10 GROUP BY 1) SELECT configuration, 'precision' AS metric, {sql6('value')} AS value, {sql6('''value - (SELECT value FROM g WHERE configuration = 'exact')''')} AS delta FROM g")
def e11(spark, sf):
    rows = None
    for name, made in (("exact", ranking(spark, sf)), ("hints", hinted(spark, sf))):
        rel = X.qrels(spark, sf).select("query_id", F.col("doc_id").alias("id"), "rel")
        one = made.join(rel, ["query_id", "id"], "left").agg(F.avg((F.coalesce("rel", F.lit(0)) > 0).cast("double")).alias("value")).select(F.lit(name).alias("configuration"), F.lit("precision").alias("metric"), "value")
        rows = one if rows is None else rows.union(one)
    return R.compare_configurations(rows, "exact").withColumns({"value": r6("value"), "delta": r6("delta")})


@query("e12_two_phase_recall", f"{CODES}, {X.RANK_SQL}, f AS (SELECT q.vec_id AS query_id, t.vec_id AS id, round(list_dot_product({DEQ}, q.v), 9) AS hint, {X.unit_score('q.v', 't.v')} AS score FROM t JOIN e q ON {X.asked('q', 't')}), g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hint DESC, id) AS n FROM f), h AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM g WHERE n <= 20) SELECT {sql6('count(r.id) / (10.0 * (SELECT count(*) FROM e WHERE vec_id % 50 = 0))')} AS recall FROM h JOIN ranked r ON r.query_id = h.query_id AND r.id = h.id AND r.rank < 10 WHERE h.rank < 10")
def e12(spark, sf):
    found = two_phase_search(X.queries(spark, sf), X.corpus(spark, sf), 20, 10, other=True)
    return R.overlap(found, ranking(spark, sf), 10).agg(r6(F.avg("overlap")).alias("recall"))

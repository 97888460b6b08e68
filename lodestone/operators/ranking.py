"""Rerank, result padding, and measures of rankings.

A ranking is (query_id, rank from 0, id); judgements are (query_id, doc_id, rel), unjudged is 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.stored import stored
from lodestone.operators.nearest import DECIMALS, nearest, ranked


def check_top_k(top_k: int, k_max: int) -> None:
    if not 0 < top_k <= k_max:
        raise ValueError(f"top_k must be in 1..{k_max}, not {top_k}")


def yes_no_score(yes: Column, no: Column) -> Column:
    """Softmax share of "yes", shifted by the larger logit."""
    top = F.greatest(yes, no)
    return F.exp(yes - top) / (F.exp(yes - top) + F.exp(no - top))


def retrieve_then_rerank(queries: DataFrame, corpus: DataFrame, first: int, k: int, score: Callable[[DataFrame], Column], other: bool = False) -> DataFrame:
    """(query_id, rank, id, score): the ``first`` best by cosine, re-scored by ``score``, the ``k`` best.

    ``score`` gets the joined rows (columns of the query and q_ prefixed ones of the corpus row, and
    the first score as ``first_score``) and returns a column: an expression or a pandas UDF.
    """
    check_top_k(k, first)
    hits = nearest(queries, corpus, first, other=other).select("query_id", "id", F.col("score").alias("first_score"))
    q = queries.select("query_id", *[F.col(c).alias(f"q_{c}") for c in queries.columns if c != "query_id"])
    rows = hits.join(q, "query_id").join(corpus, "id")
    scored = rows.select("query_id", "id", F.round(score(rows), DECIMALS).alias("score"))
    return ranked(scored, ["query_id"], [F.desc("score"), "id"], k).select("query_id", "rank", "id", "score")


def rank_with_shuffled_ties(rows: DataFrame, by: list[str], score: str, item: str, key: str) -> DataFrame:
    """``rank`` from 0 in each group: NaN last, larger scores first, equal ones by a keyed hash of the item."""
    tie = F.md5(F.concat_ws("|", F.lit(key), F.col(item).cast("string")))
    return ranked(rows, by, [F.isnan(score).asc(), F.desc(score), tie, F.col(item)])


def padded_results(results: DataFrame, queries: DataFrame, k_max: int, key: bytes) -> DataFrame:
    """(query_id, slot, payload): every query has ``k_max`` encrypted rows in an order that hides rank.

    Results (query_id, rank, id, score) fill the first ranks and decoys the others.
    """
    slots = queries.select("query_id").distinct().withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(k_max - 1))))
    full = slots.join(results.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score"), ["query_id", "rank"], "left")
    body = F.to_json(F.struct("rank", F.coalesce("id", F.lit(-1).cast("long")).alias("id"), F.coalesce("score", F.lit(0.0)).alias("score"), F.col("id").isNull().alias("decoy")))
    order = F.sha2(F.concat(F.lit(key), F.concat_ws("/", "query_id", "rank").cast("binary")), 256)
    return ranked(full.withColumns({"body": body, "order": order}), ["query_id"], ["order"], rank="slot").select("query_id", "slot", F.aes_encrypt(F.rpad("body", 120, " "), F.lit(key), F.lit("GCM")).alias("payload"))


def opened_results(padded: DataFrame, key: bytes) -> DataFrame:
    """Results again from :func:`padded_results`."""
    body = F.from_json(F.rtrim(F.aes_decrypt("payload", F.lit(key), F.lit("GCM")).cast("string")), "rank int, id long, score double, decoy boolean")
    return padded.select("query_id", body.alias("b")).where("not b.decoy").select("query_id", "b.rank", "b.id", "b.score")


def gain(rel: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + F.lit(2.0))


def dcg(ranking: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, dcg) for each query of the ranking."""
    judged = ranking.where(F.col("rank") < k).join(qrels.select("query_id", F.col("doc_id").alias("id"), "rel"), ["query_id", "id"], "left")
    return judged.groupBy("query_id").agg(F.sum(gain(F.coalesce("rel", F.lit(0)), F.col("rank"))).alias("dcg"))


def ideal_dcg(qrels: DataFrame, k: int) -> DataFrame:
    best = ranked(qrels, ["query_id"], [F.desc("rel"), "doc_id"], k)
    return best.groupBy("query_id").agg(F.sum(gain(F.col("rel"), F.col("rank"))).alias("idcg"))


def ndcg(ranking: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    both = dcg(ranking, qrels, k).join(ideal_dcg(qrels, k), "query_id", "left")
    return both.select("query_id", F.when(F.col("idcg") > 0, F.col("dcg") / F.when(F.col("idcg") > 0, F.col("idcg"))).otherwise(0.0).alias("ndcg"))


def recall(ranking: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Share of a query's positive judgements in its first ``k``; 0 without positives."""
    positive = qrels.where("rel > 0")
    found = ranking.where(F.col("rank") < k).join(positive.select("query_id", F.col("doc_id").alias("id")), ["query_id", "id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    every = ranking.select("query_id").distinct().join(positive.groupBy("query_id").agg(F.count(F.lit(1)).alias("all")), "query_id", "left").join(found, "query_id", "left")
    return every.select("query_id", F.coalesce(F.col("found") / F.col("all"), F.lit(0.0)).alias("recall"))


def reciprocal_rank(ranking: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    hits = ranking.where(F.col("rank") < k).join(qrels.where("rel > 0").select("query_id", F.col("doc_id").alias("id")), ["query_id", "id"])
    first = hits.groupBy("query_id").agg(F.min("rank").alias("first"))
    return ranking.select("query_id").distinct().join(first, "query_id", "left").select("query_id", F.coalesce(1 / (F.col("first") + 1), F.lit(0.0)).alias("mrr"))


def top1_agreement(ranking: DataFrame, baseline: DataFrame) -> DataFrame:
    """(query_id, agrees 0 or 1) for queries in both."""
    a = ranking.where("rank = 0").select("query_id", F.col("id").alias("a"))
    return a.join(baseline.where("rank = 0").select("query_id", F.col("id").alias("b")), "query_id").select("query_id", (F.col("a") == F.col("b")).cast("int").alias("agrees"))


def overlap(ranking: DataFrame, baseline: DataFrame, k: int) -> DataFrame:
    """(query_id, overlap): common items of the two first ``k``, divided by ``k`` always; 0 for a query of which ``ranking`` has nothing."""
    top = lambda r: r.where(F.col("rank") < k).select("query_id", "id")
    common = top(ranking).join(top(baseline), ["query_id", "id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    asked = ranking.select("query_id").union(baseline.select("query_id")).distinct()
    return asked.join(common, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / k).alias("overlap"))


def macro_average(ranking: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """One row of means over the queries that have judgements and a ranking."""
    both = stored(ranking.join(qrels.select("query_id").distinct(), "query_id", "left_semi"), "ranking")  # each measure reads it
    parts = ndcg(both, qrels, k).join(recall(both, qrels, k), "query_id").join(reciprocal_rank(both, qrels, k), "query_id")
    return parts.agg(F.count(F.lit(1)).alias("queries"), F.avg("ndcg").alias("ndcg"), F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"))


def top1_group_accuracy(ranking: DataFrame, labels: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of queries (query_id, expected) whose first hit has the expected label (id, label)."""
    first = ranking.where("rank = 0").join(labels.select("id", "label"), "id")
    return expected.join(first, "query_id").agg(F.avg((F.col("label") == F.col("expected")).cast("int")).alias("accuracy"))


def compare_configurations(metrics: DataFrame, baseline: str) -> DataFrame:
    """(configuration, metric, value, delta): difference to the row of the baseline configuration."""
    base = metrics.where(F.col("configuration") == baseline).select("metric", F.col("value").alias("base"))
    return metrics.join(base, "metric", "left").select("configuration", "metric", "value", (F.col("value") - F.col("base")).alias("delta"))

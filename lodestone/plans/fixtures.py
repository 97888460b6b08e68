"""Inputs derived from the test tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.registry import table

E_SQL = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
# Queries are the rows whose id is divisible by EVERY; each is searched in all rows but itself.
EVERY = 50


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def queries(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("vector"), "label")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select(F.col("vec_id").alias("id"), F.col("v").alias("vector"), "label")


def asked(q: str, c: str) -> str:
    """SQL: the pairs of a query and a candidate."""
    return f"{q}.vec_id % {EVERY} = 0 AND {c}.vec_id <> {q}.vec_id"


def unit_score(a: str, b: str) -> str:
    """SQL: cosine rounded as the rankings round it."""
    return f"round(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))), 9)"


RANK_SQL = f"""
  scored AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {unit_score("q.v", "c.v")} AS score
             FROM e q JOIN e c ON {asked("q", "c")}),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM scored)"""

QRELS_SQL = f"""
  qrels AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, CASE WHEN c.vec_id % 3 = 0 THEN 2 ELSE 1 END AS rel
            FROM e q JOIN e c ON q.label = c.label AND {asked("q", "c")})"""


def qrels(spark: SparkSession, sf: str) -> DataFrame:
    """Same label as the query: grade 2 for ids divisible by 3, else 1."""
    q, c = queries(spark, sf).select("query_id", "label"), corpus(spark, sf).select(F.col("id").alias("doc_id"), "label")
    return q.join(c, "label").where("query_id <> doc_id").select("query_id", "doc_id", F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1).alias("rel"))

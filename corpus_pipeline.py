"""A training-corpus pipeline of five stages over the documents table.

Each stage works on what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import discard, held_out, release, scratch, written
from lodestone.llm.language_id import fit_language_profiles
from lodestone.llm.near_dedup import Settings, near_duplicates
from lodestone.llm.packing import pack_documents
from lodestone.llm.quality import fit_quality
from lodestone.llm.suffix_dedup import remove_spans, repeated_passages

LEAST_COSINE, LEAST_CHARS = 0.1, 200  # a text this long whose best language is this far is in none that is known
LEAST_QUALITY = 0.3


def _new(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and long texts unlike any learned language; ``lang`` becomes the language found."""
    model = fit_language_profiles(docs.where(~held_out()).select("text", "lang"))
    label, score = _new(docs, "label"), _new(docs, "score")
    far = (F.col(score) < LEAST_COSINE) & (F.length("text") >= LEAST_CHARS)
    kept = model.apply(docs, label=label, score=score).where((F.col(label) != "und") & ~far)
    return kept.withColumn("lang", F.col(label)).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose score, the mean of their lines' probabilities of being good, is under ``LEAST_QUALITY``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs.where(~held_out()), labels.where(~held_out()))
    score = _new(docs, "score")
    return model.apply(docs, score=score).where(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def _row() -> Column:
    """Identity of a row: a 64-bit hash of its id and text, either of which may be null."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates (five words, similarity 0.8) and of equal (id, text).

    Rows are told apart by id and text, so texts that share an id or have none are documents of their
    own.  A group keeps its smallest id, null last, and of several texts under it the smallest hash;
    equal rows keep the smallest values of their other columns.
    """
    columns = docs.columns
    rest = [c for c in columns if c not in ("doc_id", "text")]
    carried = F.struct(*rest) if rest else F.struct(F.lit(0))
    rows = docs.select("doc_id", "text", carried.alias("rest"), _row().alias("_row"))
    moved = near_duplicates(rows.select("_row", "text"), key="_row", settings=Settings()).where("not kept")
    moved = written(moved.select("_row", "component_id").distinct(), "moved")
    members = moved.union(moved.select(F.col("component_id").alias("_row"), "component_id").distinct())
    members = members.join(rows.select("_row", "doc_id").distinct(), "_row")
    best = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("best"))
    gone = members.join(best, "component_id").where("_row <> best._row").select("_row")
    again = rows.groupBy("_row").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("_row")
    left = rows.join(gone, "_row", "left_anti")
    once = left.join(again, "_row", "left_anti").select("doc_id", "text", "rest")
    more = left.join(again, "_row", "left_semi").groupBy("doc_id", "text").agg(F.min("rest").alias("rest"))
    return once.union(more).select("doc_id", "text", *(["rest.*"] if rest else [])).select(*columns)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 100 bytes and more that occur earlier; characters stay whole and rows keep their other columns."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    carried = docs.select("doc_id", "text", F.struct(*rest).alias("rest")) if rest else docs
    cut = remove_spans(repeated_passages(carried), whole_characters=True)
    cut = cut.select("doc_id", F.col("kept").cast("string").alias("text"), *(["rest.*"] if rest else []))
    return (cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in rest else cut).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens; documents of which nothing is left go."""
    import public_tokenizers

    return pack_documents(docs.where("text <> ''").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_stage),
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", suffix_stage),
    ("best-fit packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage writes for itself goes once its result is written
            after = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), outlast=True)
        discard(docs)
        release(spark)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)

"""Streaming ingest: append protected chunks, upsert texts, embed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from lodestone.operators.corpus import content_key
from lodestone.operators.protect import encrypted, protect
from lodestone.streaming.bucket_table import BucketTable


def append_protected(chunks: DataFrame, path: str, checkpoint: str, vector_key: bytes, text_key: bytes, embed: Callable[[Column], Column]) -> StreamingQuery:
    """Append a stream of (tenant_id, chunk_id, text) to an index of protected vectors and encrypted texts, by tenant.

    Chunk ids may come again with other texts, so every vector and every text gets a random nonce.
    """
    rows = chunks.select("tenant_id", "chunk_id", embed(F.col("text")).alias("vector"), encrypted(F.col("text"), text_key).alias("ciphertext"))
    out = protect(rows, None, "vector", vector_key, "document")
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("tenant_id").outputMode("append").trigger(availableNow=True).start()


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark keeps in a checkpoint: a new checkpoint is another stream."""
    return spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]


def upsert_texts(spark: SparkSession, texts: DataFrame, path: str, checkpoint: str, key: str = "chunk_id", order: str = "version", buckets: int = 64) -> StreamingQuery:
    """Keep the last write (largest ``order``, among equals the last committed) of each key under ``path``.

    A batch reads and writes only the hash buckets that it touches; :class:`BucketTable` tells how commits
    survive lost drivers, runs that come again, new checkpoints and several writers.
    """
    table = BucketTable(spark, path, texts.schema, key, buckets)

    def merged(fresh: DataFrame, old: DataFrame) -> DataFrame:
        both = fresh.drop("b").withColumn("_new", F.lit(1)).unionByName(old.withColumn("_new", F.lit(0)))
        last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc("_new")))
        return both.withColumn("_n", last).where("_n = 1").drop("_n", "_new")

    def merge(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        table.commit(_stream_id(spark, checkpoint), number, batch.withColumn("b", table.bucket()), merged, replace=True)
        batch.unpersist()

    return texts.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_upserted(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table that :func:`upsert_texts` keeps, for rows of ``schema``."""
    return BucketTable(spark, path, schema, schema.names[0]).rows()


EMBEDDED = T.StructType([T.StructField("content_key", T.StringType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])


def embed_once(texts: DataFrame, path: str, checkpoint: str, model: str, embed: Callable[[Column], Column], buckets: int = 64) -> StreamingQuery:
    """Add (content_key, embedding) for texts whose key has not been seen; the seen keys are the table itself.

    The stream has no state of its own: a batch looks for its keys in the buckets that they fall into, and
    embeds what is missing.  The table outlives checkpoints.
    """
    spark = texts.sparkSession
    table = BucketTable(spark, path, EMBEDDED, "content_key", buckets)

    def unseen(fresh: DataFrame, old: DataFrame) -> DataFrame:
        new = fresh.join(old.select("content_key"), "content_key", "left_anti")
        return new.select("content_key", embed(F.col("text")).cast("array<double>").alias("embedding"))

    def add(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        keyed = batch.select(content_key(F.col("text"), model).alias("content_key"), "text").where("content_key is not null").dropDuplicates(["content_key"])
        table.commit(_stream_id(spark, checkpoint), number, keyed.withColumn("b", table.bucket()), unseen, replace=False)
        batch.unpersist()

    return texts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_embedded(spark: SparkSession, path: str) -> DataFrame:
    """(content_key, embedding) of :func:`embed_once`."""
    return BucketTable(spark, path, EMBEDDED, "content_key").rows()

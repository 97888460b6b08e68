"""Queries on sources, sinks and streams: each writes what Spark derives from a table and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.stored import own_path
from lodestone.operators import corpus as P
from lodestone.plans import fixtures as X
from lodestone.plans.registry import query, r6, sql6, table
from lodestone.sources import readers as R
from lodestone.streaming import ingest as S


def place(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    return own_path(spark, name)


def lines(df: DataFrame, name: str) -> str:
    path = place(df.sparkSession, name)
    df.write.text(path)
    return path


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("io01_read_corpus", "SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 2 = 0 THEN source || ' ' ELSE '' END || text AS text FROM documents")
def io01(spark, sf):
    rows = docs(spark, sf).select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("_id"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("title"), "text")).alias("value"))
    return R.read_corpus(spark, lines(rows.union(spark.createDataFrame([("",)], "value string")), "corpus"))


@query("io02_read_queries", "SELECT item_id::VARCHAR AS query_id, text FROM benchmark")
def io02(spark, sf):
    rows = table(spark, sf, "benchmark").select(F.to_json(F.struct(F.col("item_id").cast("string").alias("_id"), "text")).alias("value"))
    return R.read_queries(spark, lines(rows, "queries"))


@query("io03_read_qrels", "SELECT o_custkey::VARCHAR AS query_id, o_orderkey::VARCHAR AS doc_id, (o_orderkey % 3)::INT AS rel FROM orders")
def io03(spark, sf):
    q, d, rel = (F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % 3).cast("string"))
    rows = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws("\t", q, d, rel)).otherwise(F.concat_ws(" ", q, F.lit("0"), d, rel)).alias("value"))
    return R.read_qrels(spark, lines(rows.union(spark.createDataFrame([("query-id\tcorpus-id\tscore",)], "value string")), "qrels"))


@query("io04_read_token_streams", "SELECT (conv_id * 100 + turn)::INT AS prompt_idx, length(text) AS n FROM conversations")
def io04(spark, sf):
    ids = F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: i % 97)
    made = F.when(F.length("text") > 0, ids).otherwise(F.array().cast("array<int>"))
    rows = table(spark, sf, "conversations").select(F.to_json(F.struct((F.col("conv_id") * 100 + F.col("turn")).cast("int").alias("prompt_idx"), made.alias("plain_prompt_ids"))).alias("value"))
    return R.read_token_streams(spark, lines(rows, "tokens")).select("prompt_idx", F.size("plain_prompt_ids").cast("long").alias("n"))


@query("io05_read_kg_bundle", "SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS tgt, count(*) AS n FROM lineitem GROUP BY ALL")
def io05(spark, sf):
    li = table(spark, sf, "lineitem").select(F.floor(F.col("l_orderkey") / 1000).alias("g"), F.struct(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("tgt")).alias("r"))
    rows = li.groupBy("g").agg(F.collect_list("r").alias("relations")).select("g", F.to_json(F.struct("relations")).alias("value"))
    path = place(spark, "bundle")
    rows.write.partitionBy("g").text(path)  # a file for each bundle, of a thousand orders
    return R.read_kg_bundle(spark, path)[2].groupBy("src", "tgt").agg(F.count(F.lit(1)).alias("n"))


@query("io06_read_prompts", "SELECT trim(regexp_replace(text, '[\\r\\n]+', ' ', 'g')) AS prompt, count(*) AS n FROM benchmark WHERE trim(text) <> '' GROUP BY 1")
def io06(spark, sf):
    rows = table(spark, sf, "benchmark").select(F.concat(F.lit("  "), F.regexp_replace("text", "[\r\n]+", " "), F.lit(" \n")).alias("value"))
    return R.read_prompts(spark, lines(rows, "prompts")).groupBy("prompt").agg(F.count(F.lit(1)).alias("n"))


@query("io07_read_sweep_log", f"SELECT (event_id % 8)::INT AS b, (user_id % 64)::INT AS n, {sql6('sum(round(value, 3))')} AS total FROM events WHERE event_id % 5 <> 0 GROUP BY ALL")
def io07(spark, sf):
    e = table(spark, sf, "events")
    text = F.concat(F.lit("SWEEP_RESULT B="), (F.col("event_id") % 8).cast("string"), F.lit(" n="), (F.col("user_id") % 64).cast("string"), F.lit(" mask=auto prefill_tps="), F.round("value", 3).cast("string"))
    rows = e.select(F.when(F.col("event_id") % 5 == 0, F.lit("other line")).otherwise(text).alias("value"))
    return R.read_sweep_log(spark, lines(rows, "sweep")).groupBy("b", "n").agg(r6(F.sum("prefill_tps")).alias("total"))


@query("io08_write_results", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def io08(spark, sf):
    rows = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    found = None
    for kind in ("json", "csv", "parquet"):
        path = place(spark, kind)
        R.write_results(rows, path, kind)
        back = spark.read.schema(rows.schema).option("header", True).format(kind).load(path)
        found = back if found is None else found.intersect(back)
    return found


@query("io09_index_table", "SELECT label % 3 AS tenant_id, count(*) AS n FROM embeddings GROUP BY 1")
def io09(spark, sf):
    path = place(spark, "index")
    R.write_index(X.vectors(spark, sf).select((F.col("label") % 3).alias("tenant_id"), "vec_id", "v"), path)
    return R.read_index(spark, path).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))


@query("io10_forget_tenant", "SELECT label % 3 AS tenant_id, count(*) AS n FROM embeddings WHERE label % 3 <> 1 GROUP BY 1")
def io10(spark, sf):
    path = place(spark, "index")
    R.write_index(X.vectors(spark, sf).select((F.col("label") % 3).alias("tenant_id"), "vec_id", "v"), path)
    R.forget_tenant(spark, path, 1)
    return R.read_index(spark, path).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))


def chunk_stream(spark, sf) -> DataFrame:
    """The documents as a stream of several files."""
    path = place(spark, "stream")
    key = F.col("doc_id") % 150 + 150 * F.floor(F.col("doc_id") / 600)  # four versions of each key
    rows = docs(spark, sf).select((F.col("doc_id") % 3).alias("tenant_id"), F.concat(F.lit("c"), key.cast("string")).alias("chunk_id"), F.col("doc_id").alias("version"), "text")
    rows.repartitionByRange(4, "version").write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("s01_append_ingest", "SELECT doc_id % 3 AS tenant_id, text FROM documents")
def s01(spark, sf):
    from lodestone.operators.protect import decrypted

    path, key = place(spark, "s01"), b"0123456789abcdef"
    S.append_protected(chunk_stream(spark, sf), path, place(spark, "c01"), b"secret", key, P.hashed_words).awaitTermination()
    return R.read_index(spark, path).select("tenant_id", decrypted(F.col("ciphertext"), key).alias("text"))


@query("s02_upsert_texts", "SELECT 'c' || (doc_id % 150 + 150 * (doc_id // 600)) AS chunk_id, max(doc_id) AS version, arg_max(text, doc_id) AS text FROM documents GROUP BY 1")
def s02(spark, sf):
    path = place(spark, "s02")
    texts = chunk_stream(spark, sf).select("chunk_id", "version", "text")
    S.upsert_texts(spark, texts, path, place(spark, "c02"), buckets=16).awaitTermination()
    return S.read_upserted(spark, path, texts.schema)


@query("s03_embed_once", "SELECT DISTINCT sha256(sha256('embedding|words') || '|' || text) AS content_key FROM documents")
def s03(spark, sf):
    path = place(spark, "s03")
    S.embed_once(chunk_stream(spark, sf), path, place(spark, "c03"), "words", P.hashed_words).awaitTermination()
    return S.read_embedded(spark, path).select("content_key")

"""Readers and writers of corpora, judgements, token streams, graph bundles, logs and index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of JSON lines with _id, title and text; the title comes first if there is one.  Blank lines are skipped."""
    rows = spark.read.schema("_id string, title string, text string").json(path).where("_id is not null")
    body = F.coalesce("text", F.lit(""))
    return rows.select(F.col("_id").alias("doc_id"), F.when(F.coalesce("title", F.lit("")) != "", F.concat_ws(" ", "title", body)).otherwise(body).alias("text"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("_id string, text string").json(path).where("_id is not null").select(F.col("_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, rel) of lines with three or four fields split by blanks; a heading is skipped, other widths are an error."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(value, 'query-id')").withColumn("f", F.split(F.trim("value"), "\\s+"))
    n = F.size("f")
    width = F.when(n.isin(3, 4), n).otherwise(F.raise_error(F.concat(F.lit("judgement line with other than 3 or 4 fields: "), F.col("value"))).cast("int"))
    return lines.select(F.get("f", F.lit(0)).alias("query_id"), F.element_at("f", -2).alias("doc_id"), F.when(width > 0, F.element_at("f", -1).cast("int")).alias("rel"))


def read_token_streams(spark: SparkSession, path: str) -> DataFrame:
    """(prompt_idx, plain_prompt_ids, obf_prompt_ids, obf_response_ids) of JSON lines; blank lines are skipped."""
    ids = "array<int>"
    return spark.read.schema(f"prompt_idx int, plain_prompt_ids {ids}, obf_prompt_ids {ids}, obf_response_ids {ids}").json(path).where("prompt_idx is not null")


def read_kg_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, entities, relations) of JSON documents that hold the three lists."""
    vec = "embedding: array<float>"
    schema = (
        f"chunks array<struct<id: string, text: string, {vec}>>, entities array<struct<name: string, description: string, {vec}, source_chunks: array<string>>>, "
        f"relations array<struct<src: string, tgt: string, description: string, {vec}, source_chunks: array<string>>>"
    )
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    chunks, entities, relations = (raw.select(F.posexplode(c).alias("pos", "r")).select("pos", "r.*") for c in ("chunks", "entities", "relations"))
    return chunks, entities, relations


def read_prompts(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """(file, line, prompt) of trimmed lines that are not blank, in file order; only the first ``first`` if given.

    Lines are numbered while a file is read whole, as prompt files are small lists.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "prompt"))
    rows = whole.select("file", "line", F.trim("prompt").alias("prompt")).where("prompt <> ''")
    return rows if first is None else rows.orderBy("file", "line").limit(first)


def read_sweep_log(spark: SparkSession, path: str) -> DataFrame:
    """Fields of lines that start with SWEEP_RESULT as a map ``pairs``, and its usual numbers as columns; others are skipped."""
    lines = spark.read.text(path).where("startswith(value, 'SWEEP_RESULT')")
    pairs = F.str_to_map(F.trim(F.substr("value", F.lit(13))), F.lit("\\s+"), F.lit("="))
    rows = lines.select(pairs.alias("pairs"))
    number = lambda name, kind: F.expr(f"try_cast(try_element_at(pairs, '{name}') AS {kind})").alias(name.lower())
    return rows.select("pairs", number("B", "int"), number("n", "int"), number("prefill_tps", "double"), number("decode_tps", "double"), F.try_element_at("pairs", F.lit("mask")).alias("mask"))


def write_results(results: DataFrame, path: str, kind: str = "parquet") -> None:
    """Result tables as parquet, json or csv (with a heading)."""
    writer = results.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)


def write_index(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Vector index rows, partitioned by tenant; appending adds to a tenant's rows."""
    rows.write.mode(mode).partitionBy("tenant_id").parquet(path)


def read_index(spark: SparkSession, path: str, tenant: str | int | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if tenant is None else rows.where(F.col("tenant_id") == tenant)


def index_length(spark: SparkSession, path: str, tenant: str | int) -> int:
    return read_index(spark, path, tenant).count()


def forget_tenant(spark: SparkSession, path: str, tenant: str | int) -> bool:
    """Drop a tenant's partition, whose folder Spark names with some characters escaped; False if there is none."""
    jvm = spark._jvm  # noqa: SLF001 - the file system behind any Spark path
    name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(tenant))
    return remove(spark, f"{path}/tenant_id={name}")


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder of any file system that Spark knows; False if there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    return bool(files.exists(target) and files.delete(target, True))

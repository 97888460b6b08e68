"""Joins and lookups: multimaps, paired observations, hit texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multimap_get(keys: DataFrame, multimap: DataFrame, key: str = "key", values: str = "values") -> DataFrame:
    """(key, values): an empty list for a missing key."""
    kind = multimap.schema[values].dataType.simpleString()
    return keys.select(key).join(multimap.select(key, values), key, "left").select(key, F.coalesce(values, F.array().cast(kind)).alias(values))


def pair_observations(observed: DataFrame, plain: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each observed key: its status is paired, unpaired or shape (vectors of other lengths)."""
    left = observed.select(*keys, F.col("vec").alias("observed"))
    right = plain.select(*keys, F.col("vec").alias("plain"))
    status = F.when(F.col("plain").isNull(), "unpaired").when(F.size("observed") != F.size("plain"), "shape").otherwise("paired")
    return left.join(right, keys, "left").withColumn("status", status)


def select_snapshots(rows: DataFrame, layer: int | None = None, kind: str | None = None, prompts: list[int] | None = None, data_only: bool = True) -> DataFrame:
    """Rows by optional layer, kind and prompts; shield rows (row_idx >= n_data) are dropped unless asked for."""
    if layer is not None:
        rows = rows.where(F.col("layer") == layer)
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    if prompts is not None:
        rows = rows.where(F.col("prompt_idx").isin(prompts))
    return rows.where("row_idx < n_data") if data_only else rows


def stack_with_labels(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """Observations (prompt_idx, row_idx, vec) with the token at the same place of their prompt; the shorter side decides."""
    places = tokens.select("prompt_idx", F.posexplode("tokens").alias("row_idx", "token"))
    return rows.join(places, ["prompt_idx", "row_idx"])


def attach_texts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the text of their chunk, in rank order within each query."""
    return hits.join(chunks.select("id", "text"), "id").select(*hits.columns, "text")


def first_seen(rows: DataFrame, by: list[str], value: str, position: str) -> DataFrame:
    """Distinct values of each group with the position where they are seen first."""
    return rows.groupBy(*by, value).agg(F.min(position).alias(position))

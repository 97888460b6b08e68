"""Percentiles, profiles, throughput and sweeps of run telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.nearest import ranked, with_group


WHOLE = 1_000_000  # rows of a group that one task sorts at most


def rounded_percentiles(rows: DataFrame, by: list[str], value: str = "value", shares: tuple[float, ...] = (0.50, 0.95, 0.99), accuracy: int = 10_000) -> DataFrame:
    """n, mean, std (population) and the value at place round(p * (n - 1)) of the sorted values, for each p; nulls take no part.

    Values are exact.  If no group has more than ``WHOLE`` rows, each is sorted in a task.  Else a sketch
    brackets each wanted place; values below a bracket are only counted, and those within it, about
    6 / ``accuracy`` of the group, are sorted, one row for each distinct value.
    """
    most = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return _sorted_percentiles(rows, by, value, shares) if most <= WHOLE else _sketched_percentiles(rows, by, value, shares, accuracy)


def _sorted_percentiles(rows: DataFrame, by: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    given = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    group = Window.partitionBy(*by)
    placed = given.select(*by, "_v", F.count(F.lit(1)).over(group).alias("_n"), F.avg("_v").over(group).alias("_mean"), F.stddev_pop("_v").over(group).alias("_std"), (F.row_number().over(group.orderBy("_v")) - 1).alias("_at"))
    wanted = [F.round(F.lit(float(p)) * (F.col("_n") - 1)) for p in shares]
    kept = placed.where(F.col("_at").cast("double").isin(*wanted))
    picks = [F.max(F.when(F.col("_at") == w, F.col("_v"))).alias(f"p{round(p * 100)}") for p, w in zip(shares, wanted, strict=True)]
    return kept.groupBy(*by).agg(F.first("_n").alias("n"), F.first("_mean").alias("mean"), F.first("_std").alias("std"), *picks)


def _sketched_percentiles(rows: DataFrame, by: list[str], value: str, shares: tuple[float, ...], accuracy: int) -> DataFrame:
    given = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    few, reach = F.col("_n") <= accuracy, 3 / accuracy
    ends = [F.percentile_approx("_v", [min(max(p + side * reach, 0.0), 1.0) for p in shares], accuracy).alias(name) for side, name in ((-1, "_low"), (1, "_high"))]
    groups = given.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("_mean"), F.stddev_pop("_v").alias("_std"), *ends)
    spots = []
    for k, p in enumerate(shares):
        above = F.lit(True) if p <= reach else few | (F.col("_v") >= F.col("_low")[k])
        under = F.lit(True) if p >= 1 - reach else few | (F.col("_v") <= F.col("_high")[k])
        spots.append(F.when(under, F.struct(F.lit(k).alias("k"), F.when(above, F.col("_v")).alias("v"))))
    stats = ["_n", "_mean", "_std"]
    spread = with_group(given, groups, by).select(*by, *stats, F.explode(F.filter(F.array(*spots), lambda s: s.isNotNull())).alias("_s"))
    counted = spread.groupBy(*by, "_s.k", "_s.v").agg(*[F.first(c).alias(c) for c in stats], F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by, "k").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    place = F.round(F.get(F.array(*[F.lit(float(p)) for p in shares]), F.col("k")) * (F.col("_n") - 1))
    held = counted.withColumn("_upto", upto).withColumn("_hit", (F.col("_upto") - F.col("_c") <= place) & (place < F.col("_upto")) & F.col("v").isNotNull())
    missed = F.raise_error(F.lit("a sketch missed its bracket: raise the accuracy")).cast("double")
    picks = [F.coalesce(F.max(F.when(F.col("_hit") & (F.col("k") == k), F.col("v"))), missed).alias(f"p{round(p * 100)}") for k, p in enumerate(shares)]
    return held.groupBy(*by).agg(F.first("_n").alias("n"), F.first("_mean").alias("mean"), F.first("_std").alias("std"), *picks)


def stage_table(runs: DataFrame, stages: list[str], by: list[str]) -> DataFrame:
    """Percentiles of each stage column of wide timing rows, one row a stage."""
    long = runs.select(*by, F.explode(F.create_map(*[x for s in stages for x in (F.lit(s), F.col(s).cast("double"))])).alias("stage", "value"))
    return rounded_percentiles(long, [*by, "stage"])


def without_warm_up(rows: DataFrame, by: list[str], order: str, skip: int) -> DataFrame:
    """Rows after the first ``skip`` of each group; ``order`` tells the rows of a group apart.

    Rows without ``order``, and rows that tie with the last one skipped, are skipped too.  Only the
    first rows of each partition are sorted: they give the place from which a group's rows stay.
    """
    if skip <= 0:
        return rows.where(F.col(order).isNotNull())
    first = ranked(rows.where(F.col(order).isNotNull()).select(*by, order), by, [order], skip)
    last = first.groupBy(*by).agg(F.max(order).alias("_last"))
    return with_group(rows, last, by).where(F.col(order) > F.col("_last")).drop("_last")


def merged_profile(rows: DataFrame, category: str = "category", seconds: str = "seconds") -> DataFrame:
    """(category, total, calls, share), largest total first."""
    sums = rows.groupBy(category).agg(F.sum(seconds).alias("total"), F.count(F.lit(1)).alias("calls"))
    every = sums.agg(F.sum("total").alias("every"))  # one row
    return sums.join(F.broadcast(every)).select(category, "total", "calls", (F.col("total") / F.when(F.col("every") > 0, F.col("every"))).alias("share")).orderBy(F.desc("total"), category)


def phase_throughput(rows: DataFrame, phase: str, items: str, seconds: str) -> DataFrame:
    """(phase, items, seconds, per_item, rate): infinite rate for no time."""
    sums = rows.groupBy(phase).agg(F.sum(items).alias("items"), F.sum(seconds).alias("seconds"))
    rate = F.when(F.col("seconds") > 0, F.col("items") / F.when(F.col("seconds") > 0, F.col("seconds"))).otherwise(F.lit(float("inf")))
    return sums.withColumns({"per_item": F.col("seconds") / F.when(F.col("items") > 0, F.col("items")), "rate": rate})


def sweep_comparison(rows: DataFrame, cell: list[str], variant: str, value: str, base: str, other: str) -> DataFrame:
    """(cell..., base, other, ratio): one variant's mean against another's in the same cell."""
    side = lambda name, out: rows.where(F.col(variant) == name).groupBy(*cell).agg(F.avg(value).alias(out))
    return side(base, "base").join(side(other, "other"), cell).withColumn("ratio", F.col("other") / F.when(F.col("base") != 0, F.col("base")))

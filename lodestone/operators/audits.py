"""Leakage audits: recovery rates, splits, frequency and bigram statistics, ridge inversion, Gram fingerprints."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.functions.blocks import matrix
from lodestone.functions.keys import seeded_order
from lodestone.functions.stored import stored
from lodestone.operators.nearest import nearest, numbered, ranked, scalar_hits, with_group


def row_zscores(scores: DataFrame) -> DataFrame:
    """``z`` of (row, candidate, score) by row; a deviation under 1e-8 counts as 1."""
    w = Window.partitionBy("row")
    spread = F.stddev_pop("score").over(w)
    return scores.withColumn("z", (F.col("score") - F.avg("score").over(w)) / F.when(spread < 1e-8, 1.0).otherwise(spread))


def top1_rate(rows: DataFrame, predicted: str = "predicted", truth: str = "truth") -> DataFrame:
    """Share of rows predicted exactly; 0 for no rows; rows where one side is missing are an error."""
    same = F.when(F.col(predicted).isNull() != F.col(truth).isNull(), F.raise_error(F.lit("predictions and truths differ in shape")).cast("double")).otherwise((F.col(predicted) == F.col(truth)).cast("double"))
    return rows.agg(F.coalesce(F.avg(same), F.lit(0.0)).alias("top1"))


def topk_rate(ranking: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 10)) -> DataFrame:
    """One row of rates topK: share of truths (query_id, truth) within the first k of the ranking."""
    place = truth.join(ranking.select("query_id", "rank", F.col("id").alias("truth")), ["query_id", "truth"], "left")
    return place.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.avg(F.coalesce(F.col("rank") < k, F.lit(False)).cast("double")), F.lit(0.0)).alias(f"top{k}") for k in ks])


def risk_level(rate: Column) -> Column:
    return F.when(rate.isNull() | F.isnan(rate.cast("double")), "unknown").when(rate >= 0.30, "high").when(rate >= 0.10, "medium").otherwise("low")


def split_sizes(total: int, wanted: tuple[int, ...] | None, shares: tuple[float, ...], floors: tuple[int, ...]) -> list[int]:
    """Sizes of the splits: ``wanted`` if there are so many rows, else shares of what there is, but at least the floors.

    The first split may go down to what the floors of the others leave; the last takes the rest.
    """
    if wanted and sum(wanted) <= total:
        return list(wanted)
    sizes = [max(int(total * shares[0]), min(floors[0], total - sum(floors[1:])))]
    sizes += [max(int(total * share), floor) for share, floor in zip(shares[1:-1], floors[1:-1], strict=True)]
    return [*sizes, max(total - sum(sizes), floors[-1])]


def split_rows(rows: DataFrame, key: str, shares: tuple[float, ...] = (0.70, 0.15, 0.15), names: tuple[str, ...] = ("train", "validation", "test"), seed: int = 0, sizes: tuple[int, ...] | None = None, floors: tuple[int, ...] = (4, 1, 1)) -> DataFrame:
    """``split`` of each row, in splits of exact size by a seeded order of the key (see :func:`split_sizes`).

    Rows beyond the wanted sizes are left out.  The order is counted in 65,536 ranges of its hash, which
    is all that reaches the driver; only the ranges that a bound falls into are sorted.
    """
    placed = rows.withColumns({"_h": seeded_order(F.col(key), seed)}).withColumn("_range", F.shiftright("_h", 44))
    counts = sorted((r["_range"], r["count"]) for r in placed.groupBy("_range").count().collect())
    total = sum(n for _, n in counts)
    bounds, reached = [], 0
    for size in split_sizes(total, sizes, shares, floors):
        reached = min(reached + size, total)
        bounds.append(reached)
    start, cut, before = 0, {}, []
    for number, n in counts:
        before.append((number, start))
        if any(start < b < start + n for b in bounds):
            cut[number] = start
        start += n
    last_whole = lambda b: max((number for number, s in before if s < b), default=-1)  # noqa: E731 - the range that holds place b - 1
    whole = F.lit(None).cast("string")
    for bound, name in reversed(list(zip(bounds, names, strict=True))):
        whole = F.when(F.col("_range") <= last_whole(bound), name).otherwise(whole)
    out = placed.where(~F.col("_range").isin(list(cut))).withColumn("split", whole) if cut else placed.withColumn("split", whole)
    if cut:
        starts = F.create_map(*[F.lit(x).cast("long") for item in cut.items() for x in item])
        sorted_ = placed.where(F.col("_range").isin(list(cut))).withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy("_h", key)) + F.element_at(starts, F.col("_range")))
        one = F.lit(None).cast("string")
        for bound, name in reversed(list(zip(bounds, names, strict=True))):
            one = F.when(F.col("_n") <= bound, name).otherwise(one)
        out = out.unionByName(sorted_.withColumn("split", one).drop("_n"))
    return out.where("split is not null").drop("_h", "_range")


def split_by_label(rows: DataFrame, label: str, floors: tuple[int, ...] = (2, 1, 1), **how) -> DataFrame:
    """Distinct labels are split and all rows of a label follow it, so vocabularies are disjoint."""
    return rows.join(split_rows(rows.select(label).distinct(), label, floors=floors, **how), label)


def split_by_prompt(rows: DataFrame, prompt: str, observed: str, seed: int = 0) -> DataFrame:
    """75/25 by prompt, at least one of them in the first; then rows without observed ids are skipped."""
    split = split_by_label(rows, prompt, floors=(1, 0), shares=(0.75, 0.25), names=("train", "test"), seed=seed)
    return split.where(F.col(observed).isNotNull() & (F.size(observed) > 0))


def token_frequencies(sequences: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(token, n, share)."""
    counts = sequences.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select("token", "n", (F.col("n") / F.col("total")).alias("share"))


def frequency_matching(observed: DataFrame, reference: DataFrame, mapping: DataFrame, ks: tuple[int, ...] = (1, 10, 100)) -> DataFrame:
    """Match observed tokens with reference tokens of the nearest relative frequency; score against ``mapping`` (observed, reference).

    Tokens with the same share are ordered by id.
    """
    share = F.round(F.col("share") * 1e12) / 1e12
    asked = token_frequencies(observed).select(F.col("token").alias("observed"), share.alias("value"))
    known = token_frequencies(reference).select(F.col("token").alias("id"), share.alias("value"))
    asked = stored(asked.join(mapping.select("observed", F.col("reference").alias("truth")), "observed"), "asked")
    hits = stored(asked.select("value").distinct().join(scalar_hits(asked, known, max(ks)), "value", "left"), "hits")  # a row for each share, of which there are few
    place = with_group(asked, hits, ["value"]).withColumn("place", F.array_position(F.transform("hits", lambda h: h["id"]), F.col("truth")))  # from 1; 0 if it is not there
    return place.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.avg(F.col("place").between(1, k).cast("double")), F.lit(0.0)).alias(f"top{k}") for k in ks])


def bigram_counts(sequences: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(first, second, n)."""
    both = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1))), lambda a, b: F.struct(a.alias("first"), b.alias("second")))
    rows = sequences.where(F.size(tokens) > 1).select(F.explode(both).alias("b")).select("b.first", "b.second")
    return rows.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))


def bigram_signatures(sequences: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(token, runs, square): each token's following-token counts, largest first, as runs (n, times); ``square`` is their squared norm.

    Few counts are large and different, so runs are short where the list of all counts is as long as the vocabulary.
    """
    counts = bigram_counts(sequences, tokens).groupBy(F.col("first").alias("token"), "n").agg(F.count(F.lit(1)).alias("times"))
    runs = F.reverse(F.sort_array(F.collect_list(F.struct("n", "times"))))
    return counts.groupBy("token").agg(runs.alias("runs"), F.sum(F.col("n") * F.col("n") * F.col("times")).alias("square"))


NORM_ROWS = 4096  # signatures that a query is compared with at once


def nearest_signatures(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(token, guess, distance2): for each token of ``asked`` the token of ``known`` of the nearest signature by L2, ties to the smaller token.

    Equal signatures are compared once.  Signatures lie in ranges of their norms.  Norms differ by no more
    than signatures do, so the nearest in a query's own range bounds the ranges that it must also visit.
    """
    kinds = lambda rows: rows.groupBy("runs", "square").agg(F.min("token").alias("id"))
    q = stored(kinds(asked).select(F.col("id").alias("query_id"), "runs", "square", F.sqrt("square").alias("norm")), "asked")
    c = stored(kinds(known).select("id", "runs", "square", F.sqrt("square").alias("norm")), "known")
    ranges = max(1, c.count() // NORM_ROWS)
    cuts = sorted(set(c.agg(F.percentile_approx("norm", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0])) if ranges > 1 else []
    marks = F.array(*[F.lit(float(x)) for x in cuts]) if cuts else F.array().cast("array<double>")
    place = lambda v: F.size(F.filter(marks, lambda m: m <= v))
    c = c.withColumn("range", place(F.col("norm")))

    def compare(asked, own):
        if not asked.num_rows or not own.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "distance2": pa.array([], pa.int64())})
        own = own.sort_by("id")
        ids, square, norm = (own.column(n).to_numpy() for n in ("id", "square", "norm"))
        runs = own.column("runs").combine_chunks()
        size = np.diff(runs.offsets.to_numpy())
        flat = runs.flatten()
        n, times = (flat.field(k).to_numpy() for k in (0, 1))
        first = np.cumsum(size) - size
        end = np.cumsum(times)
        end = end - np.repeat(end[first] - times[first], size)  # places within each signature
        out = []
        for row in asked.to_pylist():
            mine = [(r["n"], r["times"]) for r in row["runs"]]
            at = np.cumsum([0, *(t for _, t in mine)])
            total = np.cumsum([0, *(v * t for v, t in mine)])
            upto = lambda x: np.interp(x, at, total)  # noqa: B023, E731 - the sum of the first x counts
            product = np.add.reduceat(n * (upto(end) - upto(end - times)), first)
            d = row["square"] + square - 2 * np.rint(product).astype(np.int64)
            k = int(d.argmin())
            out.append((row["query_id"], int(ids[k]), int(d[k])))
        return pa.table({name: pa.array([o[k] for o in out], pa.int64()) for k, name in enumerate(("query_id", "id", "distance2"))})

    def met(visits: DataFrame) -> DataFrame:
        salted = visits.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(8)).cast("int"))
        members = c.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
        return salted.groupBy("range", "salt").cogroup(members.groupBy("range", "salt")).applyInArrow(compare, "query_id long, id long, distance2 long")

    first = stored(met(q.withColumn("range", place(F.col("norm")))), "first")
    spans = c.groupBy("range").agg(F.min("norm").alias("least"), F.max("norm").alias("most")).collect()  # a row for each range
    reach = F.sqrt(F.coalesce("distance2", F.lit(float("inf")))) + F.lit(1e-6)
    wanted = F.filter(F.array(*[F.struct(F.lit(r["range"]).alias("range"), F.lit(r["least"]).alias("least"), F.lit(r["most"]).alias("most")) for r in spans]), lambda x: (x["least"] <= F.col("norm") + reach) & (x["most"] >= F.col("norm") - reach)) if spans else F.array().cast("array<struct<range: int, least: double, most: double>>")
    further = q.join(first.select("query_id", "distance2"), "query_id", "left").withColumn("own", place(F.col("norm"))).withColumn("x", F.explode(wanted)).where("x.range <> own")
    both = first.union(met(further.select("query_id", "runs", "square", "norm", F.col("x.range").alias("range"))))
    best = both.groupBy("query_id").agg(F.min(F.struct("distance2", "id")).alias("b"))
    named = q.join(best, "query_id").select("runs", F.col("b.id").alias("guess"), F.col("b.distance2").alias("distance2"))
    return asked.join(named, "runs").select("token", "guess", "distance2")


def bigram_substitution(observed: DataFrame, reference: DataFrame) -> DataFrame:
    """(prompt, tokens): observed sequences with each token replaced by the reference token of the nearest bigram signature.

    A token that is followed by nothing anywhere stays as it is.
    """
    near = nearest_signatures(bigram_signatures(observed), bigram_signatures(reference))
    places = observed.select("prompt", F.posexplode("tokens").alias("pos", "token")).join(near.select("token", "guess"), "token", "left")
    return places.groupBy("prompt").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("guess", "token").alias("t")))), lambda s: s["t"]).alias("tokens"))


def ngrams(tokens: Column, n: int) -> Column:
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)).cast("array<string>"), " "))).otherwise(F.array().cast("array<string>"))


def corpus_bleu(pairs: DataFrame, key: str = "prompt", candidate: str = "candidate", reference: str = "reference") -> DataFrame:
    """One row (bleu 0 to 100, risk): corpus BLEU-4 with clipped counts and brevity penalty; 0 if some order has no match."""
    orders = []
    for n in range(1, 5):
        count = lambda side: pairs.select(key, F.explode(ngrams(F.col(side), n)).alias("g")).groupBy(key, "g").agg(F.count(F.lit(1)).alias(side))  # noqa: B023, E731
        both = count(candidate).join(count(reference), [key, "g"], "left")
        orders.append(both.agg(F.lit(n).alias("n"), F.coalesce(F.sum(F.least(F.col(candidate), F.coalesce(reference, F.lit(0)))), F.lit(0)).alias("hit"), F.coalesce(F.sum(candidate), F.lit(0)).alias("all")))
    rows = orders[0]
    for o in orders[1:]:
        rows = rows.union(o)
    precision = rows.agg(F.min("hit").alias("least"), F.avg(F.when(F.col("hit") > 0, F.log(F.col("hit") / F.col("all")))).alias("logs"))
    sizes = pairs.agg(F.sum(F.size(candidate)).alias("c"), F.sum(F.size(reference)).alias("r"))
    brevity = F.when(F.col("c") >= F.col("r"), F.lit(1.0)).otherwise(F.exp(1 - F.col("r") / F.col("c")))
    bleu = F.when(F.col("least") > 0, 100 * brevity * F.exp("logs")).otherwise(0.0)
    return precision.join(F.broadcast(sizes)).select(bleu.alias("bleu"), F.when(bleu < 5, "low").otherwise("elevated").alias("risk"))


def nearest_inversion(observed: DataFrame, table: DataFrame, width: int | None = None, seed: int = 0, share: float = 1.0, ks: tuple[int, ...] = (1, 10)) -> DataFrame:
    """Recover tokens of observations (row, vec, token) by the nearest vectors of a reference table (token, vec)."""
    rows = observed.where(seeded_order(F.col("row"), seed) < int(share * 2**60))
    cut = lambda v: V.resized(F.col(v), width) if width else V.doubles(F.col(v))
    near = nearest(rows.select(F.col("row").alias("query_id"), cut("vec").alias("vector")), table.select(F.col("token").alias("id"), cut("vec").alias("vector")), max(ks))
    return topk_rate(near, rows.select(F.col("row").alias("query_id"), F.col("token").alias("truth")), ks)


TREE = 32  # matrices that one task adds up


class Ridge:
    """A linear map with intercept, fitted on standardised columns from sums over partitions.

    Tasks return sums of products of their rows; the driver adds blocks of (dim_x + dim_y + 1) squared
    and solves.  ``scaled`` False leaves columns as they are.
    """

    def __init__(self, rows: DataFrame, x: str = "x", y: str = "y", scaled: bool = True):
        self.scaled = scaled

        def sums(batches):
            total = None
            for batch in batches:
                if batch.num_rows:
                    a, b = matrix(batch.column(0)), matrix(batch.column(1))
                    both = np.hstack([np.ones((len(a), 1)), a, b])
                    total = both.T @ both if total is None else total + both.T @ both
                    self_dim = a.shape[1]
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([self_dim]), pa.array([total.ravel().tobytes()], pa.binary())], names=["d", "m"])

        def add(batches):
            total = dim = None
            for batch in batches:
                for d, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    total = np.frombuffer(m).copy() if total is None else total + np.frombuffer(m)
                    dim = d
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["d", "m"])

        partial = rows.select(V.doubles(F.col(x)), V.doubles(F.col(y))).mapInArrow(sums, "d long, m binary")
        left = rows.rdd.getNumPartitions()
        while left > 1:  # a task adds at most some TREE matrices, one at a time
            left = -(-left // TREE)
            partial = partial.repartition(left).mapInArrow(add, "d long, m binary")
        found = partial.first()
        if found is None:
            raise ValueError("no rows to fit")
        m = np.frombuffer(found["m"])
        size, self.dim = int(math.isqrt(len(m))), found["d"]
        m = m.reshape(size, size)
        n, mean = m[0, 0], m[0, 1:] / m[0, 0]
        cov = m[1:, 1:] / n - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(cov), 0)) if scaled else np.ones(size - 1)
        scale[scale < 1e-12] = 1.0
        d = self.dim
        gram = cov / np.outer(scale, scale) * n
        self.xx, self.xy = gram[:d, :d], gram[:d, d:]
        self.mean_x, self.mean_y, self.scale_x, self.scale_y = mean[:d], mean[d:], scale[:d], scale[d:]

    def solve(self, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """(weights, intercept) on the original scales for penalty ``alpha``; the Gram matrix is shared by all alphas."""
        w = np.linalg.solve(self.xx + alpha * np.eye(self.dim), self.xy)
        w = w / self.scale_x[:, None] * self.scale_y
        return w, self.mean_y - self.mean_x @ w


def ridge_predict(rows: DataFrame, weights: np.ndarray, intercept: np.ndarray, x: str = "x", out: str = "predicted") -> DataFrame:
    """``rows`` with ``out``; the weights (dim_x by dim_y) travel with the task."""
    from lodestone.functions.batches import extended

    kept = rows.drop(out)
    at, schema = kept.columns.index(x), extended(kept.schema, **{out: "array<double>"})
    names = schema.names

    def apply(batches):
        for batch in batches:
            if batch.num_rows:
                y = np.array(batch.column(at).to_pylist(), np.float64) @ weights + intercept
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(y.tolist(), pa.list_(pa.float64()))], names=names)

    return kept.mapInArrow(apply, schema)


def ridge_inversion(rows: DataFrame, pool: DataFrame, alphas: tuple[float, ...] = (1e-4, 1e-2, 1.0), seed: int = 0) -> DataFrame:
    """One row (alpha, validation_top1, top1, top10): rows (row, x, y, token) are split, fitted for each alpha and recovered.

    Predictions are matched with ``pool`` (token, vec), to which the rows' own truths are added.  The
    alpha with the best validation top-1 is kept, the first among equals.
    """
    split = split_rows(rows, "row", seed=seed)
    fit = Ridge(split.where("split = 'train'"))
    full = pool.select("token", V.doubles(F.col("vec")).alias("vec")).union(split.select("token", V.doubles(F.col("y")))).dropDuplicates(["token"])
    best = None
    for alpha in alphas:
        guess = ridge_predict(split.where("split = 'validation'"), *fit.solve(alpha))
        rate = _recover(guess, full).first()["top1"]
        if best is None or rate > best[1]:
            best = (alpha, rate)
    test = _recover(ridge_predict(split.where("split = 'test'"), *fit.solve(best[0])), full)
    return test.select(F.lit(best[0]).alias("alpha"), F.lit(best[1]).alias("validation_top1"), "top1", "top10")


def _recover(guess: DataFrame, pool: DataFrame) -> DataFrame:
    near = nearest(guess.select(F.col("row").alias("query_id"), F.col("predicted").alias("vector")), pool.select(F.col("token").alias("id"), F.col("vec").alias("vector")), 10)
    return topk_rate(near, guess.select(F.col("row").alias("query_id"), F.col("token").alias("truth")))


def anchored_ridge(rows: DataFrame, by: str, alpha: float = 1e-2) -> DataFrame:
    """(by, p95) of the absolute cosine between recovered and true vectors of rows (x, y, anchor) that are no anchors.

    Each group is fitted on its anchors; a group is one condition of an audit and fits a task.
    """

    def recover(key, table):
        x, y = (np.array(table.column(c).to_pylist(), np.float64) for c in ("x", "y"))
        anchor = np.array(table.column("anchor").to_pylist(), bool)
        p95 = None
        if anchor.any() and not anchor.all():
            w = np.linalg.solve(x[anchor].T @ x[anchor] + alpha * np.eye(x.shape[1]), x[anchor].T @ y[anchor])
            guess, truth = x[~anchor] @ w, y[~anchor]
            size = np.linalg.norm(guess, axis=1) * np.linalg.norm(truth, axis=1)
            p95 = float(np.percentile(np.abs((guess * truth).sum(1) / np.where(size > 0, size, 1)), 95))
        return pa.table({by: pa.array([key[0].as_py()], table.schema.field(by).type), "p95": pa.array([p95], pa.float64())})

    kind = rows.schema[by].dataType.simpleString()
    return rows.select(by, V.doubles(F.col("x")).alias("x"), V.doubles(F.col("y")).alias("y"), "anchor").groupBy(by).applyInArrow(recover, f"`{by}` {kind}, p95 double")


def vote_match(scores: list[DataFrame], k: int) -> DataFrame:
    """Sum the row-wise z-scores of several (row, candidate, score) tables; (query_id, rank, id, score), true best first."""
    rows = None
    for s in scores:
        z = row_zscores(s).select("row", "candidate", "z")
        rows = z if rows is None else rows.union(z)
    total = rows.groupBy(F.col("row").alias("query_id"), F.col("candidate").alias("id")).agg(F.round(F.sum("z"), 9).alias("score"))
    return ranked(total, ["query_id"], [F.desc("score"), "id"], k).select("query_id", "rank", "id", "score")


def moments(rows: DataFrame, vector: str = "vector") -> np.ndarray:
    """The matrix of sums of products of (1, vector) over all rows: counts, sums and squares that add up over partitions."""

    def sums(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                both = np.hstack([np.ones((len(x), 1)), x])
                total = both.T @ both if total is None else total + both.T @ both
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tobytes()], pa.binary())], names=["m"])

    return _added(rows.select(V.doubles(F.col(vector))).mapInArrow(sums, "m binary"), rows.rdd.getNumPartitions())


def _added(partial: DataFrame, parts: int) -> np.ndarray:
    """The sum of square matrices (m, as bytes), of which tasks add some ``TREE`` each; 0 by 0 if there are none."""

    def add(batches):
        total = None
        for batch in batches:
            for m in batch.column(0).to_pylist():
                total = np.frombuffer(m).copy() if total is None else total + np.frombuffer(m)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    while parts > 1:
        parts = -(-parts // TREE)
        partial = partial.repartition(parts).mapInArrow(add, "m binary")
    found = partial.first()
    m = np.frombuffer(found["m"]) if found else np.zeros(0)
    return m.reshape((math.isqrt(len(m)),) * 2)


def vote_search(sources: list[tuple[DataFrame, DataFrame]], k: int, bins: int = 16) -> DataFrame:
    """What :func:`vote_match` gives for :func:`feature_scores` of several (left, right) tables, without a row for each pair.

    The mean and the deviation of a row's cosines follow from the moments of the right features, a first
    pass over them; the sum of z-scores is then one product of weighted features side by side, less a number
    for each row, and a second pass keeps the ``k`` best.  All sources hold the same ids.
    """
    left = right = None
    for n, (a, b) in enumerate(sources):
        unit = lambda t: t.select("id", V.normalized(V.sorted_quantiles(F.col("vec"), bins)).alias(f"f{n}"))  # noqa: B023, E731
        f, g = unit(a), unit(b)
        m = moments(g, f"f{n}")
        if not len(m):
            m = np.zeros((bins + 1, bins + 1))
        count = max(m[0, 0], 1.0)
        mean, square = F.array(*[F.lit(float(x)) for x in m[0, 1:] / count]), F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in m[1:, 1:] / count])
        average = V.dot(F.col(f"f{n}"), mean)
        second = V.dot(F.col(f"f{n}"), F.transform(square, lambda row: V.dot(row, F.col(f"f{n}"))))  # noqa: B023
        spread = F.sqrt(F.greatest(second - average * average, F.lit(0.0)))
        f = f.withColumns({"_m": average, "_s": spread}).withColumn("_s", F.when(F.col("_s") < 1e-8, 1.0).otherwise(F.col("_s")))
        f = f.select("id", F.transform(f"f{n}", lambda x: x / F.col("_s")).alias(f"f{n}"), (F.col("_m") / F.col("_s")).alias(f"o{n}"))
        left, right = (f, g) if left is None else (left.join(f, "id"), right.join(g, "id"))
    names = range(len(sources))
    q = left.select(F.col("id").alias("query_id"), F.concat(*[F.col(f"f{n}") for n in names]).alias("vector"), sum((F.col(f"o{n}") for n in names), F.lit(0.0)).alias("less"))
    found = nearest(q, right.select("id", F.concat(*[F.col(f"f{n}") for n in names]).alias("vector")), k, "dot")
    return found.join(q.select("query_id", "less"), "query_id").select("query_id", "rank", "id", F.round(F.col("score") - F.col("less"), 9).alias("score"))


def feature_scores(left: DataFrame, right: DataFrame, bins: int = 16) -> DataFrame:
    """(row, candidate, score): cosine of sorted-quantile features of (id, vec) tables, all pairs of the audit's candidates."""
    f = lambda t, n: t.select(F.col("id").alias(n), V.sorted_quantiles(F.col("vec"), bins).alias("vector"))
    return nearest(f(left, "query_id"), f(right, "id"), None).select(F.col("query_id").alias("row"), F.col("id").alias("candidate"), "score")


def projected(rows: DataFrame, matrix: np.ndarray, vec: str = "vec") -> DataFrame:
    """``rows`` (id, vec) with ``projection``, the product with ``matrix`` (dim by any)."""
    return ridge_predict(rows.select("id", V.doubles(F.col(vec)).alias(vec)), matrix, np.zeros(matrix.shape[1]), vec, "projection")


def scalar_invariants(rows: DataFrame, matrix: np.ndarray) -> DataFrame:
    """(id, value): mean of each row's projection."""
    return projected(rows, matrix).select("id", (V.total(F.col("projection")) / F.size("projection")).alias("value"))


def block_energies(rows: DataFrame, matrix: np.ndarray, width: int = 16) -> DataFrame:
    """(id, vector): squared norm of each ``width``-wide block of the projection; a last partial block counts too."""
    p = F.col("projection")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / width).cast("int")), lambda b: V.dot(F.slice(p, b * width + 1, F.lit(width)), F.slice(p, b * width + 1, F.lit(width))))
    return projected(rows, matrix).select("id", blocks.alias("vector"))


def row_grams(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., i, j, dot) of the rows (row_idx, vec) of each group; groups are prompts, of bounded length."""
    a = rows.select(*by, F.col("row_idx").alias("i"), F.col("vec").alias("a"))
    b = rows.select(*by, F.col("row_idx").alias("j"), F.col("vec").alias("b"))
    return a.join(b, by).select(*by, "i", "j", V.dot(F.col("a"), F.col("b")).alias("dot"))


def gram_fingerprints(observed: DataFrame, plain: DataFrame, by: list[str]) -> DataFrame:
    """(by..., distance): Frobenius distance, 0 to sqrt(2), of the row Gram matrices scaled to norm 1."""
    both = row_grams(observed, by).withColumnRenamed("dot", "x").join(row_grams(plain, by).withColumnRenamed("dot", "y"), [*by, "i", "j"])
    parts = both.groupBy(*by).agg(F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum(F.col("x") * F.col("y")).alias("xy"))
    size = F.sqrt(F.col("xx") * F.col("yy"))
    return parts.select(*by, F.sqrt(F.greatest(2 - 2 * F.when(size > 0, F.col("xy") / F.when(size > 0, size)).otherwise(0.0), F.lit(0.0))).alias("distance"))


def fingerprint_risk(distances: DataFrame, by: list[str]) -> DataFrame:
    """(by..., median, risk) where risk is the level of 1 - median / sqrt(2)."""
    medians = distances.groupBy(*by).agg(F.median("distance").alias("median"))
    return medians.withColumn("risk", risk_level(1 - F.col("median") / math.sqrt(2)))


GRAM_ROWS = 4096  # rows whose products a task adds at once


def column_grams(rows: DataFrame, by: list[str], cap: int | None = None) -> DataFrame:
    """(by..., part, m): column Gram matrices as bytes, summed over parts of a group so that a few remain for any size of group."""
    kinds = ", ".join(f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by)
    v = V.doubles(F.slice("vec", 1, cap) if cap else F.col("vec"))
    sizes = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / GRAM_ROWS).cast("long").alias("_parts"))
    dealt = with_group(rows.select(*by, v.alias("vec")), sizes, by).withColumn("part", F.pmod(F.xxhash64("vec"), F.col("_parts")))

    def named(key, table, total):
        keys = [pa.array([key[n].as_py()], table.schema.field(b).type) for n, b in enumerate(by)]
        return pa.table([*keys, pa.array([key[len(by)].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=[*by, "part", "m"])

    def product(key, table):
        x = matrix(table.column("vec"))
        return named(key, table, x.T @ x)

    def add(key, table):
        return named(key, table, sum(np.frombuffer(m) for m in table.column("m").to_pylist()))

    grams = dealt.select(*by, "part", "vec").groupBy(*by, "part").applyInArrow(product, f"{kinds}, part long, m binary")
    return grams.withColumn("part", F.floor(F.col("part") / 256)).groupBy(*by, "part").applyInArrow(add, f"{kinds}, part long, m binary")


def column_gram_error(observed: DataFrame, plain: DataFrame, by: list[str], cap: int | None = None) -> DataFrame:
    """(by..., error): relative Frobenius error of the column Gram matrices, over the first ``cap`` columns if given; null where the plain one is zero."""
    kinds = ", ".join(f"`{b}` {plain.schema[b].dataType.simpleString()}" for b in by)
    both = column_grams(observed, by, cap).withColumn("side", F.lit(0)).union(column_grams(plain, by, cap).withColumn("side", F.lit(1)))

    def error(key, table):
        side, parts = table.column("side").to_pylist(), table.column("m").to_pylist()
        keys = lambda n: [pa.array([key[k].as_py()] * n, table.schema.field(b).type) for k, b in enumerate(by)]
        if len(set(side)) < 2:  # only one side has the group
            return pa.table([*keys(0), pa.array([], pa.float64())], names=[*by, "error"])
        x, y = (sum(np.frombuffer(m) for s, m in zip(side, parts, strict=True) if s == k) for k in (0, 1))
        size = float(np.linalg.norm(y))
        return pa.table([*keys(1), pa.array([float(np.linalg.norm(x - y)) / size if size > 0 else None], pa.float64())], names=[*by, "error"])

    return both.groupBy(*by).applyInArrow(error, f"{kinds}, error double")


def singular_values(rows: DataFrame, by: list[str], k: int | None = None, name: str = "vector") -> DataFrame:
    """(by..., vector): squared singular values of each group's rows, largest first; a group is one small matrix."""
    kinds = ", ".join(f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by)

    def spectrum(key, table):
        values = np.linalg.svd(np.array(table.column("vec").to_pylist(), np.float64), compute_uv=False)[:k] ** 2
        return pa.table([*(pa.array([key[n].as_py()], table.schema.field(b).type) for n, b in enumerate(by)), pa.array([values.tolist()], pa.list_(pa.float64()))], names=[*by, name])

    return rows.select(*by, V.doubles(F.col("vec")).alias("vec")).groupBy(*by).applyInArrow(spectrum, f"{kinds}, {name} array<double>")


def spectrum_error(observed: DataFrame, plain: DataFrame, by: list[str]) -> DataFrame:
    """(by..., error): relative L2 error of the sorted squared singular values."""
    both = singular_values(observed, by, name="x").join(singular_values(plain, by, name="y"), by)
    return both.select(*by, (V.l2(F.col("x"), F.col("y")) / F.when(V.norm(F.col("y")) > 0, V.norm(F.col("y")))).alias("error"))


def signature_hits(signatures: DataFrame, reference: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, hit_rate): share of blocks (by..., block, vector) whose nearest reference block is itself."""
    q = signatures.select(*by, F.col("block").cast("long").alias("query_id"), "vector")
    c = reference.select(*by, F.col("block").cast("long").alias("id"), "vector")
    near = nearest(q, c, 1, "l2", by=by)
    return near.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("query_id") == F.col("id")).cast("double")).alias("hit_rate"))


def magnitude_signatures(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., vector): norms of each group's rows in row order."""
    return rows.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", V.norm(F.col("vec")).alias("n")))), lambda s: s["n"]).alias("vector"))


def audit_matrix(conditions: dict, audits: dict, skip: set | None = None) -> DataFrame:
    """(condition, audit, status, value): audits are functions from a condition to a one-row DataFrame with ``value``.

    An audit that fails gives an ``unknown`` row with the error's name, a skipped (condition, audit)
    ``not_applicable``.
    """
    out = None
    for condition, data in conditions.items():
        for name, audit in audits.items():
            spark = data.sparkSession
            if (condition, name) in (skip or set()):
                row = (condition, name, "not_applicable", None)
            else:
                try:
                    row = (condition, name, "ok", float(audit(data).first()["value"]))
                except Exception as error:  # the matrix reports failures of single audits
                    row = (condition, name, f"unknown: {type(error).__name__}", None)
            one = spark.createDataFrame([row], "condition string, audit string, status string, value double")
            out = one if out is None else out.union(one)
    return out


def acceptance_gate(results: DataFrame, limits: dict[str, float], bands: dict[str, tuple[float, float]]) -> DataFrame:
    """One row of booleans for each condition: a limit holds if its value is at most that, missing is false; a band is null if missing."""
    wide = results.groupBy("condition").pivot("audit", sorted({*limits, *bands})).agg(F.max("value"))
    return wide.select("condition", *[F.coalesce(F.col(a) <= v, F.lit(False)).alias(f"{a}_ok") for a, v in limits.items()], *[F.col(a).between(*b).alias(f"{a}_in_band") for a, b in bands.items()])


def seed_summary(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("seeds"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def feature_aggregates(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """mean, std (population), min, max, median and mean of the five largest."""
    top = ranked(rows.select(*by, value), by, [F.desc(value)], 5).groupBy(*by).agg(F.avg(value).alias("top5"))
    stats = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.median(value).alias("median"))
    return stats.join(top, by)


def feature_correlations(rows: DataFrame, features: list[str], outcome: str) -> DataFrame:
    """(feature, r): Pearson correlation of each feature column with the outcome."""
    long = rows.select(F.col(outcome).alias("y"), F.explode(F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))])).alias("feature", "x"))
    return long.groupBy("feature").agg(F.corr("x", "y").alias("r"))


RANGES = 64  # pieces in which a group's values are sorted


def gap_numbers(rows: DataFrame, by: list[str], value: str, eps: float | str, ranges: int = RANGES) -> DataFrame:
    """(by..., value, n, cluster): distinct values with their counts; the cluster grows by one where the gap to the value before exceeds ``eps``.

    ``eps`` is a number, or the name of one of the columns ``by``.

    A group is cut at quantiles into pieces of about equal size, which are sorted on their own; the last value
    and the number of gaps of each piece are carried to the next one.  Nulls take no part.
    """
    wide = F.col(eps) if isinstance(eps, str) else F.lit(eps)
    values = stored(rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")), "values")
    cuts = values.groupBy(*by).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("_cuts"))
    dealt = with_group(values, cuts, by).withColumn("_piece", F.size(F.filter(F.array_distinct("_cuts"), lambda c: c <= F.col(value)))).drop("_cuts")
    w = Window.partitionBy(*by, "_piece").orderBy(value)
    marked = dealt.withColumn("_gaps", F.sum(F.coalesce((F.col(value) - F.lag(value).over(w) > wide).cast("long"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    marked = stored(marked, "marked")
    line = Window.partitionBy(*by).orderBy("_piece")  # at most ``ranges`` rows of a group
    pieces = marked.groupBy(*by, "_piece").agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.max("_gaps").alias("_inner"))
    pieces = pieces.withColumn("_opens", F.coalesce((F.col("_low") - F.lag("_high").over(line) > wide).cast("long"), F.lit(0)))
    before = F.sum(F.col("_opens") + F.col("_inner")).over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_inner")
    placed = with_group(marked, pieces.select(*by, "_piece", before.alias("_before")), [*by, "_piece"])
    return placed.select(*by, value, "n", (F.col("_gaps") + F.col("_before")).alias("cluster"))


def gap_clusters(rows: DataFrame, by: list[str], value: str, eps: float) -> DataFrame:
    """(by..., cluster, size, low, high): sorted values split where the gap exceeds ``eps``; nulls take no part."""
    return gap_numbers(rows, by, value, eps).groupBy(*by, "cluster").agg(F.sum("n").alias("size"), F.min(value).alias("low"), F.max(value).alias("high"))


def spans_of(values: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """First place and size of the greedy clusters of sorted ``values``, whose span is at most ``eps``."""
    starts, at = [], 0
    while at < len(values):
        starts.append(at)
        end = int(np.searchsorted(values, values[at] + eps, side="right"))
        while end < len(values) and values[end] - values[at] <= eps:
            end += 1
        while end > at + 1 and values[end - 1] - values[at] > eps:
            end -= 1
        at = max(end, at + 1)
    first = np.array(starts, np.int64)
    return first, np.diff(np.append(first, len(values)))


def span_clusters(rows: DataFrame, by: list[str], value: str, eps: float | str) -> DataFrame:
    """(by..., cluster, size, low): greedy clusters from the smallest value whose span is at most ``eps``; nulls take no part.

    Values are first split where the gap exceeds ``eps``, as no cluster spans such a gap; a task folds the
    distinct values of one such piece and not of a whole group.  ``eps`` is a number, or one of the columns ``by``.
    """
    pieces = gap_numbers(rows.select(*by, F.col(value).cast("double").alias("_v")), by, "_v", eps)
    kinds = ", ".join(f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by)

    def fold(key, table):
        table = table.sort_by("_v")
        values, n = table.column("_v").to_numpy(), table.column("n").to_numpy()
        first, _ = spans_of(values, key[by.index(eps)].as_py() if isinstance(eps, str) else eps)
        own = [pa.array([key[k].as_py()] * len(first), table.schema.field(b).type) for k, b in enumerate(by)]
        return pa.table([*own, pa.array(np.add.reduceat(n, first), pa.int64()), pa.array(values[first], pa.float64())], names=[*by, "size", "low"])

    found = stored(pieces.groupBy(*by, "cluster").applyInArrow(fold, f"{kinds}, size long, low double"), "spans")
    return numbered(found, by, "low", "cluster").select(*by, "cluster", "size", "low")


# The widths for which pairs are analysed, and the least pairs of a useful cluster.
EPSILONS = (0.01, 0.05, 0.10, 0.25)
USEFUL = 8


def pair_coverage(pairs: DataFrame, by: list[str], epsilons: tuple[float, ...] = EPSILONS, least: int = USEFUL) -> DataFrame:
    """(by..., eps, symmetric, coverage, verdict) of (by..., a, b) pairs, for each width ``eps``; shares in percent.

    A pair is symmetric if its values differ by less than ``eps``.  The means of symmetric pairs are
    clustered with a span of at most ``eps``; coverage is the share of all pairs that lie in clusters of
    ``least`` or more.
    """
    rows = pairs.withColumn("eps", F.explode(F.array(*[F.lit(float(e)) for e in epsilons])))
    rows = rows.select(*by, "eps", (F.abs(F.col("a") - F.col("b")) < F.col("eps")).alias("same"), ((F.col("a") + F.col("b")) / 2).alias("mean"))
    keys = [*by, "eps"]
    share = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (100 * F.avg(F.col("same").cast("double"))).alias("symmetric"))
    big = span_clusters(rows.where("same"), keys, "mean", "eps").where(F.col("size") >= least).groupBy(*keys).agg(F.sum("size").alias("held"))
    held = big.select(*[F.col(k).alias(f"_{k}") for k in keys], "held")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return share.join(held, same, "left").select(*keys, "symmetric", (100 * F.coalesce("held", F.lit(0)) / F.col("n")).alias("coverage")).withColumn("verdict", coverage_verdict(F.col("coverage")))


def coverage_verdict(percent: Column) -> Column:
    return F.when(percent >= 50, "viable").when(percent >= 25, "marginal").otherwise("dead")


def paired_cosines(pairs: DataFrame) -> DataFrame:
    """One row of mean, std, p10, p90 of the cosine of (a, b)."""
    rows = pairs.select(V.cosine(F.col("a"), F.col("b")).alias("c"))
    return rows.agg(F.avg("c").alias("mean"), F.stddev_pop("c").alias("std"), F.percentile("c", 0.1).alias("p10"), F.percentile("c", 0.9).alias("p90"))


def flatten_heads(cells: DataFrame, width: int, diagonal: bool = False) -> DataFrame:
    """(prompt, q, vector) of cells (prompt, head, q, kv, value): values by head and kv, padded with zeros to ``width``."""
    rows = cells.where("q = kv") if diagonal else cells
    lists = rows.groupBy("prompt", "q").agg(F.transform(F.sort_array(F.collect_list(F.struct("head", "kv", F.col("value").cast("double").alias("value")))), lambda s: s["value"]).alias("v"))
    return lists.select("prompt", "q", V.resized(F.col("v"), width).alias("vector"))


def head_summary(rows: DataFrame) -> DataFrame:
    """One row over heads of the mean over seeds of (head, seed, value): least, median, mean, p90, most and the best head."""
    heads = rows.groupBy("head").agg(F.avg("value").alias("v"))
    return heads.agg(F.min("v").alias("min"), F.median("v").alias("median"), F.avg("v").alias("mean"), F.percentile("v", 0.9).alias("p90"), F.max("v").alias("max"), F.max_by("head", F.struct("v", -F.col("head"))).alias("best_head"))


def compare_values(cells: DataFrame, by: str) -> DataFrame:
    """(by, statistics) of cells (by, plain, protected): moments of both, differences, correlation, near equality."""
    d = F.abs(F.col("plain") - F.col("protected"))
    stats = [f(side).alias(f"{side}_{n}") for side in ("plain", "protected") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return cells.groupBy(by).agg(*stats, F.max(d).alias("max_diff"), F.median(d).alias("median_diff"), F.corr("plain", "protected").alias("r"), F.avg((d <= 1e-4).cast("double")).alias("equal"))


def label_repetition(rows: DataFrame, label: str, top: int = 10) -> DataFrame:
    """One row: total, distinct, median, mean and largest count of a label, and the ``top`` largest counts."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    most = counts.orderBy(F.desc("n")).limit(top).agg(F.reverse(F.sort_array(F.collect_list("n"))).alias("largest"))  # one row
    stats = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.median("n").alias("median"), F.avg("n").alias("mean"), F.max("n").alias("max"))
    return stats.join(F.broadcast(most))


def split_leakage(rows: DataFrame, key: str, label: str, seeds: tuple[int, ...] = (0,)) -> DataFrame:
    """(seed, n, leak): test rows, and the share of them whose label is also a training label, for each seed's split."""
    out = None
    for seed in seeds:
        split = split_rows(rows, key, seed=seed)
        train = split.where("split = 'train'").select(label).distinct().withColumn("seen", F.lit(1.0))
        one = split.where("split = 'test'").join(train, label, "left").agg(F.lit(seed).alias("seed"), F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.coalesce("seen", F.lit(0.0))), F.lit(0.0)).alias("leak"))
        out = one if out is None else out.union(one)
    return out


def token_pool(sequences: DataFrame, n: int, tokens: str = "tokens") -> DataFrame:
    """(rank, token, n, share) of the ``n`` most frequent tokens, ties to the smaller token."""
    top = token_frequencies(sequences, tokens).orderBy(F.desc("n"), "token").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "token")) - 1).select("rank", "token", "n", "share")

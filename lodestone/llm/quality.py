"""Document quality from a linear-chain conditional random field over lines.

Each line gets features of itself and of the lines before and after it.  A two-state chain (bad,
good) is trained on lines that carry their document's label; forward-backward gives each line's
probability of being good, and a document's score is the mean of these weighted by line length.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import extended, slices

N_LINE = 12  # features of one line without its neighbours


@functools.cache
def char_classes() -> np.ndarray:
    """0 lower-case and other letters, 1 upper case, 2 digit, 3 white space, 4 sentence marks, 5 ! and ?, 6 other signs, 7 line feed."""
    table = np.full(0x110000, 6, np.uint8)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            table[point] = 1 if char.isupper() else 0
        elif char.isdigit():
            table[point] = 2
        elif char.isspace():
            table[point] = 3
    table[[ord(c) for c in ".,;:'\"()-"]] = 4
    table[[ord(c) for c in "!?"]] = 5
    table[10] = 7
    return table


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x N_LINE) and the weight (length + 1) of each line; an empty text is one empty line."""
    lines = text.split("\n")
    classes = char_classes()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    line = np.cumsum(classes == 7)
    line -= classes == 7
    counts = np.bincount(line * 8 + classes, minlength=len(lines) * 8).reshape(-1, 8)[: len(lines), :7].astype(np.float64)
    size = counts.sum(axis=1)
    seen: dict[str, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    repeated, words, distinct = np.empty((3, len(lines)))
    for k, x in enumerate(lines):
        parts = x.split()
        words[k], distinct[k], repeated[k] = len(parts), len(set(parts)), seen[x] > 1 and x != ""
    n, w = np.maximum(size, 1), np.maximum(words, 1)
    return np.column_stack([
        np.log1p(size) / 8, counts[:, 1] / n, counts[:, 2] / n, counts[:, 3] / n, counts[:, 4] / n, counts[:, 5] / n, counts[:, 6] / n,
        np.minimum(size / w / 20, 2), repeated, np.minimum(counts[:, 6] / w, 3), np.minimum(counts[:, 5] / w, 3), 1 - distinct / w,
    ]), size + 1


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """A constant, each line's features, and those of the line before and the line after (zeros at the ends)."""
    edge = np.zeros((1, x.shape[1]))
    return np.hstack([np.ones((len(x), 1)), x, np.vstack([edge, x[:-1]]), np.vstack([x[1:], edge])])


def forward_backward(emit: list[np.ndarray], trans: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, float]:
    """For many chains: P(good) of each line, expected transitions (2 x 2) and the log partition sum.

    ``emit`` holds each chain's score of "good" by line, against 0 for "bad".  Chains go side by side
    with those of up to twice their length, so that padding at most doubles what they hold.
    """
    order = sorted(range(len(emit)), key=lambda k: -len(emit[k]))
    out: list[np.ndarray] = [np.zeros(0)] * len(emit)
    expected, total, at = np.zeros((2, 2)), 0.0, 0
    while at < len(order):
        end = at + 1
        while end < len(order) and 2 * len(emit[order[end]]) + 8 >= len(emit[order[at]]):
            end += 1
        own = order[at:end]
        good, moved, z = _side_by_side([emit[k] for k in own], trans)
        for k, g in zip(own, good, strict=True):
            out[k] = g
        expected += moved
        total += z
        at = end
    return out, expected, total


def _side_by_side(emit: list[np.ndarray], trans: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, float]:
    """:func:`forward_backward` of chains that are sorted from long to short."""
    sizes = np.array([len(e) for e in emit])
    longest = int(sizes.max()) if len(sizes) else 0
    pad = np.zeros((longest, len(emit)))
    for col, e in enumerate(emit):
        pad[: sizes[col], col] = e
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), side="right")  # chains that have a line t
    alpha, beta = np.zeros((longest, len(emit), 2)), np.zeros((longest, len(emit), 2))
    for t in range(longest):
        a = active[t]
        if t:
            before = alpha[t - 1, :a]
            alpha[t, :a] = np.logaddexp(before[:, :1] + trans[0], before[:, 1:] + trans[1])
        alpha[t, :a, 1] += pad[t, :a]
    for t in range(longest - 2, -1, -1):
        a = active[t + 1]
        after = beta[t + 1, :a].copy()
        after[:, 1] += pad[t + 1, :a]
        beta[t, :a] = np.logaddexp(after[:, :1] + trans[:, 0], after[:, 1:] + trans[:, 1])
    last = alpha[sizes - 1, np.arange(len(emit))] if longest else np.zeros((0, 2))
    z = np.logaddexp(last[:, 0], last[:, 1])
    good = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z)
    expected = np.zeros((2, 2))
    here = np.arange(longest)[1:, None] < sizes  # chains that move to line t
    for i in (0, 1):
        for j in (0, 1):
            expected[i, j] = np.exp((alpha[:-1, :, i] + trans[i, j] + j * pad[1:] + beta[1:, :, j] - z)[here]).sum()
    return [good[: sizes[col], col] for col in range(len(emit))], expected, float(z.sum())


@dataclass(frozen=True)
class LineCrf:
    weights: np.ndarray
    trans: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        feats = [line_features(t or "") for t in texts]
        marginals, _, _ = forward_backward([with_neighbours(x) @ self.weights for x, _ in feats], self.trans)
        return np.array([float(np.clip((m * w).sum() / w.sum(), 0, 1)) for m, (_, w) in zip(marginals, feats, strict=True)])

    def apply(self, docs: DataFrame, text: str = "text", score: str = "score") -> DataFrame:
        """``docs`` with ``score``, replacing a column of this name; a null text scores as an empty one."""
        kept = docs.drop(score)
        at, model = kept.columns.index(text), self
        schema = extended(kept.schema, **{score: "double"})
        names = schema.names

        def predict(batches):
            for batch in slices(batches, 256):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(batch.column(at).to_pylist()), pa.float64())], names=names)

        return kept.mapInArrow(predict, schema)


def train(feats: list[np.ndarray], labels: np.ndarray, steps: int = 120, l2: float = 1e-5, rate: float = 0.3) -> LineCrf:
    """Maximise the mean conditional log likelihood by line with Adam; the classes weigh as they occur."""
    width = 1 + 3 * N_LINE
    if not len(feats) or labels.min() == labels.max():
        prior = float(labels.mean()) if len(feats) else 0.5
        weights = np.zeros(width)
        weights[0] = np.log((prior * 0.98 + 0.01) / (1 - prior * 0.98 - 0.01))
        return LineCrf(weights, np.zeros((2, 2)))
    rows = [with_neighbours(x) for x in feats]
    ends = np.cumsum([len(x) for x in rows])
    flat, total = np.vstack(rows), float(ends[-1])
    truth = np.repeat(labels, [len(x) for x in rows])
    seen = np.zeros((2, 2))
    for y, x in zip(labels, rows, strict=True):
        seen[y, y] += len(x) - 1
    param, m, v = np.zeros(width + 4), 0.0, 0.0
    for step in range(1, steps + 1):
        weights, trans = param[:width], param[width:].reshape(2, 2)
        good, expected, _ = forward_backward(np.split(flat @ weights, ends[:-1]), trans)
        grad = np.concatenate([flat.T @ (truth - np.concatenate(good)), (seen - expected).ravel()]) / total - l2 * param
        grad[width:] -= 0.01 * param[width:]  # all lines of a training document agree: keep the chain from locking
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        param = param + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return LineCrf(param[:width], param[width:].reshape(2, 2))


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", fit_docs: int = 2_500, fit_lines: int = 60_000) -> LineCrf:
    """Train on labelled documents.

    At most about ``fit_docs`` documents are used, picked by a hash of the key, and of them no more
    than ``fit_lines`` lines: these bounds hold what one machine must fit at any size of the corpus.
    Without usable labels the scores are a constant.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    truth = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and key is not null")
    total = truth.count()
    if total > fit_docs:
        truth = truth.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(1_000_000 * fit_docs / total))
    truth = truth.groupBy("key").agg(F.max("y").alias("y"))  # bounded by fit_docs

    def features(batches):
        for batch in slices(batches, 256):
            made = [line_features(t)[0].astype(np.float32)[:fit_lines] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x.tobytes() for x in made], pa.binary())], names=["y", "x"])

    pairs = rows.join(F.broadcast(truth) if min(total, fit_docs) <= 200_000 else truth, "key").orderBy(F.xxhash64("text"), "key").select("text", "y")
    feats, ys, lines = [], [], 0
    for row in pairs.mapInArrow(features, "y int, x binary").toLocalIterator():
        x = np.frombuffer(row["x"], np.float32).reshape(-1, N_LINE).astype(np.float64)
        feats.append(x)
        ys.append(row["y"])
        lines += len(x)
        if lines >= fit_lines:
            break
    return train(feats, np.array(ys, dtype=int))

"""Language identification with hyperdimensional profiles.

Every letter owns a random +1/-1 vector.  An n-gram vector binds the letters' vectors, each rotated
by its place in the n-gram; a text's vector bundles (adds) its n-gram vectors.  Bundling the texts
of a language gives its prototype; a text gets the language whose prototype has the largest cosine.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import extended, slices

CHUNK = 500_000  # code points of a text that are encoded at once
GRAMS = 1_000_000  # n-grams that are held at a time
BLOCK = 2048  # distinct n-grams that are bound and counted at a time


@functools.cache
def letter_codes() -> np.ndarray:
    """Lower-cased code point of each letter, 0 for everything else."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            table[point] = ord(char.lower()[0])
    return table


@functools.cache
def letter_vector(code: int, dim: int, seed: int) -> np.ndarray:
    bits = np.random.Generator(np.random.PCG64([seed, code])).integers(0, 2, dim, dtype=np.int8)
    return bits * np.int8(2) - np.int8(1)


def symbols(text: str, n: int = 1, chunk: int = CHUNK) -> Iterator[np.ndarray]:
    """Letters as codes; each run of other characters, and either end, as one 0.  Nothing without letters.

    Long texts come in pieces that repeat the last ``n`` - 1 symbols of the piece before, so that the
    n-grams of all pieces are those of the whole text.
    """
    carried, skip, some = np.zeros(1, np.uint32), 0, False
    for at in range(0, len(text), chunk):
        codes = letter_codes()[np.frombuffer(text[at : at + chunk].encode("utf-32-le", "replace"), np.uint32)]
        codes = np.concatenate((carried, codes, np.zeros(int(at + chunk >= len(text)), np.uint32)))
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        codes = codes[keep]
        some = some or bool(codes.any())
        if some and len(codes) - skip >= n:
            yield codes[skip:]
            hold = max(n - 1, 1)
            carried, skip = codes[-hold:], hold - (n - 1)
        else:
            carried = codes


def ngram_keys(codes: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit key per n-gram (n is at most 3: 21 bits a letter)."""
    if len(codes) < n:
        codes = np.concatenate((codes, np.zeros(n - len(codes), codes.dtype)))
    keys = np.zeros(len(codes) - n + 1, np.uint64)
    for place in range(n):
        keys = (keys << np.uint64(21)) | codes[place : place + len(keys)].astype(np.uint64)
    return keys


def _add_grams(out: np.ndarray, owner: np.ndarray, keys: np.ndarray, n: int, seed: int) -> None:
    """Add the vectors of the n-grams ``keys`` to their owners' rows of ``out``, ``BLOCK`` distinct n-grams at a time."""
    rows, dim = out.shape
    order = np.argsort(keys, kind="stable")
    owner, keys = owner[order], keys[order]
    fresh = np.concatenate(([True], keys[1:] != keys[:-1]))
    which, grams = np.cumsum(fresh) - 1, keys[fresh]
    letters = [((grams >> np.uint64(21 * (n - 1 - place))) & np.uint64(0x1FFFFF)).astype(np.int64) for place in range(n)]
    alphabet = np.unique(np.concatenate(letters))
    cuts = np.searchsorted(which, np.arange(0, len(grams) + BLOCK, BLOCK))
    for at, low, high in zip(range(0, len(grams), BLOCK), cuts, cuts[1:], strict=False):
        own = [x[at : at + BLOCK] for x in letters]
        used = np.unique(np.concatenate(own)) if len(alphabet) > BLOCK else alphabet
        vectors = np.stack([letter_vector(int(c), dim, seed) for c in used])
        bound = np.ones((len(own[0]), dim), np.int8)
        for place in range(n):
            bound *= np.roll(vectors, n - 1 - place, axis=1)[np.searchsorted(used, own[place])]
        counts = np.bincount(owner[low:high] * BLOCK + which[low:high] - at, minlength=rows * BLOCK).reshape(rows, BLOCK)
        out += counts[:, : len(bound)].astype(np.float32) @ bound.astype(np.float32)


def bundle(texts: list[str | None], dim: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors (texts x dim) and whether each text has letters.  At most about ``GRAMS`` n-grams are held at a time."""
    out, some = np.zeros((len(texts), dim)), np.zeros(len(texts), bool)
    held: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if held:
            _add_grams(out, np.repeat([row for row, _ in held], [len(k) for _, k in held]), np.concatenate([k for _, k in held]), n, seed)
            held.clear()

    size = 0
    for row, text in enumerate(texts):
        for codes in symbols(text or "", n):
            some[row] = True
            held.append((row, ngram_keys(codes, n)))
            size += len(codes)
            if size > GRAMS:
                flush()
                size = 0
    flush()
    return out, some


@dataclass(frozen=True)
class LanguageProfiles:
    """Prototypes by language; ``apply`` predicts."""

    languages: tuple[str, ...]
    prototypes: np.ndarray
    dim: int
    n: int
    seed: int

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        vectors, some = bundle(texts, self.dim, self.n, self.seed)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        cosine = vectors @ self.prototypes.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        best = cosine.argmax(axis=1)
        top = np.where(some, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0.0)
        return [self.languages[b] if s else "und" for b, s in zip(best, some, strict=True)], top.astype(float)

    def apply(self, docs: DataFrame, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
        """``docs`` with ``label`` and ``score`` (cosine to the best prototype, 0 to 1), replacing columns of these names.

        Null texts and texts without a letter get ``und`` and 0, as does everything if no language was learned.
        """
        kept = docs.drop(label, score)
        at, model = kept.columns.index(text), self
        schema = extended(kept.schema, **{label: "string", score: "double"})
        names = schema.names

        def predict(batches):
            for batch in slices(batches, 128, 600_000):
                labels, top = model.scores(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(top, pa.float64())], names=names)

        return kept.mapInArrow(predict, schema)


def fit_language_profiles(docs: DataFrame, text: str = "text", label: str = "lang", dim: int = 1024, n: int = 3, seed: int = 7, fit_rows: int = 20_000) -> LanguageProfiles:
    """Learn a prototype for each non-null ``label``.

    At most about ``fit_rows`` rows are used, picked by a hash of the text, so that fitting time is
    bounded; what returns to the driver is one vector for each language.  Rows without letters,
    text or label teach nothing; an empty table gives no languages.
    """
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("lang")).where("text is not null and lang is not null")
    total = rows.count()
    if total > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * fit_rows / total))

    def bundles(batches):
        for batch in slices(batches, 128, 600_000):
            vectors, some = bundle(batch.column(0).to_pylist(), dim, n, seed)
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for lang in sorted(set(langs[some])):
                total = vectors[(langs == lang) & some].sum(axis=0, dtype=np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total.tobytes()], pa.binary())], names=["lang", "sum"])

    def add(key, table):
        total = np.sum([np.frombuffer(x, np.float64) for x in table.column("sum").to_pylist()], axis=0)
        return pa.table({"lang": [key[0].as_py()], "sum": pa.array([total.tobytes()], pa.binary())})

    found = sorted(rows.mapInArrow(bundles, "lang string, sum binary").groupBy("lang").applyInArrow(add, "lang string, sum binary").collect())
    prototypes = np.array([np.frombuffer(r["sum"], np.float64) for r in found]).reshape(len(found), dim)
    prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)
    return LanguageProfiles(tuple(r["lang"] for r in found), prototypes.astype(np.float32), dim, n, seed)

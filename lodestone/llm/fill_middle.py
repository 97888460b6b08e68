"""Fill-in-the-middle: documents cut at two places between units and written as prefix, suffix, middle.

One ``fullmatch`` of ``(unit)*`` by the regex library keeps every repetition of its group, so the ends
of that group give the number of units and the offset of any cut.  Texts beyond a million characters
are matched in windows that end behind a character that is a unit by itself, which changes no unit and
bounds what a match holds.  The cuts are the only thing computed in Python; orders are Spark columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import extended, let, slices, windows

UNIT = r"[A-Za-z]++|[^A-Za-z]"
SEAM = re.compile("[^A-Za-z]")


@dataclass(frozen=True)
class Settings:
    """Of a hundred documents ``changed`` are rearranged, and of those ``suffix_first`` of a hundred begin with the suffix."""

    changed: int = 90
    suffix_first: int = 20
    seed: str = "1"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def unit_ends(text: str) -> np.ndarray:
    """The offset behind each unit of ``text``, in characters."""
    import regex

    pattern, parts, at = regex.compile(f"({UNIT})*+"), [np.zeros(0, np.int64)], 0
    for piece in windows(text, SEAM):
        parts.append(np.array(pattern.fullmatch(piece).ends(1), np.int64) + at)
        at += len(piece)
    return np.concatenate(parts)


def draws(key: Column, seed: str = "1") -> list[Column]:
    """Four unsigned 32-bit numbers: the first groups of eight digits of the SHA-256 of ``seed:key``; a null key is the text 'null'."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def cut_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``docs`` with n_units, form, prefix_chars, middle_chars and output, replacing columns of these names.

    The prefix ends after the smaller of ``h1 % (n + 1)`` and ``h2 % (n + 1)`` units and the middle after
    the larger.  A document is ``plain`` (output: the text; no lengths) if its text is null or empty or
    holds a sentinel, or by ``h3``; else ``spm`` or ``psm`` by ``h4``.  Each row stands alone: equal
    rows give equal rows, an empty table an empty one.
    """
    made = ("n_units", "form", "prefix_chars", "middle_chars", "output")
    kept = docs.drop(*made)
    assert {key, text} <= set(kept.columns), "the key and the text cannot bear the name of a result"
    rows = kept.withColumns({"n_units": F.coalesce(F.col(text).cast("string"), F.lit("")), "prefix_chars": draws(F.col(key), settings.seed)[0], "middle_chars": draws(F.col(key), settings.seed)[1]})
    schema = extended(kept.schema, n_units="long", prefix_chars="long", middle_chars="long")
    width = len(kept.columns)

    def cut(batches):
        for batch in slices(batches, 256):
            n, first, last = [], [], []
            for value, a, b in zip(*(batch.column(width + k).to_pylist() for k in range(3)), strict=True):
                ends = unit_ends(value)
                a, b = sorted((a % (len(ends) + 1), b % (len(ends) + 1)))
                n.append(len(ends))
                first.append(int(ends[a - 1]) if a else 0)
                last.append(int(ends[b - 1]) if b else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *(pa.array(x, pa.int64()) for x in (n, first, np.subtract(last, first)))], names=schema.names)

    _, _, h3, h4 = draws(F.col(key), settings.seed)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    marked = F.lit(False)
    for s in settings.sentinels:
        marked = marked | body.contains(s)
    form = F.when((body == "") | marked | (h3 % 100 >= settings.changed), "plain").when(h4 % 100 < settings.suffix_first, "spm").otherwise("psm")
    head = F.substring(body, F.lit(1), F.col("prefix_chars").cast("int"))
    middle = F.substring(body, (F.col("prefix_chars") + 1).cast("int"), F.col("middle_chars").cast("int"))
    rest = F.substring(body, (F.col("prefix_chars") + F.col("middle_chars") + 1).cast("int"), F.lit(2**31 - 1))
    p, s, m = (F.lit(x) for x in settings.sentinels)
    output = F.when(F.col("form") == "plain", body).when(F.col("form") == "psm", F.concat(p, head, s, rest, m, middle)).otherwise(F.concat(s, rest, p, head, m, middle))
    out = rows.mapInArrow(cut, schema).withColumn("form", form).withColumn("output", output)
    lengths = {c: F.when(F.col("form") != "plain", F.col(c)) for c in ("prefix_chars", "middle_chars")}
    return out.withColumns(lengths).select(*kept.columns, *made)


def restored(output: Column, form: Column, settings: Settings = Settings()) -> Column:
    """The text that ``output`` was made of: no text that holds a sentinel is ever rearranged, so each occurs once."""
    parts = lambda: F.split(output, "|".join(re.escape(x) for x in settings.sentinels), -1)
    psm = let(parts(), lambda x: F.concat(x[1], x[3], x[2]))
    spm = let(parts(), lambda x: F.concat(x[2], x[3], x[1]))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)

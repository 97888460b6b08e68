"""Order MinHash fingerprints with DataFrame functions only.

k-mers are substrings of ``k`` characters, white space included (shorter at the end of the text).  Every
character of the text starts one, so an inserted character changes those near it only.  k-mers are
numbered by their occurrence in the text.

Every one of the ``m`` sketches orders these numbered k-mers of the text, takes the ``l`` smallest, puts
them back in text order and hashes that tuple.  The orders are rotations of one hash: a sketch's
smallest k-mers are those that follow its own start in the sorted hashes, round the end.  For any one
sketch all k-mers are as likely to be chosen as under a hash of its own, and two texts agree in it
exactly if they would under the order that this rotation defines on the k-mers of both; sketches of
texts of few k-mers depend on each other.  Because tuples keep the order, moving text apart changes
them, as it changes edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import let

PLACE = 28  # bits of a packed k-mer that hold its place; the hash is above them.  Spark's arrays of longs end below 2 ** 28
LOW = (1 << PLACE) - 1
MOST_RANGES = 10_000  # ranges of keys; their cuts and heads are a few hundred kB


def _pack(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(F.lit(~LOW)).bitwiseOR(place)


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(LOW))


def _steps(size: Column, bits: int) -> Column:
    """Powers of two that are not above ``size``, largest first: the steps of a binary search."""
    return F.filter(F.array(*[F.lit(1 << b) for b in range(bits, -1, -1)]), lambda step: step <= size)


def _first_from(s: Column, steps: Column, floor: Column) -> Column:
    """Index of the first element of sorted ``s`` that is not below ``floor``."""
    return F.aggregate(steps, F.lit(-1), lambda at, step: F.when(F.get(s, at + step) < floor, at + step).otherwise(at)) + 1


def rotations(m: int) -> list[int]:
    """The hash values from which the sketches draw, evenly round the circle."""
    return [(-(2**63) + j * (2**64 // m)) & ~LOW for j in range(m)]


def _numbered(s: Column) -> Column:
    """Sorted packed k-mers: first occurrences keep their hash, later ones are hashed with their number."""

    def same(x: Column, y: Column) -> Column:
        return F.shiftrightunsigned(x.bitwiseXOR(y), PLACE) == 0

    def number(x: Column, j: Column, steps: Column) -> Column:
        first = F.when(same(x, F.get(s, j - 2)), _first_from(s, steps, x.bitwiseAND(F.lit(~LOW)))).otherwise(j - 1)  # most k-mers that come again come twice
        return F.when(same(x, F.get(s, j - 1)), _pack(F.xxhash64(F.shiftright(x, PLACE), j - first), _place(x))).otherwise(x)

    return let(_steps(F.size(s), PLACE), lambda steps: F.transform(s, lambda x, j: number(x, j, steps)))


def _sketches(p: Column, l: int, m: int) -> Column:  # noqa: E741
    """Tuple hashes of the ``m`` rotations over sorted, numbered k-mers."""

    def sketch(steps: Column, start: Column) -> Column:
        def tuple_hash(at: Column) -> Column:
            chosen = [F.get(p, F.when(at + t < F.size(p), at + t).otherwise((at + t) % F.size(p))) for t in range(l)]
            chosen = F.slice(F.array(*chosen), F.lit(1), F.least(F.lit(l), F.size(p)))
            in_order = F.transform(F.sort_array(F.transform(chosen, lambda x: F.struct(_place(x).alias("place"), F.shiftrightunsigned(x, PLACE).alias("hash")))), lambda x: x["hash"])
            return let(in_order, lambda c: F.xxhash64(*[F.get(c, F.lit(i)) for i in range(l)]).bitwiseAND(F.lit(0xFFFFFFFF)))

        return let(_first_from(p, steps, start), tuple_hash)

    return let(_steps(F.size(p), PLACE), lambda steps: F.transform(F.array(*[F.lit(s).cast("long") for s in rotations(m)]), lambda start: sketch(steps, start)))


def with_signature(rows: DataFrame, text: str = "text", into: str = "signature", k: int = 16, l: int = 2, m: int = 48) -> DataFrame:  # noqa: E741
    """``rows`` with ``into``: ``m`` tuple hashes (unsigned 32-bit values as long) of all k-mers of ``text``.

    Null counts as empty; an empty text is one empty k-mer.  The sorted k-mers are columns on the way, as
    Spark sorts longs with generated code there and boxed ones within a lambda.  In UTF-32 a k-mer is found
    by its place.  A text's k-mers are in memory at once.
    """

    def kmers(wide: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.octet_length(wide) - 3, F.lit(1)), F.lit(4))
        return F.transform(starts, lambda at, i: _pack(F.xxhash64(F.substring(wide, at, F.lit(4 * k))), i.cast("long")))

    found, numbered = f"{into}_found", f"{into}_numbered"
    rows = rows.withColumn(found, F.sort_array(let(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-32"), kmers)))
    rows = rows.withColumn(numbered, F.sort_array(_numbered(F.col(found))))
    return rows.withColumn(into, _sketches(F.col(numbered), l, m)).drop(found, numbered)


def signature(text: Column, k: int = 16, l: int = 2, m: int = 48, run: int = 6) -> Column:  # noqa: E741
    """As :func:`with_signature`, as one expression and of thinned k-mers; no query uses it, and the two do not compare.

    k-mers start at the text's first character, at every run of white space and every ``run`` characters
    within it, and at every character that has ``run`` others without white space before it.
    """
    text = F.coalesce(text, F.lit(""))
    kmers = F.regexp_extract_all(text, F.lit(r"(?s)(?=(.{1,%d}))(?:\s{1,%d}+\S{0,%d}+|^\S{1,%d}+|\S)" % (k, run, run, run)), F.lit(1))
    found = F.transform(kmers, lambda x, i: _pack(F.xxhash64(x), i.cast("long")))
    found = let(found, lambda f: F.when(F.size(f) == 0, F.array(_pack(F.xxhash64(text), F.lit(0).cast("long")))).otherwise(f))
    return let(F.sort_array(let(F.sort_array(found), _numbered)), lambda p: _sketches(p, l, m))


def fingerprint(signature: Column) -> Column:
    """Eight hexadecimal digits for each sketch."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal sketches, 0 to 1."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.size(a)


def ranges(rows: DataFrame, key: str, tie: str, bucket_rows: int) -> Column:
    """Number of the range that a row falls into, rising with (``key``, ``tie``), null keys lowest.

    Cuts are quantiles of the key; a key that fills several ranges, and null keys, are cut by the tie,
    which must be a hash.
    """
    count, nulls = rows.agg(F.count(F.lit(1)), F.count_if(F.col(key).isNull())).first()
    wanted = min(MOST_RANGES, max(1, (count - nulls) // bucket_rows))
    cuts = rows.agg(F.percentile_approx(key, [i / wanted for i in range(1, wanted)], 10 * wanted)).first()[0] if wanted > 1 else []
    tie_share = F.shiftrightunsigned(F.col(tie).bitwiseXOR(F.lit(-(2**63))), 34)  # 30 bits that rise with the tie

    def part(n: Column) -> Column:
        return F.shiftright(tie_share * n, 30)

    own, first, times = [], [], []
    at = 0
    for cut in sorted(set(cuts or [])):
        n = cuts.count(cut)
        own.append(cut)
        first.append(at)
        times.append(n if n > 1 else 0)
        at += 1 + times[-1]
    null_parts = max(1, min(MOST_RANGES, nulls // bucket_rows))
    place = F.lit(at)
    if own:
        keys, starts, repeats = (F.array(*[F.lit(v).cast("long") for v in values]) for values in (own, first, times))
        place = let(
            _first_from(keys, F.array(*[F.lit(1 << b) for b in range(len(own).bit_length(), -1, -1)]), F.col(key)),
            lambda i: F.when(i >= len(own), F.lit(at)).otherwise(F.get(starts, i) + F.when((F.get(keys, i) == F.col(key)) & (F.get(repeats, i) > 0), 1 + part(F.get(repeats, i))).otherwise(0)),
        )
    return F.when(F.col(key).isNull(), part(F.lit(null_parts)) - null_parts).otherwise(place).cast("long")


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_rows: int = 4000) -> DataFrame:
    """Columns ``key``, ``text``, ``signature``, and ``next_text``, ``next_signature`` of the next row by descending key.

    The row after the last is the first; a single row follows itself.  Rows of one key are ordered by
    a hash of their text; null keys come last.  Rows are cut into ranges (see :func:`ranges`), and each
    range borrows the first row of the next, so rows move once.
    """
    rows = docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))
    rows = rows.withColumn("tie", F.xxhash64(text))
    rows = rows.withColumn("bucket", ranges(rows.select(key, "tie"), key, "tie", bucket_rows))
    heads = rows.groupBy("bucket").agg(F.max(F.struct(F.col(key).alias("k"), "tie")).alias("head"))  # at most 3 x MOST_RANGES rows
    down = Window.orderBy(F.col("bucket").desc())
    follow = F.coalesce(F.lead("head").over(down), F.first("head").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select(F.col("bucket").alias("into"), follow.alias("head")).select("into", F.col("head.k").alias("k"), F.col("head.tie").alias("t"))
    lent = rows.join(F.broadcast(heads), F.col(key).eqNullSafe(F.col("k")) & (F.col("tie") == F.col("t")))
    lent = lent.select(key, text, "tie", F.col("into").alias("bucket"), F.lit(1).alias("lent"))
    both = rows.select(key, text, "tie", "bucket", F.lit(0).alias("lent")).union(lent)
    both = with_signature(both, text)
    order = Window.partitionBy("bucket").orderBy("lent", F.col(key).desc_nulls_last(), F.col("tie").desc())
    moved = both.withColumns({"next_text": F.lead(text).over(order), "next_signature": F.lead("signature").over(order)})
    return moved.where("lent = 0").select(key, text, "signature", "next_text", "next_signature")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last floor(n/2) characters replaced by the first as many (or all) of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))

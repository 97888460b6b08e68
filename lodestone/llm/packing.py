"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Lengths never exceed the capacity, so the packing is planned on the histogram of lengths, whose size
does not grow with the corpus: pieces above a third of the capacity are matched at most two to a
sequence, each with the largest partner that fits; smaller ones then go, largest first, where they
leave the least room.  The plan is a list of patterns with multiplicities.  Every piece finds its
place from its rank among the pieces of its length, so no task sees more than its share.
"""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import extended, slices, written

CAPACITY = 2048
RARE = re.compile("[^\0-\u02ff]")
SPACES = 100_000  # tiktoken's pattern gives up on about a million white-space characters in a row
LONG_SPACE = re.compile(r"\s{%d}" % SPACES)
# Fixed value: how byte-level pre-tokenizers split texts.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@functools.cache
def fast_encoding(path: str):
    """The same vocabulary for tiktoken, or None if merges are not in the order of ids."""
    import json

    import tiktoken

    from lodestone.llm.bpe import byte_symbols

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocab, byte = spec["model"]["vocab"], {s: b for b, s in enumerate(byte_symbols())}
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    made = [vocab[a + b] for a, b in pairs]
    plain = spec["pre_tokenizer"].get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space")
    if spec["normalizer"] or not plain or made != sorted(made):
        return None
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)


class ByteEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers, as the tokenizers library gives them.

    A byte-level vocabulary whose ids follow its merges goes through the faster tiktoken.  Texts with
    characters beyond U+02FF, where the libraries' tables of letters may differ, go through tokenizers, and
    so do those with very long runs of white space, which tiktoken does not split.
    """

    def __init__(self, path: str):
        self.library, self.fast = tokenizer(path), fast_encoding(path)

    def encode(self, texts: list[str]) -> list[bytes]:
        slow = [k for k, t in enumerate(texts) if self.fast is None or RARE.search(t) or len(t) > SPACES and LONG_SPACE.search(t)]
        found = dict(zip(slow, self.library.encode_batch_fast([texts[k] for k in slow], add_special_tokens=False), strict=True)) if slow else {}
        return [np.array(found[k].ids, "<u4").tobytes() if k in found else self.fast.encode_to_numpy(t, allowed_special="all").astype("<u4").tobytes() for k, t in enumerate(texts)]


def token_pieces(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row for each piece: ``key``, piece, start, length, ids_crc32.

    A document is its ids and then ``end_id`` (a null text: ``end_id`` alone).  Documents longer than
    ``capacity`` are cut into pieces of that length, of which only the first may be shorter.
    """
    rows = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = rows.schema
    out = extended(rows.select(key).schema, piece="int", start="long", length="long", ids_crc32="long")
    tail = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encoder = ByteEncoder(tokenizer_path)
        for batch in slices(batches, 256):
            owner, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(encoder.encode(batch.column(1).to_pylist())):
                ids += tail
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                for k, at in enumerate([0, *range(first, n, capacity)]):
                    size = capacity if k else first
                    owner.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=out.names)

    assert schema.names == [key, "text"]
    return rows.mapInArrow(cut, out)


@dataclass
class Pattern:
    lengths: list[int]
    times: int

    @property
    def used(self) -> int:
        return sum(self.lengths)


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold every piece of ``histogram`` (length -> count) exactly once."""
    left = {n: c for n, c in histogram.items() if c > 0}
    third = capacity / 3
    large = sorted(n for n in left if n > third)
    bins: list[Pattern] = []
    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        k = bisect.bisect_right(large, capacity - n) - 1
        while k >= 0 and left[large[k]] - (large[k] == n) <= 0:
            if not left[large[k]]:
                large.pop(k)
            k -= 1
        if k < 0:
            bins.append(Pattern([n], left[n]))
            left[n] = 0
        else:
            partner = large[k]
            times = left[n] // 2 if partner == n else min(left[n], left[partner])
            bins.append(Pattern([n, partner], times))
            left[n] -= times
            left[partner] -= times
    gaps: dict[int, list[Pattern]] = {}
    for b in bins:
        gaps.setdefault(capacity - b.used, []).append(b)
    rooms = sorted(gaps)
    done: list[Pattern] = []

    def put(pattern: Pattern) -> None:
        room = capacity - pattern.used
        if room not in gaps:
            gaps[room] = []
            bisect.insort(rooms, room)
        gaps[room].append(pattern)

    for n in sorted((n for n in left if n <= third), reverse=True):
        while left[n]:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                fits = capacity // n
                times, rest = divmod(left[n], fits)
                if times:
                    put(Pattern([n] * fits, times))
                if rest:
                    put(Pattern([n] * rest, 1))
                left[n] = 0
                break
            room = rooms[at]
            base = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
                rooms.pop(at)
            fits = min(room // n, left[n])
            times = min(base.times, left[n] // fits)
            if times < base.times:
                put(Pattern(base.lengths, base.times - times))
            put(Pattern(base.lengths + [n] * fits, times))
            left[n] -= fits * times
    for kept in gaps.values():
        done += kept
    return done


def placements(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first_rank, last_rank, per_sequence, first_sequence, offset of the first such piece)."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for p in patterns:
        offset = 0
        for n, each in _runs(p.lengths):
            start = rank.get(n, 0)
            rank[n] = start + each * p.times
            rows.append((n, start, rank[n] - 1, each, sequence, offset))
            offset += n * each
        sequence += p.times
    return rows


def _runs(lengths: list[int]) -> list[tuple[int, int]]:
    out: dict[int, int] = {}
    for n in lengths:
        out[n] = out.get(n, 0) + 1
    return list(out.items())


def pack_pieces(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, salt_rows: int = 250_000) -> DataFrame:
    """``pieces`` with sequence_id and offset; every sequence is filled without gaps from 0.

    Pieces of one length are ranked within salts of about ``salt_rows`` pieces, so a length gets as
    many salts as it needs.  The driver sees a count for each length, and one for each (length, salt):
    at most capacity + pieces / ``salt_rows`` rows, 32 bytes each.
    """
    salts = {r["length"]: -(-r["count"] // salt_rows) for r in pieces.groupBy("length").count().collect()}
    often = {n: c for n, c in salts.items() if c > 1}
    hashed = F.xxhash64(key, "piece", "ids_crc32")
    of_length = F.coalesce(F.element_at(F.create_map(*[F.lit(x).cast("long") for item in often.items() for x in item]), F.col("length")), F.lit(1).cast("long")) if often else F.lit(1)
    salted = pieces.withColumn("salt", F.pmod(hashed, of_length).cast("int"))
    counts = sorted((r["length"], r["salt"], r["count"]) for r in salted.groupBy("length", "salt").count().collect())
    histogram: dict[int, int] = {}
    starts = []
    for n, salt, count in counts:
        starts.append((n, salt, histogram.get(n, 0)))
        histogram[n] = histogram.get(n, 0) + count
    table: dict[int, list[tuple[int, ...]]] = {}
    for n, *row in placements(plan_patterns(histogram, capacity)):
        table.setdefault(n, []).append(tuple(row))
    base = {(n, salt): start for n, salt, start in starts}
    ranks = {n: np.array([r[0] for r in rows]) for n, rows in table.items()}
    values = {n: np.array(rows) for n, rows in table.items()}
    within = Window.partitionBy("length", "salt").orderBy(key, "piece", "ids_crc32")
    ranked = salted.withColumn("at", (F.row_number().over(within) - 1).cast("long"))
    names = [*pieces.columns, "length", "salt", "at"]
    out = extended(pieces.schema, sequence_id="long", offset="long")

    def place(batches):
        for batch in batches:
            n, salt, at = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "salt", "at"))
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            rank = at + np.array([base[k] for k in zip(n.tolist(), salt.tolist(), strict=True)], np.int64) if len(n) else at
            for size in np.unique(n):
                own = n == size
                row = values[size][np.searchsorted(ranks[size], rank[own], side="right") - 1]
                nth = rank[own] - row[:, 0]
                sequence[own] = row[:, 3] + nth // row[:, 2]
                offset[own] = row[:, 4] + (nth % row[:, 2]) * size
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(out.names) - 2)), pa.array(sequence), pa.array(offset)], names=out.names)

    assert len(names) == len(out.names) + 1
    return ranked.mapInArrow(place, out)


def pack_documents(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Tokenise and pack ``docs``; see :func:`token_pieces` and :func:`pack_pieces`.

    Empty and null texts are pieces of one token.  Repeated rows are packed as often as they occur.
    An empty table packs into no sequence.  Pieces are written to the shared folder once, since their
    counts and their places are two passes.
    """
    return pack_pieces(written(token_pieces(docs, tokenizer_path, key, text, capacity, end_id), "pieces"), key, capacity)



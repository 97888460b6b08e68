"""Token counts with a whole-token shortcut.

Offline, from the vocabulary alone, two things are proved.  First, which strings encode as exactly one
token: those whose own merges end in one symbol.  Second, which characters stand side by side in some
vocabulary string: characters joined by such pairs form classes (letters, for example), and no merge
crosses from one class into another.  Texts are cut there into pre-tokens, which are encoded
independently of each other; one that is a whole token counts as one at once, and only the rest go
through the merges.
"""

from __future__ import annotations

import functools
import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import extended, slices, windows

SPACE = "▁"  # fixed value: stands for a blank
REMEMBERED = 64  # pre-tokens of at most so many characters are remembered,
CACHED = 500_000  # up to so many of them
SCANNED = 32  # words of at most so many characters are merged by scanning their pairs, longer ones with a heap
NEVER = 1 << 40
SEAM = re.compile(f"[^{SPACE}](?={SPACE})")


class PieceCounter(dict):
    """Tokens of each pre-token for a sentencepiece BPE model with byte fallback; a missing one is merged on demand."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        model, library = ModelProto(), SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules, kinds = model.normalizer_spec, model.SentencePiece
        pieces = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        plain = not rules.precompiled_charsmap and rules.escape_whitespaces and rules.add_dummy_prefix and not rules.remove_extra_whitespaces
        other = {p.type for p in model.pieces} - {kinds.NORMAL, kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN}
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback or not plain or other or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("expected a BPE model with byte fallback, unchanged texts, a blank put before them and no symbols of its user")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("a piece goes beyond a blank, so blanks are no borders of pre-tokens")
        assert library.get_piece_size() == len(model.pieces)
        places = {score: k for k, score in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.rank = {p: places[score] for p, score in pieces.items()}
        self.inner = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        self.pattern = re.compile("|".join([*(f"{SPACE}*[{re.escape(''.join(sorted(c)))}]+" for c in self.classes()), f"{SPACE}+", "."]), re.DOTALL)
        self.whole = {p: 1 for p in pieces if self.merges(p) == 1}
        super().__init__(self.whole)

    def classes(self) -> list[set[str]]:
        """Characters, without the blank, that are joined by pairs inside pieces; a character in no pair is in none."""
        of: dict[str, set[str]] = {}
        for a, b in self.inner:
            if SPACE in (a, b):
                of.setdefault(b if a == SPACE else a, {b if a == SPACE else a})
                continue
            both = of.get(a, {a}) | of.get(b, {b})
            of.update(dict.fromkeys(both, both))
        of.pop(SPACE, None)
        return sorted({id(c): c for c in of.values()}.values(), key=lambda c: (-len(c), min(c)))

    def merges(self, word: str) -> int:
        """The number of tokens of ``word``: symbols left by the merges, where an unknown one counts its bytes."""
        rank = self.rank
        if len(word) > SCANNED:
            symbol = self.merged(word)
        else:
            symbol, get = list(word), rank.get
            ranks = [get(word[k : k + 2], NEVER) for k in range(len(word) - 1)]
            while ranks and (best := min(ranks)) < NEVER:
                at = ranks.index(best)
                pair = symbol[at] = symbol[at] + symbol.pop(at + 1)
                del ranks[at]
                if at < len(ranks):
                    ranks[at] = get(pair + symbol[at + 1], NEVER)
                if at:
                    ranks[at - 1] = get(symbol[at - 1] + pair, NEVER)
        return sum([1 if s in rank else len(s.encode("utf-8")) for s in symbol])

    def merged(self, word: str) -> list[str]:
        """The symbols in which the merges of ``word`` end: best score first, then the leftmost place."""
        symbol, n, rank = list(word), len(word), self.rank
        after, before = [*range(1, n), n], [*range(-1, n - 1)]
        queue = [(rank[pair] << 32) | k for k in range(n - 1) if (pair := word[k : k + 2]) in rank]
        heapq.heapify(queue)
        while queue:
            key = heapq.heappop(queue)
            at = key & 0xFFFFFFFF
            follow = after[at]
            if not symbol[at] or follow >= n or rank.get(pair := symbol[at] + symbol[follow], -1) != key >> 32:
                continue  # one of the two has gone into another symbol meanwhile
            symbol[at], symbol[follow] = pair, ""
            follow = after[at] = after[follow]
            if follow < n:
                before[follow] = at
                if (new := rank.get(pair + symbol[follow])) is not None:
                    heapq.heappush(queue, (new << 32) | at)
            left = before[at]
            if left >= 0 and (new := rank.get(symbol[left] + pair)) is not None:
                heapq.heappush(queue, (new << 32) | left)
        return [s for s in symbol if s]

    def __missing__(self, unit: str) -> int:
        n = self.merges(unit)
        if len(unit) <= REMEMBERED:
            if len(self) > CACHED:
                self.clear()
                self.update(self.whole)
            self[unit] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(sum(map(self.__getitem__, self.pattern.findall(piece))) for piece in windows((SPACE + text).replace(" ", SPACE), SEAM))


@functools.cache
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit``), replacing columns of these names.

    Counts are those of the sentencepiece library without begin, end or other added tokens; strings of
    control symbols in a text are ordinary text.  A null text is an empty one, with no tokens.  Each row
    stands alone: equal rows give equal rows, an empty table an empty one.  A pre-token (no blank inside)
    is merged in memory whole, at about 250 bytes for each of its characters.
    """
    made = ("n_bytes", "n_tokens", "over_limit")
    kept = docs.drop(*made)
    assert text in kept.columns, "the text cannot bear the name of a result"
    at = kept.columns.index(text)
    schema = extended(kept.schema, n_tokens="long")

    def count(batches):
        pieces = counter(model_path)
        for batch in slices(batches, 1024):
            found = [pieces.count(t) if t else 0 for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=schema.names)

    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    return kept.mapInArrow(count, schema).select(*kept.columns, size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

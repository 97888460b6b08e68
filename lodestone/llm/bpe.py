"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A word starts as its symbols.  A segment tree holds the merge rank of each adjacent pair; its root is
the lowest rank and, among equals, the leftmost place.  A merge changes three leaves, each updated in
logarithmic time, until the root says that no pair merges.  The words of a batch that have not been
seen yet go through their trees side by side, one numpy row for each.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import extended, slices

NONE = np.int64(1) << np.int64(62)
PLACE = 31  # bits of a leaf's key that hold the place (a string of Spark ends below 2 ** 31 bytes); the rank is above them
SINGLE = 1024  # words with more symbols go through a tree of their own
CACHED = 200_000  # units that are remembered,
REMEMBERED = 400  # if they have at most so many characters
RARE = re.compile("[^\0-\u02ff]")
CONTROL = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """A vocabulary file in the format of the tokenizers library: lower case, byte level, words with an end mark."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = dict(model["vocab"])
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self.tokens = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + self.suffix] for s in symbols], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.width = np.int64(max(self.tokens) + 1)
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], np.int64)
        order = keys.argsort(kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.table = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        words = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"][0]
        self.words = regex.compile(words)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.space = re.compile("[\t-\r \x85\xa0]+")
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.splitter = pre_tokenizers.Split(Regex(words), "removed", invert=True)
        self.known: dict[str, tuple[bytes, str]] = {}
        self.former: dict[str, tuple[bytes, str]] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for pairs that do not merge."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def units(self, text: str) -> list[str]:
        """Normalised runs without white space; special tokens stand alone after a line feed."""
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text) if self.cut and "<|" in text else (text,)):
            if k % 2:
                out.append("\n" + part)
            elif part and not part.isascii() and RARE.search(part):  # as the library's tables of letters have it
                out += [u for u in self.normalizer.normalize_str(part).split(" ") if u]
            elif part:
                part = part if part.isascii() else unicodedata.normalize("NFC", part)
                if CONTROL.search(part):  # str.split would cut there
                    out += [u.lower() for u in self.space.split(part) if u]
                else:
                    out += part.lower().split()
        return out

    def words_of(self, unit: str) -> list[str]:
        if unit.isascii() and unit.isalpha():
            return [unit]
        if RARE.search(unit):
            return [w for w, _ in self.splitter.pre_tokenize_str(unit)]
        return self.words.findall(unit)

    def merge_many(self, words: list[bytes]) -> list[tuple[bytes, str]]:
        """Ids of each word as little-endian 32-bit integers, and its token strings joined by spaces."""
        out: list[tuple[bytes, str]] = [(b"", "")] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        bits = np.ceil(np.log2(np.maximum(size, 2))).astype(int)
        for b in np.unique(bits):
            own = np.flatnonzero(bits == b)
            if 1 << b > SINGLE:
                for k in own.tolist():
                    ids = self.merge_one(words[k])
                    out[k] = np.array(ids, "<i4").tobytes(), self.decode(ids)
                continue
            for at in range(0, len(own), 16_384):
                part = own[at : at + 16_384].tolist()
                symbols, live = self.trees([words[k] for k in part], 1 << int(b))
                flat, ends = symbols[live], np.cumsum(live.sum(axis=1)).tolist()
                packed, strings, start = flat.astype("<i4").tobytes(), [self.tokens[i] for i in flat.tolist()], 0
                for k, end in zip(part, ends, strict=True):
                    out[k] = packed[4 * start : 4 * end], " ".join(strings[start:end])
                    start = end
        return out

    def trees(self, words: list[bytes], leaves: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge words of at most ``leaves`` bytes side by side; returns symbols and which of them remain."""
        count, size = len(words), np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(leaves, b"\0") for w in words), np.uint8).reshape(count, leaves)
        place = np.arange(leaves)
        symbol = self.inner[raw]
        rows = np.arange(count)
        symbol[rows, size - 1] = self.last[raw[rows, size - 1]]
        live = place < size[:, None]
        after = np.where(place + 1 < size[:, None], place + 1, leaves)  # ``leaves`` means none
        before = np.where(live, place - 1, -1)
        tree = np.full((count, 2 * leaves), NONE)
        rank = self.rank(symbol[:, :-1], symbol[:, 1:])
        tree[:, leaves : 2 * leaves - 1] = np.where((rank >= 0) & live[:, 1:], (rank << PLACE) | place[:-1], NONE)
        level = leaves
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        active = np.flatnonzero(tree[:, 1] < NONE)
        while len(active):
            root = tree[active, 1]
            at = root & ((1 << PLACE) - 1)
            gone = after[active, at]
            new = self.merged[root >> PLACE]
            symbol[active, at] = new
            live[active, gone] = False
            right, left = after[active, gone], before[active, at]
            after[active, at] = right
            some = right < leaves
            before[active[some], right[some]] = at[some]
            r = np.where(some, self.rank(new, symbol[active, np.minimum(right, leaves - 1)]), -1)
            tree[active, leaves + at] = np.where(r >= 0, (r << PLACE) | at, NONE)
            tree[active, leaves + gone] = NONE
            first = np.maximum(left, 0)
            r = np.where(left >= 0, self.rank(symbol[active, first], new), -1)
            some = left >= 0
            tree[active[some], leaves + left[some]] = np.where(r >= 0, (r << PLACE) | left, NONE)[some]
            nodes = [leaves + at, leaves + gone, leaves + np.where(some, left, at)]
            while nodes[0][0] > 1:
                nodes = [n >> 1 for n in nodes]
                for n in nodes:
                    tree[active, n] = np.minimum(tree[active, 2 * n], tree[active, 2 * n + 1])
            active = active[tree[active, 1] < NONE]
        return symbol, live

    def merge_one(self, word: bytes) -> list[int]:
        """The same for one long word, without numpy's cost for each call."""
        n, none, width = len(word), int(NONE), int(self.width)
        leaves = 1 << (n - 1).bit_length()
        symbol = [int(self.inner[b]) for b in word]
        symbol[-1] = int(self.last[word[-1]])
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        tree = [none] * (2 * leaves)

        def key(at: int) -> int:
            follow = after[at]
            rank = self.table.get(symbol[at] * width + symbol[follow]) if follow >= 0 else None
            return none if rank is None else (rank << PLACE) | at

        for at in range(n - 1):
            tree[leaves + at] = key(at)
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(at: int, value: int) -> None:
            node = leaves + at
            tree[node] = value
            node >>= 1
            while node:
                tree[node] = min(tree[2 * node], tree[2 * node + 1])
                node >>= 1

        gone: set[int] = set()
        while tree[1] < none:
            at = tree[1] & ((1 << PLACE) - 1)
            symbol[at] = int(self.merged[tree[1] >> PLACE])
            drop = after[at]
            gone.add(drop)
            after[at] = after[drop]
            if after[at] >= 0:
                before[after[at]] = at
            put(drop, none)
            put(at, key(at))
            if before[at] >= 0:
                put(before[at], key(before[at]))
        return [s for k, s in enumerate(symbol) if k not in gone]

    def learn(self, wanted: set[str]) -> None:
        """Make the codes of these units known; units of long ago are forgotten."""
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > CACHED:
            self.former, self.known, new = self.known, {}, wanted
        old = new.intersection(self.former)
        self.known.update((u, self.former[u]) for u in old)
        fresh = list(new.difference(old))
        parts = [[] if u[0] == "\n" else self.words_of(u) for u in fresh]
        distinct = list({p for x in parts for p in x})
        code = dict(zip(distinct, self.merge_many([d.encode("utf-8", "replace") for d in distinct]), strict=True))
        for unit, words in zip(fresh, parts, strict=True):
            if len(words) == 1:
                self.known[unit] = code[words[0]]
            elif unit[0] == "\n":
                self.known[unit] = np.array([self.special[unit[1:]]], "<i4").tobytes(), unit[1:]
            else:
                found = [code[w] for w in words]
                self.known[unit] = b"".join([f[0] for f in found]), " ".join([f[1] for f in found])

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by spaces: what a vocabulary file without a decoder decodes to."""
        return " ".join(self.tokens[i] for i in ids)

    def encode_batch(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """For each text its ids (little-endian 32-bit) and the text that they decode to."""
        units = [self.units(t) for t in texts]
        self.learn({u for x in units for u in x})
        known = self.known
        both = [[known[u] for u in x] for x in units]
        for unit in {u for x in units for u in x if len(u) > REMEMBERED}:
            del known[unit]
        return [b"".join([p[0] for p in x]) for x in both], [" ".join([p[1] for p in x if p[1]]) for x in both]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0][0], "<i4").tolist()


@functools.cache
def vocabulary(path: str) -> Bpe:
    return Bpe(path)


def encode_decode(docs: DataFrame, vocabulary_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the ids of ``text`` and the text they decode to, replacing columns of these names.

    A null or empty text has no ids and decodes to an empty text.  Special tokens in a text stand for
    themselves; nothing is truncated, padded or added.
    """
    kept = docs.drop(ids, decoded)
    at = kept.columns.index(text)
    schema = extended(kept.schema, **{ids: "array<int>", decoded: "string"})
    names = schema.names

    def code(batches):
        bpe = vocabulary(vocabulary_path)
        for batch in slices(batches, 256):
            packed, texts = bpe.encode_batch([t or "" for t in batch.column(at).to_pylist()])
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(texts, pa.string())], names=names)

    return kept.mapInArrow(code, schema)


def token_digests(coded: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """n_tokens and the SHA-256 of the ids (decimal, single spaces) and of the decoded text."""
    return coded.withColumns({
        "n_tokens": F.size(ids).cast("long"), "ids_sha256": F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256), "decoded_sha256": F.sha2(F.col(decoded), 256),
    })

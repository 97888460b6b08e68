"""Grouping of spelling variants: words one edit apart, found with k-d trees over letter counts.

One inserted, deleted or replaced character changes a word's vector of letter counts by at most one up
and one down, so its L1 distance is at most two.  Words are dealt into the boxes of a k-d tree for each
length (fitted on a bounded sample of the words; every word is placed by it).  A word meets the words of
its own box and is sent to those boxes of its own and the next length that lie within reach.  In each box
a finer k-d tree prunes by bounding boxes, and the order of letters of what is left is compared.  A box
gives one row for each word that has near words, never pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import slices, windows, written

# The characters of words, of which only A-Z is lower-cased.
WORD = re.compile("[a-zÀ-ÿ]+")
SEAM = re.compile("[^a-zÀ-ÿ]")
FOLD = 192  # characters are counted by code point modulo this, which can only lessen distances
LONGEST = 64  # words of at least so many characters share one tree
COUNTED = 200_000  # different words that a task counts before it passes them on
LEAF = 48
CELLS = 4_000_000  # numbers in one comparison of queries with a leaf
DEEPEST = 31  # forms grow five times in count at each step, so no chain of them is longer


@dataclass(frozen=True)
class Settings:
    """``sample``: words on which the boxes are fitted at most; ``box``: words that a box is meant to hold at most."""

    min_length: int = 6
    min_count: int = 5
    ratio: int = 5
    sample: int = 200_000
    box: int = 4_096


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings(), change: Callable[[str, str], str] | None = None) -> DataFrame:
    """(word, n): words of at least ``min_length`` characters that occur at least ``min_count`` times in all texts.

    ``change(key, word)`` may return another word for an occurrence; a null key is the text 'null'.  Null
    texts have no words.  Tasks count before the shuffle, so a frequent word is a few rows.
    """
    least = settings.min_length

    def count(batches):
        seen: dict[str, int] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in slices(batches, 1024):
            for owner, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece in windows(value.encode("utf-8").lower().decode("utf-8"), SEAM):  # bytes.lower changes A-Z only
                    for word, n in Counter(WORD.findall(piece)).items():
                        if change is not None:
                            word = change(owner, word)
                        if len(word) >= least:
                            seen[word] = seen.get(word, 0) + n
                    if len(seen) > COUNTED:
                        yield flush()
        yield flush()

    rows = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= settings.min_count)


class Words:
    """Words as code points and as letter counts (characters modulo ``FOLD``)."""

    def __init__(self, words: list[str]):
        self.size = np.array([len(w) for w in words], np.int64)
        self.flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        self.start = np.cumsum(self.size) - self.size
        row = np.repeat(np.arange(len(words)), self.size)
        self.counts = np.bincount(row * FOLD + self.flat % FOLD, minlength=len(words) * FOLD).reshape(len(words), FOLD).astype(np.int32)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words ``a`` and ``b`` (places, pairwise) differ by exactly one edit."""
        short, long = np.where(self.size[a] <= self.size[b], a, b), np.where(self.size[a] <= self.size[b], b, a)
        out = np.zeros(len(a), bool)
        more = self.size[long] - self.size[short]
        for n in np.unique(self.size[short]):
            for d in (0, 1):
                own = np.flatnonzero((self.size[short] == n) & (more == d))
                for at in range(0, len(own), step := max(1, CELLS // max(1, int(n)))):
                    part = own[at : at + step]
                    x, y = self.start[short[part]][:, None] + np.arange(n), self.start[long[part]][:, None] + np.arange(n)
                    differ = self.flat[x] != self.flat[y]
                    if d == 0:
                        out[part] = differ.sum(axis=1) == 1
                        continue
                    shifted = self.flat[x] != self.flat[y + 1]
                    ahead = np.where(differ.any(axis=1), differ.argmax(axis=1), n)
                    behind = np.where(shifted.any(axis=1), shifted[:, ::-1].argmax(axis=1), n)
                    out[part] = ahead + behind >= n
        return out


@dataclass
class Node:
    """A box of the upper tree, or the split of one: counts of ``letter`` up to ``most`` go left."""

    box: int = -1
    letter: int = 0
    most: int = 0
    left: Node | None = None
    right: Node | None = None


@dataclass
class Boxes:
    """k-d trees over letter counts, one for each length; a box is a number."""

    trees: dict[int, Node] = field(default_factory=dict)
    count: int = 0

    @classmethod
    def fit(cls, words: list[str], share: float, box: int) -> Boxes:
        """Split a sample, which is ``share`` of all words, until boxes hold about ``box`` words of all."""
        out, sample = cls(), Words(words)
        group = np.minimum(sample.size, LONGEST)
        for g in range(1, LONGEST + 1):
            out.trees[g] = out.split(sample.counts[group == g], max(2, int(box * share)))
        return out

    def split(self, counts: np.ndarray, most: int) -> Node:
        if len(counts) > most:
            letter = int(counts.var(axis=0).argmax())
            values = counts[:, letter]
            cut = int(np.median(values))
            cut = cut if (values > cut).any() else cut - 1
            low = values <= cut
            if low.any() and not low.all():
                return Node(letter=letter, most=cut, left=self.split(counts[low], most), right=self.split(counts[~low], most))
        self.count += 1
        return Node(box=self.count - 1)

    def own(self, words: Words) -> np.ndarray:
        """The box in which each word lies."""
        out, group = np.zeros(len(words.size), np.int64), np.minimum(words.size, LONGEST)
        for g in np.unique(group):
            todo = [(self.trees[int(g)], np.flatnonzero(group == g))]
            while todo:
                node, rows = todo.pop()
                if node.box >= 0:
                    out[rows] = node.box
                elif len(rows):
                    low = words.counts[rows, node.letter] <= node.most
                    todo += [(node.left, rows[low]), (node.right, rows[~low])]
        return out

    def reached(self, words: Words, longer: bool) -> Iterator[tuple[int, np.ndarray]]:
        """Each box with the words that may have a near word in it, of their own length or the next.

        A near word of the same length (or tree) has at most one letter more and one less; one of the
        next length has one letter more and none less.
        """
        size = np.minimum(words.size, LONGEST)
        group = np.minimum(words.size + 1, LONGEST) if longer else size
        for g in np.unique(group):
            rows = np.flatnonzero((group == g) & (size != g if longer else True))
            todo = [(self.trees[int(g)], rows, np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int32), {})]
            while todo:
                node, rows, up, down, bounds = todo.pop()
                if node.box >= 0:
                    yield node.box, rows
                    continue
                low, high = bounds.get(node.letter, (0, 1 << 30))
                value = words.counts[rows, node.letter]
                for child, lo, hi in ((node.left, low, min(high, node.most)), (node.right, max(low, node.most + 1), high)):
                    more = up + np.maximum(lo - value, 0) - np.maximum(low - value, 0)
                    less = down + np.maximum(value - hi, 0) - np.maximum(value - high, 0)
                    live = (more <= 1) & (less <= (0 if longer else 1))
                    if live.any():
                        todo.append((child, rows[live], more[live], less[live], bounds | {node.letter: (lo, hi)}))


def search(points: np.ndarray, queries: np.ndarray, less: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, point) whose counts differ by at most one up and, down, by at most ``less`` of the query.

    A k-d tree over the points: a query goes down only where its distance to the bounding box allows it.
    """
    used = np.flatnonzero(points.any(axis=0) | queries.any(axis=0))
    points, queries = points[:, used], queries[:, used]
    todo = [(np.arange(len(points)), np.arange(len(queries)))]
    while todo:
        rows, live = todo.pop()
        if not len(rows) or not len(live):
            continue
        low, high = points[rows].min(axis=0), points[rows].max(axis=0)
        step = max(1, CELLS // max(1, len(used)))
        kept = []
        for at in range(0, len(live), step):
            part = live[at : at + step]
            q = queries[part]
            kept.append(part[(np.maximum(low - q, 0).sum(axis=1) <= 1) & (np.maximum(q - high, 0).sum(axis=1) <= less[part])])
        live = np.concatenate(kept)
        spread = high - low
        if len(rows) <= LEAF or not spread.any():
            for first in range(0, len(rows), 1024):
                some = rows[first : first + 1024]
                step = max(1, CELLS // (len(some) * max(1, len(used))))
                for at in range(0, len(live), step):
                    part = live[at : at + step]
                    change = points[some][None] - queries[part][:, None]
                    q, p = np.nonzero((np.maximum(change, 0).sum(axis=2) <= 1) & (np.maximum(-change, 0).sum(axis=2) <= less[part][:, None]))
                    yield part[q], some[p]
            continue
        letter = int(points[rows].var(axis=0).argmax())
        values = points[rows, letter]
        cut = int(np.median(values))
        cut = cut if (values > cut).any() else cut - 1
        todo += [(rows[values <= cut], live), (rows[values > cut], live)]


class Best:
    """For each word the number of its near words, and the near word of largest count (among equals the smallest)."""

    def __init__(self, n: np.ndarray):
        self.n, self.near = n, np.zeros(len(n), np.int64)
        self.top, self.at = np.full(len(n), -1, np.int64), np.full(len(n), -1, np.int64)

    def add(self, word: np.ndarray, other: np.ndarray) -> None:
        """``other`` are near words of ``word``, pairwise; places are in the order of words."""
        order = np.lexsort((other, -self.n[other], word))
        word, other = word[order], other[order]
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
        own, best = word[first], other[first]
        better = (self.n[best] > self.top[own]) | ((self.n[best] == self.top[own]) & (best < self.at[own]))
        self.near[own] += np.diff(np.r_[first, len(word)])
        own, best = own[better], best[better]
        self.top[own], self.at[own] = self.n[best], best


POINT, SAME, SHORTER = 0, 1, 2


def sent_to_boxes(words: DataFrame, boxes: Boxes) -> DataFrame:
    """(box, role, word, n): each word as a point of its box, and as a query in every other box within reach.

    Of two boxes of one tree only the words of the one with the smaller number go to the other.
    """

    def send(batches):
        for batch in slices(batches, 4096):
            table = Words(batch.column(0).to_pylist())
            own = boxes.own(table)
            box, role, row = [own], [np.full(len(own), POINT)], [np.arange(len(own))]
            for longer in (False, True):
                for number, rows in boxes.reached(table, longer):
                    rows = rows if longer else rows[own[rows] < number]
                    box.append(np.full(len(rows), number))
                    role.append(np.full(len(rows), SHORTER if longer else SAME))
                    row.append(rows)
            at = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(box), pa.int32()), pa.array(np.concatenate(role), pa.int32()), batch.column(0).take(at), batch.column(1).take(at)], names=["box", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(send, "box int, role int, word string, n long")


def near_words(words: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(word, n_near, form, form_n): words of ``words`` (word, n) with a near word, and the near word of largest n.

    ``words`` are distinct and not null.  The driver sees a sample of at most about ``sample`` words.
    """
    total = words.count()
    share = min(1.0, settings.sample / max(1, total))
    chosen = words if share == 1 else words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    boxes = Boxes.fit([r["word"] for r in chosen.select("word").collect()], share, settings.box)

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("word")
        words_here, role, n = table.column("word").to_pylist(), table.column("role").to_numpy(), table.column("n").to_numpy()
        all_words, best = Words(words_here), Best(n)
        points = np.flatnonzero(role == POINT)
        for q, p in search(all_words.counts[points], all_words.counts, np.where(role == SHORTER, 0, 1)):
            p = points[p]
            fresh = (role[q] != POINT) | (q < p)
            q, p = q[fresh], p[fresh]
            near = all_words.near(q, p)
            best.add(q[near], p[near])
            best.add(p[near], q[near])
        some = np.flatnonzero(best.near)
        return pa.table({"word": table.column("word").take(pa.array(some)), "n_near": best.near[some], "form": table.column("word").take(pa.array(best.at[some])), "form_n": best.top[some]})

    met = sent_to_boxes(words, boxes).groupBy("box").applyInArrow(compare, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each row of ``forms`` (word, form): the last word when forms are followed.

    Steps double each round, and chains have at most ``DEEPEST`` steps.  At most 192 n + 96 words of n
    characters are near one word of n characters, so no form gathers more rows than that.
    """
    found, reach = written(forms.select("word", F.col("form").alias("root")), "roots"), 1
    while reach < DEEPEST:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = found.join(onward, "root", "left")
        following = written(moved.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not following.where("moved").limit(1).count():
            break
        found, reach = following.drop("moved"), 2 * reach
    return found


def spelling_variants(words: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Each row of ``words`` (word, n) with form, root, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced character.  ``form`` is the near word of
    largest n (ties: the smallest) if that is at least ``ratio`` times the word's own; ``root`` is where
    following forms ends, the word itself if it has none.  Words are distinct; a null word is dropped.
    """
    words = written(words.where(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n")), "words")
    rows = words.join(near_words(words, settings), "word", "left")
    larger = F.col("form_n") >= settings.ratio * F.col("n")
    rows = written(rows.select("word", F.when(larger, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(larger, F.col("form_n")).alias("form_n")), "variants")
    found = roots(rows.where(F.col("form").isNotNull()))
    return rows.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def misspelt(key: str, word: str) -> str:
    """``word`` without one character where 199 divides the crc32 of ``key:word``: known errors, to see them found again."""
    h = zlib.crc32(f"{key}:{word}".encode())
    if h % 199:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]

"""MinHash near-duplicates with sequential Bayesian verification.

1.  Every document gets its set of distinct word shingles, a MinHash signature and a hash of the set.
    Documents with equal sets are one node, named by their smallest id.
2.  Bands of the signature put nodes into buckets.  In each bucket, pairs with the smallest node are
    candidates; after linking these, buckets that still hold several components compare all pairs
    between them, so that no pair that shares a bucket is left out unless it is already connected.
3.  A candidate's signatures are compared batch by batch.  With m of n values equal and a uniform
    prior, the posterior chance that the similarity reaches the threshold is P(Bin(n + 1, t) <= m);
    a pair is dropped once that is below ``miss``.  Survivors are verified on their full sets.
4.  Links become components by alternating stars.
"""

from __future__ import annotations

import functools
import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import discard, slices, written
from lodestone.llm.components import connected_components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
ODD = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 3072  # nodes of a bucket that are compared with as many others at a time
FEW_IDS = 400_000  # ids that are broadcast (a few MB); beyond, the same join shuffles


@dataclass(frozen=True)
class Settings:
    """``words`` to a shingle, similarity ``percent`` of 100, ``bands`` x ``rows`` values, batches of ``batch`` values, ``miss`` probability."""

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    batch: int = 16
    miss: float = 1e-9
    seed: int = 11

    @property
    def size(self) -> int:
        return self.bands * self.rows


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _constants(seed: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, dtype=np.uint64)


@functools.cache
def _powers(size: int) -> np.ndarray:
    return np.cumprod(np.full(size, ODD, np.uint64))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and the number of words of each text.

    Words are what lies between blanks and control characters 9 to 13, with A to Z lower-cased.
    """
    raw = [(t or "").encode("utf-8", "replace").translate(LOWER) for t in texts]
    joined = np.frombuffer(b" ".join([*raw, b" "]), np.uint8)
    blank = SPACE[joined]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank)).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    sizes = ends - starts
    place = np.arange(len(joined))[~blank] - np.repeat(starts, sizes)
    top = int(sizes.max(initial=0))
    powers = _powers(1 << max(6, (top - 1).bit_length())) if top <= 1 << 20 else np.cumprod(np.full(top, ODD, np.uint64))
    terms = (joined[~blank].astype(np.uint64) + np.uint64(1)) * powers[place]
    hashes = np.add.reduceat(terms, np.concatenate(([0], np.cumsum(sizes)[:-1]))) if len(sizes) else np.zeros(0, np.uint64)
    bounds = np.cumsum([len(r) + 1 for r in raw])
    return mix(hashes + sizes.astype(np.uint64)), np.diff(np.concatenate(([0], np.searchsorted(starts, bounds))))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; one shingle for a text with fewer words, none without words."""
    hashes, counts = word_hashes(texts)
    factors, _ = _constants(3, words)
    out, start = [], 0
    for n in counts.tolist():
        own = hashes[start : start + n]
        start += n
        if not n:
            out.append(own[:0])
            continue
        if n < words:
            total = np.sum(own * factors[:n], keepdims=True, dtype=np.uint64) + np.uint64(n)
        else:
            total = own[: n - words + 1] * factors[0]
            for k in range(1, words):
                total = total + own[k : n - words + 1 + k] * factors[k]
        out.append(np.unique(mix(total)))
    return out


def minhash(found: np.ndarray, s: Settings) -> np.ndarray:
    """Signature of a set as unsigned 32-bit values."""
    a, b = _constants(s.seed, s.size)
    low = np.full(s.size, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        np.minimum(low, (found[at : at + 4096, None] * a + b).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def least_matches(s: Settings) -> list[tuple[int, int]]:
    """(values compared, matches below which a pair is dropped) after each batch."""
    t, out = s.percent / 100, []
    for n in range(s.batch, s.size + 1, s.batch):
        below, m = 0.0, -1
        while True:
            below += math.comb(n + 1, m + 1) * t ** (m + 1) * (1 - t) ** (n - m)
            if below >= s.miss:
                break
            m += 1
        out.append((n, m + 1))
    return out


def signatures(docs: DataFrame, key: str, text: str, s: Settings) -> DataFrame:
    """(id, n, content, sig) for each document: set size, hash of the set and signature."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def sign(batches):
        for batch in slices(batches, 512):
            sets = shingle_sets(batch.column(1).to_pylist(), s.words)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(x) for x in sets], pa.int64()),
                pa.array([hashlib.md5(x.tobytes()).digest() if len(x) else None for x in sets], pa.binary()),
                pa.array([minhash(x, s).tobytes() if len(x) else None for x in sets], pa.binary()),
            ], names=["id", "n", "content", "sig"])

    return rows.mapInArrow(sign, "id long, n long, content binary, sig binary")


def band_keys(nodes: DataFrame, s: Settings) -> DataFrame:
    """(bucket, node, band) for each band of each node."""

    def bands(batches):
        for batch in slices(batches, 1024):
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, s.bands, s.rows).astype(np.uint64)
            key = np.broadcast_to(np.arange(s.bands, dtype=np.uint64), sig.shape[:2])
            for r in range(s.rows):
                key = mix(key * ODD + sig[:, :, r])
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(len(sig)), s.bands))), pa.array(np.tile(np.arange(s.bands, dtype=np.int32), len(sig)))], names=["bucket", "node", "band"])

    return nodes.select("node", "sig").mapInArrow(bands, "bucket long, node long, band int")


def likely(pairs: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) that batch-wise comparison of signatures does not rule out."""
    steps = least_matches(s)
    left, right = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))

    def test(batches):
        for batch in slices(batches, 4096):
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, s.size) for c in (2, 3))
            alive, matches, done = np.arange(len(x)), np.zeros(len(x), int), 0
            for n, least in steps:
                matches = matches + (x[alive, done:n] == y[alive, done:n]).sum(axis=1)
                keep = matches >= least
                alive, matches, done = alive[keep], matches[keep], n
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive))], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(test, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, s: Settings) -> DataFrame:
    """Pairs whose full sets reach the threshold: 100 * intersection >= percent * union."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    few = ids.count() <= FEW_IDS
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(ids) if few else ids, "id", "left_semi")
    left, right = rows.select(F.col("id").alias("a"), F.col("text").alias("x")), rows.select(F.col("id").alias("b"), F.col("text").alias("y"))

    def check(batches):
        for batch in slices(batches, 128):
            distinct = {}
            for c in (2, 3):
                for t in batch.column(c).to_pylist():
                    distinct.setdefault(t, len(distinct))
            sets = shingle_sets(list(distinct), s.words)
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = sets[distinct[x]], sets[distinct[y]]
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(bool(len(p)) and 100 * both >= s.percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["u", "v"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "u long, v long").distinct()


def first_labels(links: DataFrame) -> DataFrame:
    """(node, component) after two steps along the links (u smaller than v): equal labels are surely connected."""
    one = links.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
    two = one.select(F.col("node").alias("component"), F.col("component").alias("next"))
    two = one.join(two, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return two


def grouped(batches, key: str):
    """Runs of rows with an equal ``key``, which must be sorted, as tables."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
        cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
        for at, end in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0] != keys[at]:
                yield pa.Table.from_batches(held[1])
                held = []
            if held:
                held[1].append(batch.slice(at, end - at))
            else:
                held = [keys[at], [batch.slice(at, end - at)]]
    if held:
        yield pa.Table.from_batches(held[1])


def open_pairs(table: pa.Table, s: Settings, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of pairs of different components that signatures do not rule out and that share no earlier band."""
    node, component, own = (table.column(c).to_numpy() for c in ("node", "component", "own"))
    band = table.column("band")[0].as_py()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, s.size)
    i, j = np.nonzero((component[:, None] != component) & (node[:, None] < node) & ((own[:, None] != own) | (own.min() == own.max())))
    alive, matches, done = np.arange(len(i)), np.zeros(len(i), np.int16), 0
    for n, least in steps:
        for c in range(done, n):
            matches += sig[i[alive], c] == sig[j[alive], c]
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], n
    i, j = i[alive], j[alive]
    fresh = np.ones(len(i), bool)
    for earlier in range(band):
        at = earlier * s.rows
        same = fresh.copy()
        for c in range(at, at + s.rows):
            same[same] = sig[i[same], c] == sig[j[same], c]
        fresh &= ~same
    return i[fresh], j[fresh]


def between_components(buckets: DataFrame, groups: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, s: Settings) -> DataFrame:
    """(u, v): for each node that links to others of its group, the smallest node that these links reach from it.

    Only buckets with several components take part.  Buckets of more than ``BLOCK`` nodes are cut into
    blocks that meet two by two in separate groups.  A first pass over signatures finds the nodes of
    pairs that are not ruled out; these meet again with their full sets.  Pairs are never rows before
    they are links, and a pair is verified in the first bucket that it shares.  The links of a group
    connect the same nodes as the rows that come back, of which there is at most one for each node.
    """
    labelled = buckets.join(groups, "node", "left").select("bucket", "node", "band", F.coalesce("component", "node").alias("component"))
    open_ = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("c")).where("low <> high")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    rows = labelled.join(open_.select("bucket", blocks.alias("blocks")), "bucket").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("node", "component", "own", "band", F.concat_ws("/", "bucket", F.least("own", "other"), F.greatest("own", "other")).alias("meet"))
    steps = least_matches(s)
    names = ["node", "component", "own", "band", "meet"]
    schema = "node long, component long, own int, band int, meet string"

    def candidates(batches):
        for table in grouped(batches, "meet"):
            i, j = open_pairs(table, s, steps)
            if len(i):
                yield from table.select(names).take(pa.array(np.unique(np.concatenate([i, j])))).combine_chunks().to_batches()

    rows = rows.join(nodes.select("node", "sig"), "node").select(*names, "sig").repartition("meet").sortWithinPartitions("meet")
    rows = written(rows.mapInArrow(candidates, schema), "open")
    ids = rows.select(F.col("node").alias("id")).distinct()
    few = ids.count() <= FEW_IDS
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def sets(batches):
        for batch in slices(batches, 512):
            found = [x.tobytes() for x in shingle_sets(batch.column(1).to_pylist(), s.words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "found"])

    texts = texts.mapInArrow(sets, "node long, found binary").dropDuplicates(["node"])

    def verify(batches):
        for table in grouped(batches, "meet"):
            i, j = open_pairs(table, s, steps)
            node, found = table.column("node").to_numpy(), [np.frombuffer(x, np.uint64) for x in table.column("found").to_pylist()]
            root = list(range(len(node)))

            def find(x, root=root):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            order = np.argsort(i, kind="stable")
            firsts, at = np.unique(i[order], return_index=True)
            for a, partners in zip(firsts.tolist(), np.split(j[order], at[1:]), strict=True):
                own, sizes = found[a], np.array([len(found[b]) for b in partners])
                joined = np.concatenate([found[b] for b in partners])
                both = np.add.reduceat((own[np.minimum(np.searchsorted(own, joined), len(own) - 1)] == joined).astype(np.int64), np.cumsum(sizes) - sizes)
                good = partners[100 * both >= s.percent * (len(own) + sizes - both)]
                for b in good.tolist():
                    x, y = find(a), find(b)
                    if x != y:
                        root[x if node[x] > node[y] else y] = y if node[x] > node[y] else x  # the smaller node stays a root
            least = node[[find(x) for x in range(len(node))]]
            moved = least != node
            if moved.any():
                yield pa.RecordBatch.from_arrays([pa.array(least[moved]), pa.array(node[moved])], names=["u", "v"])

    full = rows.join(nodes.select("node", "sig"), "node").join(texts, "node").select(*names, "sig", "found").repartition("meet").sortWithinPartitions("meet")
    return full.mapInArrow(verify, "u long, v long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """(``key``, n_shingles, component_id, kept) for each row of ``docs``.

    ``component_id`` is the smallest id reachable over links; ``kept`` says that it is the row's own.
    Null texts and texts without words have no shingles and no links.  A row with a null id takes no
    part: its component is null and it is kept.  Rows that share an id are one document.  An empty
    table gives no rows.
    """
    s = settings or Settings()
    signed = written(signatures(docs, key, text, s), "signatures")
    some = signed.where("n > 0 and id is not null")
    nodes = written(some.groupBy("content").agg(F.min("id").alias("node"), F.first("sig").alias("sig")), "nodes")
    buckets = written(_shared(band_keys(nodes, s)), "buckets")
    pivots = buckets.groupBy("bucket").agg(F.min("node").alias("a"))
    stars = buckets.join(pivots, "bucket").where("a < node").select("a", F.col("node").alias("b")).distinct()
    unsure = written(likely(stars, nodes, s), "likely")
    links = written(verified(unsure, docs, key, text, s), "links")
    discard(unsure)
    more = between_components(buckets, first_labels(links), nodes, docs, key, text, s)
    groups = connected_components(links.union(more))
    by_content = nodes.join(groups, "node", "left").select("content", F.coalesce("component", "node").alias("component"))
    out = signed.join(by_content, "content", "left")
    component = F.coalesce(F.when(F.col("id").isNotNull(), F.col("component")), F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _shared(buckets: DataFrame) -> DataFrame:
    """Buckets with more than one node."""
    more = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket")
    return buckets.join(more, "bucket", "left_semi")

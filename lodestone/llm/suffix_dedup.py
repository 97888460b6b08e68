"""Repeated passages by suffix arrays built with two-stage sorting.

A byte goes if a string of ``length`` bytes that covers it also starts earlier, in a document with a
smaller id or earlier in the same one.  To spread the work, each window of ``length`` bytes is owned
by its anchor, the ``GRAM`` bytes of it with the smallest hash: equal windows have equal anchors.

1.  Exact copies are found by digest and take no part in what follows.
2.  Anchors that occur once own no repeated window.  Tasks send (anchor hash, document, windows) in
    packed blobs to the hash's partition, which answers with the anchors that occur again.  An anchor
    that one slice of texts holds several times is surely shared and sent once for the slice.
    For shared anchors, the text under their windows goes to the anchor's partition; anchors that
    occur very often send each window by its own hash instead, so that no partition gathers them all.
3.  There a suffix array of these texts is built: suffixes smaller than their successors are sorted
    directly, the rest follow from bucket scans, and adjacent common prefixes of ``length`` bytes
    join equal windows.  All but the earliest are repeated.
4.  Repeated windows return to their documents as spans, which are merged there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import discard, release, shuffle_parts, slices, written

GRAM = 24
HOT = 20_000  # slices of text that share an anchor (at most 3.5 MB of text under it) beyond which its windows travel one by one
FEW_COPIES = 400_000  # (document, hash) of exact copies that are broadcast (a few MB); beyond, the same joins shuffle
CHUNK = 4_000_000  # bytes that are hashed at a time; must stay below 2 ** 24
MIX = np.uint64(0xBF58476D1CE4E5B9)
ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each place, by doubling (8, then 16 and 8 more)."""

    def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = left * ODD + right
        out ^= out >> np.uint64(32)
        out *= MIX
        out ^= out >> np.uint64(29)
        return out

    h = data.astype(np.uint64) + np.uint64(1)
    eight = h
    for step in (1, 2, 4, 8):
        h = join(h[:-step], h[step:])
        if step == 4:
            eight = h
    return join(h[:-8], eight[16 : 16 + len(h) - 8])


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows within the documents that end at ``ends``: (anchor hash, first start, number of starts)."""
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = gram_hashes(data)
    width = length - GRAM + 1
    low = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    doc = np.searchsorted(ends, np.arange(len(at)), side="right")
    valid = np.arange(len(at)) + length <= ends[doc]
    change = np.ones(len(at), bool)
    change[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(change & valid)
    if not len(first):
        return np.zeros(0, np.uint64), first, first
    counts = np.add.reduceat(valid.astype(np.int64), np.flatnonzero(change))[valid[np.flatnonzero(change)]]
    return hashes[at[first]], first, counts


def window_hash(window: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little")


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """Big-endian value of the eight bytes from each place, with zeros behind the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)]
    return out


def directly_sorted(data: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """Places whose suffix is smaller than its successor, and the runs of equal bytes that end a text.

    ``lasts`` are the last places of the texts; a run of equal bytes has the type of its last byte.
    """
    n = len(data)
    follow = np.append(data[1:].astype(np.int16), -1)
    follow[lasts] = -1
    differ = np.flatnonzero(follow != data).astype(np.int32)
    last = np.repeat(differ, np.diff(differ, prepend=-1))
    return (follow[last] > data[last]) | (follow[last] < 0)


def _sorted_places(places: np.ndarray, keys: np.ndarray, words: int) -> np.ndarray:
    """``places`` by the ``words`` eight-byte values behind them.

    Sorted by the first two; runs that are equal in these but not in all go through the others.
    """

    def word(at: np.ndarray, t: int) -> np.ndarray:
        return keys[np.minimum(at + 8 * t, len(keys) - 1)] * (at + 8 * t < len(keys))

    if not len(places):
        return places
    for t in (1, 0):
        places = places[np.argsort(word(places, t), kind="stable")]
    equal = [word(places, t)[1:] == word(places, t)[:-1] for t in (0, 1)]
    run = np.concatenate(([0], np.cumsum(~(equal[0] & equal[1]))))
    mixed = np.zeros(run[-1] + 1, bool)
    for t in range(2, words):
        w = word(places, t)
        mixed[run[1:][(w[1:] != w[:-1]) & (run[1:] == run[:-1])]] = True
    slots = np.flatnonzero(mixed[run])
    part = places[slots]
    order = np.lexsort([*(word(part, t) for t in range(words - 1, 1, -1)), run[slots]])
    places[slots] = part[order]
    return places


def two_stage_order(data: np.ndarray, keys: np.ndarray, wanted: np.ndarray, rising: np.ndarray, length: int) -> np.ndarray:
    """The places marked in ``wanted`` in the order of their suffixes, by at least ``length`` bytes.

    Those marked in ``rising`` (see :func:`directly_sorted`) are sorted, the others induced, so
    ``wanted`` must hold the successor of each of these.  ``keys`` are :func:`eight_bytes` of ``data``.
    """
    n = len(data)
    direct, induced = np.flatnonzero(wanted & rising), wanted & ~rising
    direct = _sorted_places(direct, keys, (length + 7) // 8)
    direct = [direct[data[direct] == c] for c in range(256)]
    heads: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def before(places: np.ndarray) -> np.ndarray:
        previous = places[places > 0] - 1
        return previous[induced[previous]]

    for c in range(256):
        wave, bucket = np.concatenate(heads[c]) if heads[c] else direct[c][:0], []
        while len(wave):
            bucket.append(wave)
            previous = before(wave)
            wave = previous[data[previous] == c]
        full = np.concatenate([*bucket, direct[c]])
        out.append(full)
        previous = before(full)
        previous = previous[data[previous] > c]
        if len(previous):
            order = previous[np.argsort(data[previous], kind="stable")]
            values, at = np.unique(data[order], return_index=True)
            for value, part in zip(values.tolist(), np.split(order, at[1:]), strict=True):
                heads[value].append(part)
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, keys: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Bytes, up to ``length``, that each place of ``order`` shares with the one before; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for at in range(0, length, 8):
        x, y = order[alive - 1] + at, order[alive] + at
        inside = np.maximum(x, y) < len(data)
        alive, x, y = alive[inside], x[inside], y[inside]
        differ = keys[x] ^ keys[y]
        same = differ == 0
        high = np.zeros(len(alive), np.int64)
        for k in range(8):
            high += (differ >> np.uint64(8 * (7 - k))) == 0
        out[alive] += high
        alive = alive[same]
    return np.minimum(out, length)


def repeated_windows(texts: list[bytes], starts: np.ndarray, length: int, rank: np.ndarray) -> np.ndarray:
    """Which windows repeat an earlier one.

    Text k holds ``starts[k]`` windows, at its first places; ``rank`` orders all windows (they follow
    one another by text and place).  Returns one flag for each window.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    base = np.cumsum(sizes) - sizes
    total = int(starts.sum())
    first = np.cumsum(starts) - starts
    places = np.repeat(base - first, starts) + np.arange(total)
    window = np.full(len(data), -1, np.int32)
    window[places] = np.arange(total)
    # after the last window, go on to the first place that is sorted directly: each induced one has its successor
    rising = directly_sorted(data, base + sizes - 1)
    places = np.flatnonzero(rising)
    stop = places[np.searchsorted(places, base + starts - 1)]
    mark = np.zeros(len(data) + 1, np.int8)
    np.add.at(mark, base, 1)
    np.add.at(mark, stop + 1, -1)
    keys = eight_bytes(data)
    order = two_stage_order(data, keys, np.cumsum(mark[:-1], dtype=np.int8) > 0, rising, length)
    order = order[window[order] >= 0]
    group = np.cumsum(common_prefixes(data, keys, order, length) < length) - 1
    own = rank[window[order]]
    least = np.minimum.reduceat(own, np.flatnonzero(np.diff(group, prepend=-1))) if len(order) else own
    out = np.zeros(total, bool)
    out[window[order]] = own != least[group]
    return out


def _pack(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, count: np.ndarray, extra: list[np.ndarray]) -> bytes:
    """Rows as bytes; each (doc, tie) is held once and rows name it by number."""
    fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])))
    number = np.cumsum(fresh) - 1
    heads = np.array([len(doc), int(fresh.sum())], "<u8")
    return b"".join(np.ascontiguousarray(x).tobytes() for x in (heads, doc[fresh].astype("<i8"), tie[fresh].astype("<i8"), number.astype("<u4"), start.astype("<u4"), count.astype("u1"), *extra))


def _unpack(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    (n, owners), at, out = np.frombuffer(blob, "<u8", 2).tolist(), 16, []
    for size, kind in ((owners, "<i8"), (owners, "<i8"), (n, "<u4"), (n, "<u4"), (n, "u1"), *((n, k) for k in kinds)):
        out.append(np.frombuffer(blob, kind, size, at))
        at += out[-1].nbytes
    doc, tie, number, *rest = out
    return [doc[number], tie[number], *rest, np.frombuffer(blob, np.uint8, offset=at)]


SINGLE, KNOWN, OFTEN = 0, 1, 2  # an anchor that its slice has once; one that it has more often; an anchor of too many slices


def find_anchors(docs: DataFrame, length: int, parts: int) -> DataFrame:
    """(part, kind, blob): the anchors of all documents.  ``docs`` is (doc, tie, text).

    An anchor that a slice of texts has several times is sent to its partition once, without a
    document; its places are known to be shared and go to any partition, so that no partition
    receives more than one row of it from each slice.
    """

    def blobs(kind, part, row, start, count, hashes, ids, ties):
        order = np.argsort(part, kind="stable")
        if not len(order):
            return []
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
        made = [_pack(ids[row[o]], ties[row[o]], start[o], count[o], [hashes[o].astype("<u8")]) for o in np.split(order, cuts[1:])]
        return list(zip(part[order][cuts].tolist(), [kind] * len(made), made, strict=True))

    def send(batches):
        for batch in slices(batches, 2048, CHUNK // 2):
            ids, ties = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            pieces, owner, offset = [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                raw = (text or "").encode("utf-8", "replace")
                for at in range(0, max(1, len(raw) - length + 1), CHUNK // 2):  # windows that start in this stretch
                    if len(raw) >= length:
                        pieces.append(raw[at : at + CHUNK // 2 + length - 1])
                        owner.append(row)
                        offset.append(at)
            at = 0
            while at < len(pieces):
                end, size = at, 0
                while end < len(pieces) and (end == at or size + len(pieces[end]) <= CHUNK):
                    size += len(pieces[end])
                    end += 1
                data = np.frombuffer(b"".join(pieces[at:end]), np.uint8)
                ends = np.cumsum([len(p) for p in pieces[at:end]])
                hashes, first, count = anchors(data, ends, length)
                piece = np.searchsorted(ends, first, side="right")
                row = np.array(owner[at:end], np.int64)[piece]
                start = first - np.concatenate(([0], ends[:-1]))[piece] + np.array(offset[at:end], np.int64)[piece]
                _, one, which, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                own, again = np.sort(one), np.flatnonzero(times[which] > 1)
                count_sent = np.where(times[which[own]] > 1, 0, count[own])
                rows = blobs(SINGLE, (hashes[own] % np.uint64(parts)).astype(np.int64), row[own], start[own], count_sent, hashes[own], ids, ties)
                spread = np.full(len(again), int(hashes[0] % np.uint64(parts)) if len(hashes) else 0)
                rows += blobs(KNOWN, spread, row[again], start[again], count[again], hashes[again], ids, ties)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "kind", "blob"])
                at = end

    return docs.mapInArrow(send, "part long, kind int, blob binary")


def shared_anchors(sent: DataFrame, often: int) -> DataFrame:
    """(doc, tie, start, count, hash) of the anchors that occur more than once, and (hash) alone of those in more than ``often`` slices."""
    names = ["kind", "doc", "tie", "start", "count", "hash"]

    def rows(kind, doc, tie, start, count, hashes):
        for at in range(0, len(doc), 100_000):
            to = slice(at, at + 100_000)
            values = (np.full(len(doc[to]), kind, np.int32), doc[to], tie[to], start[to].astype(np.int64), count[to].astype(np.int32), hashes[to].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=names)

    def answer(batches):
        held = []
        for batch in batches:
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = _unpack(blob, ["<u8"])[:5]
                if kind == KNOWN:
                    yield from rows(KNOWN, *found)
                else:
                    held.append(found)
        if not held:
            return
        doc, tie, start, count, hashes = (np.concatenate([h[k] for h in held]) for k in range(5))
        held.clear()
        order = np.argsort(hashes, kind="stable")
        cuts = np.flatnonzero(np.diff(hashes[order], prepend=~hashes[order[0]]) != 0)
        sizes = np.diff(np.append(cuts, len(order)))
        own = order[np.repeat(sizes, sizes) > 1]
        own = own[count[own] > 0]  # the others' places are known
        yield from rows(SINGLE, doc[own], tie[own], start[own], count[own], hashes[own])
        hot = hashes[order[cuts[sizes > often]]]
        nothing = np.zeros(len(hot), np.int64)
        yield from rows(OFTEN, nothing, nothing, nothing, nothing, hot)

    return sent.mapInArrow(answer, "kind int, doc long, tie long, start long, count int, hash long")


def send_texts(owned: DataFrame, length: int, parts: int, hot: frozenset[int]) -> DataFrame:
    """(part, blob) of the texts under shared anchors.  ``owned`` is (doc, tie, text, found) with found a list of anchors.

    Equal texts of one task are sent once, by their earliest owner; the later owners' windows are
    known repeats and go without text to any partition.  Anchors of ``hot`` send each window by its
    own hash.
    """

    def send(batches):
        kept: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        known: list[tuple[int, int, int, int]] = []
        held = turn = 0

        def flush():
            rows: dict[int, list] = {}
            for (part, text), (doc, tie, start) in kept.items():
                rows.setdefault(part, []).append((doc, tie, start, len(text) - length + 1, len(text), text))
            if known:
                rows.setdefault(turn % parts, []).extend((*m, 0, b"") for m in sorted(known))
            parts_, blobs = [], []
            for part, all_ in rows.items():
                doc, tie, start, count, size = (np.array([r[k] for r in all_]) for k in range(5))
                packed = _pack(doc, tie, start, count, [size.astype("<u4"), np.frombuffer(b"".join(r[5] for r in all_), np.uint8)])
                parts_.append(part)
                blobs.append(len(packed).to_bytes(8, "little") + pa.compress(packed, "zstd", asbytes=True))
            kept.clear(), known.clear()
            return pa.RecordBatch.from_arrays([pa.array(parts_, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "blob"]) if parts_ else None

        for batch in slices(batches, 256):
            for doc, tie, text, found in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                raw = text.encode("utf-8", "replace")
                for f in found:
                    often = f["hash"] in hot
                    spread = ((f["start"] + k, 1) for k in range(f["count"])) if often else ((f["start"], f["count"]),)
                    for start, count in spread:
                        under = raw[start : start + count - 1 + length]
                        part = (window_hash(under) if often else f["hash"] % 2**64) % parts
                        owner, now = kept.get((part, under)), (doc, tie, start)
                        if owner is None:
                            kept[part, under] = now
                            held += len(under) + 100
                        elif owner != now:
                            kept[part, under] = min(owner, now)
                            known.append((*max(owner, now), count))
                            held += 100
                turn = tie
            if held > 64_000_000:
                out, held = flush(), 0
                if out is not None:
                    yield out
        out = flush()
        if out is not None:
            yield out

    return owned.mapInArrow(send, "part long, blob binary")


def repeated_spans(sent: DataFrame, length: int) -> DataFrame:
    """(doc, tie, start, end) of stretches that repeated windows cover."""

    def opened(blob: bytes) -> list[np.ndarray]:
        return _unpack(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True), ["<u4"])

    def find(batches):
        held = [opened(b) for batch in batches for b in batch.column(1).to_pylist()]
        if not held:
            return
        doc, tie, start, count, size = (np.concatenate([h[k] for h in held]).astype(np.int64) for k in range(5))
        raw = b"".join(h[5].tobytes() for h in held)
        ends = np.cumsum(size)
        _, place = np.unique(np.column_stack([doc, tie]), axis=0, return_inverse=True)
        place = place.reshape(-1).astype(np.int64)
        key = (place << 32) | start
        fresh = np.flatnonzero(size > 0)
        fresh = fresh[np.sort(np.unique(key[fresh], return_index=True)[1])]  # rows that occur twice count once
        repeated = np.zeros(0, np.int64)
        if len(fresh):
            rank = np.repeat(key[fresh] - (np.cumsum(count[fresh]) - count[fresh]), count[fresh]) + np.arange(count[fresh].sum())
            flags = repeated_windows([raw[ends[k] - size[k] : ends[k]] for k in fresh], count[fresh], length, rank)
            repeated = rank[flags]
        told = np.flatnonzero(size == 0)
        windows = np.unique(np.concatenate([repeated, np.repeat(key[told] - (np.cumsum(count[told]) - count[told]), count[told]) + np.arange(count[told].sum())]))
        if not len(windows):
            return
        cut = np.concatenate(([0], np.flatnonzero(np.diff(windows) > length) + 1))  # windows that touch are one span
        first, last = windows[cut], windows[np.append(cut[1:], len(windows)) - 1]
        _, some = np.unique(place, return_index=True)  # places are numbered from 0 without gaps
        row = some[first >> 32]
        yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(tie[row]), pa.array(first & 0xFFFFFFFF), pa.array((last & 0xFFFFFFFF) + length)], names=["doc", "tie", "start", "end"])

    return sent.mapInArrow(find, "doc long, tie long, start long, end long")


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, part_mb: int = 2) -> DataFrame:
    """``key``, ``text`` and ``spans`` (sorted array of start, end in bytes of UTF-8, which may overlap): what to remove.

    Each row of ``docs`` gives one row, which keeps its other columns (after these; one called ``spans`` is replaced).
    Texts count as bytes, null as empty; matches never cross documents.  Rows are ordered by ``key``,
    nulls first, then by a hash of the text; rows equal in both are one document and get the same
    spans.  A document whose text occurs earlier is removed whole if it has ``length`` bytes.  Texts
    shorter than ``length`` keep everything.  An empty table gives no rows.
    ``part_mb`` of text make a partition of the suffix arrays, which need about 100 bytes for each of theirs.

    Anchors that more than ``HOT`` slices share (or more than a 40,000,000th of all bytes, if that is
    more) send each window on its own; so at most about a million hashes of anchors reach the driver.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c not in (key, text, "spans")]
    carried, given = ([F.struct(*rest).alias("rest")], ["rest.*"]) if rest else ([], [])
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *carried)
    rows = rows.withColumns({"doc": F.coalesce("key", F.lit(-(2**63))), "tie": F.xxhash64("text")})
    digests = written(rows.select("doc", "tie", F.md5("text").alias("digest"), F.octet_length("text").cast("long").alias("size")), "digests")
    total = digests.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(shuffle_parts(spark), int(total // (32 * part_mb << 20)) + 1)
    text_parts = max(shuffle_parts(spark), int(total // (part_mb << 20)) + 1)
    firsts = digests.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("digest", "first")
    firsts = written(firsts, "firsts")
    firsts = F.broadcast(firsts) if firsts.count() <= FEW_COPIES else firsts  # a text of very many copies is one row here
    copies = written(digests.join(firsts, "digest").where("doc > first").select("doc", "tie").distinct(), "copies")
    few = copies.count() <= FEW_COPIES
    own = rows.select("doc", "tie", "text").where(F.octet_length("text") >= length)
    own = own.join(F.broadcast(copies) if few else copies, ["doc", "tie"], "left_anti")  # copies are neither anchored nor sent
    found = written(shared_anchors(find_anchors(own, length, parts).repartition(parts, "part"), max(HOT, total // 40_000_000)), "anchors")
    release(spark)
    hot = frozenset(r[0] for r in found.where(F.col("kind") == OFTEN).select("hash").collect())
    lists = found.where(F.col("kind") != OFTEN).groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "count", "hash")).alias("found"))
    owned = own.join(lists, ["doc", "tie"]).select("doc", "tie", "text", "found")
    spans = written(repeated_spans(send_texts(owned, length, text_parts, hot).repartition(text_parts, "part"), length), "spans")
    discard(found)
    release(spark)
    spans = spans.groupBy("doc", "tie").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    marked = copies.withColumn("copy", F.lit(True))
    out = rows.join(spans, ["doc", "tie"], "left").join(F.broadcast(marked) if few else marked, ["doc", "tie"], "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end")))
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    chosen = F.when(F.col("copy") & (F.octet_length("text") >= length), whole).otherwise(F.coalesce("spans", nothing))
    return out.select(F.col("key").alias(key), F.col("text").alias(text), chosen.alias("spans"), *given)


def remove_spans(found: DataFrame, text: str = "text", spans: str = "spans", whole_characters: bool = False) -> DataFrame:
    """``found`` with ``kept`` (binary), ``n_bytes``, ``n_removed`` and ``n_spans`` (maximal runs) in place of ``text`` and ``spans``.

    With ``whole_characters`` a span gives back the bytes of characters that it would cut.
    """
    rest = found.drop(text, spans, "kept", "n_bytes", "n_removed", "n_spans")
    columns = rest.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), "kept binary, n_bytes long, n_removed long, n_spans long"])
    names = [*columns, "kept", "n_bytes", "n_removed", "n_spans"]

    def cut(batches):
        for batch in slices(batches, 512):
            kept, sizes, removed, runs = [], [], [], []
            n = len(columns)
            for value, pairs in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                raw = (value or "").encode("utf-8", "replace")
                out, at, gone, run, open_ = [], 0, 0, 0, -1
                for p in sorted((p["start"], p["end"]) for p in pairs):
                    start, end = p
                    if whole_characters:
                        while start < end and raw[start] & 0xC0 == 0x80:
                            start += 1
                        while end > start and end < len(raw) and raw[end] & 0xC0 == 0x80:
                            end -= 1
                    if start > open_:
                        run += 1
                        out.append(raw[at:start])
                    gone += max(0, end - max(start, at))
                    at = open_ = max(at, end)
                out.append(raw[at:])
                kept.append(b"".join(out))
                sizes.append(len(raw))
                removed.append(gone)
                runs.append(run)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs))], names=names)

    return found.select(*columns, text, spans).mapInArrow(cut, schema)

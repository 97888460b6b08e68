"""op4 draws from the k-mers at every character: compared with a brute-force version of that definition."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import order_minhash
from lodestone.llm.queries import op4_order_minhash

LOW = 2**28 - 1


def signed(data: bytes, seed: int = 42) -> int:
    h = xxhash.xxh64_intdigest(data, seed % 2**64)
    return h - 2**64 if h >= 2**63 else h


def brute_signature(text: str, k: int = 16, l: int = 2, m: int = 48) -> list[int]:  # noqa: E741
    """One k-mer for each character, numbered by occurrence, in every sketch's order."""
    seen: Counter = Counter()
    items = []
    for at in range(max(1, len(text))):
        h = signed(text[at : at + k].encode("utf-32-be")) & ~LOW
        n = seen[h]
        seen[h] += 1
        items.append((signed(n.to_bytes(4, "little"), signed((h >> 28).to_bytes(8, "little", signed=True))) & ~LOW if n else h, at))
    items.sort()
    out = []
    for start in order_minhash.rotations(m):
        first = next((n for n, (h, at) in enumerate(items) if h | at >= start), len(items))
        value = 42
        for h, _ in sorted((items[(first + t) % len(items)] for t in range(min(l, len(items)))), key=lambda x: x[1]):
            value = signed(((h % 2**64) >> 28).to_bytes(8, "little"), value)
        out.append(value & 0xFFFFFFFF)
    return out


def prose(n: int) -> str:
    rng = random.Random(n)
    return " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 9))) for _ in range(n))


TEXTS = ["", None, " ", "a", "ab", "  a b", "word " * 40, "x" * 100 + "\n\n y", "the end of the end of the end of the end", "日本語" * 30 + "。", "\U0001f600" * 20, "é" * 9 + " ßß", "a" + " " * 40 + "b" + "\n" * 13 + "c d", prose(80), prose(80), prose(81)[:-1] + "\r\n"]


def test_query_draws_from_the_kmers_at_every_character(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in op4_order_minhash(spark, str(tmp_path)).collect()}
    assert sorted(out) == list(range(len(TEXTS)))
    printed = lambda sig: "".join(f"{x:08x}" for x in sig)
    for i, r in out.items():
        text, following = TEXTS[i] or "", TEXTS[i - 1] or ""  # the row before the first is the last
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        own, other, after = brute_signature(text), brute_signature(edited), brute_signature(following)
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == printed(own) and r["edited_fingerprint"] == printed(other), text
        assert r["near_edited"] == pytest.approx(sum(a == b for a, b in zip(own, other)) / 48)
        assert r["near_next"] == pytest.approx(sum(a == b for a, b in zip(own, after)) / 48)


def test_every_place_is_looked_at_in_text_of_short_words(spark):
    """As many k-mers as characters: with as many sketches as that, more places are drawn than words start."""
    text = prose(40)
    rows = spark.createDataFrame([(text,)], "text string")
    many = order_minhash.with_signature(rows, l=1, m=4096).select(F.size(F.array_distinct("signature"))).first()[0]
    assert many > 0.9 * len(text) > 2 * len(text.split())


def test_edits_change_what_is_near_them_only(spark):
    rng = random.Random(3)
    run = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=3000))
    text = prose(400)
    texts = [run, "x" + run, run[:1500] + "x" + run[1500:], text, text[:700] + text[701:], " ".join(text.split()[200:] + text.split()[:200]), text.replace(" ", "  ")]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sig = {r[0]: r[1] for r in order_minhash.with_signature(rows).select("doc_id", "signature").collect()}
    like = lambda a, b: sum(x == y for x, y in zip(sig[a], sig[b])) / 48
    assert like(0, 1) > 0.9 and like(0, 2) > 0.85 and like(3, 4) > 0.85
    assert like(3, 5) < like(3, 4) and like(3, 6) < 0.1

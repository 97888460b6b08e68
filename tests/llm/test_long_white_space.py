"""Texts of two million blanks, line feeds or tabs, and others that grow without words, in the operators and the pipeline's last stage."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import near_dedup, order_minhash, packing, suffix_dedup
from lodestone.llm.bpe import encode_decode, token_digests

tokenizers = pytest.importorskip("public_tokenizers")
BYTE_BPE, WORD_BPE = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("word_bpe_49k.json")
N = 2_000_000
TEXTS = [" " * N, "\n" * N, "\t" * N, "a few words" + " \n" * (N // 2) + "and more", " " * 100_001, "\n" * 99_999 + "x"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)


def test_packing_equals_the_library(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    rows = sorted(packing.pack_documents(docs, BYTE_BPE).collect(), key=lambda r: (r["doc_id"], r["piece"]))
    for i, text in enumerate(TEXTS):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        own = [r for r in rows if r["doc_id"] == i]
        assert sum(r["length"] for r in own) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)


def test_a_short_limit_changes_no_ids(monkeypatch):
    import re

    encoder = packing.ByteEncoder(BYTE_BPE)
    texts = ["a  b\n\n c", "x" + " " * 50 + "y", "\t" * 30, "plain words", " lead"]
    whole = encoder.encode(texts)
    monkeypatch.setattr(packing, "SPACES", 1)
    monkeypatch.setattr(packing, "LONG_SPACE", re.compile(r"\s{2}"))
    assert encoder.encode(texts) == whole


def test_words_and_shingles(docs):
    out = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs).collect()}
    assert [out[i]["n_shingles"] for i in range(6)] == [0, 0, 0, 1, 0, 1] and all(r["kept"] for r in out.values())


def test_lower_cased_words_have_no_tokens_in_blanks(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    out = {r["doc_id"]: r for r in token_digests(encode_decode(docs, WORD_BPE).drop("text")).collect()}
    for i, text in enumerate(TEXTS):
        ids = library.encode(text, add_special_tokens=False).ids
        assert out[i]["n_tokens"] == len(ids) and out[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_fingerprints(docs):
    rows = order_minhash.with_next(docs).select("doc_id", F.length("text").alias("n"), order_minhash.fingerprint(F.col("signature")).alias("f")).collect()
    assert {r["doc_id"]: r["n"] for r in rows} == {i: len(t) for i, t in enumerate(TEXTS)} and all(r["f"] for r in rows)


def test_repeated_passages(docs):
    kept = {r["doc_id"]: bytes(r["kept"]) if not isinstance(r["kept"], str) else r["kept"].encode() for r in suffix_dedup.remove_spans(suffix_dedup.repeated_passages(docs)).collect()}
    for i in range(3):  # of one byte again and again a string that starts later covers all but the first
        assert kept[i] == TEXTS[i][:1].encode()
    assert kept[4] == b""

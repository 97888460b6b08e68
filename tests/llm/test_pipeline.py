"""The pipeline's stages on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

TABLES = Path("/root/testdata/sf0.001")
pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
def test_stages_take_effect(spark):
    from lodestone.llm.common import written

    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "12345 6789", "en", "s", 10), (10**6 + 1, None, None, None, None)], docs.schema)
    docs, counts = docs.union(junk), []
    columns = docs.columns
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = written(stage(spark, docs, str(TABLES)), "test")
        counts.append(docs.count())
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert docs.where(F.col("doc_id") >= 10**6).count() == 0
    assert 150 < counts[2] <= counts[1] < counts[0] <= 200 and counts[3] == counts[2]
    use = docs.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert use.where("n <> end or n > 2048").count() == 0


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
def test_clashing_names_and_empty_tables(spark):
    names = ["_label", "label", "_score", "score", "_row", "rest", "spans", "kept", "component_id", "n_bytes", "id", "node"]
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").withColumns({c: F.lit(f"own {c}") for c in names})
    empty, ids = docs.where("1 = 0"), docs.count()
    for _, stage in pipeline.STAGES[:-1]:
        docs, empty = pipeline.written(stage(spark, docs, str(TABLES)), "test"), pipeline.written(stage(spark, empty, str(TABLES)), "test")
        assert docs.columns == empty.columns and empty.count() == 0
        assert docs.select(*names).distinct().collect() == [tuple(f"own {c}" for c in names)]
        assert 0 < docs.count() <= ids
    assert pipeline.packing_stage(spark, empty, "").count() == 0


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
def test_run_against_brute_force(spark):
    """Every row of the tables is kept, cut or dropped by a named rule, and run() packs exactly what is left."""
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from lodestone.llm.common import held_out
    from lodestone.llm.language_id import fit_language_profiles
    from lodestone.llm.quality import fit_quality
    from tests.llm.test_llm_operators import brute_components, brute_spans

    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    model = fit_language_profiles(docs.where(~held_out()).select("text", "lang"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found, cosine = model.scores([t for _, t in rows])
    rows = [r for r, lang, c in zip(rows, found, cosine, strict=True) if lang != "und" and not (c < 0.1 and len(r[1]) >= 200)]
    kept = docs.where(F.col("doc_id").isin([i for i, _ in rows]))
    scores = fit_quality(kept.where(~held_out()), labels.where(~held_out())).scores([t for _, t in rows])
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= 0.3]
    group = brute_components(rows, 5, 80)
    rows = sorted((i, t) for i, t in rows if group[i] == i)
    want: dict = {}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain = brute_spans(rows, 100)
    for i, t in rows:
        raw = plain[i][0]
        text = t if not plain[i][1] else raw.decode("utf-8", "strict") if raw.isascii() else None
        if text:
            tokens = [*library.encode(text, add_special_tokens=False).ids, 0]
            first = (len(tokens) - 1) % 2048 + 1
            want[i] = {(k, at, zlib.crc32(np.array(tokens[at : at + (2048 if k else first)], "<u4").tobytes())) for k, at in enumerate([0, *range(first, len(tokens), 2048)])}
        elif text is None:
            want[i] = None  # cut inside other characters: whole characters stay, which the operator's own test checks
    got: dict = {}
    for r in pipeline.run(spark, str(TABLES)).collect():
        got.setdefault(r.doc_id, set()).add((r.piece, r.start, r.ids_crc32))
    assert got.keys() == want.keys()
    assert all(got[i] == p for i, p in want.items() if p is not None) and sum(p is not None for p in want.values()) > len(want) / 2


def test_rows_without_or_with_repeated_ids(spark):
    """Near-dedup and suffix stages tell rows apart by id and text."""
    import random

    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(n))
    a, b, c, d, e = (text(80) for _ in range(5))
    rows = [
        (1, a, "en"), (2, a + " more", "en"), (2, b, "de"),  # only one of the texts under 2 is a near copy
        (3, c, "en"), (3, c, "en"), (3, c, "de"), (None, d, "fr"), (None, d, "fr"), (None, e, "fr"), (None, a, "fr"),
    ]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = pipeline.near_dedup_stage(spark, docs, "")
    assert near.columns == docs.columns
    some = lambda rows: sorted(((r.doc_id, r.text, r.lang) for r in rows), key=str)
    assert some(near.collect()) == sorted([(1, a, "en"), (2, b, "de"), (3, c, "de"), (None, d, "fr"), (None, e, "fr")], key=str)
    passage = text(30)
    rows = [(None, d + "1" + passage, "fr"), (5, a, "en"), (5, b + "2" + passage, "de"), (6, c, "en"), (None, e, "es")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], docs.schema)
    cut = pipeline.suffix_stage(spark, docs, "")
    assert cut.columns == docs.columns
    out = cut.collect()
    assert some(out) == sorted([(None, d + "1" + passage, "fr"), (5, a, "en"), (5, b + "2", "de"), (6, c, "en"), (None, e, "es")], key=str)
    assert all(r.n_chars == len(r.text) and r.source == "s" for r in out)
    packed = pipeline.packing_stage(spark, cut, "").select("doc_id", "length").collect()
    assert sorted({str(r.doc_id) for r in packed}) == ["5", "6", "None"]

"""Streams into bucket tables: new checkpoints, repeated batches, lost drivers, several writers."""

from __future__ import annotations


import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import corpus, protect
from lodestone.streaming import ingest
from lodestone.streaming.bucket_table import BucketTable

SCHEMA = "chunk_id string, version long, text string"


def write(spark, place, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(place))


def run(spark, place, path, checkpoint):
    stream = spark.readStream.schema(SCHEMA).parquet(str(place))
    ingest.upsert_texts(spark, stream, str(path), str(checkpoint), buckets=4).awaitTermination()
    rows = ingest.read_upserted(spark, str(path), stream.schema).collect()
    assert len({r["chunk_id"] for r in rows}) == len(rows)
    return {r["chunk_id"]: (r["version"], r["text"]) for r in rows}


def test_last_write_wins_whatever_the_checkpoint(spark, tmp_path):
    place, path = tmp_path / "in", tmp_path / "out"
    write(spark, place, [("a", 1, "a1"), ("b", 5, "b5"), ("d", 1, None)])
    assert run(spark, place, path, tmp_path / "c1") == {"a": (1, "a1"), "b": (5, "b5"), "d": (1, None)}
    write(spark, place, [("a", 3, "a3"), ("b", 2, "late")])
    assert run(spark, place, path, tmp_path / "c1")["a"] == (3, "a3")
    other = tmp_path / "other"  # another source and a new checkpoint, whose batches count from 0 again
    write(spark, other, [("a", 4, "a4"), ("c", 1, "c1")])
    want = {"a": (4, "a4"), "b": (5, "b5"), "c": (1, "c1"), "d": (1, None)}
    assert run(spark, other, path, tmp_path / "c2") == want
    assert run(spark, place, path, tmp_path / "c3") == want  # all of the first source once more
    write(spark, place, [("a", 9, "a9")])
    assert run(spark, place, path, tmp_path / "c1") == want | {"a": (9, "a9")}
    assert len(list((path / "log").glob("[0-9]*.json"))) == 2 and not list((path / "log").glob(".[0-9a-f]*[!c]"))


def merged(fresh, old):
    return fresh.drop("b").unionByName(old).groupBy("chunk_id").agg(F.max("version").alias("version"), F.max_by("text", "version").alias("text"))


def commit(table, rows, stream, batch):
    fresh = table.spark.createDataFrame(rows, SCHEMA).withColumn("b", table.bucket())
    return table.commit(stream, batch, fresh, merged, replace=True)


def content(table):
    return {r["chunk_id"]: r["version"] for r in table.rows().collect()}


@pytest.fixture
def table(spark, tmp_path):
    return BucketTable(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema, "chunk_id", 3)


def test_a_batch_counts_once(table):
    assert commit(table, [("a", 1, "x"), ("b", 1, "x")], "s", 0) and not commit(table, [("a", 7, "again")], "s", 0)
    assert commit(table, [("a", 2, "x")], "other", 0) and content(table) == {"a": 2, "b": 1}
    assert not table.rows(buckets=[]).count() and commit(table, [], "s", 1) and content(table) == {"a": 2, "b": 1}


def test_a_driver_lost_before_its_manifest_changes_nothing(table, monkeypatch):
    commit(table, [("a", 1, "x"), ("b", 1, "x")], "s", 0)

    def lost(manifest):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch, pytest.raises(RuntimeError):
        patch.setattr(table, "_publish", lost)
        commit(table, [("a", 2, "x"), ("c", 1, "x")], "s", 1)
    assert content(table) == {"a": 1, "b": 1}
    assert commit(table, [("a", 2, "x"), ("c", 1, "x")], "s", 1) and content(table) == {"a": 2, "b": 1, "c": 1}


def test_writers_at_once_lose_nothing(table, monkeypatch):
    commit(table, [("a", 1, "x")], "s", 0)
    publish, other = table._publish, BucketTable(table.spark, table.path, table.schema, "chunk_id", 3)
    raced = []

    def late(manifest):
        if not raced:
            raced.append(commit(other, [("a", 5, "x"), ("z", 1, "x")], "other", 0))
        return publish(manifest)

    monkeypatch.setattr(table, "_publish", late)
    assert commit(table, [("a", 3, "x"), ("b", 1, "x")], "s", 1)
    assert raced == [True] and content(table) == {"a": 5, "b": 1, "z": 1}


def test_readers_of_the_manifest_before_find_their_files(table):
    for version in range(6):
        before = table.state()
        commit(table, [("a", version, "x")], "s", version)
        if version:
            assert [r["version"] for r in table.rows(before).collect()] == [version - 1]


def test_embed_once_keeps_no_state_and_survives_new_checkpoints(spark, tmp_path):
    place, path = tmp_path / "in", str(tmp_path / "out")
    texts = [["one", "two", "one", None], ["two", "three"], ["four", "one"]]
    for number, batch in enumerate(texts):
        spark.createDataFrame([(t,) for t in batch], "text string").coalesce(1).write.mode("append").parquet(str(place))
        checkpoint = tmp_path / ("c0" if number < 2 else "c1")
        stream = spark.readStream.schema("text string").parquet(str(place))
        ingest.embed_once(stream, path, str(checkpoint), "words", corpus.hashed_words, buckets=3).awaitTermination()
    rows = ingest.read_embedded(spark, path).collect()
    assert len(rows) == len({r["content_key"] for r in rows}) == 4 and all(len(r["embedding"]) for r in rows)
    assert not list((tmp_path / "c0").glob("state/**/*.delta"))


def test_vectors_of_one_id_do_not_share_their_noise(spark):
    x = np.random.default_rng(4).standard_normal((2, 16))
    rows = spark.createDataFrame([("same", r.tolist()) for r in x], "chunk_id string, v array<double>").coalesce(1)
    out = protect.protect(rows, None, "v", b"key", "document").collect()
    assert out[0]["nonce"] != out[1]["nonce"] and len(out[0]["nonce"]) == 16
    assert np.linalg.norm((np.array(out[0]["v"]) - out[1]["v"]) / 32 - (x[0] - x[1])) > 1e-3
    for protected in (protect.protect(rows, None, "v", b"key", "document"), protect.protect(rows.limit(1), "chunk_id", "v", b"key", "document")):
        back = protect.unprotect(protected, "v", b"key", "document").collect()
        assert all(min(np.abs(np.array(r["v"]) - y).max() for y in x) < 1e-9 for r in back)


def test_noise_stays_in_its_ball_and_fills_it(spark):
    rows = spark.range(400).select("id", F.array(*[F.lit(0.0)] * 3).alias("v"))
    for scheme, side, share in (("distance", "document", 3 / 8), ("distance", "query", 1 / 8), ("simple", "query", 1 / 4)):
        out = np.array([r["v"] for r in protect.protect(rows, "id", "v", b"key", side, scheme).collect()])
        far = np.linalg.norm(out, axis=1) / (share * 32 * 0.15)
        assert far.max() <= 1 and abs((far**3).mean() - 0.5) < 0.07 and np.abs(out.mean(axis=0)).max() < 0.2 * share * 32 * 0.15
    odd = rows.limit(3).select("id", F.when(F.col("id") == 0, None).when(F.col("id") == 1, F.array().cast("array<double>")).otherwise(F.array(F.lit(1.0))).alias("v"))
    assert [r["v"] and len(r["v"]) for r in protect.protect(odd, "id", "v", b"k", "query").orderBy("id").collect()] == [None, [], 1]


def test_sessions(spark):
    rows = spark.createDataFrame([(0, [0.6, 0.8, 0.0, 0.0]), (1, [0.6, 0.8, 0.0, 1e-7]), (2, [])], "id long, v array<double>")
    one = lambda key, kind: {r["id"]: np.array(r["v"]) for r in protect.session_perturbed(rows, "v", key, kind).collect()}
    a, again, other, kind = one(b"k" * 32, "ll"), one(b"k" * 32, "ll"), one(b"x" * 32, "ll"), one(b"k" * 32, "hl")
    v = np.array([0.6, 0.8, 0, 0])
    assert (a[0] == again[0]).all() and np.abs(a[0] - other[0]).max() > 1e-4 and np.abs(a[0] - kind[0]).max() > 1e-4
    assert abs(np.linalg.norm(a[0]) - 1) < 1e-12 and 0 < np.linalg.norm(a[0] - v) < 0.03 and np.abs(a[0] - a[1]).max() < 1e-6 and not len(a[2])


def test_bytes_of_quantised_vectors(spark):
    v = [1.0, -1.0, 0.5, -0.25, 3.0, 0.0, -2.0 / 32767]
    got = bytes(spark.range(1).select(protect.int16_bytes(F.array(*[F.lit(x) for x in v]))).first()[0])
    want = np.clip(np.array(v), -1, 1) * 32767
    assert np.frombuffer(got, "<i2").tolist() == (np.sign(want) * np.floor(np.abs(want) + 0.5)).astype(int).tolist()

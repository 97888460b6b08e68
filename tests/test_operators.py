"""Small cases of the operators, with the edges that tables on disk do not hold."""

from __future__ import annotations

import hashlib
import hmac
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.operators import audits, corpus, knowledge_graph, lookups, model_outputs, protect, ranking, telemetry
from lodestone.operators.graph_search import diverse_neighbours, tenant_search
from lodestone.operators.nearest import nearest, nearest_scalar, numbered


def vectors(spark, rows, name="id"):
    return spark.createDataFrame(rows, f"{name} long, vector array<double>")


def test_vector_functions_on_zero_vectors(spark):
    row = spark.range(1).select(F.array(F.lit(0.0), F.lit(0.0)).alias("z"), F.array(F.lit(3.0), F.lit(4.0)).alias("v"))
    out = row.select(V.cosine(F.col("z"), F.col("v")), V.cosine_distance(F.col("z"), F.col("v")), V.norm(F.col("v")), V.normalized(F.col("z")), V.normalized(F.col("v")), V.quantize_4bit(F.col("z"))).first()
    assert out[0] == 0 and out[1] == 1 and out[2] == 5 and out[3] == [0, 0] and out[4] == pytest.approx([0.6, 0.8]) and out[5]["scale"] == 0


def test_nearest_matches_brute_force_over_many_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((90, 8))
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(90, [0.0] * 8), (91, x[5].tolist())]
    found = nearest(vectors(spark, rows[:20], "query_id"), vectors(spark, rows), 7, block=16, query_block=8, other=True).collect()
    points = np.array([r[1] for r in rows])
    for q in range(20):
        size = np.linalg.norm(points, axis=1) * np.linalg.norm(points[q])
        score = np.round(np.divide(points @ points[q], size, out=np.zeros(len(points)), where=size > 0), 9)
        want = sorted((i for i in range(len(rows)) if i != q), key=lambda i: (-score[i], i))[:7]
        assert [r["id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_nearest_with_empty_sides(spark):
    assert nearest(vectors(spark, [], "query_id"), vectors(spark, [(1, [1.0])]), 3).count() == 0
    assert nearest(vectors(spark, [(1, [1.0])], "query_id"), vectors(spark, []), 3).count() == 0


def test_nearest_scalar_ties_and_ranges(spark):
    rng = np.random.default_rng(2)
    values = np.round(rng.random(200), 2)
    corpus_rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, value double")
    asked = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.random(15))], "query_id long, value double")
    got = {(r["query_id"], r["rank"]): r["id"] for r in nearest_scalar(asked, corpus_rows, 4, ranges=8).collect()}
    for q in asked.collect():
        want = sorted(range(200), key=lambda i: (round(abs(values[i] - q["value"]), 9), i))[:4]
        assert [got[q["query_id"], r] for r in range(4)] == want


def test_diverse_neighbours_excludes_self_and_redundant(spark):
    rows = vectors(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.11]), (3, [0.0, 1.0])])
    kept = [r["dst"] for r in diverse_neighbours(rows, 3, 2).where("src = 0").orderBy("ordinal").collect()]
    assert kept[0] == 1 and 0 not in kept and 2 not in kept


def test_tenants(spark):
    rows = spark.createDataFrame([(1, 0, [1.0])], "tenant_id int, id long, vector array<double>")
    known = spark.createDataFrame([(1,), (2,)], "tenant_id int")
    ask = lambda t: spark.createDataFrame([(t, 7, [1.0])], "tenant_id int, query_id long, vector array<double>")
    assert tenant_search(ask(1), rows, known, 3).count() == 1 and tenant_search(ask(2), rows, known, 3).count() == 0
    with pytest.raises(Exception, match="unknown tenant"):
        tenant_search(ask(3), rows, known, 3).collect()


def test_multimap_missing_key(spark):
    m = spark.createDataFrame([("a", ["x"])], "key string, values array<string>")
    out = {r["key"]: r["values"] for r in lookups.multimap_get(spark.createDataFrame([("a",), ("b",)], "key string"), m).collect()}
    assert out == {"a": ["x"], "b": []}


def test_rank_puts_nan_last(spark):
    rows = spark.createDataFrame([(0, 1, 0.5), (0, 2, math.nan), (0, 3, 0.9), (0, 4, 0.5)], "q int, id long, score double")
    out = [r["id"] for r in ranking.rank_with_shuffled_ties(rows, ["q"], "score", "id", "k").orderBy("rank").collect()]
    assert out[0] == 3 and out[-1] == 2 and sorted(out[1:3]) == [1, 4]


def test_padded_results_hide_size(spark):
    key = b"k" * 16
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    results = spark.createDataFrame([(1, 0, 5, 0.5)], "query_id long, rank int, id long, score double")
    padded = ranking.padded_results(results, queries, 4, key)
    assert padded.groupBy("query_id").count().select("count").distinct().collect()[0][0] == 4
    assert padded.select(F.length("payload")).distinct().count() == 1
    assert [tuple(r) for r in ranking.opened_results(padded, key).collect()] == [(1, 0, 5, 0.5)]
    with pytest.raises(ValueError):
        ranking.check_top_k(5, 4)


def walked_chunks(text: str, size: int, overlap: int, least: int, separators: tuple) -> list[str]:
    """The chunker's rule, one character at a time."""
    raw = text.encode()
    whole = lambda at: at == len(raw) or raw[at] & 0xC0 != 0x80
    down = lambda at: next(k for k in range(min(at, len(raw)), -1, -1) if whole(k))
    up = lambda at: next(k for k in range(min(at, len(raw)), len(raw) + 1) if whole(k))
    if not text.strip():
        return []
    out, start = [], 0
    while len(raw) - start > size:
        end = down(start + size)
        low = down(start + size - size // 4)
        cuts = [k + len(m) for m in (s.encode() for s in separators) for k in range(end - len(m), low - 1, -1) if raw[k : k + len(m)] == m]
        cut = cuts[0] if cuts else end
        if cut - start >= least:
            out.append(raw[start:cut].decode())
        start = up(max(cut - overlap, start + 1))
    return [*out, raw[start:].decode()]


def test_chunks(spark):
    text = ("word " * 120 + "\n\n") * 8
    long = "größe, weiß; 日本語。 ende! " * 700
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, "  \n"), (4, None), (5, "é" * 3000), (6, long), (7, "日" * 9000)], "doc_id long, text string")
    for size, overlap, least in ((6400, 400, 2400), (1600, 100, 600), (50, 7, 20), (37, 20, 0)):
        rows = corpus.chunk_documents(docs, size=size, overlap=overlap, least=least).orderBy("doc_id", "ordinal").collect()
        for key, value in ((1, text), (2, "short"), (3, "  "), (5, "é" * 3000), (6, long), (7, "日" * 9000)):
            assert [r["text"] for r in rows if r["doc_id"] == key] == walked_chunks(value, size, overlap, least, corpus.SEPARATORS)
    assert {r["doc_id"]: r["n"] for r in corpus.chunk_documents(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}[5] == 1  # 6,000 bytes are one chunk by default
    with pytest.raises(ValueError):
        corpus.chunk_documents(docs, size=100, overlap=80)


# A model's output with each kind of damage.
RAW = (
    '("entity"<|>"Ada"<|>"person"<|>first<|>extra)##(\'entity\'<|>“Bob”<|>person<|>)##(entity<|>Ada<|>person<|>"first")##("relationship"<|>"Bob"<|>"Ada"<|>"knows"<|>kw<|>2.5)'
    '##("relationship"<|>"Bob"<|>"Ada"<|>knows<|>kw<|>much)##(thing<|>x)##("entity"<|>"Cyd"<|>person##  ##("relationship"<|>a<|>b<|>d<|>3)##("relationship"<|>"Bob"<|>"Eve"<|>met<|>kw<|>"3.5")'
    '##(relationship<|>Ada<|>Eve<|>saw<|>kw<|>2<|>9)##("Entity"<|>"Dan"<|>person<|>no)##("entity<|>"Fay<|>person<|>no)##(entity<|>"Gus<|>person<|>"half)##(relationship<|>a<|>b<|>c<|>d<|>1.0d)##<|COMPLETE|>##("entity"<|>"Late"<|>person<|>no)'
)


def test_parser_and_merge(spark):
    out = spark.createDataFrame([("c0", RAW), ("c1", '("entity"<|>"Ada"<|>person<|>second)'), ("c2", "")], "chunk_id string, raw string")
    rows = sorted(knowledge_graph.parsed(out).collect(), key=lambda r: r["pos"])
    assert [(r["name"], r["description"]) for r in rows if r["kind"] == "entity" and r["chunk_id"] == "c0"] == [("Ada", "first<|>extra"), ("Bob", ""), ("Ada", "first"), ('"Gus', '"half')]
    assert [(r["name"], r["target"], r["description"], r["keywords"], r["strength"]) for r in rows if r["kind"] == "relationship"] == [("Bob", "Ada", "knows", "kw", 2.5), ("Bob", "Eve", "met", "kw", 3.5), ("Ada", "Eve", "saw", "kw", 2.0)]
    t = {r["chunk_id"]: r for r in knowledge_graph.trailers(out).collect()}
    assert t["c0"]["saw_completion"] and t["c0"]["malformed"] == 7 and not t["c1"]["saw_completion"]
    drafts = knowledge_graph.parsed(out).where("kind = 'entity'").withColumn("chunk_pos", F.substring("chunk_id", 2, 9).cast("long"))
    merged = {r["name"]: r for r in knowledge_graph.merge_entities(drafts).collect()}
    assert merged["Ada"]["description"] == "first<|>extra\nsecond" and merged["Ada"]["source_chunks"] == ["c0", "c1"]
    report = knowledge_graph.extraction_report(out).first()
    assert (report["processed"], report["skipped_empty"], report["truncated"], report["malformed"]) == (2, 1, 1, 7)


def test_multimaps(spark):
    rel = spark.createDataFrame([(0, "b", "a"), (1, "a", "a")], "pos long, src string, tgt string")
    out = {r["name"]: r["keys"] for r in knowledge_graph.adjacency(rel).collect()}
    assert out == {"a": ["a\0b", "a\0a"], "b": ["a\0b"]}
    lists = spark.createDataFrame([("a", ["x", "y", "z"]), ("b", ["q"])], "name string, v array<string>")
    fixed = {r["name"]: (r["v"], r["real"]) for r in knowledge_graph.fixed_volume(lists, "v", 2, 4).collect()}
    assert fixed == {"a": (["x", "y"], 2), "b": (["q", ""], 1)}
    with pytest.raises(Exception, match="byte budget"):
        knowledge_graph.fixed_volume(lists.withColumn("v", F.array(F.lit("too long"))), "v", 2, 4).collect()


def test_hmac_and_encryption(spark):
    names = spark.createDataFrame([("Ada",)], "n string")
    got = names.select(protect.pseudonym(F.col("n"), "t", b"key")).first()[0]
    assert got == hmac.new(b"key", b"t\0Ada", hashlib.sha256).hexdigest()
    key, other = b"0" * 16, b"1" * 16
    sealed = names.select(protect.encrypted(F.col("n"), key, F.lit("1")).alias("s"), protect.encrypted(F.col("n"), key).alias("r"))
    assert sealed.select(protect.decrypted(F.col("s"), key), protect.decrypted(F.col("r"), key)).first()[:] == ("Ada", "Ada")
    assert sealed.select(protect.decrypted(F.col("s"), other, strict=False)).first()[0] is None


def test_noise_is_bounded_reversible_and_keyed(spark):
    rows = spark.createDataFrame([(i, np.random.default_rng(i).standard_normal(16).tolist()) for i in range(20)] + [(99, None)], "id long, v array<double>")
    doc = protect.protect(rows, "id", "v", b"k", "document")
    moved = {r["id"]: np.array(r["v"]) for r in doc.where("v is not null").collect()}
    plain = {r["id"]: np.array(r["v"]) for r in rows.where("v is not null").collect()}
    assert all(np.linalg.norm(moved[i] - 32 * plain[i]) <= 3 / 8 * 32 * 0.15 + 1e-9 for i in plain)
    back = {r["id"]: np.array(r["v"]) for r in protect.unprotect(doc, "v", b"k", "document").where("v is not null").collect()}
    assert all(np.abs(back[i] - plain[i]).max() < 1e-9 for i in plain)
    with pytest.raises(Exception, match="not distance/query"):
        protect.unprotect(doc, "v", b"k", "query").collect()
    one, again, other, kind = (protect.session_perturbed(rows.where("id = 1"), "v", s, k).first()["v"] for s, k in ((b"a", "x"), (b"a", "x"), (b"b", "x"), (b"a", "y")))
    assert one == again and one != other and one != kind and np.linalg.norm(one) == pytest.approx(1)


def test_ridge_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 5))
    y = x @ rng.standard_normal((5, 3)) + 2 + 0.1 * rng.standard_normal((60, 3))
    rows = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<double>, y array<double>").repartition(4)
    w, c = audits.Ridge(rows).solve(0.5)
    xs, ys = (x - x.mean(0)) / x.std(0), (y - y.mean(0)) / y.std(0)
    want = np.linalg.solve(xs.T @ xs + 0.5 * np.eye(5), xs.T @ ys) / x.std(0)[:, None] * y.std(0)
    assert np.allclose(w, want) and np.allclose(c, y.mean(0) - x.mean(0) @ want)


def test_splits_are_stable_exact_and_disjoint(spark):
    rows = spark.range(500).withColumn("label", F.col("id") % 40)
    a = {r["id"]: r["split"] for r in audits.split_rows(rows, "id").collect()}
    assert a == {r["id"]: r["split"] for r in audits.split_rows(rows.repartition(7), "id").collect()}
    assert Counter(a.values()) == {"train": 350, "validation": 75, "test": 75}
    assert Counter(r["split"] for r in audits.split_rows(rows, "id", sizes=(100, 20, 30)).collect()) == {"train": 100, "validation": 20, "test": 30}
    for n, want in ((6, (4, 1, 1)), (3, (2, 1, 1)), (100, (70, 15, 15)), (1000, (100, 20, 30))):
        assert tuple(audits.split_sizes(n, (100, 20, 30), (0.7, 0.15, 0.15), (4, 1, 1))) == want
    assert audits.split_rows(rows.where("1 = 0"), "id").count() == 0
    labels = audits.split_by_label(rows, "label").groupBy("label").agg(F.count_distinct("split").alias("n"), F.first("split").alias("split")).collect()
    assert all(r["n"] == 1 for r in labels) and Counter(r["split"] for r in labels) == {"train": 28, "validation": 6, "test": 6}


def test_pair_coverage(spark):
    rng = np.random.Generator(np.random.PCG64(2))
    cells = [(g, float(a), float(a + d)) for g in range(3) for a, d in zip(rng.random(60).round(2), (rng.random(60) * 0.1).round(3))]
    found = {(r["g"], r["eps"]): r for r in audits.pair_coverage(spark.createDataFrame(cells, "g int, a double, b double"), ["g"]).collect()}
    for (g, eps), r in found.items():
        own = [(a, b) for h, a, b in cells if h == g]
        means = sorted((a + b) / 2 for a, b in own if abs(a - b) < eps)
        sizes, start = [], None
        for x in means:
            if start is None or x - start > eps:
                start = x
                sizes.append(0)
            sizes[-1] += 1
        cover = 100 * sum(n for n in sizes if n >= 8) / len(own)
        assert r["symmetric"] == pytest.approx(100 * len(means) / len(own)) and r["coverage"] == pytest.approx(cover)
        assert r["verdict"] == ("viable" if cover >= 50 else "marginal" if cover >= 25 else "dead")
    assert len(found) == 12


def test_span_clusters(spark):
    rows = spark.createDataFrame([("h", v) for v in (0.0, 0.4, 0.9, 1.1, 5.0)], "g string, v double")
    assert [r["size"] for r in audits.span_clusters(rows, ["g"], "v", 1.0).orderBy("cluster").collect()] == [3, 1, 1]
    assert [r["size"] for r in audits.gap_clusters(rows, ["g"], "v", 1.0).orderBy("cluster").collect()] == [4, 1]


def test_rates_of_nothing(spark):
    empty = spark.createDataFrame([], "truth long, predicted long")
    assert audits.top1_rate(empty).first()[0] == 0
    with pytest.raises(Exception, match="shape"):
        audits.top1_rate(spark.createDataFrame([(1, None)], "truth long, predicted long")).collect()


def test_common_prefix_and_readability(spark):
    rows = spark.createDataFrame([("abcdef", "abcxyz"), ("", "a"), ("same", "same")], "a string, b string")
    assert [r[0] for r in rows.select(model_outputs.common_prefix_length(F.col("a"), F.col("b"))).collect()] == [3, 0, 4]
    texts = spark.createDataFrame([("Plain words here.",), ("abcd" * 20,), ("\x01\x02\x03\x04x",), ("",), ("a\n\n\n\nb",), (" " * 60 + "ab",)], "t string")
    assert [r[0] for r in texts.select(model_outputs.readable(F.col("t"))).collect()] == [True, False, False, False, True, True]


def test_instructions(spark):
    cases = [
        ("one two three.", "ends_with", "", 0, "three", True), ("one two Three", "ends_with", "", 0, "three", False), ("end here!? ", "ends_with", "", 0, " here. ", True),
        ("a b", "word_count", "at most", 5, "", True), ("a b", "word_count", "at_most", 1, "", False), ("a b c", "word_count", "", 2, "", True), ("a b c", "word_count", "exactly", 2, "", False),
        ("日本語", "all_lower", "", 0, "", False), ("straße 1", "all_lower", "", 0, "", True), ("STRAßE", "all_upper", "", 0, "", False), ("ABC 1", "all_upper", "", 0, "", True),
        ("p\n \nq\n\nr", "paragraph_count", "", 2, "", True), ("p\n \nq\n\nr", "paragraph_count", "less than", 3, "", False), ("a. b! c", "sentence_count", "at least", 3, "", True),
        ("an AN ant", "keyword_frequency", None, 3, "an", True), ("x", "unknown", "", 0, "", None),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, kind string, relation string, number int, word string, want boolean")
    out = rows.select("i", "want", model_outputs.instruction_holds(F.col("t"), F.col("kind"), F.col("relation"), F.col("number"), F.array("word")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in out), [r for r in out if r["got"] != r["want"]]


def test_tenants_with_escaped_names_and_repeated_chunks(spark, tmp_path):
    from lodestone.sources import readers
    from lodestone.streaming import ingest

    path = str(tmp_path / "index")
    readers.write_index(spark.createDataFrame([("a:b", 1), ("c", 2)], "tenant_id string, n int"), path)
    assert readers.forget_tenant(spark, path, "a:b") and not readers.forget_tenant(spark, path, "a:b")
    assert [r["n"] for r in readers.read_index(spark, path).collect()] == [2]
    rows = spark.createDataFrame([("t", "c1", "first"), ("t", "c1", "second")], "tenant_id string, chunk_id string, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    ingest.append_protected(stream, str(tmp_path / "out"), str(tmp_path / "c"), b"k", b"0123456789abcdef", corpus.hashed_words).awaitTermination()
    nonces = [bytes(r["ciphertext"])[:12] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(nonces) == len(set(nonces)) == 2


def rounded(x: float) -> int:
    return math.floor(x + 0.5)


@pytest.mark.parametrize("accuracy", [100, 10_000])
def test_percentiles_are_exact_beyond_the_sketch(spark, accuracy):
    rng = np.random.default_rng(5)
    values = {"even": rng.random(6000), "ties": np.repeat([1.0, 2.0, 2.5], [3000, 2900, 100]), None: rng.lognormal(0, 4, 700), "one": np.array([7.0]), "two": np.array([1.0, 3.0])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(6)
    found = {r["g"]: r for r in telemetry.rounded_percentiles(df, ["g"], shares=(0.0, 0.01, 0.5, 0.95, 0.99, 1.0), accuracy=accuracy).collect()}
    assert set(found) == set(values)
    for g, vs in values.items():
        line, r = np.sort(vs), found[g]
        assert [r[f"p{round(p * 100)}"] for p in (0.0, 0.01, 0.5, 0.95, 0.99, 1.0)] == [line[rounded(p * (len(line) - 1))] for p in (0.0, 0.01, 0.5, 0.95, 0.99, 1.0)]
        assert r["n"] == len(vs) and r["mean"] == pytest.approx(vs.mean()) and r["std"] == pytest.approx(vs.std())
    assert telemetry.rounded_percentiles(df.where("1 = 0"), ["g"]).count() == 0


def test_warm_up(spark):
    rows = spark.createDataFrame([("a", i) for i in range(8)] + [("b", 1), ("b", 2), (None, 5), (None, 6), (None, 7), (None, 8), ("a", None)], "g string, n long")
    kept = sorted(((r["g"] or "", r["n"]) for r in telemetry.without_warm_up(rows, ["g"], "n", 3).collect()))
    assert kept == [("", 8)] + [("a", i) for i in range(3, 8)]
    assert telemetry.without_warm_up(rows, ["g"], "n", 0).count() == 14


def test_places_across_pieces(spark):
    rng = np.random.default_rng(6)
    keys = rng.permutation(3000)[:2000]
    rows = spark.createDataFrame([("hot" if i % 5 else None, int(k)) for i, k in enumerate(keys)] + [("hot", None)], "g string, k long").repartition(5)
    got = {(r["g"], r["k"]): r["n"] for r in numbered(rows, ["g"], "k", ranges=17).collect()}
    for g in ("hot", None):
        line = sorted((k for h, k in got if h == g), key=lambda k: -1 if k is None else k)
        assert [got[g, k] for k in line] == list(range(len(line)))
    assert len(got) == 2001


def test_extraction_with_a_generator(spark):
    chunks = spark.createDataFrame([("c0", "Ada knows Bob."), ("c1", "  ")], "chunk_id string, text string")
    answer = lambda prompt: F.when(prompt.contains("keywords<|>strength") & prompt.contains("Ada"), F.lit('("relationship"<|>Ada<|>Bob<|>knows<|>people<|>7)<|COMPLETE|>'))
    rows = knowledge_graph.parsed(knowledge_graph.extracted(chunks, ["person"], answer)).collect()
    assert [(r["chunk_id"], r["kind"], r["name"], r["target"], r["strength"]) for r in rows] == [("c0", "relationship", "Ada", "Bob", 7.0)]

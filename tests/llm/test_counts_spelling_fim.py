"""Token counts, spelling variants and fill-in-the-middle against the library, brute force, SQL and round trips."""

from __future__ import annotations

import hashlib
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.llm import fill_middle, queries, spelling, token_counts

tokenizers = pytest.importorskip("public_tokenizers")
PIECES = tokenizers.path("piece_bpe_32k.model")
TABLES = Path("/root/testdata/sf0.001")
RNG = random.Random(11)
ODD = " ▁▁  aeinrst.,;\n\t\0'<s>/|€éüß日本語\U0001f600xyzABC0123"
POOL = ["".join(RNG.choice("aeinrstloAé") for _ in range(RNG.randint(1, 10))) for _ in range(6000)]
LONG = " ".join(RNG.choices(POOL, k=250_000))
#: nulls, empty and very long texts, long runs of one character, repeated rows, marks, odd characters.
ROWS = [
    (1, None), (2, ""), (3, " "), (4, " " * 2_000_000), (5, "\n" * 2_000_000), (6, "a" * 1_200_000), (7, LONG), (8, "one two"), (8, "one two"), (None, "no id"), (9, "with <S> inside"), (10, "<s></s><unk>"),
    *[(100 + k, "".join(RNG.choice(ODD) for _ in range(RNG.randint(0, 80)))) for k in range(300)],
]
CLASHES = ("key", "h1", "cut", "units", "prefix", "body", "word", "box", "role", "root")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4).withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("1 = 0")


# 11 token counts


def test_counts_equal_the_library(docs):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=PIECES)
    out = token_counts.count_tokens(docs.withColumns({"n_tokens": F.lit("old"), "n_bytes": F.lit("old")}), PIECES).collect()
    assert len(out) == len(ROWS)
    for r in out:
        n = len(library.encode(r["text"] or ""))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 4096)
        assert all(r[c] == "clash" for c in CLASHES)


def test_whole_tokens_are_proved():
    from sentencepiece import SentencePieceProcessor

    library, counter = SentencePieceProcessor(model_file=PIECES), token_counts.counter(PIECES)
    assert len(counter.whole) > 30_000
    for piece in RNG.sample(sorted(p for p in counter.whole if p.startswith("▁") and not p.startswith("▁▁") and len(p) > 1), 3000):
        assert library.encode(piece[1:].replace("▁", " ")) == [library.piece_to_id(piece)]


def test_scan_and_heap_merge_alike(monkeypatch):
    counter = token_counts.counter(PIECES)
    words = ["▁" * RNG.randint(0, 9) + "".join(RNG.choice("aeinrstlo") for _ in range(RNG.randint(1, 30))) for _ in range(2000)]
    scanned = [counter.merges(w) for w in words]
    monkeypatch.setattr(token_counts, "SCANNED", 0)
    assert [counter.merges(w) for w in words] == scanned


def test_forgetting_changes_no_count(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED", 32_000)
    counter = token_counts.PieceCounter(PIECES)
    assert counter.count(LONG) == token_counts.counter(PIECES).count(LONG) and len(counter) <= 32_001


def test_other_models_are_refused(tmp_path):
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    model = ModelProto()
    model.ParseFromString(Path(PIECES).read_bytes())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="expected"):
        token_counts.PieceCounter(str(tmp_path / "other.model"))


def test_no_rows(none):
    assert token_counts.count_tokens(none, PIECES).count() == 0
    assert fill_middle.cut_documents(none).count() == 0
    words = spelling.word_counts(none)
    assert words.count() == 0 and spelling.spelling_variants(words).count() == 0


# 12 spelling variants


def brute_variants(n: dict, ratio: int = 5) -> dict:
    def one_edit(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {a: sorted(b for b in n if one_edit(a, b)) for a in n}
    best = {a: min(x, key=lambda b: (-n[b], b)) for a, x in near.items() if x}
    form = {a: b for a, b in best.items() if n[b] >= ratio * n[a]}

    def root(a):
        while a in form:
            a = form[a]
        return a

    return {a: (form.get(a), root(a), n[a], len(near[a]), n[form[a]] if a in form else None) for a in n}


def vocabulary(count: int) -> dict:
    words = {"".join(RNG.choice("aeinrst") for _ in range(RNG.randint(6, 9))) for _ in range(count)}
    for w in list(words):
        for _ in range(3):
            k, c = RNG.randrange(len(w)), RNG.choice("aeinrstzéÿ")
            words |= {w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]}
    base = "long" * 30
    words |= {base, base + "x", "x" + base[1:], base[1:], "y" * 63, "y" * 64, "y" * 65, "y" * 62 + "z"}
    return {w: 5 * 5 ** RNG.randint(0, 6) + RNG.randint(0, 3) for w in words}


@pytest.mark.parametrize("settings", [spelling.Settings(), spelling.Settings(box=40), spelling.Settings(box=40, sample=200)])
def test_variants_equal_brute_force(spark, settings):
    n = vocabulary(60)
    frame = spark.createDataFrame([*n.items(), (None, 7)], "word string, n long").repartition(3)
    out = spelling.spelling_variants(frame, settings).collect()
    assert {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in out} == brute_variants(n) and len(out) == len(n)


def test_long_chains_of_forms(spark):
    rows = [(f"w{k}", f"w{k + 1}") for k in range(26)] + [("a", "b")]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(rows, "word string, form string")).collect()}
    assert got == {f"w{k}": "w26" for k in range(26)} | {"a": "b"}


def test_word_counts_equal_brute_force(docs, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", 1000)
    want: dict = {}
    for i, t in ROWS:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = spelling.misspelt("null" if i is None else str(i), run.translate({c: c + 32 for c in range(65, 91)}))
            want[word] = want.get(word, 0) + 1
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs, change=spelling.misspelt).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5} and len(got) > 1000


# 13 fill in the middle


def brute_cut(i, text: str | None) -> tuple:
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if h[3] % 100 < 20 else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(units), "spm" if h[3] % 100 < 20 else "psm", len(prefix), len(middle), out


def test_cuts_equal_brute_force_and_come_back(docs):
    out = fill_middle.cut_documents(docs.withColumn("form", F.lit("old")))
    rows = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(ROWS) and {r["form"] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert tuple(r[c] for c in ("n_units", "form", "prefix_chars", "middle_chars", "output")) == brute_cut(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "") and all(r[c] == "clash" for c in CLASHES)


def test_windows_change_no_unit(monkeypatch):
    texts = [t for _, t in ROWS if t and len(t) < 1000]
    whole = [fill_middle.unit_ends(t).tolist() for t in texts]
    monkeypatch.setattr(fill_middle, "windows", lambda text, seam: __import__("lodestone.llm.common", fromlist=["windows"]).windows(text, seam, 3))
    assert [fill_middle.unit_ends(t).tolist() for t in texts] == whole


def test_other_sentinels(spark):
    own = fill_middle.Settings(changed=100, suffix_first=50, seed="x", prefix="[a|", suffix="[b|", middle="[c|")
    rows = spark.createDataFrame([(k, f"some (text) {k} | [x") for k in range(60)], "id long, body string")
    out = fill_middle.cut_documents(rows, "id", "body", own).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), own)).collect()
    assert {r["form"] for r in out} == {"psm", "spm"} and all(r["back"] == r["body"] for r in out)


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["op12_spelling_kd", "op13_fill_middle"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{TABLES}/documents.parquet')")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, str(TABLES)).select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
def test_count_query_equals_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=PIECES)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    out = queries.op11_whole_tokens(spark, str(TABLES))
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert {r["doc_id"]: r["n_tokens"] for r in out.collect()} == {i: len(library.encode(t)) for i, t in texts.items()}

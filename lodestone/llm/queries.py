"""The numbered queries over whole tables, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import held_out, own_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.near_dedup import Settings, near_duplicates

    return near_duplicates(_documents(spark, sf_dir).select("doc_id", "text"), settings=Settings(words=4))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.packing import pack_documents

    return pack_documents(_documents(spark, sf_dir).select("doc_id", "text"), _tokenizer("byte_bpe_50k.json"))


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.quality import fit_quality

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs.where(~held_out()), labels.where(~held_out()))
    scored = model.apply(docs)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import order_minhash as omh

    rows = omh.with_next(_documents(spark, sf_dir).select("doc_id", "text"))
    rows = omh.with_signature(rows.withColumn("edited", omh.edited(F.col("text"), F.col("next_text"))), "edited", "edited_signature")
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        omh.fingerprint(F.col("signature")).alias("fingerprint"), omh.fingerprint(F.col("edited_signature")).alias("edited_fingerprint"),
        omh.likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"), omh.likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.sharding import shard_records

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    rows, _ = shard_records(docs, size, own_path(spark, "slot-map"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op6_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.bpe import encode_decode, token_digests

    coded = encode_decode(_documents(spark, sf_dir).select("doc_id", "text"), _tokenizer("word_bpe_49k.json"))
    return token_digests(coded.drop("text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.collision_ann import search

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 100 = 0"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.warc import derivatives, responses

    return derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op9_language_hd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.language_id import fit_language_profiles

    docs = _documents(spark, sf_dir)
    model = fit_language_profiles(docs.where(~held_out()).select("text", "lang"))
    return model.apply(docs.select("doc_id", "text")).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_suffix_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.suffix_dedup import remove_spans, repeated_passages

    kept = remove_spans(repeated_passages(_documents(spark, sf_dir).select("doc_id", "text")))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_whole_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.token_counts import count_tokens

    return count_tokens(_documents(spark, sf_dir).select("doc_id", "text"), _tokenizer("piece_bpe_32k.model")).drop("text")


def op12_spelling_kd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.spelling import misspelt, spelling_variants, word_counts

    return spelling_variants(word_counts(_documents(spark, sf_dir).select("doc_id", "text"), change=misspelt))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.fill_middle import cut_documents, restored

    rows = cut_documents(_documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_bayes": op1_minhash_bayes,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_quality_crf": op3_quality_crf,
        "op4_order_minhash": op4_order_minhash,
        "op5_virtual_slots": op5_virtual_slots,
        "op6_bpe_segment_tree": op6_bpe_segment_tree,
        "op7_collision_counting": op7_collision_counting,
        "op8_warc_derivatives": op8_warc_derivatives,
        "op9_language_hd": op9_language_hd,
        "op10_suffix_two_stage": op10_suffix_two_stage,
        "op11_whole_tokens": op11_whole_tokens,
        "op12_spelling_kd": op12_spelling_kd,
        "op13_fill_middle": op13_fill_middle,
    }


def _warc_sql() -> str:
    """The records of :func:`op8_warc_derivatives` in DuckDB's SQL."""
    from lodestone.llm.warc import BREAKS, ENTITIES

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    named = "MAP {" + ", ".join(f"{quoted(name)}: chr({point})" for name, point in ENTITIES.items()) + "}"
    code = "CASE WHEN lower(n[2]) = 'x' THEN ('0x' || n[3:])::INT ELSE n[2:]::INT END"
    number = f"CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN chr({code}) END"

    def decoded(x: str) -> str:
        name = "regexp_extract(p, '^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{0,31});', 1)"
        char = f"list_transform([{name}], lambda n: CASE WHEN n = '' THEN NULL WHEN n[1] = '#' THEN {number} ELSE element_at({named}, n)[1] END)[1]"
        rest = f"list_transform(str_split({x}, '&')[2:], lambda p: coalesce({char} || substr(p, length({name}) + 2), '&' || p))"
        return f"replace(str_split({x}, '&')[1] || array_to_string({rest}, ''), chr(160), ' ')"

    def regex(x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {quoted(pattern)}, {by}, 'g')"

    def uuid(x: str) -> str:
        return f"'<urn:uuid:' || substr(md5({x}), 1, 8) || '-' || substr(md5({x}), 9, 4) || '-' || substr(md5({x}), 13, 4) || '-' || substr(md5({x}), 17, 4) || '-' || substr(md5({x}), 21, 12) || '>'"

    crlf, lf = "chr(13) || chr(10)", "chr(10)"
    text = regex(regex(regex("body", "(?is)<!--.*?-->", "' '"), r"(?is)<script\b.*?</script\s*>", "' '"), r"(?is)<style\b.*?</style\s*>", "' '")
    text = regex(regex(regex(text, "[ \\t\\r\\n]+", "' '"), BREAKS, lf), "<[^>]*>", "''")
    text = regex(regex(regex(decoded(text), " +", "' '"), " ?\n[ \n]*", lf), "^[ \n]+|[ \n]+$", "''")
    title = decoded(regex("regexp_extract(body, '(?is)<title[^>]*>(.*?)</title', 1)", "[ \\t\\r\\n]+", "' '"))
    links = f"array_to_string(list_transform(regexp_extract_all(body, '(?i)<a\\s[^>]*href=\"([^\"]*)\"', 1), lambda x: {crlf} || 'outlink: ' || x), '')"
    return f"""WITH p AS (SELECT page_id, coalesce(url, '') AS uri, coalesce(html, '') AS body FROM pages),
 h AS (SELECT *, 'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(body) || {crlf} || {crlf} || body AS block, {uuid(f"concat_ws({lf}, 'response', coalesce(page_id::VARCHAR, ''), uri)")} AS source_id FROM p),
 m AS (SELECT page_id, 'metadata' AS record_type, source_id, uri, 'application/warc-fields' AS content_type, 'sha256:' || sha256(body) AS payload_digest,
 'source-payload-digest: sha256:' || sha256(body) || {crlf} || 'source-block-digest: sha256:' || sha256(block) || {crlf} || 'source-header: Content-Type: text/html; charset=utf-8' || {crlf} || 'source-header: Content-Length: ' || strlen(body) || {crlf} || 'title: ' || trim({title}) || {crlf} || 'language: ' || regexp_extract(body, '(?i)<html[^>]*\\slang="([^"]*)"', 1) || {links} || {crlf} AS made FROM h
 UNION ALL SELECT page_id, 'conversion', source_id, uri, 'text/plain; charset=utf-8', 'sha256:' || sha256(body), {text} FROM h)
SELECT page_id, record_type, {uuid(f"concat_ws({lf}, record_type, source_id)")} AS record_id, source_id AS refers_to, uri AS target_uri, '2024-01-01T00:00:00Z' AS warc_date, content_type, strlen(made)::BIGINT AS content_length, payload_digest, 'sha256:' || sha256(made) AS block_digest, made AS block FROM m"""


def _fill_middle_sql() -> str:
    """The rows of :func:`op13_fill_middle`: units are listed, so a cut is a slice of the list."""
    draw = lambda k: f"('0x' || substr(digest, {8 * k + 1}, 8))::BIGINT"
    joined = lambda x: f"coalesce(array_to_string({x}, ''), '')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS body, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS digest FROM documents),
 u AS (SELECT *, regexp_extract_all(body, '[A-Za-z]+|[^A-Za-z]') AS units FROM d),
 c AS (SELECT *, len(units) AS n, {draw(0)} % (len(units) + 1) AS a, {draw(1)} % (len(units) + 1) AS b,
 CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR {draw(2)} % 100 >= 90 THEN 'plain' WHEN {draw(3)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
 p AS (SELECT doc_id, n, form, body, {joined("units[1:least(a, b)]")} AS prefix, {joined("units[least(a, b) + 1:greatest(a, b)]")} AS middle, {joined("units[greatest(a, b) + 1:]")} AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
 sha256(body) AS restored_sha256 FROM p"""


def _spelling_sql() -> str:
    """The rows of :func:`op12_spelling_kd`: near words share what is left when one character of each, or of the longer, is gone."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    table = []  # of the polynomial of crc32, for four bits
    for k in range(16):
        for _ in range(4):
            k = (k >> 1) ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    nibbles = f"({table}::BIGINT[])"
    step = lambda crc, bits: f"xor({nibbles}[1 + (xor({crc}, {bits}) & 15)], {crc} >> 4)"
    whole = "hex(coalesce(doc_id::VARCHAR, 'null') || ':' || run)"
    steps = f"list_transform(range(0, length({whole}), 2), lambda i: [('0x' || substr({whole}, i + 2, 1))::BIGINT, ('0x' || substr({whole}, i + 1, 1))::BIGINT])"
    crc = f"xor(list_reduce(flatten({steps}), lambda crc, bits: {step('crc', 'bits')}, 4294967295::BIGINT), 4294967295)"
    return f"""WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
 g AS (SELECT doc_id, run, count(*) AS c FROM r GROUP BY ALL),
 h AS (SELECT run, c, {crc} AS h FROM g),
 e AS (SELECT c, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
 w AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
 v AS MATERIALIZED (SELECT word, k, substr(word, 1, k) || substr(word, k + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS k FROM w)),
 s AS (SELECT v.word AS long, w.word AS short FROM v JOIN w ON v.rest = w.word),
 p AS (SELECT a.word AS word, b.word AS near FROM v a JOIN v b USING (k, rest) WHERE a.word <> b.word UNION SELECT long, short FROM s UNION SELECT short, long FROM s),
 b AS (SELECT p.word, count(*) AS n_near, first(near ORDER BY w.n DESC, near) AS near, max(w.n) AS most FROM p JOIN w ON w.word = p.near GROUP BY p.word),
 f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN near END AS form, CASE WHEN most >= 5 * w.n THEN most END AS form_n FROM w LEFT JOIN b USING (word)),
 o AS (SELECT word, word AS last, 0 AS steps FROM f UNION ALL SELECT o.word, f.form, steps + 1 FROM o JOIN f ON f.word = o.last WHERE f.form IS NOT NULL)
SELECT f.word, f.form, t.root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM f JOIN (SELECT word, arg_max(last, steps) AS root FROM o GROUP BY word) t USING (word)"""


def oracle_sql() -> dict[str, str]:
    return {"op8_warc_derivatives": _warc_sql(), "op12_spelling_kd": _spelling_sql(), "op13_fill_middle": _fill_middle_sql()}

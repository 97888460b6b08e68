"""Queries on knowledge graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import knowledge_graph as K
from lodestone.operators import protect as S
from lodestone.operators.nearest import nearest
from lodestone.plans import fixtures as X
from lodestone.plans.registry import query, r6, sql6, table

# One output for each order: for each of its lines an entity record of the part, one of the supplier and a relation
# between them, with every kind of damage and of harmless variety; ``v`` and ``w`` pick the part's and the relation's.
RECORDS = """rec AS (SELECT l_orderkey AS chunk_pos, 'o' || l_orderkey AS chunk_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS n,
 'P' || l_partkey AS part, 'S' || l_suppkey AS sup, 'd' || (l_partkey % 3) AS about, (l_partkey * 7 + l_orderkey) % 11 AS v, (l_partkey + l_suppkey + l_orderkey) % 7 AS w, l_quantity AS q FROM lineitem)"""
DRAFTS = f"""{RECORDS}, ent AS (SELECT chunk_pos, chunk_id, 3 * n AS pos, part AS name, 'part about ' || about || CASE WHEN v = 3 THEN '<|>more' ELSE '' END AS description FROM rec WHERE v NOT IN (0, 1, 4) UNION ALL SELECT chunk_pos, chunk_id, 3 * n + 1, sup, 'supplier' FROM rec WHERE chunk_pos % 3 = 0),
 rel AS (SELECT chunk_pos, chunk_id, 3 * n + 2 AS pos, part, sup, least(part, sup) AS src, greatest(part, sup) AS tgt, part || ' by ' || sup AS description, q AS strength FROM rec WHERE w >= 3)"""
MALFORMED = "sum((v IN (0, 1, 4))::INT + (chunk_pos % 3 <> 0)::INT + (w < 3)::INT)::BIGINT"


def outputs(spark, sf):
    """(chunk_id, chunk_pos, raw): tuple streams built from order lines."""
    from pyspark.sql import Window

    li = table(spark, sf, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")) - 1
    part, sup, q = F.concat(F.lit("P"), F.col("l_partkey").cast("string")), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), F.col("l_quantity").cast("string")
    about = F.concat(F.lit("part about d"), (F.col("l_partkey") % 3).cast("string"))
    v, w = (F.col("l_partkey") * 7 + F.col("l_orderkey")) % 11, (F.col("l_partkey") + F.col("l_suppkey") + F.col("l_orderkey")) % 7
    joined = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    entity = (
        F.when(v == 0, joined('["entity"<|>"', part, '"<|>part<|>', about, ")")).when(v == 1, joined('("Entity"<|>"', part, '"<|>part<|>', about, ")"))
        .when(v == 2, joined('(entity<|> "', part, '" <|>part<|>"', about, '")')).when(v == 3, joined("(\u201centity\u201d<|>", part, "<|>part<|>", about, "<|>more)"))
        .when(v == 4, joined('("entity"<|>"', part, '"<|>part)')).otherwise(joined('("entity"<|>"', part, '"<|>part<|>', about, ")"))
    )
    other = F.when(F.col("l_orderkey") % 3 == 0, joined("('entity'<|>", sup, "<|>firm<|>supplier)")).otherwise(F.lit("(entity<|><|>firm<|>none)"))
    ends, said = joined(part, "<|>", sup, "<|>"), joined(part, " by ", sup)
    relation = (
        F.when(w == 0, joined("(relationship<|>", ends, said, "<|>", q, ")")).when(w == 1, joined("(relationship<|>", ends, said, "<|>words<|>high)")).when(w == 2, joined("(relationship<|>", part, "<|> <|>", said, "<|>words<|>", q, ")"))
        .when(w == 3, joined("(relationship<|>", ends, said, '<|>words<|>"', q, '")')).when(w == 4, joined("(relationship<|>", ends, said, "<|>words<|>", q, "<|>9)"))
        .when(w == 5, joined("('relationship'<|>'", part, "'<|>\"", sup, '"<|>"', said, '"<|>words<|>', q, ")")).otherwise(joined('("relationship"<|>', ends, said, "<|>words<|>", q, ")"))
    )
    lines = li.select("l_orderkey", n.alias("n"), F.concat_ws(" ##\n", entity, other, relation).alias("t"))
    raw = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "t"))), lambda s: s["t"]), "##")
    made = lines.groupBy(F.col("l_orderkey").alias("chunk_pos")).agg(raw.alias("raw"))
    end = F.when(F.col("chunk_pos") % 5 == 0, "").otherwise("##<|COMPLETE|>")
    return made.select(F.concat(F.lit("o"), F.col("chunk_pos").cast("string")).alias("chunk_id"), "chunk_pos", F.concat("raw", end).alias("raw"))


def drafts(spark, sf):
    rows = K.parsed(outputs(spark, sf)).withColumn("chunk_pos", F.substring("chunk_id", 2, 20).cast("long"))
    return rows.where("kind = 'entity'"), rows.where("kind = 'relationship'")


@query("g01_parse", f"WITH {DRAFTS} SELECT 'entity' AS kind, chunk_id, pos, name, NULL AS target, description, NULL AS keywords, NULL::DOUBLE AS strength FROM ent UNION ALL SELECT 'relationship', chunk_id, pos, part, sup, description, 'words', strength FROM rel")
def g01(spark, sf):
    rows = K.parsed(outputs(spark, sf)).where("kind <> 'malformed'")
    return rows.select("kind", "chunk_id", F.col("pos").cast("long").alias("pos"), "name", "target", "description", "keywords", "strength")


@query("g02_trailers", f"WITH {RECORDS} SELECT chunk_id, CASE WHEN chunk_pos % 5 = 0 THEN 0 ELSE 1 END AS saw_completion, {MALFORMED} AS malformed FROM rec GROUP BY chunk_id, chunk_pos")
def g02(spark, sf):
    return K.trailers(outputs(spark, sf)).withColumn("saw_completion", F.col("saw_completion").cast("int"))


MERGE = "list_reduce(list_prepend('', list(description ORDER BY chunk_pos, pos)), lambda a, x: CASE WHEN x = '' OR contains(a, x) THEN a WHEN a = '' THEN x ELSE a || chr(10) || x END)"
CHUNKS = "array_to_string(list_transform(list_sort(list_distinct(list(chunk_pos))), lambda p: 'o' || p), ',')"


@query("g03_merge_entities", f"WITH {DRAFTS} SELECT name, {MERGE} AS description, {CHUNKS} AS chunks FROM ent GROUP BY name")
def g03(spark, sf):
    return K.merge_entities(drafts(spark, sf)[0]).select("name", "description", F.array_join("source_chunks", ",").alias("chunks"))


@query("g04_merge_relations", f"WITH {DRAFTS} SELECT src, tgt, {MERGE} AS description, {CHUNKS} AS chunks FROM rel GROUP BY src, tgt")
def g04(spark, sf):
    return K.merge_relations(drafts(spark, sf)[1]).select("src", "tgt", "description", F.array_join("source_chunks", ",").alias("chunks"))


FEW = "en AS (SELECT DISTINCT name FROM ent WHERE right(name, 1) <> '7')"


def dangling(spark, sf):
    ent, rel = drafts(spark, sf)
    return K.without_dangling(K.merge_relations(rel), K.merge_entities(ent).where(~F.endswith("name", F.lit("7"))))


@query("g05_dangling", f"WITH {DRAFTS}, {FEW} SELECT DISTINCT src, tgt FROM rel WHERE src IN (SELECT name FROM en) AND tgt IN (SELECT name FROM en)")
def g05(spark, sf):
    return dangling(spark, sf)[0].select("src", "tgt")


@query("g05_dangling_count", f"WITH {DRAFTS}, {FEW}, d AS (SELECT DISTINCT src, tgt FROM rel) SELECT count(*) AS dangling FROM d WHERE NOT (src IN (SELECT name FROM en) AND tgt IN (SELECT name FROM en))")
def g05_count(spark, sf):
    return dangling(spark, sf)[1]


@query("g06_texts", f"WITH {DRAFTS} SELECT DISTINCT name || ': ' || description AS text FROM ent UNION SELECT src || ' -> ' || tgt || ': ' || description FROM rel")
def g06(spark, sf):
    ent, rel = drafts(spark, sf)
    e = ent.select(K.entity_text(F.col("name"), F.col("description")).alias("text"))
    r = rel.select(K.relation_text(F.least("name", "target"), F.greatest("name", "target"), F.col("description")).alias("text"))
    return e.union(r).distinct()


LIVE = "chunk_pos % 9 <> 0"  # the other outputs are white space


def partly_blank(spark, sf):
    return outputs(spark, sf).withColumn("raw", F.when(F.col("chunk_pos") % 9 == 0, F.lit("\n \u3000\t")).otherwise(F.col("raw")))


@query("g07_report", f"""WITH {DRAFTS}, r AS (SELECT * FROM rec WHERE {LIVE}), d AS (SELECT DISTINCT src, tgt FROM rel WHERE {LIVE}), en AS (SELECT name FROM ent WHERE {LIVE})
 SELECT (SELECT count(DISTINCT chunk_id) FROM r) AS processed, (SELECT count(DISTINCT chunk_id) FROM rec WHERE NOT {LIVE}) AS skipped_empty, (SELECT count(DISTINCT chunk_id) FROM r WHERE chunk_pos % 5 = 0) AS truncated, (SELECT {MALFORMED} FROM r) AS malformed,
 (SELECT count(*) FROM en) AS entities, (SELECT count(*) FROM rel WHERE {LIVE}) AS relations, (SELECT count(*) FROM d WHERE src NOT IN (SELECT name FROM en) OR tgt NOT IN (SELECT name FROM en)) AS dangling""")
def g07(spark, sf):
    return K.extraction_report(partly_blank(spark, sf))


@query("g07_chunk_counts", f"""WITH {DRAFTS}, m AS (SELECT chunk_pos, chunk_id, {MALFORMED} AS malformed FROM rec GROUP BY ALL), a AS (SELECT chunk_id, count(*) AS n FROM ent GROUP BY 1), b AS (SELECT chunk_id, count(*) AS n FROM rel GROUP BY 1)
 SELECT chunk_id, NOT {LIVE} AS empty, {LIVE} AND chunk_pos % 5 = 0 AS truncated, CASE WHEN {LIVE} THEN malformed ELSE 0 END AS malformed, CASE WHEN {LIVE} THEN coalesce(a.n, 0) ELSE 0 END AS entities, CASE WHEN {LIVE} THEN coalesce(b.n, 0) ELSE 0 END AS relations
 FROM m LEFT JOIN a USING (chunk_id) LEFT JOIN b USING (chunk_id)""")
def g07_counts(spark, sf):
    return K.chunk_counts(partly_blank(spark, sf))


@query("g08_last_ids", "SELECT p_type AS name, max(p_partkey - 1) AS id FROM part GROUP BY 1")
def g08(spark, sf):
    return K.last_ids(table(spark, sf, "part").select(F.col("p_type").alias("name"), (F.col("p_partkey") - 1).alias("pos")), "name", "pos")


# Entities are suppliers and parts, relations the pairs in order lines, chunks the orders; the vector of an entity is
# the embedding whose row is its key modulo their number, that of a relation by the sum of both keys.
GRAPH = """ln AS (SELECT l_orderkey AS o, l_suppkey AS s, l_partkey AS p FROM lineitem), n AS (SELECT count(*) AS n FROM embeddings),
 ents AS (SELECT DISTINCT 2 * s AS id, 'S' || s AS name, s % n AS place FROM ln, n UNION SELECT DISTINCT 2 * p + 1, 'P' || p, p % n FROM ln, n),
 rels AS (SELECT DISTINCT p * 16777216 + s AS id, 'P' || p AS src, 'S' || s AS tgt, (p + s) % n AS place FROM ln, n),
 ment AS (SELECT DISTINCT 'S' || s AS name, o AS pos, 'o' || o AS chunk_id FROM ln UNION SELECT DISTINCT 'P' || p, o, 'o' || o FROM ln)"""


def places(spark, sf):
    """Entities and relations with the place of their vector, mentions, vectors."""
    ln = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"))
    vec = X.vectors(spark, sf).select(F.col("vec_id").alias("place"), F.col("v").alias("vector"))
    n = vec.count()
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    end = lambda kind, key, odd: ln.select(key).distinct().select((2 * F.col(key) + odd).alias("id"), name(kind, key).alias("name"), (F.col(key) % n).alias("place"))
    pairs = ln.select("p", "s").distinct().select((F.col("p") * 16777216 + F.col("s")).alias("id"), name("P", "p").alias("src"), name("S", "s").alias("tgt"), ((F.col("p") + F.col("s")) % n).alias("place"))
    ends = ln.select(F.explode(F.array(name("S", "s"), name("P", "p"))).alias("name"), F.col("o").alias("pos"))
    mentions = ends.distinct().withColumn("chunk_id", F.concat(F.lit("o"), F.col("pos").cast("string")))
    return end("S", "s", 0).union(end("P", "p", 1)), pairs, mentions, vec


def graph(spark, sf):
    entities, relations, mentions, vec = places(spark, sf)
    return entities.join(vec, "place").drop("place"), relations.join(vec, "place").drop("place"), mentions


@query("g09_adjacency", f"WITH {GRAPH}, a AS (SELECT id, src AS name, src || '/' || tgt AS key FROM rels UNION ALL SELECT id, tgt, src || '/' || tgt FROM rels) SELECT name, string_agg(key, ',' ORDER BY id) AS keys FROM a GROUP BY name")
def g09(spark, sf):
    _, relations, _ = graph(spark, sf)
    return K.adjacency(relations.withColumnRenamed("id", "pos")).select("name", F.replace(F.array_join("keys", ","), F.lit(K.NUL), F.lit("/")).alias("keys"))


@query("g10_source_chunks", f"WITH {GRAPH} SELECT name, string_agg(chunk_id, ',' ORDER BY pos) AS chunks FROM ment GROUP BY name")
def g10(spark, sf):
    return K.source_chunks(graph(spark, sf)[2]).select("name", F.array_join("chunks", ",").alias("chunks"))


@query("g11_fixed_volume", f"WITH {GRAPH}, o AS (SELECT name, chunk_id, row_number() OVER (PARTITION BY name ORDER BY pos) AS n, count(*) OVER (PARTITION BY name) AS c FROM ment) SELECT name, string_agg(chunk_id, ',' ORDER BY n) || repeat(',', greatest(20 - max(c), 0)::INT) AS chunks, least(max(c), 20) AS real FROM o WHERE n <= 20 GROUP BY name")
def g11(spark, sf):
    rows = K.fixed_volume(K.source_chunks(graph(spark, sf)[2]), "chunks", 20, 64)
    return rows.select("name", F.array_join("chunks", ",").alias("chunks"), F.col("real").cast("long").alias("real"))


INNER, OUTER = (bytes(x ^ pad for x in b"secret".ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))  # the pads of HMAC for SHA-256


@query("g12_pseudonyms", f"SELECT s_name, sha256(unhex('{OUTER}' || sha256(unhex('{INNER}' || hex(encode('entities')) || '00' || hex(encode(s_name)))))) AS pseudonym FROM supplier")
def g12(spark, sf):
    names = table(spark, sf, "supplier").select("s_name")
    return names.select("s_name", S.pseudonym(F.col("s_name"), "entities", b"secret").alias("pseudonym"))


@query("g13_encrypt_texts", "SELECT doc_id, text FROM documents")
def g13(spark, sf):
    key = b"0123456789abcdef"
    sealed = table(spark, sf, "documents").select("doc_id", S.encrypted(F.col("text"), key, F.col("doc_id").cast("string")).alias("sealed"))
    return sealed.select("doc_id", S.decrypted(F.col("sealed"), key).alias("text"))


HITS = f"{X.E_SQL}, {GRAPH}, hits AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM (SELECT q.vec_id AS query_id, n.id, n.name, {X.unit_score('q.v', 'c.v')} AS score FROM e q JOIN ents n ON q.vec_id % {X.EVERY} = 0 JOIN e c ON c.vec_id = n.place))"


@query("g14_entity_topk", f"WITH {HITS} SELECT query_id, rank, name FROM hits WHERE rank < 5")
def g14(spark, sf):
    entities, _, _ = graph(spark, sf)
    return nearest(X.queries(spark, sf), entities, 5).join(entities.select("id", "name"), "id").select("query_id", "rank", "name")


def asked(spark, sf):
    return X.queries(spark, sf).select("query_id", F.col("vector").alias("low"), F.reverse("vector").alias("high"))


LOCAL = f"{HITS}, nm AS (SELECT query_id, name, rank AS pos FROM hits WHERE rank < 5)"
HYBRID = f"""{HITS}, near AS (SELECT query_id, src, tgt, rank FROM (SELECT query_id, src, tgt, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM
 (SELECT q.query_id, r.id, r.src, r.tgt, {X.unit_score('q.v', 'c.v')} AS score FROM (SELECT vec_id AS query_id, list_reverse(v) AS v FROM e WHERE vec_id % {X.EVERY} = 0) q, rels r JOIN e c ON c.vec_id = r.place)) WHERE rank < 5),
 nm AS (SELECT query_id, name, min(pos) AS pos FROM (SELECT query_id, name, rank AS pos FROM hits WHERE rank < 5 UNION ALL SELECT query_id, src, 1000000 + 2 * rank FROM near UNION ALL SELECT query_id, tgt, 1000001 + 2 * rank FROM near) GROUP BY ALL)"""
ANSWER = """kk AS (SELECT nm.query_id, r.src || '/' || r.tgt AS value, min([1, nm.pos, r.id]) AS pos FROM nm JOIN rels r ON nm.name IN (r.src, r.tgt) GROUP BY ALL{more}),
 kg AS (SELECT query_id, value, min(pos) AS pos FROM kk GROUP BY ALL),
 ch AS (SELECT nm.query_id, m.chunk_id AS value, min(nm.pos * 2 + m.n) AS pos FROM nm JOIN (SELECT name, chunk_id, row_number() OVER (PARTITION BY name ORDER BY pos) - 1 AS n FROM ment) m ON m.name = nm.name AND m.n < 2 GROUP BY ALL),
 found AS (SELECT query_id, 'entity' AS part, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS pos, name AS value FROM nm UNION ALL SELECT query_id, 'relation', row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1, value FROM kg UNION ALL SELECT query_id, 'chunk', row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1, value FROM ch)"""
LOCAL_SQL = f"WITH {LOCAL}, {ANSWER.format(more='')}"
HYBRID_SQL = f"WITH {HYBRID}, {ANSWER.format(more=''' UNION ALL SELECT query_id, src || '/' || tgt, [0, rank, 0] FROM near''')}"


def found(spark, sf, mode):
    entities, relations, mentions, vectors = places(spark, sf)
    return K.graph_query(asked(spark, sf), entities, relations, mentions, mode, vectors=vectors)


def shown(rows):
    return rows.select("query_id", "part", F.col("pos").cast("long").alias("pos"), F.replace("value", F.lit(K.NUL), F.lit("/")).alias("value"))


@query("g15_local_query", f"{LOCAL_SQL} SELECT * FROM found")
def g15(spark, sf):
    return shown(found(spark, sf, "local"))


@query("g16_hybrid_query", f"{HYBRID_SQL} SELECT * FROM found")
def g16(spark, sf):
    return shown(found(spark, sf, "hybrid"))


@query("g17_batch_query", f"{LOCAL_SQL} SELECT query_id, part, count(*) AS n FROM found GROUP BY ALL")
def g17(spark, sf):
    return found(spark, sf, "local").groupBy("query_id", "part").agg(F.count(F.lit(1)).alias("n"))


@query("g18_ordered_dedup", "WITH s AS (SELECT o_custkey, o_orderpriority AS v, o_orderkey AS pos FROM orders) SELECT o_custkey, v, min(pos) AS pos FROM s GROUP BY ALL")
def g18(spark, sf):
    from lodestone.operators.lookups import first_seen

    rows = table(spark, sf, "orders").select("o_custkey", F.col("o_orderpriority").alias("v"), F.col("o_orderkey").alias("pos"))
    return first_seen(rows, ["o_custkey"], "v", "pos")


@query("g19_context", f"{LOCAL_SQL}, s AS (SELECT query_id, string_agg(value, chr(10) ORDER BY pos) FILTER (part = 'entity') AS a, string_agg(replace(value, '/', ' -- '), chr(10) ORDER BY pos) FILTER (part = 'relation') AS b, string_agg('text of ' || value, chr(10) ORDER BY pos) FILTER (part = 'chunk') AS c FROM found GROUP BY 1) SELECT query_id, '# Entities' || chr(10) || a || chr(10) || '# Relations' || chr(10) || b || chr(10) || '# Source chunks' || chr(10) || c AS context FROM s")
def g19(spark, sf):
    texts = graph(spark, sf)[2].select("chunk_id").distinct().withColumn("text", F.concat(F.lit("text of "), "chunk_id"))
    return K.context_text(found(spark, sf, "local"), texts)


@query("g20_synthetic_graph", "WITH n AS (SELECT count(*) AS n FROM customer), r AS (SELECT range AS id FROM range((SELECT ceil(0.33 * n)::BIGINT FROM n))), x AS (SELECT id, id * 7 % n AS a, (id * 11 + 5) % n AS b FROM r, n) SELECT id, 'entity-' || lpad(a::VARCHAR, 6, '0') AS src, 'entity-' || lpad(b::VARCHAR, 6, '0') AS tgt FROM x WHERE a <> b")
def g20(spark, sf):
    return K.synthetic_graph(spark, table(spark, sf, "customer").count())[2]


@query("g21_counts", f"WITH {GRAPH} SELECT (SELECT count(DISTINCT chunk_id) FROM ment) AS chunks, (SELECT count(*) FROM ents) AS entities, (SELECT count(*) FROM rels) AS relations")
def g21(spark, sf):
    entities, relations, mentions = graph(spark, sf)
    return K.graph_counts(mentions.select("chunk_id").distinct(), entities, relations)


def _hmac(message: str) -> str:
    """SQL: HMAC with the key of these fixtures of a message given in hexadecimal."""
    return f"sha256(unhex('{OUTER}' || sha256(unhex('{INNER}' || {message}))))"


def _numbers(tag: str, count: int) -> str:
    """SQL: the first ``count`` numbers that follow from a tag."""
    blocks = f"array_to_string(list_transform(range({-(-count // 8)}), lambda n: sha256(unhex({tag} || lpad(to_hex(n), 2, '0') || '000000'))), '')"
    return f"(SELECT list_transform(range({count}), lambda i: ('0x' || substr(s, 8 * i + 7, 2) || substr(s, 8 * i + 5, 2) || substr(s, 8 * i + 3, 2) || substr(s, 8 * i + 1, 2))::BIGINT::DOUBLE) FROM (SELECT {blocks} AS s))"


NONCE = f"substr({_hmac('hex(encode(' + chr(39) + 'nonce|' + chr(39) + ' || vec_id))')}, 1, 32)"
NOISE_TAG = _hmac("hex(encode('noise|document|')) || nonce")
SHARE = "lambda i: sqrt(-2 * ln((m[2 * i + 1] + 0.5::DOUBLE) / 4294967296)) * cos(2 * pi() * (m[2 * i + 2] + 0.5::DOUBLE) / 4294967296)"
ROWS = "SELECT vec_id, unnest(range(len(w))) AS pos, unnest(w) AS x FROM t"


@query("v15_protect", f"WITH {X.E_SQL}, n AS (SELECT vec_id, v, {NONCE} AS nonce FROM e), g AS (SELECT vec_id, v, {NOISE_TAG} AS tag FROM n), k AS (SELECT vec_id, v, {_numbers('tag', 129)} AS m FROM g), u AS (SELECT vec_id, v, m, list_transform(range(64), {SHARE}) AS u FROM k), t AS (SELECT vec_id, list_transform(list_zip(v, u), lambda z: z[1] * 32 + z[2] / sqrt(list_dot_product(u, u)) * 1.8::DOUBLE * pow((m[129] + 0.5::DOUBLE) / 4294967296, 1 / 64.0::DOUBLE)) AS w FROM u), r AS ({ROWS}) SELECT vec_id, pos, {sql6('x')} AS x FROM r")
def v15(spark, sf):
    rows = S.protect(X.vectors(spark, sf).select("vec_id", "v"), "vec_id", "v", b"secret", "document")
    return rows.select("vec_id", F.posexplode("v").alias("pos", "x")).withColumn("x", r6("x"))


@query("v16_unprotect", f"WITH {X.E_SQL} SELECT vec_id, round(list_sum(v), 4) + 0.0 AS total FROM e")
def v16(spark, sf):
    from lodestone.functions.vectors import total

    rows = S.protect(X.vectors(spark, sf).select("vec_id", "v"), None, "v", b"secret", "document")
    return S.unprotect(rows, "v", b"secret", "document").select("vec_id", (F.round(total(F.col("v")), 4) + F.lit(0.0)).alias("total"))


INT16 = "array_to_string(list_transform(v, lambda x: lpad(to_hex(((round(greatest(least(x, 1.0), -1.0) * 32767)::INT & 255) << 8) | ((round(greatest(least(x, 1.0), -1.0) * 32767)::INT >> 8) & 255)), 4, '0')), '')"
SESSION_TAG = _hmac(f"hex(encode('ll')) || '00' || {INT16}")


@query("v17_session_noise", f"WITH {X.E_SQL}, g AS (SELECT vec_id, v, {SESSION_TAG} AS tag FROM e), u AS (SELECT vec_id, v, list_transform({_numbers('tag', 64)}, lambda n: n / 4294967295 * 2 - 1) AS u FROM g), m AS (SELECT vec_id, list_transform(list_zip(v, u), lambda z: z[1] + 0.02::DOUBLE * z[2] / sqrt(list_dot_product(u, u))) AS m FROM u), t AS (SELECT vec_id, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS w FROM m), r AS ({ROWS}) SELECT vec_id, pos, {sql6('x')} AS x FROM r")
def v17(spark, sf):
    rows = S.session_perturbed(X.vectors(spark, sf).select("vec_id", "v"), "v", b"secret", "ll")
    return rows.select("vec_id", F.posexplode("v").alias("pos", "x")).withColumn("x", r6("x"))

"""Knowledge graphs from tuple streams: parsing, merging, multimaps, local and hybrid queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.stored import stored
from lodestone.operators.corpus import extraction_prompt, generated, without_empty
from lodestone.operators.lookups import first_seen
from lodestone.operators.nearest import nearest, ranked

DONE, RECORD, FIELD = "<|COMPLETE|>", "##", "<|>"
# Pairs of quotes that may surround a field.
QUOTED = "(?s)^(?:\"(.*)\"|'(.*)'|\u201c(.*)\u201d)$"
NUMBER = "^[+-]?(?:[0-9]+\\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\\.[0-9]+(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"
NUL = "\u0000"


def _trimmed(value: Column) -> Column:
    return F.regexp_replace(value, "(?U)^\\s+|\\s+$", "")


def _bare(value: Column) -> Column:
    """Trimmed and, if one pair of quotes surrounds it, without these."""
    return _trimmed(F.regexp_replace(_trimmed(value), QUOTED, "$1$2$3"))


def records(outputs: DataFrame, chunk: str = "chunk_id", raw: str = "raw") -> DataFrame:
    """(chunk, pos, body, ok) of the records before the completion marker; ok says that outer parentheses are there."""
    text = F.substring_index(raw, DONE, 1)
    rows = outputs.select(chunk, F.posexplode(F.split(text, RECORD)).alias("pos", "record")).withColumn("record", _trimmed(F.col("record")))
    rows = rows.where("record <> ''")
    ok = F.startswith("record", F.lit("(")) & F.endswith("record", F.lit(")"))
    return rows.select(chunk, "pos", F.when(ok, F.substring("record", F.lit(2), F.length("record") - 2)).alias("body"), ok.alias("ok"))


def extracted(chunks: DataFrame, kinds: list[str], generate, chunk: str = "chunk_id", text: str = "text") -> DataFrame:
    """(chunk, raw): what ``generate``, a function from a column of prompts to one of texts, says of each chunk with text."""
    rows = without_empty(chunks, text)[0].select(chunk, extraction_prompt(F.col(text), kinds).alias("prompt"))
    return generated(rows, generate).select(chunk, "raw")


def parsed(outputs: DataFrame, chunk: str = "chunk_id", raw: str = "raw") -> DataFrame:
    """Every record with its kind: entity, relationship or malformed, and its fields (null where they do not apply).

    An entity needs a name, a type and a description; what follows belongs to the description, which
    then keeps field marks and quotes.  A relationship needs both ends, a description, keywords and a
    number as strength; what follows is ignored.
    """
    rows = records(outputs, chunk, raw).withColumn("f", F.split("body", "<\\|>"))
    field = lambda i: F.get("f", F.lit(i))
    n = F.size("f")
    # one-element explodes keep Catalyst from copying the fields' expressions into each use of them
    read = F.struct(
        *[_bare(field(i)).alias(name) for i, name in enumerate(("kind", "one", "two", "three", "four", "five"))],
        _trimmed(F.array_join(F.slice("f", F.lit(4), F.greatest(n - 3, F.lit(0))), FIELD)).alias("rest"), n.alias("n"),
    )
    rows = rows.select(chunk, "pos", "ok", F.explode(F.array(read)).alias("r"))
    strength = F.when(F.rlike("r.five", F.lit(NUMBER)), F.col("r.five").try_cast("double"))
    entity = F.col("ok") & (F.col("r.kind") == "entity") & (F.col("r.n") >= 4) & (F.col("r.one") != "")
    relation = F.col("ok") & (F.col("r.kind") == "relationship") & (F.col("r.n") >= 6) & (F.col("r.one") != "") & (F.col("r.two") != "") & strength.isNotNull()
    what = F.when(F.coalesce(entity, F.lit(False)), "entity").when(F.coalesce(relation, F.lit(False)), "relationship").otherwise("malformed")
    rows = rows.select(chunk, "pos", "r", F.explode(F.array(what)).alias("kind"))
    own = lambda kind, value: F.when(F.col("kind") == kind, value)
    about = F.when(F.col("r.n") == 4, F.col("r.three")).otherwise(F.col("r.rest"))
    return rows.select(
        chunk, "pos", "kind", F.when(F.col("kind") != "malformed", F.col("r.one")).alias("name"), own("entity", F.col("r.two")).alias("type"), own("relationship", F.col("r.two")).alias("target"),
        F.coalesce(own("entity", about), own("relationship", F.col("r.three"))).alias("description"), own("relationship", F.col("r.four")).alias("keywords"), own("relationship", strength).alias("strength"),
    )


def trailers(outputs: DataFrame, chunk: str = "chunk_id", raw: str = "raw") -> DataFrame:
    """(chunk, saw_completion, malformed)."""
    bad = parsed(outputs, chunk, raw).groupBy(chunk).agg(F.sum((F.col("kind") == "malformed").cast("int")).alias("malformed"))
    return outputs.select(chunk, F.contains(raw, F.lit(DONE)).alias("saw_completion")).join(bad, chunk, "left").select(chunk, "saw_completion", F.coalesce("malformed", F.lit(0)).alias("malformed"))


def _merged(drafts: DataFrame, by: list[str]) -> DataFrame:
    """Descriptions in order, each added on a line unless empty or contained in what is there; chunks in first-seen order."""
    seen = F.sort_array(F.collect_list(F.struct("chunk_pos", "pos", "chunk_id", F.coalesce("description", F.lit("")).alias("description"))))
    lists = drafts.groupBy(*by).agg(seen.alias("s"))
    add = lambda acc, x: F.when((x["description"] == "") | F.contains(acc, x["description"]), acc).when(acc == "", x["description"]).otherwise(F.concat(acc, F.lit("\n"), x["description"]))
    text = F.aggregate("s", F.lit(""), add)
    first = F.get("s", F.lit(0))
    return lists.select(*by, text.alias("description"), F.array_distinct(F.transform("s", lambda x: x["chunk_id"])).alias("source_chunks"), first["chunk_pos"].alias("first_chunk"), first["pos"].alias("first_pos"))


def merge_entities(drafts: DataFrame) -> DataFrame:
    """(name, description, source_chunks, ...) of drafts (chunk_id, chunk_pos, pos, name, description)."""
    return _merged(drafts, ["name"])


def merge_relations(drafts: DataFrame) -> DataFrame:
    """(src, tgt, ...) with the ends in order; drafts have name and target."""
    ends = drafts.withColumns({"src": F.least("name", "target"), "tgt": F.greatest("name", "target")})
    return _merged(ends, ["src", "tgt"])


def without_dangling(relations: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations whose ends both exist, one row with the number of the others)."""
    names = entities.select("name")
    kept = relations.join(names.withColumnRenamed("name", "src"), "src", "left_semi").join(names.withColumnRenamed("name", "tgt"), "tgt", "left_semi")
    total, good = relations.agg(F.count(F.lit(1)).alias("a")), kept.agg(F.count(F.lit(1)).alias("b"))
    return kept, total.join(good).select((F.col("a") - F.col("b")).alias("dangling"))


def entity_text(name: Column, description: Column) -> Column:
    return F.concat(name, F.lit(": "), description)


def relation_text(src: Column, tgt: Column, description: Column) -> Column:
    return F.concat(src, F.lit(" -> "), tgt, F.lit(": "), description)


def chunk_counts(outputs: DataFrame, chunk: str = "chunk_id", raw: str = "raw") -> DataFrame:
    """(chunk, empty, truncated, malformed, entities, relations) of each output; an output of white space of any kind is empty and is not read."""
    per = parsed(outputs.where(_trimmed(F.col(raw)) != ""), chunk, raw).groupBy(chunk).agg(*[F.sum((F.col("kind") == k).cast("long")).alias(n) for k, n in (("malformed", "malformed"), ("entity", "entities"), ("relationship", "relations"))])
    empty = _trimmed(F.coalesce(raw, F.lit(""))) == ""
    rows = outputs.select(chunk, empty.alias("empty"), (~empty & ~F.contains(F.coalesce(raw, F.lit("")), F.lit(DONE))).alias("truncated"))
    return rows.join(per, chunk, "left").select(chunk, "empty", "truncated", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("malformed", "entities", "relations")])


def extraction_report(outputs: DataFrame, chunk: str = "chunk_id", raw: str = "raw") -> DataFrame:
    """One row of counters: processed, skipped_empty, truncated, malformed, entities, relations, dangling.

    ``dangling`` are merged relations of which an end is no merged entity.
    """
    per = chunk_counts(outputs, chunk, raw)
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    counts = per.agg(F.sum((~F.col("empty")).cast("long")).alias("processed"), n("empty").alias("skipped_empty"), n("truncated").alias("truncated"), n("malformed").alias("malformed"), n("entities").alias("entities"), n("relations").alias("relations"))
    drafts = stored(parsed(outputs.where(_trimmed(F.col(raw)) != ""), chunk, raw).where("kind <> 'malformed'").select("kind", "name", "target"), "drafts")
    ends = drafts.where("kind = 'relationship'").select(F.least("name", "target").alias("src"), F.greatest("name", "target").alias("tgt")).distinct()
    _, dangling = without_dangling(ends, drafts.where("kind = 'entity'").select("name").distinct())
    return counts.join(F.broadcast(dangling))


def relation_key(src: Column, tgt: Column) -> Column:
    return F.concat(F.least(src, tgt), F.lit(NUL), F.greatest(src, tgt))


def last_ids(rows: DataFrame, name: str, position: str) -> DataFrame:
    """(name, id): the largest position of each name, positions being dense from 0."""
    return rows.groupBy(name).agg(F.max(position).alias("id"))


def adjacency(relations: DataFrame) -> DataFrame:
    """(name, keys): relation keys of each end in relation order; a self-loop counts once.  ``relations`` is (pos, src, tgt)."""
    ends = relations.select("pos", relation_key(F.col("src"), F.col("tgt")).alias("key"), F.explode(F.array_distinct(F.array("src", "tgt"))).alias("name"))
    return ends.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "key"))), lambda s: s["key"]).alias("keys"))


def source_chunks(mentions: DataFrame) -> DataFrame:
    """(name, chunks) of mentions (name, pos, chunk_id), in order."""
    return mentions.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "chunk_id"))), lambda s: s["chunk_id"]).alias("chunks"))


def fixed_volume(multimap: DataFrame, values: str, bound: int, max_bytes: int) -> DataFrame:
    """Lists of exactly ``bound`` values, cut or padded with empty ones, and their real count; a value over ``max_bytes`` is an error."""
    checked = F.transform(values, lambda v: F.when(F.octet_length(v) > max_bytes, F.raise_error(F.concat(F.lit("value over the byte budget: "), F.substring(v, 1, 40))).cast("string")).otherwise(v))
    cut = F.slice(checked, 1, bound)
    return multimap.withColumn("real", F.least(F.size(values), F.lit(bound))).withColumn(values, F.concat(cut, F.array_repeat(F.lit(""), F.greatest(F.lit(bound) - F.size(values), F.lit(0)))))


def graph_counts(chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    return one(chunks, "chunks").join(one(entities, "entities")).join(one(relations, "relations"))


def nearest_placed(queries: DataFrame, rows: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """:func:`nearest` for (id, place) rows that share the vectors of (place, vector): each vector is searched once.

    A place stands for its smallest id, so the k first places hold the k first rows; of each place at most k rows follow.
    """
    first = rows.groupBy("place").agg(F.min("id").alias("id"))
    hits = nearest(queries, vectors.join(first, "place").select("id", "vector"), k)
    few = ranked(rows.select("place", "id"), ["place"], ["id"], k)
    here = few.where("rank = 0").select("place", F.col("id").alias("first"))
    full = hits.select("query_id", F.col("id").alias("first"), "score").join(here, "first").join(few.select("place", "id"), "place")
    return ranked(full, ["query_id"], [F.desc("score"), "id"], k).select("query_id", "rank", "id", "score")


def graph_query(queries: DataFrame, entities: DataFrame, relations: DataFrame, mentions: DataFrame, mode: str = "local", k_entities: int = 5, k_relations: int = 5, k_chunks: int = 2, vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, part, pos, value): names, relation keys and chunk ids that answer each query, in order.

    ``queries`` is (query_id, low, high), ``entities`` (id, name, vector), ``relations`` (id, src, tgt,
    vector), ``mentions`` (name, pos, chunk_id).  Local: nearest entities, then the keys of relations
    at them in order, then their first chunks.  Hybrid: nearest relations come first among the keys
    and their ends follow the entities.  Values are distinct, where seen first; chunks are cut by
    entity before that.  With ``vectors`` (place, vector) entities and relations have a place instead of a
    vector, which may be that of many.
    """
    if mode not in ("local", "hybrid"):
        raise ValueError(f"unknown mode {mode}")
    place = lambda *parts: F.array(*[(F.lit(p) if isinstance(p, int) else F.col(p)).cast("long") for p in parts])  # noqa: E731 - arrays compare part by part
    seen = lambda kind, value, pos: F.struct(F.lit(kind).alias("kind"), value.alias("value"), pos.alias("pos"))
    at = "vector" if vectors is None else "place"
    search = nearest if vectors is None else lambda q, rows, k: nearest_placed(q, rows, vectors, k)
    entities = stored(entities.select("id", "name", at), "entities")  # searched, counted and looked up
    hits = search(queries.select("query_id", F.col("low").alias("vector")), entities.select("id", at), k_entities)
    stream = hits.join(entities.select("id", "name"), "id").select("query_id", seen("name", F.col("name"), place(0, "rank")).alias("s"))
    if mode == "hybrid":
        relations = stored(relations.select("id", "src", "tgt", at), "relations")
        near = search(queries.select("query_id", F.col("high").alias("vector")), relations.select("id", at), k_relations).join(relations.select("id", "src", "tgt"), "id")
        own = [seen("name", F.col("src"), place(1, "rank", 0)), seen("name", F.col("tgt"), place(1, "rank", 1)), seen("relation", relation_key(F.col("src"), F.col("tgt")), place(0, "rank"))]
        stream = stream.union(near.select("query_id", F.explode(F.array(*own))))
    stream = first_seen(stream.select("query_id", "s.*"), ["query_id", "kind"], "value", "pos")
    # A name is an entity of the answer and also looks up its relations and chunks; the rest passes the lookup unmatched.
    kinds = F.when(F.col("kind") == "name", F.array(F.lit("entity"), F.lit("name"))).otherwise(F.array("kind"))
    asked = stored(stream.select("query_id", F.explode(kinds).alias("kind"), F.col("value").alias("name"), "pos"), "asked")
    names = asked.where("kind = 'name'").select("name").distinct()  # only what they name is ranked or carried on
    keys = relations.select(F.explode(F.array_distinct(F.array("src", "tgt"))).alias("name"), F.lit("relation").alias("part"), relation_key(F.col("src"), F.col("tgt")).alias("value"), F.col("id").cast("long").alias("nth"))
    chunks = ranked(mentions.join(names, "name", "left_semi"), ["name"], ["pos"], k_chunks, "nth").select("name", F.lit("chunk").alias("part"), F.col("chunk_id").alias("value"), F.col("nth").cast("long").alias("nth"))
    table = keys.join(names, "name", "left_semi").unionByName(chunks).withColumn("kind", F.lit("name"))
    found = asked.join(table, ["kind", "name"], "left").where("kind <> 'name' OR value IS NOT NULL")
    after = F.concat("pos", F.array("nth"))
    pos = F.when(F.col("part") == "relation", F.concat(F.array(F.lit(1).cast("long")), after)).when(F.col("part") == "chunk", after).otherwise(F.col("pos"))
    out = first_seen(found.select("query_id", F.coalesce("part", "kind").alias("part"), F.coalesce("value", "name").alias("value"), pos.alias("pos")), ["query_id", "part"], "value", "pos")
    return ranked(out, ["query_id", "part"], ["pos"], rank="place").select("query_id", "part", F.col("place").alias("pos"), "value")


def context_text(found: DataFrame, chunk_texts: DataFrame) -> DataFrame:
    """(query_id, context): entities, relations and source chunks of :func:`graph_query` under headings, in that order."""
    texts = found.where("part = 'chunk'").join(chunk_texts.select(F.col("chunk_id").alias("value"), "text"), "value").select("query_id", "part", "pos", F.col("text").alias("value"))
    rows = found.where("part <> 'chunk'").withColumn("value", F.replace("value", F.lit(NUL), F.lit(" -- "))).unionByName(texts)
    section = lambda part: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct("pos", "value")))), lambda s: s["value"]), "\n")
    return rows.groupBy("query_id").agg(F.concat(F.lit("# Entities\n"), section("entity"), F.lit("\n# Relations\n"), section("relation"), F.lit("\n# Source chunks\n"), section("chunk")).alias("context"))


def synthetic_graph(spark, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, entities, relations) of n, ceil(1.5 n) chunks and ceil(0.33 n) relations by modular rules; no self relations."""
    chunks_n, relations_n = -(-3 * n // 2), -(-33 * n // 100)
    chunks = spark.range(chunks_n).select(F.format_string("chunk-%06d", F.col("id")).alias("chunk_id"), F.concat(F.lit("text of chunk "), "id").alias("text"))
    where = lambda add: F.format_string("chunk-%06d", (F.col("id") * 3 + add) % chunks_n)
    entities = spark.range(n).select("id", F.format_string("entity-%06d", F.col("id")).alias("name"), F.array(where(0), where(1)).alias("source_chunks"))
    ends = spark.range(relations_n).select("id", (F.col("id") * 7 % n).alias("a"), ((F.col("id") * 11 + 5) % n).alias("b")).where("a <> b")
    relations = ends.select("id", F.format_string("entity-%06d", F.col("a")).alias("src"), F.format_string("entity-%06d", F.col("b")).alias("tgt"))
    return chunks, entities, relations

"""WARC derivatives: metadata and plain-text conversion records of response records.

A record is a row (record_type, record_id, refers_to, target_uri, warc_date, content_type,
content_length, payload_digest, block_digest, block).  Derived records refer to their response,
keep its URI and date, and the metadata record lists the source's headers and digests.
"""

from __future__ import annotations

import html.entities
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import let

VERSION = "WARC/1.1"
END = "\r\n\r\n"
# The named references of HTML 4 with their code points, from the standard library, and one more of XML.
ENTITIES = {**html.entities.name2codepoint, "apos": 39}
BREAKS = "(?i)<(?:/p|/div|/li|/h[1-6]|/tr|/title|/article|/nav|/footer|/header|/section|/table|/ul|/ol|br|hr)\\b[^>]*>"


def text_id(*parts: Column) -> Column:
    """A urn:uuid made of the MD5 of ``parts``: the same input gives the same record."""
    digest = F.md5(F.concat_ws("\n", *parts))
    return F.concat(F.lit("<urn:uuid:"), *[F.concat(F.substring(digest, at, n), F.lit(mark)) for at, n, mark in ((1, 8, "-"), (9, 4, "-"), (13, 4, "-"), (17, 4, "-"), (21, 12, ">"))])


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


LONGEST = 33  # characters of the longest reference that is looked at, with its semicolon


def decoded(text: Column) -> Column:
    """``text`` with named and numeric character references resolved, once; a no-break space becomes a blank.

    What names no character stays as it is.
    """
    names = F.create_map(*[F.lit(x) for name, point in ENTITIES.items() for x in (name, chr(point))])

    def number(name: Column) -> Column:
        code = F.when(name.rlike("^#[0-9]{1,7}$"), F.substring(name, 2, 7)).when(name.rlike("^#[xX][0-9a-fA-F]{1,6}$"), F.conv(F.substring(name, 3, 6), 16, 10))
        return let(code.try_cast("int"), lambda c: F.when((c > 0) & (c < 0x110000) & ~c.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")))

    def resolved(part: Column) -> Column:
        def char(name: Column) -> Column:
            return F.when(F.startswith(name, F.lit("#")), number(name)).otherwise(F.element_at(names, name))

        def put(name: Column) -> Column:
            ended = F.substr(part, F.length(name) + 1, F.lit(1)) == ";"
            return let(F.when(ended, char(name)), lambda c: F.coalesce(F.concat(c, F.substr(part, F.length(name) + 2)), F.concat(F.lit("&"), part)))

        return let(F.substring_index(F.substring(part, 1, LONGEST), ";", 1), put)

    def joined(parts: Column) -> Column:
        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), resolved), ""))

    return F.replace(let(text, lambda t: F.when(F.contains(t, F.lit("&")), let(F.split(t, "&"), joined)).otherwise(t)), F.lit("\u00a0"), F.lit(" "))


def plain_text(html: Column) -> Column:
    """Text of a page: no comments, scripts, styles or tags; a line for each block; blanks collapsed."""
    text = F.regexp_replace(html, "(?is)<!--.*?-->", " ")
    text = F.regexp_replace(text, "(?is)<script\\b.*?</script\\s*>", " ")
    text = F.regexp_replace(text, "(?is)<style\\b.*?</style\\s*>", " ")
    text = F.regexp_replace(text, "[ \\t\\r\\n]+", " ")
    text = F.regexp_replace(text, BREAKS, "\n")
    text = decoded(F.regexp_replace(text, "<[^>]*>", ""))
    text = F.regexp_replace(text, " +", " ")
    text = F.regexp_replace(text, " ?\n[ \n]*", "\n")
    return F.regexp_replace(text, "^[ \n]+|[ \n]+$", "")


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of fetched pages: an HTTP header and the page.  Null URLs and pages count as empty."""
    uri, body = F.coalesce(F.col(url).cast("string"), F.lit("")), F.coalesce(F.col(html).cast("string"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END))
    block = F.concat(head, body)
    return pages.select(
        F.col(key), F.lit("response").alias("record_type"), text_id(F.lit("response"), F.coalesce(F.col(key).cast("string"), F.lit("")), uri).alias("record_id"), F.lit(None).cast("string").alias("refers_to"),
        uri.alias("target_uri"), F.lit(date).alias("warc_date"), F.lit("application/http; msgtype=response").alias("content_type"), F.octet_length(block).cast("long").alias("content_length"),
        digest(body).alias("payload_digest"), digest(block).alias("block_digest"), block.alias("block"),
    )


def derivatives(records: DataFrame) -> DataFrame:
    """One metadata and one conversion record for each response of ``records``; other records give none.

    Columns that ``records`` has besides those of a record are kept.  The HTTP header ends at the first
    empty line; a block without one is all body.  Repeated responses give repeated records.
    """
    fields = ["record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "content_length", "payload_digest", "block_digest", "block"]
    more = [c for c in records.columns if c not in fields]
    response = records.where("record_type = 'response'").select(F.struct(*more).alias("more") if more else F.lit(None).alias("more"), *[F.col(c) for c in fields])
    source = response.withColumn("cut", F.instr(F.col("block"), END))  # no column of ``more`` is beside these
    source = source.withColumns({
        "head": F.when(F.col("cut") > 0, F.expr("substring(block, 1, cut - 1)")).otherwise(""), "body": F.when(F.col("cut") > 0, F.expr("substring(block, cut + 4)")).otherwise(F.col("block")),
    })
    links = F.regexp_extract_all("body", F.lit('(?i)<a\\s[^>]*href="([^"]*)"'), F.lit(1))
    title = F.trim(decoded(F.regexp_replace(F.regexp_extract("body", "(?is)<title[^>]*>(.*?)</title", 1), "[ \\t\\r\\n]+", " ")))
    headers = F.array_join(F.transform(F.slice(F.split("head", "\r\n"), F.lit(2), F.size(F.split("head", "\r\n"))), lambda h: F.concat(F.lit("source-header: "), h)), "\r\n")
    lines = F.concat(
        F.lit("source-payload-digest: "), F.col("payload_digest"), F.lit("\r\nsource-block-digest: "), F.col("block_digest"), F.lit("\r\n"), headers,
        F.lit("\r\ntitle: "), title, F.lit("\r\nlanguage: "), F.regexp_extract("body", '(?i)<html[^>]*\\slang="([^"]*)"', 1),
        F.array_join(F.transform(links, lambda x: F.concat(F.lit("\r\noutlink: "), x)), ""), F.lit("\r\n"),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("t"), F.lit("application/warc-fields").alias("c"), lines.alias("b")),
        F.struct(F.lit("conversion").alias("t"), F.lit("text/plain; charset=utf-8").alias("c"), plain_text(F.col("body")).alias("b")),
    )
    both = source.withColumn("made", F.explode(kinds))
    return both.select(
        *[F.col("more")[c].alias(c) for c in more], F.col("made.t").alias("record_type"), text_id(F.col("made.t"), F.col("record_id")).alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "warc_date",
        F.col("made.c").alias("content_type"), F.octet_length("made.b").cast("long").alias("content_length"), F.col("payload_digest"), digest(F.col("made.b")).alias("block_digest"), F.col("made.b").alias("block"),
    )


def serialised(records: DataFrame) -> DataFrame:
    """``value``: each record as the text of a WARC file, without the two line ends behind it."""
    derived = F.col("record_type") != "response"
    optional = lambda name, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), F.col("record_id"), F.lit("\r\nWARC-Date: "), F.col("warc_date"), F.lit("\r\n"),
        optional("WARC-Target-URI", F.col("target_uri")), optional("WARC-Refers-To", F.col("refers_to")), F.lit("Content-Type: "), F.col("content_type"),
        F.lit("\r\n"), F.when(derived, F.lit("")).otherwise(optional("WARC-Payload-Digest", F.col("payload_digest"))), optional("WARC-Block-Digest", F.col("block_digest")),
        F.lit("Content-Length: "), F.col("content_length").cast("string"), F.lit(END),
    )
    return records.select(F.concat(head, F.col("block")).alias("value"))


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write records as WARC files, one for each partition."""
    serialised(records).write.option("lineSep", END).option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, by their Content-Length, so that blocks may hold anything.

    Files compressed with gzip, as a whole or record by record, are unpacked.  A record without a
    readable length has an empty block, one without a type a null type.  One task reads a file.
    """
    schema = "record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, payload_digest string, block_digest string, block string"
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    wire = dict(zip(["warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "content-type", "content-length", "warc-payload-digest", "warc-block-digest"], names, strict=False))

    def unpacked(raw: bytes) -> bytes:
        out = []
        while raw[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            out += [member.decompress(raw), member.flush()]
            raw = member.unused_data
        return b"".join(out) or raw

    def parse(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                raw = unpacked(raw)
                rows, at = [], 0
                while (cut := raw.find(b"\r\n\r\n", at)) >= 0:
                    fields = dict.fromkeys(names)
                    for line in raw[at:cut].decode("utf-8", "replace").split("\r\n")[1:]:
                        name, _, value = line.partition(":")
                        if name.strip().lower() in wire:
                            fields[wire[name.strip().lower()]] = value.strip()
                    length = fields["content_length"] or ""
                    size = int(length) if length.isascii() and length.isdigit() else 0
                    fields |= {"content_length": size, "block": raw[cut + 4 : cut + 4 + size].decode("utf-8", "replace")}
                    rows.append(fields)
                    at = cut + 4 + size + 4
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, pa.int64() if n == "content_length" else pa.string()) for n in names]))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, schema)

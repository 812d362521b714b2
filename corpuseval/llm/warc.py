"""WARC archives: writing with revisits, segments and chunked framing, and exact reassembly.

Writing: each row is one record whose block is an HTTP response with chunked transfer framing.  Of records with
equal payloads the one with the largest id is stored as ``response``; the others become ``revisit`` records of
the identical-payload profile that refer to it.  A block longer than ``segment_chars`` is cut into a first record
and continuation records that name its id (WARC-Segment-Origin-ID) and their number; the last one states the
total length.

Reading: archives are streamed record by record; every Content-Length is verified.  Continuations are grouped by
origin, ordered by number, checked to be gapless and of the stated total length, and the chunked framing is
decoded.  The payload must have the digest that its header states; anything else raises.

Archives are text files (version line as the line separator), so any Hadoop file system serves, and files of any size are
streamed.  A compressed file is one gzip stream, not a member for each record, and holds no warcinfo record.  The framing is cut
inside every ``WARC/1.1`` of a payload, and control characters, white space and a final ``WARC/1.1`` of urls and ids are
percent-encoded, so that neither the separator nor a line break can occur where it does not belong, whatever a page holds.
Headers are read by exact line feeds and in any letter case; blocks must be UTF-8 text of WARC/1.1.

A null payload is empty, invalid UTF-8 is replaced by U+FFFD.  Rows with equal ids are records of their own; of equal payloads
with equal largest ids all are responses.  A null id counts as the smallest.  Empty tables give an empty archive and no
rows.  Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuseval.llm import _text
from corpuseval.llm._session import scratch, stored

VERSION = "WARC/1.1"
SEGMENT_CHARS = 32_768
CHUNK_CHARS = 16_384
_END = "\r\n\r\n"
#: Readers split files here: it does not overlap itself and stands nowhere inside a record.
_SEPARATOR = f"{VERSION}\r\n"
_HEADERS = ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Refers-To", "WARC-Segment-Number", "WARC-Segment-Origin-ID", "WARC-Segment-Total-Length", "Content-Length")


def base32_sha1(payload: F.Column) -> F.Column:
    """SHA-1 as bare upper-case base32: each 40 bits of the digest are eight base-32 digits."""
    digits = F.concat(*(F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)))
    return F.translate(F.upper(digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def chunked(payload: F.Column) -> F.Column:
    """The payload in chunked transfer framing; chunks are cut inside every version mark."""
    pieces = F.when(payload.contains(VERSION), F.split(payload, r"(?<=WARC)(?=/1\.1)")).otherwise(F.array(payload))
    chunks = F.flatten(F.transform(pieces, lambda p: F.regexp_extract_all(p, F.lit(f"(?s).{{1,{CHUNK_CHARS}}}+"), F.lit(0))))
    return F.concat(F.array_join(F.transform(chunks, lambda c: F.concat(F.hex(F.octet_length(c)), F.lit("\r\n"), c, F.lit("\r\n"))), ""), F.lit(f"0{_END}"))


def encoded(text: F.Column) -> F.Column:
    """A url or id whose control characters, white space and final version mark are percent-encoded."""
    hostile = r"[\p{Cntrl}\p{Z}\s\x{80}-\x{9F}]"
    each = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.when(c.rlike(hostile), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c))
    return F.regexp_replace(F.when(text.rlike(hostile), F.array_join(each, "")).otherwise(text), r"WARC/1\.1\z", "WARC/1.%31")


def _line(name: str, value: F.Column) -> F.Column:
    """A header line, or null, which concat_ws leaves out."""
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, segment_chars: int = SEGMENT_CHARS, date: F.Column | None = None) -> DataFrame:
    """One ``record`` string for each archive record, without the version line and the final blank lines.

    ``date`` is the UTC time of all records, the time of the query unless it is given.
    """
    date = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()) if date is None else date
    payload = F.make_valid_utf8(F.coalesce(F.col(payload_col).cast("string"), F.lit("")))
    rows = pages.select(F.col(id_col).alias("id"), encoded(F.coalesce(F.col(url_col).cast("string"), F.lit(""))).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload")))
    newest = rows.where(F.col("bytes") >= min_revisit_bytes).groupBy("digest").agg(F.max("id").alias("newest"), F.count("*").alias("n")).where(F.col("n") > 1)
    # Written first, so that its size is known: few repeated payloads are broadcast and pages are not shuffled for them.
    rows = rows.join(stored(newest.select("digest", "newest"), "repeated-payloads"), "digest", "left")
    revisit = F.col("newest").isNotNull() & (F.col("bytes") >= min_revisit_bytes) & ~F.col("id").eqNullSafe(F.col("newest"))
    text_id = dict(rows.dtypes)["id"] in ("string", "binary")
    name = lambda page, digest: F.concat(F.lit("<urn:page:"), F.coalesce(encoded(page.cast("string")) if text_id else page.cast("string"), F.lit("none")), F.lit(":"), digest, F.lit(">"))
    rows = rows.withColumn("revisit", revisit).withColumn("name", name(F.col("id"), F.col("digest")))
    head = F.when(F.col("revisit"), F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(_END)))
    body = F.concat(F.lit(f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked{_END}"), chunked(F.col("payload")))
    rows = rows.withColumn("whole", F.coalesce(head, body))
    rows = rows.withColumn("parts", F.when(F.length("whole") > segment_chars, F.regexp_extract_all("whole", F.lit(f"(?s).{{1,{segment_chars}}}+"), F.lit(0))).otherwise(F.array("whole")))
    rows = rows.withColumn("total", F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p)))
    cut = rows.withColumn("segments", F.size("parts")).select("*", F.posexplode("parts").alias("at", "part"))
    first, many = F.col("at") == 0, F.col("segments") > 1
    lines = F.concat_ws(
        "",
        _line("WARC-Type", F.when(~first, "continuation").when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.when(first, F.col("name")).otherwise(F.concat(F.expr("substr(name, 1, length(name) - 1)"), F.lit(":"), (F.col("at") + 1).cast("string"), F.lit(">")))),
        _line("WARC-Date", F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("digest")))),
        _line("WARC-Profile", F.when(first & F.col("revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("WARC-Refers-To", F.when(first & F.col("revisit"), name(F.col("newest"), F.col("digest")))),
        _line("WARC-Segment-Number", F.when(many, F.col("at") + 1)),
        _line("WARC-Segment-Origin-ID", F.when(~first, F.col("name"))),
        _line("WARC-Segment-Total-Length", F.when(many & (F.col("at") + 1 == F.col("segments")), F.col("total"))),
        _line("Content-Type", F.when(first, F.lit("application/http; msgtype=response"))),
        _line("Content-Length", F.octet_length("part")),
    )
    return cut.select(F.concat(lines, F.lit("\r\n"), F.col("part")).alias("record"))


def write_warc(found: DataFrame, path: str, compression: str = "gzip") -> None:
    """Archives of the ``record`` strings, one file for each task."""
    found.select(F.concat(F.lit(f"{VERSION}\r\n"), F.col("record"))).write.option("lineSep", _END).option("compression", compression).option("zlib.compress.level", "BEST_SPEED").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Header fields and ``block`` of every record, lengths verified."""
    raw = spark.read.option("lineSep", _SEPARATOR).text(path)
    raw = raw.where("value <> ''").withColumnRenamed("value", "record")
    head = F.substring_index("record", _END, 1)
    raw = raw.select(head.alias("head"), F.expr(f"substr(record, length(substring_index(record, '{_END}', 1)) + 5)").alias("block"))
    field = lambda k: F.nullif(F.regexp_extract("head", rf"(?mdi)^{k}: (.*?)\r?$", 1), F.lit(""))
    rows = raw.select(*(field(k).alias(k.lower().replace("-", "_")) for k in _HEADERS), "block")
    want, got = F.col("content_length").cast("long"), F.octet_length("block")
    whole = F.when((got == want + 4) & F.col("block").endswith(_END), F.expr("substr(block, 1, length(block) - 4)"))
    return rows.withColumn("block", F.coalesce(whole, F.raise_error(F.concat(F.lit("record of a wrong length: "), F.coalesce("warc_record_id", F.lit("?")))).cast("string")))


def reassemble(rows: DataFrame) -> DataFrame:
    """Each record's whole block: continuations joined to their origin by number, numbers and total length verified.

    Only records of several segments are shuffled; a group is the segments of one record.
    """
    single, cut = rows.where("warc_segment_number is null"), rows.where("warc_segment_number is not null")
    number = F.col("warc_segment_number").cast("int")
    cut = cut.withColumn("origin", F.coalesce("warc_segment_origin_id", "warc_record_id"))
    # Records that share an id have the same digest in it, so copies of a segment are equal; they are counted.
    parts = cut.groupBy("origin", number.alias("number")).agg(F.first("block").alias("block"), F.count("*").alias("copies"), F.max("warc_segment_total_length").alias("total"), *(F.max(c).alias(c) for c in ("warc_type", "warc_target_uri", "warc_payload_digest", "warc_refers_to")))
    whole = parts.groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"),
        F.max("total").cast("long").alias("total"),
        F.max("number").alias("last"),
        F.min("copies").alias("fewest"),
        F.max("copies").alias("copies"),
        *(F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in ("warc_type", "warc_target_uri", "warc_payload_digest", "warc_refers_to")),
    )
    block = F.array_join(F.transform("parts", lambda p: p["block"]), "")
    sound = (F.size("parts") == F.col("last")) & (F.col("fewest") == F.col("copies")) & F.octet_length(block).cast("long").eqNullSafe(F.col("total"))
    whole = whole.withColumn("block", F.when(sound, block).otherwise(F.raise_error(F.concat(F.lit("segments missing of "), "origin")).cast("string")))
    names = ["warc_type", "warc_record_id", "warc_target_uri", "warc_payload_digest", "warc_refers_to", "block"]
    whole = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).withColumnRenamed("origin", "warc_record_id")
    return single.select(*names).unionByName(whole.select(*names))


def dechunk(body: bytes) -> bytes:
    """Decoded chunked transfer framing; chunk extensions and trailers are skipped, truncation raises."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        at = end + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("chunk of a wrong length")
        parts.append(body[end + 2 : at])
        at += 2


def payloads(rows: DataFrame) -> DataFrame:
    """The rows with ``http_head`` and ``payload`` (binary; null for revisits) in place of ``block``."""
    kept = [c for c in rows.columns if c != "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in _text.spans(batch.column("block")):
                part = batch.slice(low, high - low)
                heads, bodies = [], []
                for kind, block in zip(part.column("warc_type").to_pylist(), part.column("block").to_pylist(), strict=True):
                    head, _, body = (block or "").partition(_END)
                    heads.append(head)
                    raw = body.encode()
                    bodies.append(None if kind == "revisit" else dechunk(raw) if "\r\ntransfer-encoding: chunked" in head.lower() else raw)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(heads, pa.string()), pa.array(bodies, pa.binary())], names=[*kept, "http_head", "payload"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{schema}, http_head string, payload binary")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``record_id``, ``url``, ``record_type``, ``payload`` (null for revisits), ``payload_bytes``, ``payload_digest``, ``refers_to``."""
    rows = payloads(reassemble(read_records(spark, path)))
    stated = F.regexp_replace("warc_payload_digest", "^sha1:", "")
    found = base32_sha1(F.col("payload"))
    revisit = F.col("warc_type") == "revisit"
    digest = F.when(revisit | (found == stated), stated).otherwise(F.raise_error(F.concat(F.lit("payload of another digest: "), "warc_record_id")).cast("string"))
    length = F.when(revisit, F.regexp_extract("http_head", r"(?i)\r\ncontent-length: (\d+)", 1).cast("long")).otherwise(F.octet_length("payload").cast("long"))
    return rows.select(F.col("warc_record_id").alias("record_id"), F.col("warc_target_uri").alias("url"), F.col("warc_type").alias("record_type"), "payload", length.alias("payload_bytes"), digest.alias("payload_digest"), F.col("warc_refers_to").alias("refers_to"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_warc(records(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    page = lambda c: F.expr(f"try_cast(split({c}, ':')[2] as bigint)")
    return read_warc(spark, path).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


#: Digests by arithmetic on the hexadecimal digits; the newest page of each payload is the response.
OP5_SQL = """
with pages_ as (select page_id, coalesce(html, '') as html from pages),
hashed as (select page_id, strlen(html) as payload_bytes, sha1(html) as h from pages_),
named as (
  select page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast((cast('0x' || substr(h, cast((k // 8) * 10 + 1 as integer), 10) as bigint) >> (35 - 5 * (k % 8))) & 31 as integer) + 1, 1)), '') as payload_digest
  from hashed),
newest as (select *, max(page_id) over (partition by payload_digest) as newest_id from named)
select page_id, payload_bytes, payload_digest, case when page_id = newest_id then 'response' else 'revisit' end as record_type,
  case when page_id <> newest_id then newest_id end as refers_to
from newest
"""

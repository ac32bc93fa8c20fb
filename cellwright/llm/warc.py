"""WARC archives through Spark's own text files, and a chunked record table.

Writing.  Every payload is cut into chunks of at most ``chunk`` code points: the
first is a ``response`` (or ``revisit``) record, the others are standard
``continuation`` records that name it (WARC-Segment-Origin-ID,
WARC-Segment-Number, WARC-Segment-Total-Length).  Ids are <urn:page:ID:CHUNK>,
with a random mark after the chunk number where there are several chunks, so
that repeated rows keep apart; a revisit names its page without the mark.  Each
record carries the digest of its own block, and each first record the digest of
the whole payload, which grows chunk by chunk.  A worker streams the chunks: it
holds a payload as its row gives it, and one chunk besides.  Spark's text writer
puts the records into files: it commits tasks, retries them and writes to any file
system.  The chunks of a payload follow each other in one file.

Reading.  Files are split at the line ``WARC/1.1``, so a task holds one record
at a time, however long the file.  A payload that has this text inside is cut
there on writing, so no record contains it.  The result is the chunk table
(record_id, chunk_no, content, ...).  ``payloads`` streams the chunks of a
task's files in order, feeds each to its record's incremental digest, and returns
a row per record: nothing is shuffled, and no payload is put together again.

Records of equal payloads of ``least`` bytes or more are written once: the one
with the largest id is the response, the others revisit it.

Nulls and empty texts: null payloads are empty; rows with a null id are responses,
their id stays null, and they are never revisited; a null url gives no header.
Very long payloads become many chunks.  Ties and repeats: repeated rows of the
largest id are all responses.  An empty table gives an empty archive and no rows.
Other columns of the pages are not archived, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import Scratch, arrow_map, sliced, table

VERSION = "WARC/1.1"
_LINE = "\r\n"
_BREAK = _LINE + VERSION + _LINE


def _bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """Rows to write: page_id, url, payload, payload_bytes, digest, refers_to."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1(_bytes(F.col("payload")))})
    named = rows.where(f"payload_bytes >= {least} and page_id is not null").select("page_id", "digest", "payload_bytes")
    first = named.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("to"), F.min("page_id").alias("from")).where("`from` < `to`").drop("from")
    again = named.join(first, ["digest", "payload_bytes"]).where("page_id < `to`")
    again = again.select("page_id", F.col("digest").alias("__digest"), F.col("to").alias("refers_to")).distinct()
    got = rows.join(again.withColumnRenamed("page_id", "__id"), (F.col("page_id") == F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    return got.select("page_id", "url", "payload", "payload_bytes", "digest", "refers_to")


def cuts(payload: str, chunk: int) -> list[tuple[int, int]]:
    """Where the payload's chunks are: at most so many code points each, none with the version text.

    The version text is cut in two wherever it occurs, so neither a chunk nor
    what stands around it on writing looks like a record's first line.
    """
    ends, at = [], payload.find(VERSION)
    while at >= 0:
        ends.append(at + 3)
        at = payload.find(VERSION, at + 3)
    out, begin = [], 0
    for end in [*ends, len(payload)]:
        out += [(a, min(a + chunk, end)) for a in range(begin, end, chunk)]
        begin = end
    return out or [(0, 0)]


_CUT = "page_id long, url string, payload_bytes long, digest string, refers_to long, mark string, count int, k int, content string"


def _streamed(rows: DataFrame, chunk: int) -> DataFrame:
    """The chunks of the rows: one of no content for a revisit."""
    names = [f.split()[0] for f in _CUT.split(", ")]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()], strict=True)))

    def run(batch: pa.RecordBatch):
        held, size = [], 0
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].as_py() for name in names[:5]}
            payload = "" if row["refers_to"] is not None else batch.column("payload")[k].as_py()
            places = cuts(payload, chunk)
            if row["refers_to"] is None:
                sha = hashlib.sha1()
                for a, b in places:
                    sha.update(payload[a:b].encode())
                row["digest"] = sha.hexdigest()
            row |= {"count": len(places), "mark": f":{uuid.uuid4()}" if len(places) > 1 else ""}
            for n, (a, b) in enumerate(places):
                held.append(row | {"k": n, "content": payload[a:b]})
                size += b - a
                if size >= 4 * chunk or len(held) >= 1000:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return arrow_map(rows, run, _CUT)


def write(rows: DataFrame, path: str, chunk: int = 1 << 16) -> None:
    """Write the records as gzip-compressed WARC files below path."""
    one = F.col("refers_to").isNotNull()
    cut = _streamed(rows, chunk)
    id_text = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    record_id = lambda k: F.concat(F.lit("<urn:page:"), id_text, F.lit(":"), k.cast("string"), F.col("mark"), F.lit(">"))
    many = F.col("count") > 1
    first = F.col("k") == 0
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(~first, "continuation").when(one, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("k"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", ""))),
        F.when(first, F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))),
        F.when(first, F.concat(F.lit("WARC-Payload-Length: "), F.col("payload_bytes").cast("string"))),
        F.concat(F.lit("WARC-Block-Digest: sha1:"), F.sha1(_bytes(F.col("content")))),
        F.when(one, F.concat(F.lit("WARC-Refers-To: "), F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(":0>"))),
        F.when(one, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(many, F.concat(F.lit("WARC-Segment-Number: "), (F.col("k") + 1).cast("string"))),
        F.when(many & ~first, F.concat(F.lit("WARC-Segment-Origin-ID: "), record_id(F.lit(0)))),
        F.when(many & (F.col("k") + 1 == F.col("count")), F.concat(F.lit("WARC-Segment-Total-Length: "), F.col("payload_bytes").cast("string"))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length("content").cast("string")),
    ]
    text = F.concat(F.concat_ws(_LINE, *lines), F.lit(_LINE * 2), F.col("content"), F.lit(_LINE))
    cut.select(text.alias("value")).write.option("lineSep", _LINE).option("compression", "gzip").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of the archives below path.

    Columns: record_id (of the first record), chunk_no from 0, type, url,
    payload_digest, payload_bytes, refers_to, content, and valid (the content has
    the length and digest its header says).
    """
    raw = spark.read.option("lineSep", _BREAK).text(path).where("value <> ''")
    head, body = F.substring_index("value", _LINE * 2, 1), F.expr(f"substring(value, instr(value, '{_LINE * 2}') + 4)")
    raw = raw.select(F.concat(F.lit(_LINE), F.regexp_replace(head, f"^{VERSION}{_LINE}", ""), F.lit(_LINE)).alias("head"), body.alias("body"))
    field = lambda name: F.nullif(F.regexp_extract("head", f"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))
    size = field("Content-Length").cast("long")
    content = F.substring(F.col("body").cast("binary"), F.lit(1), size.cast("int")).cast("string")
    got = raw.select(
        F.coalesce(field("WARC-Segment-Origin-ID"), field("WARC-Record-ID")).alias("record_id"),
        (F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(1)) - 1).alias("chunk_no"),
        field("WARC-Type").alias("type"),
        field("WARC-Target-URI").alias("url"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        field("WARC-Payload-Length").cast("long").alias("payload_bytes"),
        field("WARC-Refers-To").alias("refers_to"),
        content.alias("content"),
        size.alias("size"),
        field("WARC-Block-Digest").alias("block_digest"),
    )
    valid = (F.octet_length("content") == F.col("size")) & (F.col("block_digest") == F.concat(F.lit("sha1:"), F.sha1(_bytes(F.col("content")))))
    return got.withColumn("valid", valid).drop("size", "block_digest")


def payloads(chunks: DataFrame) -> DataFrame:
    """A row per record: its first chunk's fields, bytes and digest of its content, valid.

    chunks: as ``read`` gives them, those of a record one after the other.  A
    chunk that is missing or out of place makes its record invalid.
    """
    keep = ["record_id", "type", "url", "payload_digest", "payload_bytes", "refers_to"]
    schema = pa.schema([(c, pa.int64() if c == "payload_bytes" else pa.string()) for c in keep] + [("bytes", pa.int64()), ("sha1", pa.string()), ("valid", pa.bool_())])

    def run(batches):
        first, sha, size, valid, next_no, out = None, None, 0, True, 0, []

        def done():
            whole = valid and (first["type"] == "revisit" or size == first["payload_bytes"])
            out.append({**first, "bytes": size, "sha1": sha.hexdigest(), "valid": whole})

        for batch in (part for whole in batches for part in sliced(whole)):
            columns = [batch.column(c).to_pylist() for c in keep]
            numbers, right = batch.column("chunk_no").to_pylist(), batch.column("valid").to_pylist()
            content = batch.column("content").cast(pa.binary())
            for k, row in enumerate(zip(*columns, strict=True)):
                if first is None or numbers[k] == 0 or first["record_id"] != row[0]:
                    if first is not None:
                        done()
                    first, sha, size, valid, next_no = dict(zip(keep, row, strict=True)), hashlib.sha1(), 0, True, 0
                data = content[k].as_buffer()
                sha.update(data)
                size, valid, next_no = size + data.size, valid and right[k] and numbers[k] == next_no, next_no + 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if first is not None:
            done()
            yield pa.RecordBatch.from_pylist(out, schema)

    spark_schema = "record_id string, type string, url string, payload_digest string, payload_bytes long, refers_to string, bytes long, sha1 string, valid boolean"
    return chunks.select(*keep, "chunk_no", "content", "valid").mapInArrow(run, spark_schema)


def op5_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC records, read the archives back, and report each record."""
    out = f"{Scratch(spark, 'warc').path}/archives"
    write(records(table(spark, sf_dir, "pages"), "page_id", "url", "html", 1000), out)
    got = payloads(read(spark, out))
    right = F.col("valid") & ((F.col("type") == "revisit") | ((F.col("sha1") == F.col("payload_digest")) & (F.col("bytes") == F.col("payload_bytes"))))
    checked = lambda c: F.when(right, F.col(c)).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id"))))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+):', 1) as bigint)")
    return got.select(number("record_id").alias("page_id"), F.col("payload_bytes"), checked("payload_digest").alias("payload_digest"), F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))

"""WARC archives: writing with revisits, segments and chunked bodies, and reassembly.

Writing: a payload goes out as an HTTP response with chunked transfer framing. Of records with the same payload, if that has
``least`` bytes or more, the one with the smallest id is the response and the others are revisits of it, which carry the
payload's digest and length and no body. A block longer than a segment is split: the first record keeps its type, the others
are continuations that name its id, their number and, on the last, the total length.

Reading: records without segments are complete. Continuations are grouped by the id they name, ordered by number, and their
total length is verified; then HTTP headers are taken off, chunked framing is decoded, and the digest is verified.

Spark writes the archives as text whose lines end in the two line breaks that end a record, so its commit protocol and
file systems serve; records are bounded by the segment and files by a number of records, so a file fits in memory.

Defined results: a null payload is an empty one. A null id comes after all others: such a row is a response only if none of
its group has an id. Rows with the same id and payload are records each; those with the group's smallest id are all
responses. Line breaks in URLs are percent-encoded; a null URL is left out. No rows: no records. Other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepipe.llm.common import partitions

SEGMENT, CHUNK, RECORDS = 65_536, 8_192, 4_096
#: The date that all records carry.
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"


def verdicts(pages: DataFrame, least: int = 100, page_id: str = "page_id", payload: str = "html") -> DataFrame:
    """``pages`` with payload (bytes), digest, n and refers_to: the group's smallest id, null for responses.

    Only digests are grouped. Payloads meet their group's id once, dealt to as many parts as there are shuffle partitions, so
    that a payload that very many pages share is no single task's.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b"").cast("binary"))
    digest, size = F.sha2(body, 256), F.octet_length(body)
    firsts = pages.select(F.col(page_id).alias("id"), digest.alias("digest"), size.alias("n")).where(F.col("n") >= least)
    firsts = firsts.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1 AND first IS NOT NULL")
    salts = partitions(pages.sparkSession)
    firsts = firsts.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = pages.select(F.col(page_id).alias("id"), "url", body.alias("payload"), digest.alias("digest"), size.cast("long").alias("n"), F.pmod(F.xxhash64(F.col(page_id), F.col("url")), F.lit(salts)).cast("int").alias("salt"))
    return rows.join(firsts, ["digest", "salt"], "left").withColumn("refers_to", F.when(F.col("id").isNull() | (F.col("id") != F.col("first")), F.col("first"))).drop("first", "salt")


def _text(c: Column) -> Column:
    return c.cast("string")


def _chunked(payload: str) -> Column:
    """The payload in chunked framing, as a string of bytes."""
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.octet_length(payload) / CHUNK).cast("int") - 1)),
        lambda i: F.substring(F.col(payload), i * CHUNK + 1, F.lit(CHUNK)),
    )
    framed = F.transform(F.filter(pieces, lambda p: F.octet_length(p) > 0), lambda p: F.concat(F.hex(F.octet_length(p).cast("long")), F.lit("\r\n"), _text(p), F.lit("\r\n")))
    return F.concat(F.array_join(framed, ""), F.lit("0\r\n\r\n"))


def _record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(_text(p), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def records(pages: DataFrame, segment: int = SEGMENT, **how) -> DataFrame:
    """One column, record: each WARC record without the two line breaks at its end."""
    rows = verdicts(pages, **how)
    revisit = F.col("refers_to").isNotNull()
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n")
    block = F.when(revisit, F.concat(http, F.lit("\r\n"))).otherwise(F.concat(http, F.lit("Transfer-Encoding: chunked\r\n\r\n"), _chunked("payload")))
    rows = rows.withColumn("block", block.cast("binary")).withColumn("record_id", _record_id(F.col("id"), F.col("digest")))
    rows = rows.withColumn("segments", F.greatest(F.lit(1), F.ceil(F.octet_length("block") / segment).cast("int"))).drop("payload")
    rows = rows.withColumn("number", F.explode_outer(F.sequence(F.lit(1), F.col("segments"))))
    rows = rows.withColumn("data", F.substring(F.col("block"), (F.col("number") - 1) * segment + 1, F.lit(segment)))
    first, last, many = F.col("number") == 1, F.col("number") == F.col("segments"), F.col("segments") > 1

    def line(name: str, value: Column, when: Column | None = None) -> Column:
        made = F.concat(F.lit(f"{name}: "), _text(value), F.lit("\r\n"))
        return F.coalesce(made if when is None else F.when(when, made), F.lit(""))

    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(~first, "continuation").when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.when(first, F.col("record_id")).otherwise(_record_id(F.col("record_id"), F.col("number")))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")), first),
        line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("digest")), first & revisit),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), first & revisit),
        line("Page-ID", F.col("id"), first),
        line("Refers-To-Page-ID", F.col("refers_to"), first & revisit),
        line("Payload-Length", F.col("n"), first & revisit),
        line("WARC-Segment-Number", F.col("number"), many),
        line("WARC-Segment-Origin-ID", F.col("record_id"), ~first),
        line("WARC-Segment-Total-Length", F.octet_length("block"), many & last),
        line("Content-Type", F.lit("application/http;msgtype=response"), first),
        line("Content-Length", F.octet_length("data")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, _text(F.col("data"))).alias("record"))


def write(pages: DataFrame, folder: str, compression: str = "gzip", records_per_file: int = RECORDS, **how) -> None:
    """Archives of at most ``records_per_file`` records each into ``folder``."""
    records(pages, **how).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).option("compression", compression).text(folder)


# ---- reading


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers (names in lower case) and the block of each record."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        head = data[at:end].decode("utf-8", "surrogateescape").split("\r\n") if end >= 0 else [""]
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError("a record is cut off")
        yield fields, block
        at = end + 4 + size
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"no end of a record at byte {at}")
        at += 4


def dechunk(body: bytes) -> bytes:
    """The payload of a body in chunked framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk's size is cut off")
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise ValueError("not a chunk's size")
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(body[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes:
    """What an HTTP message carries."""
    head, _, body = block.partition(b"\r\n\r\n")
    if re.search(rb"^transfer-encoding:\s*chunked\s*$", head, re.IGNORECASE | re.MULTILINE):
        return dechunk(body)
    return body


def joined(segments: list[tuple[int, int | None, bytes]]) -> tuple[bytes, int]:
    """The block of (number, total length or None, data) in any order, and how many records it stands for: a segment that is
    there several times is of several like records."""
    by: dict[int, list] = {}
    for number, total, data in segments:
        by.setdefault(number, []).append((total, data))
    if sorted(by) != list(range(1, len(by) + 1)):
        raise ValueError(f"segments {sorted(by)}")
    copies = {len(v) for v in by.values()}
    if len(copies) > 1 or any(d != v[0] for v in by.values() for d in v):
        raise ValueError("segments of different records under one id")
    block = b"".join(by[i][0][1] for i in sorted(by))
    if by[len(by)][0][0] != len(block):
        raise ValueError(f"{len(block)} bytes in segments, {by[len(by)][0][0]} in all")
    return block, copies.pop()


_COLUMNS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_SEGMENTS = "origin string, url string, number int, total long, fields string, data binary"


def _finished(fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    known = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    page, to = fields.get("page-id"), fields.get("refers-to-page-id")
    if fields["warc-type"] == "revisit":
        payload, size, digest = None, int(fields["payload-length"]), known
    else:
        payload = payload_of(block)
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if known and digest != known:
            raise ValueError(f"page {page}: the payload is not the one that its digest tells of")
    return (int(page) if page else None, fields.get("warc-target-uri"), fields["warc-type"], int(to) if to else None, size, digest, payload if payloads else None)


def _batches(rows: Iterator[tuple], names: list[str], types: list, weight) -> Iterator[pa.RecordBatch]:
    """Batches of up to 8 MB or 4096 rows."""
    held, mass = [], 0
    for r in rows:
        held.append(r)
        mass += weight(r)
        if mass > 8_000_000 or len(held) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names=names)
            held, mass = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names=names)


_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for revisits,
    and without ``payloads``). Lengths and digests are those of the payloads as decoded; a revisit tells its response's."""
    import json

    files = spark.read.format("binaryFile").load(folder).select("content")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i in range(b.num_rows):
                    for fields, block in parse(b.column(0)[i].as_py()):
                        if "warc-segment-number" not in fields:
                            yield _finished(fields, block, payloads)

        yield from _batches(rows(), _NAMES, _TYPES, lambda r: len(r[6] or b""))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i in range(b.num_rows):
                    for fields, block in parse(b.column(0)[i].as_py()):
                        if "warc-segment-number" in fields:
                            total = fields.get("warc-segment-total-length")
                            origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])
                            first = fields["warc-segment-number"] == "1"
                            yield origin, fields.get("warc-target-uri"), int(fields["warc-segment-number"]), int(total) if total else None, json.dumps(fields) if first else None, block

        yield from _batches(rows(), [c.split()[0] for c in _SEGMENTS.split(", ")], [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()], lambda r: len(r[5]))

    parts = files.mapInArrow(segments, _SEGMENTS)
    grouped = parts.groupBy("origin", "url").agg(F.max("fields").alias("fields"), F.collect_list(F.struct("number", "total", "data")).alias("parts"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i in range(b.num_rows):
                    block, copies = joined([(p["number"], p["total"], p["data"]) for p in b.column("parts")[i].as_py()])
                    row = _finished(json.loads(b.column("fields")[i].as_py()), block, payloads)
                    for _ in range(copies):
                        yield row

        yield from _batches(rows(), _NAMES, _TYPES, lambda r: len(r[6] or b""))

    return files.mapInArrow(whole, _COLUMNS).unionByName(grouped.mapInArrow(finish, _COLUMNS))

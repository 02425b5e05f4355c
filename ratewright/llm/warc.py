"""WARC archives: writing pages as segmented records, and reassembling them.

A page is an HTTP response with chunked transfer framing. A response longer than a segment is
cut: the first record is of type ``response`` with segment number 1, the others are
``continuation`` records that name the first as their origin; the last one states the total
length. So every record, and with a fixed number of records every file, has a bounded size.
Reading groups segments by origin, orders them by number, verifies the total length and takes
the payload out of the chunked framing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.llm.common import byte_texts, new_shared_path, pieces, small

#: Bytes of a record's block, of a transfer chunk, records of a file, and the least payload that
#: is worth a revisit record.
SEGMENT, CHUNK, FILE_RECORDS, LEAST_REVISIT = 65_536, 8_192, 400, 1_000
#: What stands between two records of an archive, and so ends each but the last.
BETWEEN = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def payload(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def chunked(data: bytes) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(data[i : i + CHUNK]), data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; trailing fields after the last chunk are allowed."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def header(kind: str, name: str, length: int, fields: dict) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in fields.items() if v is not None]
    return ("\r\n".join([*lines, f"Content-Length: {length}"]) + "\r\n\r\n").encode()


def records(name: str, uri: str | None, data: bytes, refers: str | None) -> Iterator[bytes]:
    """All records of one page, without what separates them."""
    digest = hashlib.sha1(data).hexdigest()
    start = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    fields = {"WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response"}
    if refers is not None:
        more = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{refers}>"}
        yield header("revisit", name, len(start), fields | more) + start
        return
    block = start + chunked(data)
    if len(block) <= SEGMENT:
        yield header("response", name, len(block), fields) + block
        return
    last = (len(block) - 1) // SEGMENT
    for i in range(last + 1):
        part = block[i * SEGMENT : (i + 1) * SEGMENT]
        if i == 0:
            yield header("response", name, len(part), fields | {"WARC-Segment-Number": 1}) + part
            continue
        more = {"WARC-Segment-Origin-ID": f"<{name}>", "WARC-Segment-Number": i + 1}
        if i == last:
            more["WARC-Segment-Total-Length"] = len(block)
        yield header("continuation", f"{name}:{i + 1}", len(part), more) + part


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``page_id, url, html`` as archives under ``path``.

    Of pages with equal payloads of at least LEAST_REVISIT bytes, that with the largest page_id
    is a response, the others are revisits of it. Rows that tie (a repeated page_id, or only
    null ids) are all responses. A null html is an empty payload. Record names hold the page_id
    and the row's place in its task, so that rows of one page_id stay apart.
    """
    rows = pages.select(
        "page_id", F.regexp_replace("url", r"[\x00-\x20]", "%20").alias("url"), payload(F.col("html")).alias("data")
    ).withColumn("digest", F.sha1("data"))
    groups = (
        rows.where(F.length("data") >= LEAST_REVISIT)
        .groupBy("digest", F.length("data").alias("size"))
        .agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("known"), "size", "largest")
    )
    marked = rows.join(
        small(groups), (F.col("digest") == F.col("known")) & (F.length("data") == F.col("size")), "left"
    ).select(
        "page_id",
        "url",
        "data",
        F.when(~F.col("largest").eqNullSafe(F.col("page_id")), F.col("largest")).alias("refers"),
        F.concat_ws("-", F.spark_partition_id(), F.monotonically_increasing_id()).alias("place"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8_000_000, "data"):
            out = [
                record
                for page, url, data, refers, place in zip(*(batch.column(i).to_pylist() for i in range(5)))
                for record in records(
                    f"urn:page:{'' if page is None else page}:{place}",
                    url,
                    data,
                    None if refers is None else f"urn:page:{refers}",
                )
            ]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    written = marked.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    (
        written.write.option("lineSep", BETWEEN)
        .option("maxRecordsPerFile", FILE_RECORDS)
        .option("compression", "gzip")
        .text(path)
    )


def parsed(archive: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header fields and block of each record."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        lines = archive[at:end].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        stop = end + 4 + int(fields["Content-Length"])
        yield fields, archive[end + 4 : stop]
        at = stop + len(BETWEEN)


def decoded(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


PART = "origin string, type string, refers string, digest string, number int, total long, block binary"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, complete, payload`` for
    every page in the archives under ``path``.

    A page is complete if its segments are numbered without a gap from 1, their lengths add up
    to the total the last one states, and the payload has the digest its header names; if not,
    length, digest and payload are null. A revisit takes length and digest from the response it
    refers to, and is complete if that one is and has the digest the revisit names. Records may
    be in any order and file.
    """
    import gzip

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parsed(gzip.decompress(content.as_py())):
                    name = fields["WARC-Record-ID"].strip("<>")
                    rows.append(
                        (
                            fields.get("WARC-Segment-Origin-ID", name).strip("<>"),
                            fields["WARC-Type"],
                            fields.get("WARC-Refers-To", "").strip("<>") or None,
                            fields.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None,
                            int(fields.get("WARC-Segment-Number", 0)),
                            int(fields.get("WARC-Segment-Total-Length", -1)),
                            block,
                        )
                    )
                kinds = [pa.string()] * 4 + [pa.int32(), pa.int64(), pa.binary()]
                columns = zip(*rows) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    names=["origin", "type", "refers", "digest", "number", "total", "block"],
                )

    # a page's own segments: as much as the page
    joined = (
        files.mapInArrow(split, PART)
        .groupBy("origin")
        .agg(
            F.max(F.when(F.col("type") != "continuation", F.col("type"))).alias("type"),
            F.max("refers").alias("refers"),
            F.max("digest").alias("digest"),
            F.max("total").alias("total"),
            F.sort_array(F.collect_list(F.struct("number", "block"))).alias("segments"),
        )
        .select(
            "origin", "type", "refers", "digest", "total", F.col("segments.number").alias("numbers"), F.col("segments.block").alias("blocks")
        )
    )

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500).to_pylist()
                sizes, digests, whole, data = [], [], [], []
                for row in some:
                    block, numbers = b"".join(row["blocks"]), row["numbers"]
                    good = numbers == [0] or (numbers == list(range(1, len(numbers) + 1)) and len(block) == row["total"])
                    content = None
                    if good and row["type"] == "response":
                        try:
                            content = decoded(block)
                        except ValueError:
                            content = None
                    digest = None if content is None else hashlib.sha1(content).hexdigest()
                    good = good and (row["type"] == "revisit" or (digest is not None and digest == row["digest"]))
                    whole.append(bool(good))
                    data.append(content if good else None)
                    digests.append(digest if good else None)
                    sizes.append(len(content) if good and content is not None else None)
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("origin", "type", "refers", "digest")),
                        pa.array(whole, pa.bool_()),
                        pa.array(sizes, pa.int64()),
                        pa.array(digests, pa.string()),
                        pa.array(data, pa.binary()),
                    ],
                    names=["origin", "type", "refers", "named", "whole", "size", "digest", "payload"],
                )

    pages = joined.mapInArrow(
        assemble,
        "origin string, type string, refers string, named string, whole boolean, size long, digest string, payload binary",
    ).withColumn("page", F.split("origin", ":")[2])
    return pages


def resolved(pages: DataFrame) -> DataFrame:
    """Give each revisit the length and digest of the response it refers to."""
    number = F.when(F.col("page") != "", F.col("page")).cast("long")
    mine = pages.select("page", "type", "refers", "named", "whole", "size", "digest", number.alias("page_id"), "payload")
    target = F.split("refers", ":")[2]
    responses = (
        pages.where("type = 'response' AND whole")
        .groupBy(F.col("page").alias("their_page"), F.col("digest").alias("their_digest"))
        .agg(F.max("size").alias("their_size"))
    )
    revisits = mine.where("type = 'revisit'").withColumn("target", target)
    found = revisits.join(
        responses, (F.col("target") == F.col("their_page")) & (F.col("named") == F.col("their_digest")), "left"
    ).select(
        "page_id",
        F.col("their_size").alias("payload_bytes"),
        F.col("their_digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("target").cast("long").alias("refers_to"),
        (F.col("whole") & F.col("their_digest").isNotNull()).alias("complete"),
        F.lit(None).cast("binary").alias("payload"),
    )
    own = mine.where("type <> 'revisit'").select(
        "page_id",
        F.col("size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"),
        F.col("whole").alias("complete"),
        "payload",
    )
    return own.union(found)


def round_trip(pages: DataFrame, label: str = "warc") -> DataFrame:
    """Write ``pages`` into the shared folder and read them back. The archive's pages are landed
    without payload, so that reading happens once; an empty table gives no rows."""
    from ratewright.llm.common import land

    path = new_shared_path(pages.sparkSession, label)
    write_archives(pages, path)
    read = land(read_archives(pages.sparkSession, path).drop("payload"), f"{label}-pages")
    return resolved(read.withColumn("payload", F.lit(None).cast("binary"))).drop("payload")

"""WARC archives: a writer with one gzip member per record and a sequential reader.

The reader decompresses step by step, ends a record with its gzip member, cuts header and block by Content-Length and
verifies the digests. Archives lie in the cluster's shared folder and are opened by their address through pyarrow's file
systems (file, hdfs, s3, gs), never by local path. A task writes under a name of its own and only names of finished tasks
count, so a lost executor leaves at most files that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, scratch

#: Bytes of repeated digests that are broadcast (DIGEST_BYTES each); beyond it only those of one row in HOT or more are.
BROADCAST_BYTES, DIGEST_BYTES, HOT = 64 << 20, 64, 4096

_STEP = 1 << 16
#: An archive is closed when it has this many bytes.
ARCHIVE_BYTES = 256 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One compressed record: a response with its payload or, with ``refers_to``, a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or 'urn:none', safe=':/?#[]@!$&()*+,;=%-._~' + chr(39))}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []),
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(stream) -> Iterator[bytes]:
    """The content of each gzip member, one at a time."""
    waiting = b""
    while waiting or (waiting := stream.read(_STEP)):
        unpacker, out = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not waiting and not (waiting := stream.read(_STEP)):
                raise ValueError("the archive ends inside a record")
            out.append(unpacker.decompress(waiting, _STEP * 16))
            waiting = unpacker.unconsumed_tail or (b"" if not unpacker.eof else waiting)
        waiting = unpacker.unused_data
        yield b"".join(out)


def parse(member: bytes) -> dict:
    """A record's fields; ValueError where framing or a digest is wrong."""
    head, split, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not split or not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't fit the record")
    if fields["warc-block-digest"] != "sha1:" + digest(block):
        raise ValueError("the block digest is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(re.search(rb"(?im)^Content-Length: *([0-9]+)", http)[1])
    if fields["warc-type"] == "response" and (len(payload) != full or fields["warc-payload-digest"] != "sha1:" + digest(payload)):
        raise ValueError("the payload digest is wrong")
    number = lambda x: int(m[1]) if x and (m := re.search(r"page:(-?[0-9]+)", x)) else None
    return {
        "page_id": number(fields["warc-record-id"]),
        "target_uri": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"],
        "payload": payload if fields["warc-type"] == "response" else None,
        "payload_bytes": full,
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
        "refers_to": number(fields.get("warc-refers-to")),
    }


def _with_first(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """``rows`` with the id that their digest's response has. Digests that occur once need no partner, so payloads stay
    where they are while the repeated ones are few, which is checked. Beyond that, rows of hot digests still stay."""
    n, total = shared.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n * DIGEST_BYTES <= BROADCAST_BYTES:
        return rows.join(F.broadcast(shared.drop("n")), "key", "left")
    hot = F.col("n") * HOT >= total
    mine = rows.join(F.broadcast(shared.where(hot).select("key", F.col("first").alias("hot"))), "key", "left")
    mine = mine.withColumn("s", F.when(F.col("hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("page_id", "url"), F.lit(HOT)).cast("int")))
    zero = F.pmod(F.xxhash64("key"), F.lit(1)).cast("int")  # no constant, which would be taken out of the join's keys
    return mine.join(shared.where(~hot).select("key", zero.alias("s"), "first"), ["key", "s"], "left").withColumn("first", F.coalesce("hot", "first"))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write a record per row and return the archives' addresses (path, records).

    Of rows with equal payloads of at least ``least_bytes`` bytes, that with the largest id is the response and the
    others revisit it; smaller ones are all responses. A null html is an empty payload, a null url ``urn:none``. Rows
    that repeat the largest id are responses all; rows of null id revisit a response if there is one with an id. An empty
    table gives no archives; a payload of any length is one record, held in memory as a whole by its task; other columns,
    whatever their names, are not read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.unhex(F.sha1(F.col("html").cast("binary"))))
    shared = rows.where(F.octet_length("html") >= least_bytes).groupBy("key").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    rows = _with_first(rows, materialise(shared, "repeated-digests")).select("page_id", "url", "html", F.expr("if(page_id is null or page_id < first, first, null)").alias("refers_to"))
    folder = scratch(spark, "warc")
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        out, path, count, size, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path = f"{uuid.uuid4().hex}.warc.gz"
                    out, count, size = system.open_output_stream(f"{base}/{path}", compression=None), 0, 0
                data = record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((f"{folder}/{path}", count))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{path}", count))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    return materialise(rows.mapInArrow(run, "path string, records long"), "warc-list")


def broken_revisits(records: DataFrame) -> DataFrame:
    """(refers_to, payload_digest, revisits) of revisits without a response of that id and digest; none if all is well.
    Revisits are counted before they are joined, so a response with very many of them is one row."""
    revisits = records.where("record_type = 'revisit'").groupBy("refers_to", "payload_digest").agg(F.count("*").alias("revisits"))
    responses = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest").distinct()
    return revisits.join(responses, ["refers_to", "payload_digest"], "left_anti")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of all archives: page_id, target_uri, record_type, payload (binary; null for revisits), payload_bytes,
    payload_digest, refers_to. Each archive is read by one task from start to end; a broken one fails the query."""
    files = archives.select("path")
    kinds = {"page_id": pa.int64(), "target_uri": pa.string(), "record_type": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64()}
    if not with_payload:
        del kinds["payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_stream(name, compression=None) as stream:
                    rows, size = [], 0
                    for member in members(stream):
                        rows.append(parse(member))
                        size += len(member)
                        if size > 4 << 20 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))
                            rows, size = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))

    payload = "payload binary, " if with_payload else ""
    return files.repartition(max(1, files.count())).mapInArrow(run, f"page_id long, target_uri string, record_type string, {payload}payload_bytes long, payload_digest string, refers_to long")

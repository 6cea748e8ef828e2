"""WARC archives: a writer that marks repeated payloads, and a splittable reader.

Writing: every page becomes one record, a gzip member of its own. Of pages with equal payloads of at least MIN_BYTES
bytes the one with the smallest id is a response, the others are revisits that refer to it. Tasks emit runs of members, and
Spark's text writer stores their raw bytes with its commit protocol; the separator it needs between rows is an empty
gzip member, which decoders skip. Payload digests are SHA-256.

Reading: files are cut into byte ranges, which are dealt to tasks. A task scans its range for the gzip magic, validates each candidate by inflating
its start and looking for a WARC version line, and owns the records that start inside its range; it reads beyond the range's
end to finish the last one. A false magic is passed over; a record that breaks off or whose checksum is wrong raises an error.

Defined cases: null html is the empty payload; payloads below MIN_BYTES are always responses; rows that repeat the
smallest id of their payload are responses too, as nothing tells them apart; a null id is kept as null and never refers or is
referred to; a null url becomes urn:page:<id>; an empty table gives no records; columns other than id, url and html
are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch
from .common import BROADCAST_BYTES, bounded_batches, checkpoint

#: Fixed values of the formats: gzip's magic, an empty member, how a record begins, and the profile of identical payloads.
MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003" "0300" "0000000000000000")
VERSION = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
MIN_BYTES = 100
#: Bytes of members in one written row, of a reader's range, and read at once beyond it.
RUN_BYTES, RANGE_BYTES, MORE_BYTES = 4 << 20, 32 << 20, 1 << 20
#: Tasks of a reader at most; with more ranges each takes several.
TASKS = 20_000
#: Bytes inflated at once.
STEP_BYTES = 16 << 10


def member(head: str, block: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int = 1) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return member("\r\n".join(lines) + "\r\n", block, level)


def with_refers(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Add _digest and _refers_to. Only payloads that several pages share are gathered, without their html. Pages are joined with
    these by broadcast while they are few; beyond that a payload that very many pages share is still broadcast, so no
    payload's pages meet in one task."""
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    digest = F.sha2(html, 256)
    shared = pages.filter(F.octet_length(html_col) >= min_bytes).groupBy(digest.alias("_digest")).agg(F.min(id_col).alias("_first"), F.count("*").alias("_n"))
    shared = checkpoint(shared.filter("_n > 1"))
    marked = pages.withColumn("_digest", digest)
    if shared.count() * 128 <= BROADCAST_BYTES:
        found = marked.join(F.broadcast(shared.drop("_n")), "_digest", "left")
    else:
        limit = max(1000, shared.agg(F.sum("_n")).first()[0] // 100_000)
        hot = F.broadcast(shared.filter(F.col("_n") > limit).select("_digest", F.col("_first").alias("_hot")))
        cold = shared.filter(F.col("_n") <= limit).select(F.col("_digest").alias("_cold"), "_first")
        # rows that are decided by now get a key of their own, which nothing matches
        keyed = marked.join(hot, "_digest", "left").withColumn("_key", F.when(F.col("_hot").isNull(), F.col("_digest")).otherwise(F.uuid()))
        found = keyed.join(cold, F.col("_key") == F.col("_cold"), "left").withColumn("_first", F.coalesce("_hot", "_first")).drop("_hot", "_key", "_cold")
    long_enough = F.octet_length(html) >= min_bytes
    return found.withColumn("_refers_to", F.when(long_enough & (F.col(id_col) != F.col("_first")), F.col("_first"))).drop("_first")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES, level: int = 1) -> str:
    """Write one record for every row to files in ``path``, a folder that must not exist."""
    bounded_batches(pages.sparkSession)
    named = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    ready = with_refers(named, "id", "html", min_bytes)

    def members(batches):
        run, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("id", "url", "html", "_digest", "_refers_to")}
                run.append(record(row["id"], row["url"], (row["html"] or "").encode(), row["_digest"], row["_refers_to"], level))
                size += len(run[-1])
                if size >= RUN_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(run)], pa.binary())], ["run"])
                    run, size = [], 0
        if run:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(run)], pa.binary())], ["run"])

    runs = ready.select("id", "url", "html", "_digest", "_refers_to").mapInArrow(members, "run binary")
    # the separator is given as Latin-1 text, each character one byte
    runs.select(F.col("run").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)
    return path


def files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and sizes of the files in a folder, by Spark's own file systems."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return [(f.getPath().toString(), f.getLen()) for f in found if f.isFile() and not f.getPath().getName().startswith(("_", "."))]


class ByteSource:
    """Random access to a file; holds the last MORE_BYTES or so that were read."""

    def __init__(self, uri: str):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
        self.file = system.open_input_file(path)
        self.size, self.base, self.held = self.file.size(), 0, b""

    def load(self, at: int, n: int = MORE_BYTES) -> None:
        self.base, self.held = at, self.file.read_at(max(0, min(n, self.size - at)), at)

    def read(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``at`` on; empty only at the end."""
        if not self.base <= at < self.base + len(self.held):
            self.load(at)
        return self.held[at - self.base : at - self.base + n]

    def find(self, what: bytes, at: int, end: int) -> int:
        """Offset of the first ``what`` that starts in [at, end), or -1."""
        while at < end and at + len(what) <= self.size:
            if not self.base <= at <= self.base + len(self.held) - len(what):
                self.load(at)
            k = self.held.find(what, at - self.base)
            if k >= 0:
                return self.base + k if self.base + k < end else -1
            at = self.base + len(self.held) - len(what) + 1
        return -1


def inflate(source: ByteSource, at: int) -> tuple[bytes, int] | None:
    """The WARC record in the member at ``at`` and the offset after it; None if there is no such member."""
    z, out, head = zlib.decompressobj(31), [], b""
    try:
        while not z.eof:
            data = source.read(at, STEP_BYTES)
            if not data:
                if head == VERSION:
                    raise ValueError(f"a record breaks off at byte {at}")
                return None
            out.append(z.decompress(data))
            at += len(data) - len(z.unused_data)
            if len(head) < len(VERSION):
                head = (head + out[-1])[: len(VERSION)]
                if not VERSION.startswith(head):
                    return None
    except zlib.error as e:
        if head == VERSION:
            raise ValueError(f"a record is broken before byte {at}") from e
        return None
    return (b"".join(out), at) if head == VERSION else None


def members_in(source: ByteSource, begin: int, end: int):
    """(offset, inflated record) of the WARC members that start in [begin, end)."""
    at = begin
    while (at := source.find(MAGIC, at, end)) >= 0:
        if found := inflate(source, at):
            yield at, found[0]
            at = found[1]
        else:
            at += 1


def parse(raw: bytes) -> dict:
    """Headers and payload facts of one inflated record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    numbers = lambda name: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)>", fields.get(name, ""))) else None
    kind = fields["WARC-Type"]
    told = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response":
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if digest != told:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't the one its digest names")
    else:
        size, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), told
    return {"page_id": numbers("WARC-Record-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": numbers("WARC-Refers-To"), "url": fields["WARC-Target-URI"], "payload": payload}


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, payloads: bool = False) -> DataFrame:
    """Records of all files in ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to, and on request
    url and payload (empty for revisits)."""
    found = [(f, size) for f, size in files(spark, path) if size]
    count = sum(-(-size // range_bytes) for _, size in found)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payloads
    if not found:
        return spark.createDataFrame([], schema)
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[c.split()[1]]) for n, c in zip(names, schema.split(", "), strict=True)])

    def scan(batches):
        for batch in batches:
            for file, begin, end in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows, held = [], 0
                for _, raw in members_in(ByteSource(file), begin, end):
                    rows.append({n: v for n, v in parse(raw).items() if n in names})
                    held += len(raw) if payloads else 200
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long")))
    work = spark.createDataFrame(found, "file string, size long").select("file", begin.alias("begin"), "size")
    work = work.select("file", "begin", F.least(F.col("begin") + range_bytes, "size").alias("end"))
    return work.repartition(min(count, TASKS)).mapInArrow(scan, schema)


def archive_round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write all pages to a new folder in the shared one and read the archives back."""
    return read(pages.sparkSession, write(pages, scratch(pages.sparkSession, "warc"), **columns))

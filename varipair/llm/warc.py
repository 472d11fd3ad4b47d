"""WARC archives: a writer with revisit records, and a splittable reader of record-per-member gzip files.

Reading: each task has byte ranges of files. From the start of its range it looks for the gzip magic, and takes
a place for a record if what inflates there begins with a complete WARC header whose Content-Length is the rest
of the member. It owns the records that start inside its range, and reads on past its end to finish the last.
Records follow each other without gaps, so after the first one found the next starts where the last ended.

Files lie in a store that the executors reach (pyarrow's file systems: file, hdfs, s3, gs, by the scheme).
Task attempts write under names of their own; only the files named in the committed manifest belong to an
archive, so a lost or repeated attempt leaves nothing behind that is read.

Cases: null html is an empty payload; rows with the smallest page_id of a payload are all response if that row is
repeated; a null page_id never is the smallest, and where all are null all are response; an empty table gives an
archive without records; extra columns are ignored. A record is held in memory, ranges are read in pieces.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MAGIC = b"\x1f\x8b\x08"
PIECE = 1 << 20
_END = b"\r\n\r\n"


# ---- writing -------------------------------------------------------------------------------------------------


def plan_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest and refers_to (null for responses). Digests are counted
    with partial aggregates, and only those that occur twice come to the join."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2(F.col("html").cast("binary"), 256))
    repeated = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    joined = rows.join(repeated, "payload_digest", "left")
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when((F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def record(page_id, url, html: bytes, n_bytes: int, digest: str, refers_to, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    block = http if refers_to is not None else http + html
    name = f"{page_id}" if page_id is not None else f"none:{uuid.uuid4()}"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '').replace(chr(10), '')}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {n_bytes}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + _END + block + _END


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(batches, folder: str, date: str):
    """One file for the task; a row that names it."""
    from pyarrow import fs
    from pyspark import TaskContext

    store, base = fs.FileSystem.from_uri(folder)
    name, size, n = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
    out = None
    for part in C.steps(batches, "html"):
        columns = [part.column(c).to_pylist() for c in ("page_id", "url")] + [C.texts_of(part.column("html"))] + [part.column(c).to_pylist() for c in ("payload_bytes", "payload_digest", "refers_to")]
        out = out or store.open_output_stream(f"{base}/{name}", compression=None)
        for row in zip(*columns, strict=True):
            data = member(record(*row, date))
            out.write(data)
            size, n = size + len(data), n + 1
    if out:
        out.close()
        yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "size": [size], "n_records": [n]})


def write_archive(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the pages as WARC files below folder; returns the manifest (file, size, n_records), a written table."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    return C.written(C.arrow_map(plan_records(pages), _write, "file string, size long, n_records long", folder, date), "warc-manifest")


# ---- reading -------------------------------------------------------------------------------------------------


class Window:
    """A file's bytes from a growing window; what lies before `keep` may be let go."""

    def __init__(self, handle, size: int, start: int):
        self.handle, self.size, self.base, self.data = handle, size, start, b""

    def upto(self, end: int) -> bool:
        """Have the bytes before `end`, as far as the file goes; False if it ends earlier."""
        have = self.base + len(self.data)
        if end > have and have < self.size:
            self.handle.seek(have)
            self.data += self.handle.read(min(self.size, max(end, have + PIECE)) - have)
        return self.base + len(self.data) >= end

    def let_go(self, place: int) -> None:
        if place - self.base > PIECE:
            self.data, self.base = self.data[place - self.base :], place


def inflate(window: Window, place: int) -> tuple[bytes, int] | None:
    """The member at place and where it ends, or None if no WARC record in a whole member is there."""
    z, out, at, checked = zlib.decompressobj(31), [], place, False
    head = b""
    while not z.eof:
        window.upto(at + 65536)
        chunk = window.data[at - window.base : at - window.base + 65536]
        if not chunk:
            return None
        try:
            got = z.decompress(chunk)
        except zlib.error:
            return None
        at += len(chunk)
        out.append(got)
        if not checked:
            head += got
            if not head.startswith(b"WARC/1."[: len(head)]):
                return None
            checked = _END in head
            if not checked and len(head) > PIECE:
                return None
    data = b"".join(out)
    if not checked:
        return None
    header = data.index(_END) + 4
    length = dict(fields(data[:header])).get("content-length", "")
    if not length.isdigit() or header + int(length) + 4 != len(data):
        return None
    return data, at - len(z.unused_data)


def fields(header: bytes) -> list[tuple[str, str]]:
    pairs = (line.partition(":") for line in header.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return [(k.strip().lower(), v.strip()) for k, _, v in pairs]


def records_in(handle, size: int, start: int, stop: int):
    """The records that start in [start, stop)."""
    window, at = Window(handle, size, start), start
    while at < stop:
        window.upto(min(stop + 2, at + PIECE))
        found = window.data.find(MAGIC, at - window.base)
        if found < 0:
            at = max(at + 1, window.base + len(window.data) - 2)
            if at + 2 >= min(size, stop + 2):
                return
            window.let_go(at)
            continue
        place = window.base + found
        if place >= stop:
            return
        got = inflate(window, place)
        if got is None:
            at = place + 1
        else:
            yield got[0]
            at = got[1]
        window.let_go(at)


_RECORD = "record_id string, record_type string, url string, refers_to_id string, payload_digest string, payload_bytes long, payload binary"
_RECORD_SCHEMA = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to_id", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def parse(data: bytes) -> tuple:
    end = data.index(_END) + 4
    f = dict(fields(data[:end]))
    block = data[end:-4]
    declared = f.get("warc-payload-digest", "").removeprefix("sha256:") or None
    if f.get("warc-type") == "response":
        payload = block[block.index(_END) + 4 :] if _END in block else block
        digest = hashlib.sha256(payload).hexdigest()
        if declared not in (None, digest):
            raise ValueError(f"the payload of {f.get('warc-record-id')} does not have its digest")
        return f.get("warc-record-id"), "response", f.get("warc-target-uri"), None, digest, len(payload), payload
    length = f.get("warc-payload-length", "")
    return f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-refers-to"), declared, int(length) if length.isdigit() else None, None


def _read(batches):
    from pyarrow import fs

    for batch in batches:
        for file, size, start, stop in zip(*(batch.column(c).to_pylist() for c in ("file", "size", "start", "stop")), strict=True):
            store, path = fs.FileSystem.from_uri(file)
            rows, held = [], 0
            with store.open_input_file(path) as handle:
                for data in records_in(handle, size, start, stop):
                    rows.append(parse(data))
                    held += len(data)
                    if held > C.STEP_BYTES:
                        yield C.batch_of(_RECORD_SCHEMA, list(map(list, zip(*rows, strict=True))))
                        rows, held = [], 0
            if rows:
                yield C.batch_of(_RECORD_SCHEMA, list(map(list, zip(*rows, strict=True))))


def read_archive(files: DataFrame, split_bytes: int = 4 << 20) -> DataFrame:
    """The records of files (file, size), by tasks of about split_bytes of archive each."""
    ranges = files.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.withColumn("stop", F.least(F.col("size"), F.col("start") + split_bytes))
    return C.arrow_map(ranges.repartition(C.shuffle_partitions(files.sparkSession), "file", "start"), _read, _RECORD)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archive(C.table(spark, sf_dir, "pages"), C.fresh_path(spark, "warc"))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    as_long = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return read_archive(files).select(as_long("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_long("refers_to_id").alias("refers_to"))


#: DuckDB SQL for op5.
SQL5 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

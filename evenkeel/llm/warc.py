"""WARC archives: a deduplicating writer and a splittable reader.

Every record is a gzip member of its own, so an archive can be cut anywhere. The
reader deals byte ranges of the archives to tasks. A task looks for the gzip
magic in its range, validates each candidate by inflating its head and parsing
the record's header, and owns the records that start inside its range; it reads
past the end of the range only to finish the last of them. A candidate inside
compressed data fails validation, and after a valid record the search goes on at
the record's end. What no reader of ranges can tell apart is a whole gzipped WARC
record that another record holds uncompressed (deflate stores what it can't
shrink), where a range begins between the two starts; this writer's payloads are
UTF-8, in which the magic can't occur.

Of pages with equal payloads of MIN_REVISIT bytes or more, the smallest page_id
is written as a response and the others as revisits that name it and carry the
payload's digest and length.

Defined results: null html is an empty payload; a null page_id is kept, sorts
before all others and is written as an empty id; rows that repeat a page_id are
records of their own: one row with the smallest url (null first) holds the
payload, the others revisit it. A url of any length is kept (white space in it
becomes a blank). Other columns are ignored. An empty table writes no archives
and reads as no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

MIN_REVISIT = 100
#: The twelve header bytes that begin a gzip member of this writer or of common tools: magic and deflate.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
RANGE = 8 << 20
ARCHIVE = 64 << 20
CHUNK = 1 << 20
MOST_TASKS = 20_000
#: The table of shared payloads is broadcast up to so many rows (under 150 bytes each), and joined by shuffle beyond.
BROADCAST_ROWS = 200_000
HEAD = 64 << 10
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _open(path: str):
    """The file system and the name in it of a path as Spark gives it."""
    from pyarrow import fs

    path = path.replace("s3a://", "s3://", 1)
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:", "file://", 1))


# ---------------------------------------------------------------- writing


def _record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + (b"" if revisit else payload)
    name = lambda x: "" if x is None else str(x)
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{name(page_id)}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": " ".join(str(url).split()) if url is not None else None,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Payload-Length": str(size),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(body)),
    }
    if revisit:
        head |= {"WARC-Refers-To": f"<urn:page:{name(refers_to)}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + lines.encode() + b"\r\n" + body + b"\r\n\r\n") + packer.flush()


def shared_payloads(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """digest, first_id, twins: payloads that several rows have, and how many rows have them under the smallest id."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.where(F.octet_length("html") >= min_revisit).select("page_id", F.sha2(F.col("html"), 256).alias("digest"))
    by_page = keyed.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    # a null page_id is the smallest of a struct
    both = by_page.groupBy("digest").agg(F.sum("n").alias("n"), F.min(F.struct("page_id", "n")).alias("first")).where("n > 1")
    return store.written(both.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.n").alias("twins")), "payloads")


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Each page with its payload's digest and size, whether it is a revisit, and of which page."""
    shared = shared_payloads(pages, min_revisit)
    if shared.count() <= BROADCAST_ROWS:
        shared = F.broadcast(shared)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html"), 256)).withColumn("size", F.octet_length("html").cast("long"))
    joined = rows.join(shared, "digest", "left")
    again = F.col("twins").isNotNull()
    is_first = F.col("page_id").eqNullSafe(F.col("first_id"))
    columns = ["page_id", "url", "html", "digest", "size", "first_id"]
    once = joined.where(~again | ~is_first | (F.col("twins") == 1)).select(*columns, F.when(again, ~is_first).otherwise(F.lit(False)).alias("revisit"))
    # of rows that repeat the smallest page_id one holds the payload; only their numbers and urls are gathered
    twice = joined.where(again & is_first & (F.col("twins") > 1))
    same = twice.groupBy("page_id", "url", "digest", "size", "first_id").agg(F.count(F.lit(1)).alias("rows"))
    holder = same.groupBy(F.col("digest").alias("held")).agg(F.min(F.struct(F.col("url").isNotNull().alias("has"), "url")).alias("holder"))
    each = same.join(holder, F.col("digest") == F.col("held")).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    marked = each.withColumn("revisit", (F.col("nth") > 1) | ~F.col("url").eqNullSafe(F.col("holder.url")))
    texts = twice.groupBy(F.col("digest").alias("of")).agg(F.min("html").alias("html"))
    with_text = marked.where(~F.col("revisit")).join(texts, F.col("digest") == F.col("of")).select(*columns, "revisit")
    without = marked.where("revisit").withColumn("html", F.lit(None).cast("string")).select(*columns, "revisit")
    return once.unionByName(with_text).unionByName(without)


def write(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Write archives under `path`; returns the written table of archives with their sizes."""
    planned = plan_records(pages, min_revisit)
    records = planned.withColumn("html", F.when(~F.col("revisit"), F.col("html")))

    def run(batches):
        context = TaskContext.get()
        files, root = _open(path)
        files.create_dir(root, recursive=True)
        number, out, size, name = 0, None, 0, None
        done = []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    # an attempt has files of its own: a lost or repeated one leaves none that are listed
                    name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{number:04d}.warc.gz"
                    out, size, number = files.open_output_stream(f"{root}/{name}", compression=None), 0, number + 1
                payload = None if row["revisit"] else (row["html"] or "").encode()
                data = _record(row["page_id"], row["url"], payload, row["size"], row["digest"], row["first_id"], row["revisit"])
                out.write(data)
                size += len(data)
                if size >= archive_bytes:
                    out.close()
                    done.append((name, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size))
        yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{n}" for n, _ in done], pa.string()), pa.array([s for _, s in done], pa.int64())], names=["archive", "bytes"])

    return store.written(records.mapInArrow(run, "archive string, bytes long"), "archives")


# ---------------------------------------------------------------- reading


def _headers(head: bytes) -> tuple[dict[str, str], int] | None:
    """A record's header fields and the length of the header, if `head` begins with a whole header."""
    if not head.startswith(b"WARC/"):
        return None
    end = head.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in head[:end].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[key.decode("latin1").lower()] = value.strip().decode("utf-8", "replace")
    return (fields, end + 4) if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


class Chunks:
    """Bytes of an open file from any position on, read in chunks and let go as the scan moves."""

    def __init__(self, source, size: int):
        self.source, self.size, self.low, self.held = source, size, 0, b""

    def take(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if at < self.low or at + n > self.low + len(self.held):
            self.low, self.held = at, self.source.read_at(max(n, min(CHUNK, self.size - at)), at)
        return self.held[at - self.low : at - self.low + n]


def _member(bytes_: Chunks, at: int):
    """Yields the inflated bytes of the gzip member at `at`, then its end; raises zlib.error where there is none."""
    packer, here = zlib.decompressobj(31), at
    while not packer.eof:
        raw = bytes_.take(here, HEAD)
        if not raw:
            raise zlib.error("cut short")
        yield packer.decompress(raw), None
        here += len(raw)
    yield b"", here - len(packer.unused_data)


def _valid(bytes_: Chunks, at: int):
    """The record that begins at `at`: fields, content, end; None if no record begins there."""
    try:
        parts = _member(bytes_, at)
        head, end = bytearray(), None
        # a header may be as long as its member; only what is new is searched for the header's end
        for data, end in parts:
            seen = max(0, len(head) - 3)
            head += data
            if head.find(b"\r\n\r\n", seen) >= 0 or end is not None or not b"WARC/".startswith(bytes(head[:5])):
                break
        found = _headers(bytes(head))
        if not found:
            return None
        content = [head]
        if end is None:
            for data, end in parts:
                content.append(data)
        fields, skip = found
        body = b"".join(content)[skip : skip + int(fields["content-length"])]
        return (fields, body, end) if end is not None and len(body) == int(fields["content-length"]) else None
    except zlib.error:
        return None


def records_in(source, size: int, low: int, high: int):
    """Fields and content of the records that start in [low, high) of a file."""
    bytes_, at = Chunks(source, size), low
    while at < high:
        # candidates must start before `high`; their magic may end after it
        block = bytes_.take(at, min(CHUNK, high - at + len(MAGIC) - 1))
        hit = block.find(MAGIC)
        if hit < 0:
            if len(block) < len(MAGIC):
                return
            at += len(block) - len(MAGIC) + 1
            continue
        record = _valid(bytes_, at + hit)
        if record is None:
            at += hit + 1
            continue
        yield record[0], record[1]
        at = record[2]


def read(spark: SparkSession, archives: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """All records of the listed archives (archive, bytes), read by byte ranges."""
    ranges = archives.where("bytes > 0").select("archive", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("low"))
    ranges = ranges.withColumn("high", F.least(F.col("bytes"), F.col("low") + range_bytes))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                files, name = _open(row["archive"])
                out, held = [], 0
                with files.open_input_file(name) as source:
                    for fields, body in records_in(source, row["bytes"], row["low"], row["high"]):
                        out.append(_row(fields, body))
                        held += len(body)
                        if held > 8 << 20:
                            yield _batch(out)
                            out, held = [], 0
                yield _batch(out)

    n = archives.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    return ranges.repartition(max(1, min(int(n), MOST_TASKS))).mapInArrow(run, RECORDS)


def _identity(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def _row(fields: dict[str, str], body: bytes) -> tuple:
    kind = fields["warc-type"]
    payload = None
    if kind == "response":
        payload = body[body.find(b"\r\n\r\n") + 4 :] if body.startswith(b"HTTP/") else body
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    else:
        size, digest = int(fields.get("warc-payload-length", "0")), fields.get("warc-payload-digest", "").partition(":")[2]
    return (_identity(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, _identity(fields.get("warc-refers-to")), size, digest, payload)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    return read(spark, write(pages, store.new_path(spark, "warc")))

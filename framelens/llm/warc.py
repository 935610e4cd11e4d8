"""WARC archives: a writer of one gzip member per record, and a splittable reader.

Writer. Of records with equal payloads of at least ``least_bytes`` bytes, the one with the smallest id is a
response; the others are revisits that name it and carry no payload. Each task writes its own file under a
name of its own (partition and attempt), and the list of files is a stored table, so that files of failed or
repeated attempts are never read. Paths go through pyarrow's file systems.

Reader. Files are cut into byte ranges, one row each; any task reads any range. It scans for the gzip magic,
takes an offset for a record only if the member there inflates, begins with a WARC version line, has a
well-formed header with Content-Length, holds that much and ends as the gzip trailer says, and owns the records that start inside its
range, however far they reach beyond it. Ranges without a record's start yield nothing, so every record is read
once whatever the range size. Memory is bounded by the largest record. (A payload that itself is a gzipped WARC
and was stored without compression could offer a false start; the writer's payloads are compressed, and UTF-8
text can't contain the magic bytes.)

Edge cases. A null payload is empty. A null id is written as such, read back as null and never is the one
referred to. Repeated rows of the smallest id are responses each. Null URLs have no target header; line breaks
in URLs are percent-encoded. Records that can't be validated are passed over. An empty table writes no file and
reads back empty. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import attach, bounded_batches, cut, shared_path

MAGIC = b"\x1f\x8b\x08"
READ_BYTES = 1 << 18
SPLIT_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("id", pa.int64()), ("url", pa.string()),
                    ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
RECORD_DDL = ("path string, offset long, record_type string, id long, url string, refers_to long, payload_digest string, "
              "payload_bytes long, payload binary")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:/", "file:///", 1))


def _urn(number: int | None) -> str:
    return f"<urn:page:{'' if number is None else number}>"


def _from_urn(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def encode_record(row: dict, date: str) -> bytes:
    """One record as a gzip member."""
    revisit = row["refers_to"] is not None
    payload = b"" if revisit else row["payload"]
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(row['id'])}", f"WARC-Date: {date}"]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + row["url"].replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{row['digest']}", f"X-Payload-Bytes: {row['bytes']}"]
    if revisit:
        head += [f"WARC-Refers-To: {_urn(row['refers_to'])}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + payload + b"\r\n\r\n") + pack.flush()


def decode_member(raw: bytes, more) -> tuple[dict, bytes, int] | None:
    """(header, payload, member length) of the record that begins ``raw``; ``more()`` gives further bytes, then b''."""
    unpack, out, used, body, size = zlib.decompressobj(31), bytearray(), 0, -1, 0
    head: dict[str, str] = {}
    try:
        while not unpack.eof:
            if not raw and not (raw := more()):
                return None
            out += unpack.decompress(raw)
            used += len(raw) - len(unpack.unused_data)
            raw = b""
            if body < 0:
                if not out[:7] == b"WARC/1."[:len(out[:7])]:
                    return None
                if (at := out.find(b"\r\n\r\n")) >= 0:
                    lines = out[:at].decode("utf-8", "surrogatepass").split("\r\n")[1:]
                    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                    body, size = at + 4, int(head["content-length"])
    except (zlib.error, ValueError, KeyError):
        return None
    if body < 0 or not 0 <= size <= len(out) - body:
        return None
    return head, bytes(out[body:body + size]), used


def read_range(path: str, start: int, end: int) -> Iterator[dict]:
    """The records of one file that start in [start, end)."""
    system, name = _open(path)
    with system.open_input_file(name) as f:
        length = f.size()
        end = min(end, length)
        buffer, base = b"", start  # ``buffer`` holds the file from ``base`` on

        def fill(upto: int) -> None:
            nonlocal buffer
            while base + len(buffer) < min(upto, length):
                buffer += f.read_at(min(READ_BYTES, length - base - len(buffer)), base + len(buffer))

        at = start
        while at < end:
            buffer, base = buffer[at - base:] if at <= base + len(buffer) else b"", at
            fill(at + READ_BYTES // 4)
            if (k := buffer.find(MAGIC)) < 0:
                at = base + max(1, len(buffer) - len(MAGIC) + 1)
                continue
            at = base + k
            if at >= end:
                return
            reach = base + len(buffer)

            def more() -> bytes:
                nonlocal reach
                got = f.read_at(min(READ_BYTES, length - reach), reach) if reach < length else b""
                reach += len(got)
                return got

            found = decode_member(buffer[k:], more)
            if found is None:
                at += 1
                continue
            head, payload, used = found
            url = head.get("warc-target-uri")
            digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
            yield {"path": path, "offset": at, "record_type": head.get("warc-type"), "id": _from_urn(head.get("warc-record-id")),
                   "url": url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
                   "refers_to": _from_urn(head.get("warc-refers-to")), "payload_digest": digest,
                   "payload_bytes": int(head.get("x-payload-bytes") or len(payload)), "payload": payload}
            at += used


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write (id, url, payload) rows; returns the stored list of files (path, bytes, records)."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("id").cast("long").alias("id"), "url", F.coalesce("payload", F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    same = cut(rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("id").alias("response"), F.count(F.lit(1)).alias("n"))
               .where("n > 1"), "equal-payloads")
    total = rows.select("id").count()
    marked = attach(rows, same, "digest", "n", total).withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("response")), F.col("response")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, path, size, records = TaskContext.get(), None, "", 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
                    system, name = _open(path)
                    system.create_dir(name.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(name, compression=None)
                member = encode_record(row, date)
                out.write(member)
                size, records = size + len(member), records + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [records]},
                                             schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    data = marked.select("id", "url", "payload", "digest", "bytes", "refers_to")
    return cut(data.mapInArrow(write, "path string, bytes long, records long"), "warc-files")


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of the archives in ``files`` (path, bytes)."""
    splits = files.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    n = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                for record in read_range(row["path"], row["start"], row["start"] + split_bytes):
                    held.append(record)
                    size += len(record["payload"])
                    if size > 1 << 22 or len(held) >= 500:
                        yield pa.RecordBatch.from_pylist(held, schema=RECORD)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=RECORD)

    return splits.repartition(int(n), "path", "start").mapInArrow(read, RECORD_DDL)


def list_archives(spark, path: str) -> DataFrame:
    """(path, bytes) of the archives below any path that Spark reads."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("length").alias("bytes"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) written as archives and read back, a row per page."""
    files = write_warc(pages.select(F.col("page_id").alias("id"), "url", F.encode("html", "UTF-8").alias("payload")),
                       shared_path(pages.sparkSession, "warc"))
    got = read_warc(files)
    own = F.col("record_type") == "response"
    return got.select(F.col("id").alias("page_id"), F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
                      F.when(own, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


#: The round trip's result in DuckDB.
SQL = """
WITH p AS (SELECT page_id, coalesce(encode(html), ''::BLOB) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to
FROM m
"""

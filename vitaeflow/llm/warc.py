"""A WARC writer and reader with dictionary compression.

Every row becomes one record, compressed as a Zstandard frame of its own, so any record can be read
without the ones before it. All frames use a dictionary trained from a sample of the records to be
archived; each archive carries it in a leading skippable frame (magic 0x184D2A5D) and can be read
alone. Of records with the same payload of at least ``MIN_SHARED_BYTES`` bytes, the one with the
smallest key holds it; the others are revisit records that name it.

Archives are written by the tasks to ``folder``, which driver and executors must share (any place
that pyarrow's filesystems reach). A task writes to a name of its own attempt and renames the
finished archive, so that a repeated task replaces whole archives.

Bounds: the dictionary is trained from at most ``TRAIN_RECORDS`` records and has at most
``DICTIONARY_BYTES``; a task holds one record and one batch of rows at a time.

Nulls and edge cases: a null payload is archived as empty; a null url is left out of the record; a
null key is always a response and never referred to; repeated rows that hold the smallest key are
all responses; control characters in urls are percent-encoded; payloads are never cut; an empty
table gives no archive and an empty result; other columns of the input are ignored. Archives stay where
they were written; ``read_archives`` gives the length of a response's payload as read, that of a
revisit's, which has none, as its header says.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from vitaeflow.llm.common import cut, read, shared_dir

MIN_SHARED_BYTES = 100
TRAIN_RECORDS = 500
DICTIONARY_BYTES = 64 << 10
#: An archive is closed when it has grown to this.
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
#: Rows' bytes that are handed over at once when archives are read.
OUT_BYTES = 4 << 20

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CAPTURED = "1970-01-01T00:00:00Z"


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; with ``refers_to`` a revisit without the payload."""
    revisit = refers_to is not None
    body = HTTP_HEAD if revisit else HTTP_HEAD + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"record:{key}:{digest}")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {CAPTURED}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%-._~"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{refers_to}:{digest}')}>", f"X-Refers-To-Key: {refers_to}"]
    if key is not None:
        head.append(f"X-Key: {key}")
    head += [f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers (lower-case names), the type and the payload (None for a revisit) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    length = int(fields["content-length"])
    body = rest[:length]
    if len(body) < length or rest[length:] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    kind = fields["warc-type"]
    payload = body.partition(b"\r\n\r\n")[2] if kind == "response" else None
    if payload is not None and "sha256:" + hashlib.sha256(payload).hexdigest() != fields["warc-payload-digest"]:
        raise ValueError("a payload doesn't have its digest")
    return {"fields": fields, "type": kind, "payload": payload}


def frame_length(view: memoryview, at: int) -> int:
    """Bytes of the Zstandard frame (or skippable frame) at ``at``; 0 if it isn't all there."""
    left = len(view) - at
    if left < 8:
        return 0
    (magic,) = struct.unpack_from("<I", view, at)
    if 0x184D2A50 <= magic <= 0x184D2A5F:
        size = 8 + struct.unpack_from("<I", view, at + 4)[0]
        return size if size <= left else 0
    if magic != FRAME_MAGIC:
        raise ValueError("not a Zstandard frame")
    flags = view[at + 4]
    single = flags >> 5 & 1
    place = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while place + 3 <= len(view):
        block = int.from_bytes(view[place : place + 3], "little")
        place += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            size = place + 4 * (flags >> 2 & 1) - at
            return size if size <= left else 0
    return 0


def train(samples: list[bytes]) -> bytes:
    """A dictionary from records; empty if they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) > 10 else b""
    except zstandard.ZstdError:
        return b""


class Writer:
    """Writes archives into a folder, closing each at ``ARCHIVE_BYTES``."""

    def __init__(self, folder: str, name: str, attempt: str, dictionary: bytes):
        self.fs, self.folder = pa.fs.FileSystem.from_uri(folder)
        self.name, self.attempt, self.dictionary = name, attempt, dictionary
        own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=True)
        self.done: list[tuple[str, int, int]] = []
        self.out, self.size, self.rows = None, 0, 0

    def put(self, raw: bytes) -> None:
        if self.out is None:
            self.final = f"{self.folder}/{self.name}-{len(self.done):05d}.warc.zst"
            self.out = self.fs.open_output_stream(f"{self.final}.{self.attempt}", compression=None)
            self.size, self.rows = self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(self.dictionary)) + self.dictionary), 0
        self.size += self.out.write(self.packer.compress(raw))
        self.rows += 1
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(f"{self.final}.{self.attempt}", self.final)
            self.done.append((self.final, self.rows, self.size))
            self.out = None


def records(folder: str, path: str) -> Iterator[dict]:
    """The records of an archive, read frame by frame."""
    fs, _ = pa.fs.FileSystem.from_uri(folder)
    with fs.open_input_stream(path, compression=None) as source:
        held, unpacker, ended = b"", None, False
        while not ended:
            more = source.read(OUT_BYTES)
            ended = not more
            held += more
            view, at = memoryview(held), 0
            while size := frame_length(view, at):
                frame = view[at : at + size]
                if unpacker is None:
                    if struct.unpack_from("<I", frame)[0] != DICTIONARY_MAGIC:
                        raise ValueError(f"{path} has no leading dictionary frame")
                    own = bytes(frame[8:])
                    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own) if own else None)
                else:
                    yield parse(unpacker.decompress(frame))
                at += size
            held = held[at:]
        if held:
            raise ValueError(f"{path} is cut off")


def _writing(folder: str, dictionary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer = Writer(folder, f"part-{task.partitionId():05d}", str(task.taskAttemptId()), dictionary.value)
        for batch in batches:
            for key, url, payload, digest, refers_to in zip(*(batch.column(k) for k in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                writer.put(record(key.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py()))
        writer.close()
        if writer.done:
            names, rows, sizes = zip(*writer.done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(rows, pa.int64()), pa.array(sizes, pa.int64())], names=["archive", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Archive all rows of ``pages`` (page_id, url, html) in ``folder``: (archive, records, bytes)."""
    fs, path = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("digest", F.sha2("payload", 256))
    # Only keys and digests take part in finding equal payloads; the payloads move once.
    light = keyed.filter((F.octet_length("payload") >= MIN_SHARED_BYTES) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = light.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter("last > refers_to").drop("last")
    revisits = light.join(first, "digest").filter(F.col("page_id") > F.col("refers_to")).distinct()
    planned = keyed.join(revisits, ["page_id", "digest"], "left")
    # The sample's keys are chosen first, so that no task sends payloads that aren't in it.
    chosen = rows.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(TRAIN_RECORDS).distinct()
    taken = keyed.join(F.broadcast(chosen), "page_id").select("page_id", "url", F.substring("payload", 1, 16 << 10).alias("payload"), "digest")
    sample = [record(r.page_id, r.url, bytes(r.payload), r.digest, None) for r in taken.limit(TRAIN_RECORDS).collect()]
    dictionary = pages.sparkSession.sparkContext.broadcast(train(sample))
    ordered = planned.sortWithinPartitions("page_id", "digest", "url")
    return cut(ordered.mapInArrow(_writing(folder, dictionary), "archive string, records long, bytes long"))


def _reading(folder: str):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                rows, size = [], 0
                for x in records(folder, path):
                    f = x["fields"]
                    length = int(f["x-payload-length"]) if x["payload"] is None else len(x["payload"])
                    rows.append((number(f.get("x-key")), f.get("warc-target-uri"), length, f["warc-payload-digest"].removeprefix("sha256:"), x["type"], number(f.get("x-refers-to-key")), x["payload"]))
                    size += len(x["payload"] or b"") + 100
                    if size >= OUT_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """A row for every record of ``archives`` (archive): the columns of the record and its payload."""
    spread = archives.select("archive").repartition(archives.sparkSession.sparkContext.defaultParallelism, "archive")
    return spread.mapInArrow(
        _reading(folder), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    )


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, then read the archives back."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    back = read_archives(write_archives(read(spark, sf_dir, "pages"), folder), folder)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = {
    "op2_warc_archive": f"""
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= {MIN_SHARED_BYTES} GROUP BY d)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first < p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON f.d = p.d AND n >= {MIN_SHARED_BYTES}
"""
}
QUERIES = {"op2_warc_archive": op2_warc_archive}

"""WARC archives: one gzip member per record, and a reader that splits files at any byte."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reapline.llm.common import durable, file_system, rows_of, shared_folder

GZIP = b"\x1f\x8b\x08"
SPLIT_BYTES = 4 << 20  # range of a file that one task owns
STEP = 64 << 10  # bytes read at a time
NO_PAGE = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value: the profile of identical payloads


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as one gzip member; a revisit has the response's head and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = "".join(c for c in url or "" if c.isprintable())
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {target} {len(payload)}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"X-Page: {NO_PAGE}{'' if page_id is None else page_id}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{NO_PAGE}{refers_to}>"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    data = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"
    return packer.compress(data) + packer.flush()


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes one archive under a name of this attempt; emits its name and size."""
    system, root = file_system(folder)
    context = TaskContext.get()
    name = f"{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
    system.create_dir(root, recursive=True)
    size = 0
    with system.open_output_stream(f"{root}/{name}", compression=None) as out:
        for page_id, url, html, refers_to, revisit in rows_of(batches, ("page_id", "url", "html", "refers_to", "revisit")):
            data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to, revisit)
            out.write(data)
            size += len(data)
    yield pa.record_batch([pa.array([name]), pa.array([size], pa.int64())], ["file", "size"])


def write_archives(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> tuple[str, DataFrame]:
    """Writes a record per row of ``pages`` (page_id, url, html); returns the folder and its durable list of files.

    Of records with equal payloads of at least ``min_bytes`` bytes, the one with the
    largest page id is the response and the others revisit it.  The largest id per payload
    digest is an aggregate made below the shuffle; pages meet it in a join, whose skewed
    keys Spark splits.  Archives are named by attempt; only files of attempts that count are listed.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    source = source.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    several = source.select("sha", "page_id").groupBy("sha").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null").select("sha", "last")
    revisit = F.col("last").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") < F.col("last")) & (F.octet_length("html") >= min_bytes)
    rows = source.join(several, "sha", "left").withColumn("revisit", F.coalesce(revisit, F.lit(False)))
    rows = rows.select("page_id", "url", "html", F.when(F.col("revisit"), F.col("last")).alias("refers_to"), "revisit")
    return folder, durable(rows.mapInArrow(partial(_write, folder=folder), "file string, size long"))


class _Stream:
    """Bytes of a file from some place on, read a step at a time; forgets what lies behind."""

    def __init__(self, source, start: int):
        self.source, self.begin, self.data, self.done = source, start, b"", False
        source.seek(start)

    def more(self) -> bool:
        part = b"" if self.done else self.source.read(STEP)
        self.done = not part
        self.data += part
        return bool(part)

    def at(self, place: int, n: int) -> bytes:
        while len(self.data) < place - self.begin + n and self.more():
            pass
        return self.data[place - self.begin : place - self.begin + n]

    def forget(self, place: int) -> None:
        self.data = self.data[place - self.begin :]
        self.begin = place


def _member(stream: _Stream, start: int) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at ``start``, or None if none with a record's head is there."""
    inflater = zlib.decompressobj(31)
    out, place, known = [], start, False
    while not inflater.eof:
        part = stream.at(place, STEP)
        if not part:
            return None
        try:
            out.append(inflater.decompress(part))
        except zlib.error:
            return None
        place += len(part)
        if not known and sum(map(len, out)) >= 7:
            if not b"".join(out).startswith(b"WARC/1."):
                return None
            known = True
    content = b"".join(out)
    return (content, place - len(inflater.unused_data)) if content.startswith(b"WARC/1.") else None


def records(source, start: int, end: int) -> Iterator[bytes]:
    """Contents of the members that begin in [start, end) of an open file.

    From ``start`` on, every gzip magic is a candidate; it counts if it inflates, checksum
    included, to something with a record's head.  After a member the next one is looked for at its end, so
    magic bytes inside a member are only met before the range's first member.
    """
    stream, place = _Stream(source, start), start
    while place < end:
        window = stream.at(place, STEP + len(GZIP))
        if not window:
            return
        found = window.find(GZIP)
        if found < 0:
            place += max(1, len(window) - len(GZIP) + 1)
            stream.forget(place)
            continue
        place += found
        if place >= end:
            return
        member = _member(stream, place)
        if member is None:
            place += 1
        else:
            yield member[0]
            place = member[1]
        stream.forget(place)


def parse_record(content: bytes) -> dict:
    """Headers and payload of one record; the stated lengths are checked."""
    head, _, rest = content.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    kind, written = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if rest[len(block) :] != b"\r\n\r\n" or kind == "response" and (len(payload) != stated or digest(payload) != written):
        raise ValueError("damaged record")
    page = headers["X-Page"].removeprefix(NO_PAGE)
    refers = headers.get("WARC-Refers-To", "").strip("<>").removeprefix(NO_PAGE)
    return {"page_id": int(page) if page else None, "payload_bytes": stated, "payload_digest": written, "record_type": kind, "refers_to": int(refers) if refers else None,
            "url": headers["WARC-Target-URI"], "payload": payload if kind == "response" else None}


def _read(batches: Iterator[pa.RecordBatch], folder: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    system, root = file_system(folder)
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "payload": pa.binary()}
    schema = pa.schema([(c, types[c]) for c in columns])
    for batch in batches:
        for part in batch.to_pylist():
            held, size = [], 0
            with system.open_input_file(f"{root}/{part['file']}") as source:
                for content in records(source, part["start"], part["end"]):
                    row = parse_record(content)
                    held.append({c: row[c] for c in columns})
                    size += len(content) if "payload" in columns else 200
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
            yield pa.RecordBatch.from_pylist(held, schema=schema)


READ = {"page_id": "long", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long", "url": "string", "payload": "binary"}


def read_archives(folder: str, files: DataFrame, columns: tuple[str, ...] = tuple(READ), split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of all archives, each file read in ranges of ``split_bytes`` by different tasks."""
    ranges = files.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("file", "start", F.least(F.col("start") + split_bytes, F.col("size")).alias("end"))
    dealt = ranges.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "start")
    return dealt.mapInArrow(partial(_read, folder=folder, columns=list(columns)), ", ".join(f"{c} {READ[c]}" for c in columns))


def archive_table(pages: DataFrame, min_bytes: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every page, read back from its archives.

    A null html is an empty payload, a null address an empty one.  Rows with a null
    page id are responses with a null id.  Rows repeating both the largest id and the
    payload are responses each.  Long pages are one record; other columns are ignored; an empty table gives no row.
    """
    folder, files = write_archives(pages, min_bytes)
    return read_archives(folder, files, ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), split_bytes)

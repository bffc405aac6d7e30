"""Token-id files of directly addressable codes.

A file is a run of segments.  A segment holds whole documents, each id split into levels
of 8 bits: level 0 has the low byte of every token, level 1 the next byte of the tokens
that need one, and so on.  One bit per entry of a level says whether the token goes on in
the next level, and a rank directory counts the set bits before every 512th entry, so the
place of any token in any level, and with it its id, is found without decoding others.

Segment: ``DACS``, little-endian uint32 counts (documents, tokens, levels), doc ids
(int64), first token of each document and the end (uint32), then per level its entry count
(uint32), bytes, bitmap and rank directory (uint32).
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from reapline.llm.common import CACHES, durable, file_system, shared_folder, use

SEGMENT_TOKENS = 1 << 20
RANK_STEP = 512
CACHE_PIECES = 400_000
MAGIC = b"DACS"


def byte_spelling() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: bytes spelled as themselves
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Pieces(dict):
    """Ids of the words of texts as little-endian uint32 bytes, each made by the tokenizer once.

    A byte-level tokenizer first cuts a text into runs of letters, digits, signs or blanks,
    a single blank going with the run after it, and merges only inside a run.  So a text
    cut before each single blank between two signs has the ids of its pieces, end to end.
    Words of letters, perhaps with a comma or stop behind or a line break inside, go run by
    run to the tokenizer's model; any other word, and any text with blanks at a word's
    edge, goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        CACHES.append(self)
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.run_ids = self.tokenizer.model.tokenize
        self.plain = {c: self.whole(c) for c in (",", ".", "\n")}
        self.spelling = [sign for _, sign in sorted((b, s) for s, b in byte_spelling().items())]
        self.blank = self.spelling[32]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def run(self, letters: str) -> bytes:
        """Ids of one run of letters, perhaps after a blank."""
        if letters.isascii():
            spelled = letters.replace(" ", self.blank)
        else:
            spelled = "".join(map(self.spelling.__getitem__, letters.encode()))
        ids = [t.id for t in self.run_ids(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, word: str, blank: str = " ") -> bytes | None:
        """Ids of a word after ``blank``; None if the word has blanks at an edge."""
        if word.isalpha():
            return self.run(blank + word)
        if word[-1:] in (",", ".") and word[:-1].isalpha():
            return self.run(blank + word[:-1]) + self.plain[word[-1]]
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        left, line, right = word.partition("\n")
        if line and not left[-1].isspace() and not right[0].isspace() and "\n" not in right and right[0].isalpha():
            ends = self.word(left, blank), self.word(right, "")
            if None not in ends:
                return self.plain["\n"].join(ends)
        return self.whole(blank + word)

    def __missing__(self, word: str) -> bytes | None:
        if len(self) >= CACHE_PIECES:  # short words come again, long ones hardly
            short = {w: ids for w, ids in self.items() if len(w) <= 7}
            self.clear()
            if len(short) <= CACHE_PIECES // 2:
                self.update(short)
        self[word] = ids = self.word(word)
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text."""
        first, *rest = text.split(" ")
        start = self.word(first, "")
        if start is None:
            return self.whole(text)
        try:
            return start + b"".join(map(self.__getitem__, rest))
        except TypeError:  # a None: blanks at the edge of a word
            return self.whole(text)


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def pack(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels (bytes, bitmap, rank directory) of an array of ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        goes_on = rest > 0xFF
        bitmap = np.packbits(goes_on, bitorder="little")
        counts = np.add.reduceat(goes_on, np.arange(0, len(rest), RANK_STEP), dtype=np.int64) if len(rest) else np.zeros(0, np.int64)
        levels.append(((rest & 0xFF).astype(np.uint8), bitmap, np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4") if len(counts) else np.zeros(0, "<u4")))
        rest = rest[goes_on] >> 8
        if not len(rest):
            return levels


def segment(docs: list[int | None], parts: list[bytes]) -> bytes:
    """Bytes of one segment; a null document id is stored as the smallest int64."""
    ids = np.frombuffer(b"".join(parts), "<u4")
    firsts = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype("<u4")
    levels = pack(ids)
    out = [MAGIC, struct.pack("<III", len(docs), len(ids), len(levels)), np.array([-(1 << 63) if d is None else d for d in docs], "<i8").tobytes(), firsts.tobytes()]
    for low, bitmap, rank in levels:
        out += [struct.pack("<I", len(low)), low.tobytes(), bitmap.tobytes(), rank.tobytes()]
    return b"".join(out)


class Segment:
    """Random access to the tokens of one segment."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        n_docs, self.n_tokens, n_levels = struct.unpack_from("<III", data, 4)
        at = 16
        self.docs = np.frombuffer(data, "<i8", n_docs, at)
        at += 8 * n_docs
        self.firsts = np.frombuffer(data, "<u4", n_docs + 1, at)
        at += 4 * (n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<I", data, at)
            low = np.frombuffer(data, np.uint8, n, at + 4)
            bitmap = np.frombuffer(data, np.uint8, (n + 7) // 8, at + 4 + n)
            at += 4 + n + len(bitmap)
            rank = np.frombuffer(data, "<u4", -(-n // RANK_STEP), at)
            at += rank.nbytes
            self.levels.append((low, bitmap, rank))

    def token(self, place: int) -> int:
        """One id: a byte per level, the next place by rank."""
        value = 0
        for k, (low, bitmap, rank) in enumerate(self.levels):
            value |= int(low[place]) << (8 * k)
            if not bitmap[place >> 3] >> (place & 7) & 1:
                break
            block = place // RANK_STEP
            bits = np.unpackbits(bitmap[block * RANK_STEP // 8 : (place >> 3) + 1], bitorder="little")
            place = int(rank[block]) + int(bits[: place - block * RANK_STEP].sum())
        return value

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids of a stretch: on each level only the stretch's own entries are read."""
        value = np.zeros(end - start, np.uint32)
        where = np.arange(end - start)
        for k, (low, bitmap, rank) in enumerate(self.levels):
            if end <= start:
                break
            value[where] |= low[start:end].astype(np.uint32) << (8 * k)
            block = start // RANK_STEP
            bits = np.unpackbits(bitmap[block * RANK_STEP // 8 : (end + 7) // 8], bitorder="little")
            before = start - block * RANK_STEP
            own = bits[before : before + end - start].astype(bool)
            start = int(rank[block]) + int(bits[:before].sum())
            end, where = start + int(own.sum()), where[own]
        return value


WRITTEN = "part long, file string, segment int, at long, bytes long, first_doc long, docs long, tokens long"


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Writes one file of a sorted partition, under a name of this attempt; emits its segments."""
    pieces, tail = _pieces(path), struct.pack("<I", end_id)
    use(pieces)
    system, root = file_system(folder)
    context = TaskContext.get()
    name = f"{context.partitionId():06d}-{context.taskAttemptId()}.dac"
    system.create_dir(root, recursive=True)
    rows, docs, parts, held, at = [], [], [], 0, 0
    with system.open_output_stream(f"{root}/{name}", compression=None) as out:
        def flush():
            nonlocal docs, parts, held, at
            data = segment(docs, parts)
            out.write(data)
            rows.append((context.partitionId(), name, len(rows), at, len(data), docs[0], len(docs), held))
            docs, parts, held, at = [], [], 0, at + len(data)

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = (pieces.encode(text) if text else b"") + tail
                    docs.append(doc)
                    parts.append(ids)
                    held += len(ids) // 4
                    if held >= SEGMENT_TOKENS:
                        flush()
        if docs:
            flush()
    columns = list(zip(*rows)) or [[]] * 8
    types = (pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 5)
    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["part", "file", "segment", "at", "bytes", "first_doc", "docs", "tokens"])


def write_token_files(documents: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> tuple[str, DataFrame]:
    """Writes the ids of all documents in ascending doc_id order; returns the folder and its manifest.

    The manifest has a row per segment (file, place, size, first document, counts, and
    ``start``: the ids of all documents before it) and is durable.  A task writes a file
    of its own attempt, so a repeated task never touches a file in use, and only files of
    the attempts that count are listed.  Rows repeating an id follow one another, by text;
    null ids come first; a null text is an empty one and has the end id alone.
    """
    folder = folder or shared_folder(documents.sparkSession, "tokens")
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shuffled = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.repartitionByRange(shuffled, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    written = durable(ordered.mapInArrow(partial(_write, folder=folder, path=tokenizer, end_id=end_id), WRITTEN))
    # one row per segment of a million ids: segments are summed per file, files in one short list
    files = written.groupBy("part", "file").agg(F.sum("tokens").alias("n"))
    before = files.withColumn("file_start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "file_start")
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    manifest = written.join(before, "part").withColumn("start", F.col("file_start") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).drop("file_start")
    return folder, durable(manifest)


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    system, root = file_system(folder)
    for batch in batches:
        for row in batch.to_pylist():
            with system.open_input_file(f"{root}/{row['file']}") as source:
                source.seek(row["at"])
                found = Segment(source.read(row["bytes"]))
            crcs = [zlib.crc32(found.tokens(int(a), int(b)).astype("<u4").tobytes()) for a, b in zip(found.firsts[:-1], found.firsts[1:])]
            firsts = found.firsts.astype(np.int64)
            yield pa.record_batch([
                pa.array(found.docs, mask=found.docs == -(1 << 63)), pa.array(row["start"] + firsts[:-1]), pa.array(np.diff(firsts)), pa.array(crcs, pa.int64())
            ], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(folder: str, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files, a segment at a time."""
    shuffled = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = manifest.select("file", "at", "bytes", "start").repartition(shuffled, "file", "at")
    return dealt.mapInArrow(partial(_read, folder=folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(documents: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the token files of ``documents`` and describes each document as read back from them."""
    return read_token_files(*write_token_files(documents, tokenizer, end_id))

"""Helpers shared by the operators of this package: tables, the shared folder, words, word hashes, folds."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reapline.session import CHECKPOINT_KEY, durable

__all__ = ["durable", "table", "shared_folder", "file_system", "held_out", "use", "CACHES", "byte_words", "WordHashes", "mix", "groups", "rows_of"]

# Words are runs of anything but the ASCII blanks, in Python: bytes.split() without an argument.
WORD = r"[^\x20\x09-\x0D]+"
CACHE_WORDS = 200_000
CACHES: list = []  # what Python workers remember between tasks; each has clear()


def use(cache) -> None:
    """Forget what other operators remembered in this worker, so that their caches do not add up."""
    for other in CACHES:
        if other is not cache:
            other.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """Address of a new, not yet existing folder below ``spark.checkpoint.dir``.

    Files written there by tasks are seen by all executors.  Where the setting is absent
    (tests on one machine) a temporary folder becomes the checkpoint folder.
    """
    durable(spark.range(0))
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY) or spark.sparkContext.getCheckpointDir()
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + os.path.abspath(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(address: str):
    """(file system, path) of an address as tasks open it: local, HDFS or an object store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("file:///" + address[5:].lstrip("/") if address.startswith("file:") else address)


def held_out(doc_id: str = "doc_id") -> Column:
    """Fold of a document: crc32 of its id as text, modulo 3, is 1.  A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def byte_words(text: str | bytes | None) -> list[bytes]:
    """Words of a text, or of its UTF-8 bytes, with A-Z (and nothing else) lower-cased."""
    data = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return data.lower().split()


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rows_of(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[tuple]:
    """Rows of a stream of batches, converted a few hundred at a time so that long texts never pile up."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield from zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns))


def groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of every run of equal keys in a sorted stream; holds one group at a time."""
    current, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        changes = np.zeros(batch.num_rows, bool)
        changes[0] = True
        for c in columns:
            changes[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(changes)
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            key = tuple(c[start] for c in columns)
            if key != current:
                if parts:
                    yield current, pa.Table.from_batches(parts)
                current, parts = key, []
            parts.append(batch.slice(start, end - start))
    if parts:
        yield current, pa.Table.from_batches(parts)

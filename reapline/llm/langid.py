"""Language identification by compression: the dictionary that makes a text smallest names its language."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from reapline.llm.common import held_out, rows_of

DICTIONARY_BYTES = 32 << 10  # raw text of one language's dictionary, at most
TRAINING_TEXTS = 400  # texts that a dictionary is cut from, at most
TEXT_BYTES = 1024  # bytes that one training text gives to its dictionary, at most
LANGUAGES = 512  # learned languages, at most
MARGIN = 0.01  # relative gain over the next language below which a prediction is marked as narrow
UNKNOWN = "und"


_LETTERS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def normal(text: str) -> bytes:
    """The words of a whole text: small letters, no ASCII signs or digits, a word's immediate repeats once."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()
    return b" ".join(w for w, last in zip(words, [b"", *words]) if w != last)


def excerpt(text: str) -> bytes:
    """The first ``TEXT_BYTES`` of a text at most, cut at a blank near the end or else at a character."""
    data = normal(text)
    if len(data) <= TEXT_BYTES:
        return data
    cut = data.rfind(b" ", TEXT_BYTES * 3 // 4, TEXT_BYTES + 1)
    if cut < 0:  # a script without blanks, or a very long word
        cut = TEXT_BYTES
        while data[cut] & 0xC0 == 0x80:
            cut -= 1
    return data[:cut]


def _excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of the chosen training texts."""
    for rank, lang, text in rows_of(batches, ("rank", "lang", "text")):
        data = excerpt(text)
        yield pa.record_batch([pa.array([lang]), pa.array([rank], pa.int64()), pa.array([data])], ["lang", "rank", "data"])


def dictionaries(documents: DataFrame) -> dict[str, bytes]:
    """Raw dictionary content per language, from texts outside the held-out fold whose language is known.

    The first ``TRAINING_TEXTS`` distinct texts of each language by hash are taken, so
    Spark keeps that many rows per language and task; what reaches the driver is at most
    ``DICTIONARY_BYTES`` for each of at most ``LANGUAGES`` languages.  Common words of a
    language occur in any such sample; the last texts of a dictionary are the cheapest
    to refer to.
    """
    rows = documents.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("_hash"))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("_hash", "text"))).where(F.col("rank") <= TRAINING_TEXTS)
    names = first.select("lang").distinct().limit(LANGUAGES + 1).count()
    if names > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    parts: dict[str, list[bytes]] = {}
    for row in first.mapInArrow(_excerpts, "lang string, rank long, data binary").orderBy("lang", "rank").toLocalIterator():
        held = parts.setdefault(row.lang, [])
        if row.data and bytes(row.data) not in held and sum(map(len, held)) + len(row.data) <= DICTIONARY_BYTES:
            held.append(bytes(row.data))
    return {lang: b" ".join(reversed(held)) for lang, held in sorted(parts.items()) if held}


class Identifier:
    def __init__(self, content: dict[str, bytes]):
        self.names = sorted(content)
        self.compressors = []
        # a greedy search of short matches: it finds the words of the dictionary, at little cost
        settings = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_GREEDY, min_match=4, window_log=18, hash_log=16, chain_log=16, search_log=4, target_length=16,
            write_content_size=False, write_checksum=False, write_dict_id=False)
        for name in self.names:
            dictionary = zstandard.ZstdCompressionDict(content[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=settings)
            self.compressors.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=dictionary))

    def sizes(self, text: str) -> list[int]:
        """Compressed size of the whole text with each dictionary."""
        data = normal(text)
        return [len(c.compress(data)) for c in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin); the score is a softmax of sizes, the margin the relative gain over the next best."""
        if not text or not any(map(str.isalpha, text)) or not self.names:
            return UNKNOWN, 0.0, 0.0
        sizes = np.array(self.sizes(text), float)
        best = int(sizes.argmin())
        if len(sizes) == 1:
            return self.names[0], 1.0, 1.0
        margin = (np.partition(sizes, 1)[1] - sizes[best]) / sizes[best]
        gains = np.exp(-100 * (sizes - sizes[best]) / sizes[best])
        return self.names[best], float(1 / gains.sum()), float(margin)


def _identify(batches: Iterator[pa.RecordBatch], content) -> Iterator[pa.RecordBatch]:
    machine = Identifier(content.value)
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            names, scores, margins = zip(*(machine.predict(t.as_py()) for t in part.column(1)))
            margins = np.array(margins)
            yield pa.record_batch(
                [part.column(0), pa.array(names), pa.array(scores, pa.float64()), pa.array(margins), pa.array((margins < MARGIN) & (np.array(names) != UNKNOWN))],
                ["doc_id", "lang_pred", "score", "margin", "narrow"])


def identify(documents: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, margin, narrow`` of every document.

    Each whole text, as small letters without signs, is compressed with a dictionary per learned language; the smallest
    result wins, ties go to the first name.  ``narrow`` marks predictions whose gain over
    the next language is below ``MARGIN``, to be rejected where certainty is wanted.  Null
    texts and texts without a letter are ``und`` with score 0, and so is everything if no
    language could be learned.  Null ids are predicted too, repeated rows alike; other
    columns are ignored; an empty table gives no row.
    """
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    content = documents.sparkSession.sparkContext.broadcast(dictionaries(documents.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))))
    found = source.mapInArrow(partial(_identify, content=content), "doc_id long, lang_pred string, score double, margin double, narrow boolean")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "narrow")

"""Links between the tokens of two tokenizers over a corpus, counted in inverted pair bitmaps.

Both tokenizers cut the same bytes; a token of one and a token of the other are linked where
they end together.  Documents are numbered inside blocks.  Per pair of linked ids and block, a bitmap
tells which documents of the block hold the link, and multiplicity planes tell, bit by bit, how many
times more than once.  Bitmaps are sorted 16-bit places while sparse and 65,536 bits when dense.
Tasks emit bitmaps of the stretches of documents they hold in memory; those of one pair, block and
plane are OR-merged, and popcounts give document counts and link counts.  The postings then
carry each pair's counts back to the documents of a block.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reapline.llm.common import CACHES, shared_folder, use
from reapline.llm.sentencepieces import BLANK, BYTE, piece_model
from reapline.llm.tokens import byte_spelling

BLOCK_DOCS = 1 << 16  # documents of a block, numbered by 16 bits
DENSE = 4096  # places from which on a bitmap is smaller than a list
STRETCH_WORDS = 2_000_000  # words held before their bitmaps leave the task
CACHE_WORDS = 300_000
CACHE_CHARS = 30_000_000
HELD = -1  # plane of the document bitmap; plane k has bit k of (occurrences - 1)
UNSAFE, BROKEN = -1, -2  # a word that cannot be encoded by itself; a stretch whose token bytes differ from its own


class Aligner(dict):
    """Place of each word among the aligned words in memory; a word is encoded with the blank before it."""

    def __init__(self, byte_path: str, piece_path: str):
        super().__init__()
        CACHES.append(self)
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        model = piece_model(piece_path)
        self.plain = model.plain and self.a.normalizer is None
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        spelled = byte_spelling()
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(map(spelled.__getitem__, token))
        self.b_bytes = [bytes([model.byte_of[i]]) if t == BYTE else p.replace(BLANK, " ").encode() for i, (p, t) in enumerate(zip(model.pieces, model.types))]
        self.a_size, self.b_size = np.array(list(map(len, self.a_bytes))), np.array(list(map(len, self.b_bytes)))
        self.texts = [f"{i}{mark}" for size, marks in ((len(self.a_size), ",|"), (len(self.b_size), ",;")) for mark in marks for i in range(size)]
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.chars, self.waiting = 0, []
        self.strings, self.pairs, self.counts = [], [], []

    @property
    def full(self) -> bool:
        return len(self.strings) >= CACHE_WORDS or self.chars >= CACHE_CHARS

    def shrink(self) -> None:
        """Keeps short words, which come again; long ones hardly do."""
        kept = [(w, p, self.strings[p], self.pairs[p], self.counts[p]) for w, p in self.items() if p >= 0 and len(w) <= 7]
        self.clear()
        if len(kept) <= CACHE_WORDS // 2:
            self.update({k[0]: place for place, k in enumerate(kept)})
            self.strings, self.pairs, self.counts = ([k[c] for k in kept] for c in (2, 3, 4))
            self.chars = sum(len(k[0]) + 40 for k in kept)

    def link(self, a: list[list[int]], b: list[list[int]]) -> list[tuple[str, bytes, tuple[int, int, int]]]:
        """Groups (each with a mark behind), linked pairs and counts of pairs of encodings; both of a pair cover the same bytes.

        All are laid end to end, so that one search finds the shared ends of all.
        """
        sizes_a, sizes_b = np.array(list(map(len, a))), np.array(list(map(len, b)))
        ids_a, ids_b = np.fromiter(chain.from_iterable(a), np.int64, sizes_a.sum()), np.fromiter(chain.from_iterable(b), np.int64, sizes_b.sum())
        ends_a, ends_b = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b])
        at = np.minimum(np.searchsorted(ends_b, ends_a), len(ids_b) - 1)
        closes_a = ends_b[at] == ends_a
        shared_a = np.flatnonzero(closes_a)
        shared_b = at[shared_a]
        closes_b = np.zeros(len(ids_b), bool)
        closes_b[shared_b] = True
        last_a, last_b = np.cumsum(sizes_a) - 1, np.cumsum(sizes_b) - 1
        if not (ends_a[last_a] == ends_b[last_b]).all():
            raise ValueError("the tokenizers do not cover the same bytes")
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        codes = np.empty(len(ids_a) + len(ids_b), np.int64)
        codes[np.arange(len(ids_a)) + np.concatenate([[0], shared_b + 1])[group_a]] = ids_a + closes_a * len(self.a_size)
        codes[np.arange(len(ids_b)) + shared_a[group_b] + 1] = 2 * len(self.a_size) + ids_b + closes_b * len(self.b_size)
        texts = list(map(self.texts.__getitem__, codes.tolist()))
        cuts = [0, *np.cumsum(sizes_a + sizes_b).tolist()]
        pairs = ids_a[shared_a] << 32 | ids_b[shared_b]
        links = np.concatenate([[0], (group_a + closes_a)[last_a]])
        counts = zip(sizes_a.tolist(), sizes_b.tolist(), np.diff(links).tolist())
        links = links.tolist()
        return [("".join(texts[i:j]), pairs[k:m].tobytes(), n) for i, j, k, m, n in zip(cuts, cuts[1:], links, links[1:], counts)]

    def __missing__(self, word: str) -> int:
        """Gives an unknown word its place; ``learn`` fills it."""
        if not word or BLANK in word or word[0].isspace() or word[-1].isspace():
            place = UNSAFE
        else:
            place = len(self.strings)
            self.strings.append("")
            self.waiting.append((place, word))
            self.chars += len(word) + 40
        self[word] = place
        return place

    def learn(self) -> None:
        """Encodes the words that have a place and no tokens yet, all in one call.

        A byte-level tokenizer without normaliser, and a plain piece model given no sign that stands
        for a blank, lose no byte of a word.
        """
        words = [w for _, w in self.waiting]
        self.pairs += [b""] * (len(self.strings) - len(self.pairs))
        self.counts += [(0, 0, 0)] * (len(self.strings) - len(self.counts))
        if words:
            encoded = self.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False)
            found = self.link([x.ids for x in encoded], self.b.encode(words, num_threads=1))
            for (place, _), (string, pairs, counts) in zip(self.waiting, found):
                self.strings[place], self.pairs[place], self.counts[place] = string, pairs, counts
        self.waiting = []

    def stretch(self, text: str) -> int:
        """A text, or a part of it cut before single blanks, that is not remembered; BROKEN if tokens have other bytes."""
        a, b, data = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), b" " + text.encode("utf-8", "surrogatepass")
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return BROKEN
        self.chars += len(text) + 40
        string, pairs, counts = self.link([a], [b])[0]
        self.strings.append(string)
        self.pairs.append(pairs)
        self.counts.append(counts)
        return len(self.strings) - 1

    def places(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Places of the words of each text; None for a text without tokens, or whose tokens' bytes are not its own."""
        out, odd = [], {}
        for text in texts:
            found = list(map(self.__getitem__, text.split(" "))) if text and self.plain else []
            if text and (not self.plain or UNSAFE in found):
                if self.plain:  # blanks in a row or other blanks beside them: cut only before single ones
                    first, *rest = re.split(r"(?<=\S) (?=\S)", " " + text)
                    odd[len(out)] = [(p, UNSAFE if " " in p else self[p]) for p in (first[1:], *rest)]
                else:
                    odd[len(out)] = [(text, UNSAFE)]
            out.append(np.array(found, np.int64) if found else None)
        self.learn()
        for k, parts in odd.items():
            found = [self.stretch(part) if place == UNSAFE else place for part, place in parts]
            out[k] = None if BROKEN in found else np.array(found, np.int64)
        return out


@lru_cache(maxsize=1)
def _aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def pack_places(places: np.ndarray) -> bytes:
    """A container: sorted 16-bit places, or 65,536 bits (8,192 bytes) from ``DENSE`` places on."""
    if len(places) < DENSE:
        return places.astype("<u2").tobytes()
    bits = np.zeros(BLOCK_DOCS, bool)
    bits[places] = True
    return np.packbits(bits, bitorder="little").tobytes()


def unpack_places(data: bytes) -> np.ndarray:
    if len(data) < BLOCK_DOCS // 8:
        return np.frombuffer(data, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))


def or_merge(containers: list[bytes]) -> bytes:
    if sum(map(len, containers)) < BLOCK_DOCS // 8:
        return pack_places(np.unique(np.concatenate([np.frombuffer(c, "<u2") for c in containers])))
    bits = np.zeros(BLOCK_DOCS, bool)
    for c in containers:
        bits[unpack_places(c)] = True
    return pack_places(np.flatnonzero(bits))


WRITTEN = pa.schema([
    ("block", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("pair", pa.int64()), ("plane", pa.int32()), ("bits", pa.binary()),
])
WRITTEN_SQL = "block long, place int, doc_id long, n_a long, n_b long, n_links long, groups_sha256 string, pair long, plane int, bits binary"


def _batch(columns: dict, rows: int) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in WRITTEN], schema=WRITTEN)


def _containers(block: int, pair: np.ndarray, place: np.ndarray, plane: int) -> Iterator[pa.RecordBatch]:
    """Rows of one plane; entries are sorted by pair and place."""
    starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([starts, [len(pair)]]))
    for k in np.flatnonzero(sizes >= DENSE).tolist():
        yield _batch({"block": [block], "pair": [int(pair[starts[k]])], "plane": [plane], "bits": [pack_places(place[starts[k] : starts[k] + sizes[k]])]}, 1)
    sparse = np.flatnonzero(sizes < DENSE)
    for first in range(0, len(sparse), 50_000):
        rows = sparse[first : first + 50_000]
        spans = sizes[rows]
        offsets = np.concatenate([[0], np.cumsum(spans)])
        taken = np.repeat(starts[rows] - offsets[:-1], spans) + np.arange(offsets[-1])
        bits = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((offsets * 2).astype(np.int32).tobytes()), pa.py_buffer(place[taken].astype("<u2").tobytes())])
        yield _batch({"block": np.full(len(rows), block), "pair": pair[starts[rows]], "plane": np.full(len(rows), plane, np.int32), "bits": bits}, len(rows))


def _align(batches: Iterator[pa.RecordBatch], byte_path: str, piece_path: str, stretch_words: int) -> Iterator[pa.RecordBatch]:
    """A row per document, and the bitmaps of the pairs of each stretch of documents."""
    words = _aligner(byte_path, piece_path)
    use(words)
    block, place = TaskContext.get().partitionId() << 24, 0
    docs, held, size = [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal docs, held, size
        if docs:
            lengths = np.array([len(h) for h in held])
            word = np.concatenate(held)
            at = np.repeat(np.array([d[1] for d in docs], np.int64), lengths)
            counts = np.array(words.counts, np.int64).reshape(-1, 3)
            totals = np.zeros((len(docs), 3), np.int64)
            np.add.at(totals, np.repeat(np.arange(len(docs)), lengths), counts[word])
            yield _batch({"block": [d[0] for d in docs], "place": [d[1] for d in docs], "doc_id": [d[2] for d in docs], "groups_sha256": [d[3] for d in docs],
                          "n_a": totals[:, 0], "n_b": totals[:, 1], "n_links": totals[:, 2]}, len(docs))
            if size:
                yield from _inverted(docs[0][0], word, at, words.pairs, counts[:, 2])
        docs, held, size = [], [], 0

    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            for doc, found in zip(part.column(0).to_pylist(), words.places(part.column(1).to_pylist())):
                digest = "" if found is None else hashlib.sha256("".join(map(words.strings.__getitem__, found.tolist()))[:-1].encode()).hexdigest()
                docs.append((block, place, doc, digest))
                held.append(np.zeros(0, np.int64) if found is None else found)
                size += len(held[-1])
                place += 1
                if place == BLOCK_DOCS or size >= stretch_words:
                    yield from flush()
                if place == BLOCK_DOCS:
                    block, place = block + 1, 0
            if words.full:  # only between slices: places of a slice's words are in use inside it
                yield from flush()
                words.shrink()
    yield from flush()


def _inverted(block: int, word: np.ndarray, at: np.ndarray, pairs: list[bytes], sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Turns (document place, word) occurrences into bitmaps by pair."""
    key, times = np.unique(word << 16 | at, return_counts=True)
    word, at = key >> 16, key & 0xFFFF
    used, word = np.unique(word, return_inverse=True)
    named, number = np.unique(np.frombuffer(b"".join([pairs[w] for w in used.tolist()]), np.int64), return_inverse=True)
    spans = sizes[used]
    firsts = np.cumsum(spans) - spans
    many = spans[word]
    ends = np.cumsum(many)
    taken = np.repeat(firsts[word] - ends + many, many) + np.arange(ends[-1])
    key, times = number[taken] << 16 | np.repeat(at, many), np.repeat(times, many)
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    more = np.add.reduceat(times[order], starts) - 1
    pair, place = named[key[starts] >> 16], key[starts] & 0xFFFF
    yield from _containers(block, pair, place, HELD)
    plane = 0
    while more.any():
        one = more & 1 == 1
        yield from _containers(block, pair[one], place[one], plane)
        rest = more > 1
        pair, place, more = pair[rest], place[rest], more[rest] >> 1
        plane += 1


MERGED = "pair long, block long, plane int, bits binary, documents long"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """OR-merges the containers of one (pair, block, plane) in a stream sorted by these, and counts their documents."""

    def merged(rows: pa.Table) -> pa.RecordBatch:
        pair, block, plane = (rows[c].to_numpy() for c in ("pair", "block", "plane"))
        starts = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (block[1:] != block[:-1]) | (plane[1:] != plane[:-1])]))
        sizes = np.diff(np.concatenate([starts, [len(pair)]]))
        bits = rows["bits"].to_pylist()
        out = [bits[s] if n == 1 else or_merge(bits[s : s + n]) for s, n in zip(starts.tolist(), sizes.tolist())]
        documents = [len(b) // 2 if len(b) < BLOCK_DOCS // 8 else int.from_bytes(b, "little").bit_count() for b in out]
        return pa.record_batch([pa.array(pair[starts]), pa.array(block[starts]), pa.array(plane[starts]), pa.array(out, pa.binary()), pa.array(documents, pa.int64())],
                               ["pair", "block", "plane", "bits", "documents"])

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        last = rows.slice(rows.num_rows - 1)
        same = np.ones(rows.num_rows, bool)
        for c in ("pair", "block", "plane"):
            same &= rows[c].to_numpy() == last[c].to_numpy()[0]
        cut = rows.num_rows - int(same.sum())  # the last run may go on in the next batch
        if cut:
            yield merged(rows.slice(0, cut))
        rest = rows.slice(cut)
    if rest is not None:
        yield merged(rest)


def _return(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums, per document of a block, what its pairs' postings bring; the stream is sorted by block."""
    current, sums = None, None

    def done() -> pa.RecordBatch:
        places = np.flatnonzero(sums.any(axis=0))
        return pa.record_batch([pa.array(np.full(len(places), current)), pa.array(places.astype(np.int32)), pa.array(sums[0, places]), pa.array(sums[1, places])],
                               ["block", "place", "n_best", "count_sum"])

    for batch in batches:
        block, plane, links, best = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("block", "plane", "links", "best"))
        bits = batch.column(batch.schema.get_field_index("bits")).to_pylist()
        weight = np.where(plane == HELD, 1, 1 << np.maximum(plane, 0).astype(np.int64))
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)] if len(block) else [0]
        for start, end in zip(cuts[:-1], cuts[1:]):
            if block[start] != current:
                if current is not None:
                    yield done()
                current, sums = int(block[start]), np.zeros((2, BLOCK_DOCS), np.int64)
            for first in range(start, end, 4096):
                chosen = slice(first, min(end, first + 4096))
                places = [unpack_places(b) for b in bits[chosen]]
                sizes = [len(p) for p in places]
                where = np.concatenate(places).astype(np.int64)
                np.add.at(sums[0], where, np.repeat(weight[chosen] * best[chosen], sizes))
                np.add.at(sums[1], where, np.repeat(weight[chosen] * links[chosen], sizes))
    if current is not None:
        yield done()


def a_id(pair: str = "pair") -> Column:
    return F.shiftright(F.col(pair), 32).cast("int")


def b_id(pair: str = "pair") -> Column:
    return F.col(pair).bitwiseAND(0xFFFFFFFF).cast("int")


def inverted(documents: DataFrame, byte_tokenizer: str, piece_tokenizer: str, doc_id: str = "doc_id", text: str = "text", stretch_words: int = STRETCH_WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents with their own counts, merged pair bitmaps), both as written tables."""
    spark = documents.sparkSession
    source = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    folder = shared_folder(spark, "pair-bitmaps")
    # documents are numbered by task, so both kinds of rows are written by one attempt of it
    source.mapInArrow(partial(_align, byte_path=byte_tokenizer, piece_path=piece_tokenizer, stretch_words=stretch_words), WRITTEN_SQL).write.parquet(f"{folder}/parts")
    parts = spark.read.schema(WRITTEN_SQL).parquet(f"{folder}/parts")
    keys = ["pair", "block"]
    dealt = parts.where("pair is not null").select("pair", "block", "plane", "bits").repartition(*keys).sortWithinPartitions(*keys, "plane")
    dealt.mapInArrow(_merge, MERGED).write.parquet(f"{folder}/merged")
    return parts.where("pair is null").drop("pair", "plane", "bits"), spark.read.schema(MERGED).parquet(f"{folder}/merged")


def pair_counts(postings: DataFrame) -> DataFrame:
    """``pair, a, b, documents, links, best``: popcounts summed over blocks; ``best`` where no other pair of the b id has more links."""
    weight = F.when(F.col("plane") == HELD, F.lit(1).cast("long")).otherwise(F.expr("shiftleft(1L, plane)"))
    counts = postings.groupBy("pair").agg(
        F.sum(F.when(F.col("plane") == HELD, F.col("documents")).otherwise(0)).alias("documents"), F.sum(weight * F.col("documents")).alias("links"),
    ).withColumns({"a": a_id(), "b": b_id()})
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    return counts.join(most, "b").select("pair", "a", "b", "documents", "links", (F.col("links") == F.col("most")).alias("best"))


def aligned(documents: DataFrame, byte_tokenizer: str, piece_tokenizer: str, doc_id: str = "doc_id", text: str = "text", stretch_words: int = STRETCH_WORDS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    ``byte_tokenizer`` is the file of a byte-level tokenizer without normaliser (A, given a blank and
    the text), ``piece_tokenizer`` a SentencePiece BPE file that adds the blank (B); special tokens'
    strings are plain text.  Byte offsets where both end a token cut the tokens into groups; the two tokens ending there are
    linked, so there are as many links as groups.  ``count_sum`` adds, over a document's
    links, how many links of the corpus join the same two ids; ``n_best`` counts links of which no
    other pair with the same B id has more.  Texts that are null, empty, or not given back by the bytes of
    either tokenizer's tokens have zeros and an empty digest.

    Null and repeated ids and repeated rows count as rows of their own; other columns are
    ignored whatever their names; an empty table gives no row.  A pair that occurs everywhere has one
    bitmap of at most 8 kB per plane and block of 65,536 documents, so no pair gathers in one task; a task
    holds about ``stretch_words`` word places, or those of one document if that is longer.
    """
    docs, postings = inverted(documents, byte_tokenizer, piece_tokenizer, doc_id, text, stretch_words)
    counts = pair_counts(postings).select("pair", "links", F.col("best").cast("long").alias("best"))
    scored = postings.select("pair", "block", "plane", "bits").join(counts, "pair").select("block", "plane", "bits", "links", "best")
    sums = scored.repartition("block").sortWithinPartitions("block").mapInArrow(_return, "block long, place int, n_best long, count_sum long")
    zero = F.lit(0).cast("long")
    return docs.join(sums, ["block", "place"], "left").select(
        "doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")

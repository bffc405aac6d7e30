"""Benchmark decontamination: training passages query a BM25 index of test items with block-max WAND."""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reapline.llm.common import CACHES, use

K1, B = 1.2, 0.75
SCALE = 64  # impacts are kept as whole numbers, rounded up, so that sums of bounds are exact
PASSAGES = 4096  # passages bounded at a time
BLOCK_POSTINGS = 16  # postings of one block of a list
LEAST_STRIDE = 8  # passages of the shortest items
SHARD_ITEMS = 2048  # items of one index that is sent to tasks
SHARD_BYTES = 48 << 20
NGRAM = 5
SHARE = 0.65  # of an item's score against itself that a passage must reach
COMMON = 0.03  # terms in a larger share of the items lead to an item only where it needs them
OVERLAP, QUESTION = 0.75, 0.5  # of an item's and its question's word n-grams that a document must hold

SENTENCE = re.compile(r"(?<=[.?!])\s+")


_SIGNS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII signs divide words like blanks."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SIGNS).split()


def question_and_answer(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """Terms of the question and of the answer: the last sentence, or the last third of a single one."""
    parts = [p for p in map(terms, SENTENCE.split((text or "").strip())) if p]
    if len(parts) > 1:
        return [t for p in parts[:-1] for t in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def ngrams(words: list[bytes], n: int = NGRAM) -> set[tuple]:
    """Word n-grams; fewer words make one, none make none."""
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


class _List:
    """Postings of a term in order of the items' needs, with the largest impact of the list and of each block."""

    def __init__(self, postings: list[tuple[int, int]]):
        self.items, self.impacts = map(list, zip(*postings))
        self.blocks = [max(self.impacts[i : i + BLOCK_POSTINGS]) for i in range(0, len(postings), BLOCK_POSTINGS)]
        self.bound = max(self.blocks)


class _Class:
    """Block-max index over items of about one length, searched by passages of ``2 * stride`` words.

    An item's commonest terms, as far as they cannot reach its threshold by themselves,
    only add to its score; the others lead to it.  ``need`` is the threshold less what the
    common ones may add, so it is positive, and an item is found through lists of leading
    terms alone.  Items are in ascending order of need: lists that cannot reach the need of
    an item cannot reach that of any item after it.
    """

    def __init__(self, stride: int, items: list[tuple], often: set[int], df: list[int]):
        self.stride = stride
        ready = []
        for item, weights in items:
            threshold = int(np.ceil(SHARE * sum(weights.values())))
            common, spare = set(), threshold - 1
            for t in sorted(weights.keys() & often, key=lambda t: (-df[t], t)):
                if weights[t] <= spare:
                    common.add(t)
                    spare -= weights[t]
            ready.append((spare + 1, item, threshold, weights, common))
        ready.sort(key=lambda r: r[:2])
        self.need, self.item, self.threshold, self.weights = ([r[i] for r in ready] for i in range(4))
        lists: dict[int, list] = defaultdict(list)
        for k, (_, _, _, weights, common) in enumerate(ready):
            for t, impact in weights.items():
                if t not in common:
                    lists[t].append((k, impact))
        self.lists = {t: _List(p) for t, p in lists.items()}
        self.bounds = np.zeros(len(df) + 1, np.int64)  # the last one is for words of no item
        for t, found in self.lists.items():
            self.bounds[t] = found.bound

    def wand(self, codes: set[int]) -> Iterator[int]:
        """Items whose leading terms among ``codes`` reach their need."""
        need = self.need
        cursors = [[0, 0, self.lists[t]] for t in codes]  # item, position, list
        for c in cursors:
            c[0] = c[2].items[0]
        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, k = 0, 0
            for k, (item, _, found) in enumerate(cursors):
                total += found.bound
                if total >= need[item]:
                    break
            else:
                return
            pivot = cursors[k][0]
            if cursors[0][0] < pivot:
                target, moved = pivot, sum(c[0] < pivot for c in cursors)
            else:
                moved = sum(c[0] == pivot for c in cursors)
                here = cursors[:moved]
                target = pivot + 1
                if sum(c[2].blocks[c[1] // BLOCK_POSTINGS] for c in here) < need[pivot]:
                    # no item up to the end of the first of these blocks, or before the next list begins, can reach its need
                    ends = [c[2].items[min((c[1] // BLOCK_POSTINGS + 1) * BLOCK_POSTINGS, len(c[2].items)) - 1] + 1 for c in here]
                    target = min(ends + [c[0] for c in cursors[moved : moved + 1]])
                elif sum(c[2].impacts[c[1]] for c in here) >= need[pivot]:
                    yield pivot
            for c in cursors[:moved]:
                c[1] = bisect_left(c[2].items, target, c[1])
                c[0] = c[2].items[c[1]] if c[1] < len(c[2].items) else -1
            cursors = [c for c in cursors if c[0] >= 0]

    def search(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, place of the item, score) of every passage that reaches an item's threshold.

        Passages overlap by half, so every stretch as long as an item lies inside one.
        Those whose list bounds together stay below the smallest need have no pivot and
        are left out at once.
        """
        bound = self.bounds[codes]
        places = np.flatnonzero(bound)
        totals = np.zeros(len(places) + 1, np.int64)
        np.cumsum(bound[places], out=totals[1:])
        passages = np.maximum(1, -(-(ends - starts - self.stride) // self.stride))
        for d, (start, end, count) in enumerate(zip(starts, ends, passages)):
            for chunk in range(0, count, PASSAGES):
                first = start + np.arange(chunk, min(chunk + PASSAGES, count)) * self.stride
                last = np.minimum(first + 2 * self.stride, end)
                low, high = np.searchsorted(places, first), np.searchsorted(places, last)
                for p in np.flatnonzero(totals[high] - totals[low] >= self.need[0]):
                    leading = set(codes[places[low[p] : high[p]]].tolist())
                    words = None
                    for k in self.wand(leading):
                        words = words or set(codes[first[p] : last[p]].tolist())
                        score = sum(impact for t, impact in self.weights[k].items() if t in words)
                        if score >= self.threshold[k]:
                            yield d, k, score


class Index:
    """Items with words in classes of lengths that double, each with its own block-max lists."""

    def __init__(self, items: list[tuple[int, list[bytes], list[bytes]]], df: dict[bytes, int], count: int, mean: float):
        whole = [(i, q + a, []) if len(q) + len(a) < NGRAM else (i, q, a) for i, q, a in items if q or a]
        items = sorted(whole, key=lambda i: (len(i[1]) + len(i[2]), i[0] is None, i[0] or 0))
        self.ids = [i[0] for i in items]
        self.parts = [(ngrams(q), ngrams(a)) for _, q, a in items]
        used = sorted({t for _, q, a in items for t in q + a})
        self.vocabulary = {t: i for i, t in enumerate(used)}
        often = {i for i, t in enumerate(used) if df[t] > max(1, COMMON * count)}
        classes: dict[int, list] = defaultdict(list)
        for i, (_, q, a) in enumerate(items):
            words = q + a
            weights = {}
            for term, tf in Counter(words).items():
                idf = np.log(1 + (count - df[term] + 0.5) / (df[term] + 0.5))
                weights[self.vocabulary[term]] = int(np.ceil(SCALE * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))))
            classes[max(LEAST_STRIDE, 1 << (len(words) - 1).bit_length())].append((i, weights))
        self.classes = [_Class(stride, rows, often, [df[t] for t in used]) for stride, rows in sorted(classes.items())]

    def retrieve(self, codes: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(document, item, best passage score); ``codes`` are the term numbers of several documents end to end."""
        ends = np.cumsum(lengths)
        best: dict[tuple[int, int], int] = {}
        for part in self.classes:
            for doc, k, score in part.search(codes, ends - lengths, ends):
                key = (doc, part.item[k])
                best[key] = max(best.get(key, 0), score)
        for (doc, item), score in sorted(best.items()):
            yield doc, item, score / SCALE


_LOADED: dict[str, Index] = {}
CACHES.append(_LOADED)


def _load(data: bytes, name: str) -> Index:
    use(_LOADED)
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = pickle.loads(data)
    return _LOADED[name]


def _matches(texts: list[str | None], index: Index) -> list[list[tuple]]:
    """Per text the verified (item, score, question overlap, answer overlap, overlap)."""
    found: list[list[tuple]] = [[] for _ in texts]
    parts, foreign = [], len(index.vocabulary)
    for text in texts:
        words = terms(text)
        parts.append(np.fromiter(map(index.vocabulary.get, words, repeat(foreign)), np.int32, len(words)))
    grams: dict[int, set] = {}
    for doc, item, score in index.retrieve(np.concatenate(parts), np.array([len(p) for p in parts])) if parts else ():
        if doc not in grams:
            grams = {doc: ngrams(terms(texts[doc]))}
        question, answer = index.parts[item]
        hits = [sum(g in grams[doc] if len(g) == NGRAM else _short(g, texts[doc]) for g in part) for part in (question, answer)]
        overlap = sum(hits) / (len(question) + len(answer))
        q, a = (h / len(p) if p else 1.0 for h, p in zip(hits, (question, answer)))
        if overlap >= OVERLAP and q >= QUESTION:
            found[doc].append((index.ids[item], score, q, a, overlap))
    return [sorted(f, key=lambda m: (m[0] is None, m[0] or 0)) for f in found]


def _short(gram: tuple, text: str | None) -> bool:
    """Whether a part shorter than an n-gram occurs as a run of terms."""
    return b" %b " % b" ".join(gram) in b" %b " % b" ".join(terms(text))


def _batches_of(batch: pa.RecordBatch, characters: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so much text each."""
    sizes = pa.compute.coalesce(pa.compute.utf8_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held >= characters:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _find(batches: Iterator[pa.RecordBatch], shard, name: str) -> Iterator[pa.RecordBatch]:
    index = _load(shard.value, name)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *((c, pa.float64()) for c in ("score", "question_overlap", "answer_overlap", "overlap"))])
    for batch in batches:
        for part in _batches_of(batch):
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            rows = [(d, *m) for d, found in zip(ids, _matches(texts, index)) for m in found]
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _drop(batches: Iterator[pa.RecordBatch], shard, name: str) -> Iterator[pa.RecordBatch]:
    index = _load(shard.value, name)
    for batch in batches:
        for part in _batches_of(batch):
            texts = part.column(part.schema.get_field_index("text")).to_pylist()
            yield part.filter(pa.array([not m for m in _matches(texts, index)]))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = terms(text)
            if words:
                rows.append((item, text, len(words), sorted(set(words))))
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.binary())))], ["item_id", "text", "n", "terms"])


def _build(rows: pa.Table, count: int, mean: float) -> pa.Table:
    df, items = {}, {}
    for item, text, term, n in zip(*(rows[c].to_pylist() for c in ("item_id", "text", "term", "df"))):
        df[term] = n
        items[item, text] = None
    index = Index([(item, *question_and_answer(text)) for item, text in items], df, count, mean)
    return pa.table({"data": pa.array([pickle.dumps(index)], pa.binary())})


def shards(items: DataFrame) -> list[bytes]:
    """Indexes over all items with words, each of bounded size.

    Counts (items, mean length, items with a term) cover all items.  Items are dealt to
    shards of about ``SHARD_ITEMS``; shards larger than ``SHARD_BYTES`` are dealt anew to
    twice as many.  One document pass per shard follows, so more items mean more passes,
    not larger broadcasts.
    """
    source = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    words = source.mapInArrow(_item_terms, "item_id long, text string, n long, terms array<binary>")
    count, mean = words.agg(F.count(F.lit(1)), F.avg("n")).first()
    if not count:
        return []
    df = words.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = words.select("item_id", "text", F.explode("terms").alias("term")).join(df, "term")
    n = -(-count // SHARD_ITEMS)
    while True:
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
        built = dealt.groupBy("shard").applyInArrow(lambda rows: _build(rows, count, mean), "data binary")
        sizes = built.select(F.max(F.length("data"))).first()[0] if n > 1 else None
        found = [bytes(r.data) for r in built.toLocalIterator()] if n == 1 or sizes <= SHARD_BYTES or n >= count else [b""]
        if n >= count or max(map(len, found)) <= SHARD_BYTES and found != [b""]:
            return found
        n *= 2


def contaminated(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap, overlap``: verified matches only.

    Every passage of every whole text queries the index; all items whose BM25 score with
    a passage reaches 0.65 of their score against themselves are verified: at least three
    quarters of the item's word five-grams, and half of its question's, must occur in the
    document.  An item, question or answer of under five words must occur as a whole
    run.  Null and empty texts match nothing, items without words are never held, repeated items are searched once, repeated documents are reported each,
    null ids stay null.  Without items the result is empty.
    """
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, overlap double"
    context, out = documents.sparkSession.sparkContext, None
    for i, data in enumerate(shards(items)):
        shared = context.broadcast(data)
        part = source.mapInArrow(partial(_find, shard=shared, name=f"{shared._jbroadcast.id()}"), schema)
        out = part if out is None else out.unionByName(part)
    return documents.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``documents`` without a verified match, all columns unchanged."""
    context = documents.sparkSession.sparkContext
    for data in shards(items):
        shared = context.broadcast(data)
        documents = documents.mapInArrow(partial(_drop, shard=shared, name=f"{shared._jbroadcast.id()}"), documents.schema)
    return documents

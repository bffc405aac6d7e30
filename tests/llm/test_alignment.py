"""Token links against a version that encodes whole texts with both libraries and counts in dictionaries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reapline.llm.alignment import aligned, inverted, or_merge, pack_places, pair_counts, unpack_places
from reapline.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _spelling():
    """Characters that stand for bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def brute_force(rows):
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    spelling, docs, total = _spelling(), [], Counter()
    for doc_id, text in rows:
        found = []
        if text:
            data = (" " + text).encode()
            a = first.encode(" " + text, add_special_tokens=False)
            ids, b = a.ids, second.encode(text)
            left = [bytes(spelling[c] for c in t) for t in a.tokens]
            right = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(second.id_to_piece, b))]
            if b"".join(left) == data == b"".join(right):
                ends_a = {e: k for k, e in enumerate(np.cumsum([len(x) for x in left]).tolist())}
                ends_b = {e: k for k, e in enumerate(np.cumsum([len(x) for x in right]).tolist())}
                found, i, j = [], 0, 0
                for e in sorted(ends_a.keys() & ends_b.keys()):
                    found.append((ids[i : ends_a[e] + 1], b[j : ends_b[e] + 1]))
                    i, j = ends_a[e] + 1, ends_b[e] + 1
        docs.append((doc_id, found))
        total.update((x[-1], y[-1]) for x, y in found)
    most = Counter()
    for (_, y), n in total.items():
        most[y] = max(most[y], n)
    out = []
    for doc_id, found in docs:
        links = [(x[-1], y[-1]) for x, y in found]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in found)
        out.append((doc_id, sum(len(x) for x, _ in found), sum(len(y) for _, y in found), len(found), len(links), sum(total[p] == most[p[1]] for p in links),
                    sum(total[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if found else ""))
    return out, total, docs


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _awkward():
    rng = random.Random(11)
    parts = [*"abcde  \n\t.,é世𠀀ﬁ　\u0085\x1c'", " the", " and", "<|endoftext|>", "<s>", " don't", "1234", "\r\n", " "]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for k in range(300)]
    return rows + [(1000, None), (1001, ""), (1002, "a▁b"), (1003, " "), (1003, " "), (None, "the end"), (1004, "the and " * 20_000), (1005, "   lead and trail  "), (1006, "ab" * 3000)]


def test_awkward_texts(spark):
    rows = _awkward()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("pair", "block", "plane", "bits", "links", "best", "place")})
    assert rows_of(aligned(docs, A, B)) == sorted(brute_force(rows)[0], key=repr)
    assert aligned(docs.where("doc_id = -5"), A, B).count() == 0


def test_many_stretches_and_dense_bitmaps(spark):
    """Short stretches of one block: their bitmaps are OR-merged, and lists of places turn into bits."""
    rows = [(k, f"the cat {k % 7} and the the dog{k % 3}") for k in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    expected, total, held = brute_force(rows)
    assert rows_of(aligned(docs, A, B, stretch_words=10_000)) == sorted(expected, key=repr)
    merged = inverted(docs, A, B, stretch_words=10_000)[1]
    assert merged.where("length(bits) = 8192").count() and merged.groupBy("pair", "block", "plane").count().where("count > 1").isEmpty()
    counts = pair_counts(merged).collect()
    assert {(r.a, r.b): r.links for r in counts} == dict(total)
    in_docs = Counter(p for _, found in held for p in {(x[-1], y[-1]) for x, y in found})
    assert {(r.a, r.b): r.documents for r in counts} == dict(in_docs)


@pytest.mark.parametrize("sizes", [(1, 2), (3000, 3000), (5000, 10), (65_536, 4096)])
def test_containers(sizes):
    rng = np.random.default_rng(5)
    sets = [np.sort(rng.choice(65_536, n, replace=False)) for n in sizes]
    assert all((unpack_places(pack_places(s)) == s).all() for s in sets)
    assert (unpack_places(or_merge([pack_places(s) for s in sets])) == np.union1d(*sets)).all()


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert rows_of(QUERIES["op12_cross_tokenizer_alignment"](spark, folder)) == sorted(brute_force(rows)[0], key=repr)

"""Piece encoding against the sentencepiece library: ids, source spans, decoding, other normalisation rules."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from reapline.llm.queries import QUERIES
from reapline.llm.sentencepieces import PieceModel, _fields, decode, digests, encode

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [*"abcdefgh  \n\t.,é世𠀀▁ﬁ\u0000 　①Åé", "the ", "<s>", "<0x41>", "  ", "ｶﾞ", "́"]


def _bytes(number: int, data: bytes) -> bytes:
    """A length-delimited protocol-buffer field."""
    size, out = len(data), bytes([number << 3 | 2])
    while True:
        out += bytes([size & 127 | (128 if size > 127 else 0)])
        size >>= 7
        if not size:
            return out + data


def _model(rule: str | None = None, *, prefix: bool = True, trim: bool = False) -> bytes:
    """The public model, with the library's compiled map of a rule and other flags appended."""
    with open(PATH, "rb") as source:
        data = source.read()
    spec = bytes([3 << 3, prefix, 4 << 3, trim])
    if rule:
        proto = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
        spec += _bytes(2, dict(_fields(dict(_fields(proto))[3]))[2])
    return data + _bytes(3, spec)


def _texts(seed: int, count: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(count)] + ["", " ", "   ", "a" * 3000, "x y" * 500]


@pytest.mark.parametrize("rule, prefix, trim", [
    (None, True, False), (None, False, False), (None, True, True), ("nmt_nfkc", True, True), ("nfkc", True, False), ("nmt_nfkc_cf", False, True)])
def test_like_the_library(rule, prefix, trim):
    data = _model(rule, prefix=prefix, trim=trim)
    own, library = PieceModel(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    for text in _texts(7, 600):
        ids, spans = own.encode(text)
        found = library.encode(text, return_type="proto")
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text), text
        assert spans.tolist() == [[p.begin, p.end] for p in found.pieces], text
        assert own.decode(np.frombuffer(ids, "<u4")) == library.decode(library.encode(text)), text


def test_decoding_of_any_ids():
    own, library = PieceModel(_model()), sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(3)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randrange(12))]
        assert own.decode(np.array(ids, np.int64)) == library.decode(ids), ids


def test_long_run_without_blanks():
    text = "ab" * 50_000
    own = PieceModel(_model())
    assert np.frombuffer(own.encode(text)[0], "<u4").tolist() == sentencepiece.SentencePieceProcessor(model_file=PATH).encode(text)


def test_awkward_rows(spark):
    """Null, empty, repeated rows; null ids; other columns with the operator's own names; a long text; an empty table."""
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "é世"), (4, "word " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("ids", "spans", "decoded")})
    found = digests(decode(encode(docs, PATH), PATH)).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)

    def expected(doc_id, text):
        ids = [1, *library.encode(text or ""), 2]
        return doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()

    assert sorted((tuple(r)[:4] for r in found), key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert encode(docs.where("doc_id = 99"), PATH).count() == 0
    spans = np.frombuffer(encode(docs.where("doc_id is null"), PATH).first().spans, "<u4").reshape(-1, 2).tolist()
    assert spans[0] == [0, 0] and spans[-1] == [5, 5] and max(e for _, e in spans) == 5


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = QUERIES["op13_sentencepiece_offsets"](spark, folder).collect()
    assert len(found) == len(texts)
    for row in found:
        ids = [1, *library.encode(texts[row.doc_id]), 2]
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()

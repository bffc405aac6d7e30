"""SentencePiece BPE models on Spark: encoding that keeps source offsets, and decoding.

A model file is read here, not through the library: its pieces, its flags, and its compiled
character map, a double-array trie over UTF-8 bytes followed by replacement strings.  A text is
normalised by the longest key of the map at each place; every normalised byte remembers the
source byte that it came from, so the span of each piece projects back to the source.
Pieces hold blanks only in front, so a normalised text falls into runs of blanks with what
follows them, which never merge with one another; each distinct run is merged once and kept.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reapline.llm.common import CACHES, use

BLANK = "▁"  # fixed value: stands for a blank inside pieces
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: piece types of a model file
UNKNOWN_SURFACE = " ⁇ "  # fixed value: what an unknown piece decodes to where the file names nothing else
CACHE_RUNS = 300_000
SHORT_RUN = 64  # symbols that are merged by scanning; longer runs use a heap
BATCH_ROWS = 64


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class CharMap:
    """The compiled character map: the longest key at a place, and what replaces it."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes of the key) for the longest key that ``data`` has at ``at``."""
        units = self.units
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        found = None
        for place in range(at, len(data)):
            byte = data[place]
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                found = units[node] & 0x7FFFFFFF, place + 1 - at
        if found is None:
            return None
        return self.texts[found[0] : self.texts.index(b"\0", found[0])], found[1]


def _char_bytes(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class PieceModel:
    """Pieces, flags and character map of a model file; normalises, encodes and decodes texts."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.types = [], [], []
        trainer, rules = {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer |= dict(_fields(value))
            elif number == 3:
                rules |= dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("only BPE models are supported")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.suffix_blank = bool(trainer.get(24, 0))
        self.unknown_surface = trainer[44].decode() if 44 in trainer else UNKNOWN_SURFACE
        self.bos, self.eos = (v if v < len(self.pieces) else None for v in (trainer.get(41, 1), trainer.get(42, 2)))
        self.unknown = self.types.index(UNKNOWN)
        self.map = CharMap(rules.get(2, b""))
        self.dummy_prefix, self.trim, self.escape = (bool(rules.get(n, 1)) for n in (3, 4, 5))
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t in (NORMAL, USER_DEFINED, UNUSED)}
        places = {s: k for k, s in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        self.rank, self.never = {p: places[self.scores[i]] for p, i in self.ids.items()}, len(places)
        self.unused = {i for i, t in enumerate(self.types) if t == UNUSED}
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        defined = sorted((p for p, t in zip(self.pieces, self.types) if t == USER_DEFINED), key=len, reverse=True)
        self.defined = re.compile("|".join(map(re.escape, defined))) if defined else None
        inside = any(BLANK in p.lstrip(BLANK) for p, t in zip(self.pieces, self.types) if t in (NORMAL, USER_DEFINED, UNUSED))
        self.run = re.compile(r"(?s).+" if inside or self.suffix_blank or defined else f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
        self.plain = not self.map.units and not self.trim and self.escape and self.dummy_prefix and not self.suffix_blank and not defined and not inside
        byte_of = {i: b for b, i in self.bytes.items()}
        self.surface = [p.replace(BLANK, " ") if t in (NORMAL, USER_DEFINED, UNUSED) else self.unknown_surface if t == UNKNOWN else "" for p, t in zip(self.pieces, self.types)]
        self.byte_of = byte_of
        self.is_byte = np.array([t == BYTE for t in self.types])
        # a blank has three bytes in a piece and one in the source
        self.source_bytes = np.array([1 if t == BYTE else len(p.encode()) - 2 * p.count(BLANK) for p, t in zip(self.pieces, self.types)])
        self.runs = Runs(self)

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its UTF-8 bytes and its end, the source byte it came from."""
        data, out, align = text.encode("utf-8", "surrogatepass"), [], []
        blank = (BLANK if self.escape else " ").encode()
        size, at = len(data), 0

        def step(at: int) -> tuple[bytes, int]:
            if self.defined:
                found = self.defined.match(text_at(at))
                if found:
                    key = found.group().encode()
                    return key, len(key)
            found = self.map.longest(data, at) if self.map.units else None
            if found is None:
                width = _char_bytes(data[at])
                return data[at : at + width], width
            return found

        def text_at(at: int) -> str:
            return data[at : at + 256].decode("utf-8", "ignore")

        while self.trim and at < size:
            made, width = step(at)
            if made != b" ":
                break
            at += width
        if at >= size:
            return "", np.zeros(1, np.int64)
        if self.dummy_prefix and not self.suffix_blank:
            out.append(blank)
            align += [at] * len(blank)
        after_blank = self.trim
        while at < size:
            made, width = step(at)
            if after_blank:
                made = made.lstrip(b" ")
            if made:
                after_blank = made.endswith(b" ")
                shown = made.replace(b" ", blank)
                out.append(shown)
                align += [at] * len(shown)
            at += width
            after_blank = after_blank and self.trim
        done = b"".join(out)
        if self.trim:
            while done.endswith(blank):
                done = done[: -len(blank)]
                at = align[len(done)]
            del align[len(done) :]
        if self.dummy_prefix and self.suffix_blank:
            done += blank
            align += [at] * len(blank)
        return done.decode("utf-8", "surrogatepass"), np.array([*align, at], np.int64)

    def merge(self, run: str) -> list[str]:
        """Symbols of a run: the best-scored neighbours are joined first, the left ones of equals first."""
        if self.defined:
            symbols, at = [], 0
            for found in self.defined.finditer(run):
                symbols += [*run[at : found.start()], found.group()]
                at = found.end()
            symbols += run[at:]
        else:
            symbols = list(run)
        if len(symbols) <= SHORT_RUN and not self.defined and not self.unused:
            return self._merge_short(symbols)
        fixed = {i for i, s in enumerate(symbols) if self.defined and self.defined.fullmatch(s)}
        ids, scores = self.ids, self.scores
        left, right = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        agenda, taken_apart = [], {}

        def offer(a: int, b: int) -> None:
            if a < 0 or b < 0 or a in fixed or b in fixed:
                return
            joined = symbols[a] + symbols[b]
            number = ids.get(joined)
            if number is not None:
                heapq.heappush(agenda, (-scores[number], a, b, joined))
                if number in self.unused:
                    taken_apart[joined] = symbols[a], symbols[b]

        for i in range(1, len(symbols)):
            offer(i - 1, i)
        while agenda:
            _, a, b, joined = heapq.heappop(agenda)
            if not symbols[a] or not symbols[b] or symbols[a] + symbols[b] != joined:
                continue
            symbols[a], symbols[b] = joined, ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])

        def usable(symbol: str) -> list[str]:
            if ids.get(symbol) in self.unused and symbol in taken_apart:
                return [s for part in taken_apart[symbol] for s in usable(part)]
            return [symbol]

        return [s for symbol in symbols if symbol for s in usable(symbol)]

    def _merge_short(self, symbols: list[str]) -> list[str]:
        """The same for few symbols, by scanning the ranks of all neighbours."""
        rank, never = self.rank.get, self.never
        ranks = [rank(a + b, never) for a, b in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            symbols[i] += symbols.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(symbols[i] + symbols[i + 1], never)
            if i:
                ranks[i - 1] = rank(symbols[i - 1] + symbols[i], never)
        return symbols

    def run_pieces(self, run: str) -> tuple[list[int], list[int]]:
        """Ids of a run, and how many of its UTF-8 bytes each covers; of an unknown sign's bytes the last covers the sign."""
        return self.sized(self.merge(run))

    def sized(self, symbols: list[str]) -> tuple[list[int], list[int]]:
        numbers, widths = [], []
        for symbol in symbols:
            number = self.ids.get(symbol)
            width = len(symbol) if symbol.isascii() else len(symbol.encode("utf-8", "surrogatepass"))
            if number is not None:
                numbers.append(number)
                widths.append(width)
            elif self.byte_fallback:
                numbers += [self.bytes[b] for b in symbol.encode("utf-8", "surrogatepass")]
                widths += [0] * (width - 1) + [width]
            elif numbers and numbers[-1] == self.unknown:
                widths[-1] += width
            else:
                numbers.append(self.unknown)
                widths.append(width)
        return numbers, widths

    def encode(self, text: str) -> tuple[bytes, np.ndarray]:
        """Ids of a whole text as little-endian uint32 bytes, and the (begin, end) source bytes of each."""
        if not text:
            return b"", np.zeros((0, 2), np.int64)
        if self.plain and BLANK not in text:
            words = text.split(" ")
            if "" in words:
                words = [r[1:].replace(BLANK, " ") for r in self.run.findall(BLANK + text.replace(" ", BLANK))]
            made = b"".join(map(self.runs.__getitem__, words))
            return made, self._plain_spans(np.frombuffer(made, "<u4"))
        shown, align = self.normalize(text)
        numbers, widths = [], []
        for run in self.run.findall(shown):
            ids, sizes = self.run_pieces(run)
            if numbers and ids and numbers[-1] == ids[0] == self.unknown:
                widths[-1] += sizes.pop(0)
                ids.pop(0)
            numbers += ids
            widths += sizes
        cuts = align[np.concatenate([[0], np.cumsum(widths, dtype=np.int64)]).astype(np.int64)]
        return np.array(numbers, "<u4").tobytes(), np.stack([cuts[:-1], cuts[1:]], 1)

    def _plain_spans(self, ids: np.ndarray) -> np.ndarray:
        """Spans of the ids of a text that normalisation leaves as it is."""
        cuts = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.source_bytes[ids], out=cuts[1:])
        cuts = np.maximum(cuts - 1, 0)  # the first blank is not in the source
        spans = np.stack([cuts[:-1], cuts[1:]], 1)
        byte = np.flatnonzero(self.is_byte[ids])
        if len(byte):
            inner = np.zeros(len(ids) + 1, bool)  # bytes that go on with a sign
            inner[byte] = [self.byte_of[i] & 0xC0 == 0x80 for i in ids[byte].tolist()]
            first = np.maximum.accumulate(np.where(inner[:-1], 0, np.arange(len(ids))))
            spans[byte, 0] = spans[first[byte], 0]
            unended = byte[inner[byte + 1]]
            spans[unended, 1] = spans[unended, 0]
        return spans

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: control pieces give nothing, byte pieces their bytes, and the first blank goes."""
        byte = self.is_byte[ids]
        out, seen = [], False  # seen: text, or the blank that begins one
        cuts = [0, *(np.flatnonzero(byte[1:] != byte[:-1]) + 1).tolist(), len(ids)] if len(ids) else [0]
        for start, end in zip(cuts[:-1], cuts[1:]):
            part = ids[start:end].tolist()
            if byte[start]:
                out.append(_utf8(bytes(map(self.byte_of.__getitem__, part))))
                seen = True
                continue
            while part and not seen:
                first, *part = part
                shown = self.surface[first]
                if self.types[first] in (NORMAL, USER_DEFINED, UNUSED) and (self.dummy_prefix or self.trim) and shown.startswith(" "):
                    shown, seen = shown[1:], not self.trim
                seen = seen or bool(shown)
                out.append(shown)
            out += map(self.surface.__getitem__, part)
        return "".join(out)


def _utf8(data: bytes) -> str:
    """Bytes as text; each byte that starts no valid sign becomes U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError as error:
        return data[: error.start].decode() + "�" + _utf8_rest(data, error.start + 1)


def _utf8_rest(data: bytes, at: int) -> str:
    out = []
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as error:
            out.append(data[at : at + error.start].decode() + "�")
            at += error.start + 1
    return "".join(out)


class Runs(dict):
    """Ids of a blank and the word after it, by the word, as little-endian uint32 bytes."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model
        CACHES.append(self)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_RUNS:  # short words come again, long ones hardly
            short = {w: v for w, v in self.items() if len(w) <= 7}
            self.clear()
            if len(short) <= CACHE_RUNS // 2:
                self.update(short)
        model = self.model
        symbols = model.merge(BLANK + word.replace(" ", BLANK))
        ids = list(map(model.ids.get, symbols))
        if None in ids:
            ids, _ = model.sized(symbols)
        self[word] = value = array("I", ids).tobytes()
        return value


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    with open(path, "rb") as source:
        return PieceModel(source.read())


ENCODED = "doc_id long, ids binary, spans binary"


def _encode(batches: Iterator[pa.RecordBatch], path: str, ends: bool) -> Iterator[pa.RecordBatch]:
    model = piece_model(path)
    use(model.runs)
    front, back = (b"" if v is None or not ends else struct.pack("<I", v) for v in (model.bos, model.eos))
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(start, BATCH_ROWS)
            ids, spans = [], []
            for text in part.column(1).to_pylist():
                made, places = model.encode(text or "")
                size = len((text or "").encode("utf-8", "surrogatepass")) if back else 0
                ids.append(front + made + back)
                spans.append((bytes(8) if front else b"") + places.astype("<u4").tobytes() + (struct.pack("<II", size, size) if back else b""))
            yield pa.record_batch([part.column(0), pa.array(ids, pa.binary()), pa.array(spans, pa.binary())], ["doc_id", "ids", "spans"])


def encode(documents: DataFrame, model: str, ends: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids, spans`` of every row: piece ids as little-endian uint32, and a (begin, end) pair of uint32 for each.

    A span is the stretch of the text's UTF-8 bytes that its piece came from; of the byte pieces
    of one sign the last has the sign, the others are empty.  With ``ends`` the model's begin and
    end ids stand around the text, with empty spans.  ``model`` is the path of a BPE model
    file that every executor has.

    Null and empty texts have the begin and end ids alone.  Null and repeated ids, and repeated rows,
    give a row each; other columns are ignored whatever their names; an empty table gives no row.  A text is
    encoded whole, by itself, so no key or source gathers rows in a task; memory is that of
    one text's ids.
    """
    source = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(partial(_encode, path=model, ends=ends), ENCODED)


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = piece_model(path)
    use(model.runs)
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(start, BATCH_ROWS)
            texts = [model.decode(np.frombuffer(i.as_py() or b"", "<u4")) for i in part.column(1)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "spans", "decoded"])


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` with ``decoded``: the text of its ids.  Null ids decode to an empty text."""
    return encoded.select("doc_id", "ids", "spans").mapInArrow(partial(_decode, path=model), ENCODED + ", decoded string")


def n_ids(ids: str = "ids") -> Column:
    return F.floor(F.octet_length(ids) / 4).cast("long")


def digests(decoded: DataFrame) -> DataFrame:
    """A row per document: number and digest of its ids, digest of the decoded text, checksum of the spans."""
    return decoded.select(
        "doc_id", n_ids().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.crc32("spans").alias("spans_crc32"))

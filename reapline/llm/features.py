"""Sparse text features: hashed words, binned structure statistics, hashed metadata."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import numpy as np
import xxhash

from reapline.llm.common import CACHES, CACHE_WORDS, use

BITS = 18  # size of the feature space, as a power of two
EDGES = {  # upper bin limits of each structure statistic
    "words": [1, 5, 10, 20, 40, 80, 160, 320, 640, 1280, 2560, 10000],
    "mean_length": [1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5, 9, 12, 20],
    "distinct": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97],
    "same_as_last": [0.001, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.6, 0.8],
    "top_word": [0.01, 0.02, 0.04, 0.06, 0.1, 0.2, 0.4, 0.7],
    "upper": [0.005, 0.02, 0.04, 0.06, 0.1, 0.2, 0.4, 0.6],
    "digit": [0.001, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4],
    "punctuation": [0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3],
    "blank": [0.05, 0.1, 0.13, 0.16, 0.2, 0.25, 0.35, 0.5],
    "repeated_lines": [0.001, 0.1, 0.2, 0.3, 0.5, 0.7],
    "words_per_line": [1, 2, 4, 8, 16, 32, 64, 128, 512],
    "odd_ends": [0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9],
}
_KINDS = np.zeros(256, np.uint8)  # 0 other, 1 upper, 2 digit, 3 punctuation, 4 blank
for _code in range(256):
    _c = chr(_code)
    _KINDS[_code] = 1 if _c.isupper() else 2 if _c.isdigit() else 4 if _c.isspace() else 0 if _c.isalnum() else 3


def place(kind: str, name: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}\0{name}".encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


class _Words(dict):
    """(feature, doubled end sign?) of a word, by its letters without punctuation around them."""

    def __missing__(self, word: str) -> tuple[int, bool]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        core = word
        while core and not core[-1].isalnum():
            core = core[:-1]
        tail = len(word) - len(core)
        while core and not core[0].isalnum():
            core = core[1:]
        self[word] = value = (place("word", core or word), tail >= 2 or not core)
        return value


_WORDS = _Words()
CACHES.append(_WORDS)
_STATS = {(name, bin): place("stat", f"{name}:{bin}") for name, edges in EDGES.items() for bin in range(len(edges) + 1)}


def begin() -> None:
    """To be called where a task begins to make features."""
    use(_WORDS)


def structure(text: str, tokens: list[str], counts: Counter, odd: int) -> dict[str, float]:
    """Statistics of the shape of a whole text; all 0 for an empty one."""
    n = len(tokens)
    kinds = np.zeros(5, np.int64)
    for start in range(0, len(text), 1 << 20):  # bounded scratch space for very long texts
        codes = np.frombuffer(text[start : start + (1 << 20)].encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds += np.bincount(_KINDS[np.minimum(codes, 255)], minlength=5)
    share = kinds / max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    return {
        "words": n, "mean_length": sum(map(len, tokens)) / n if n else 0.0, "distinct": len(counts) / n if n else 0.0,
        "same_as_last": sum(map(str.__eq__, tokens, tokens[1:])) / n if n else 0.0,
        "top_word": max(counts.values(), default=0) / n if n else 0.0,
        "upper": share[1], "digit": share[2], "punctuation": share[3], "blank": share[4],
        "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "words_per_line": n / len(lines) if lines else 0.0, "odd_ends": odd / n if n else 0.0,
    }


def text_features(text: str | None, metadata: Sequence[tuple[str, object]] = (), shape: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(features, values) of one row.

    Distinct words carry 1 / sqrt(number of distinct words); with ``shape``, each statistic
    and each non-null metadata value is one feature of value 0.5.  Numbers among the
    metadata are binned by powers of two.  Null text counts as empty.
    """
    text = text or ""
    tokens = text.lower().split()
    counts = Counter(tokens)
    found = [_WORDS[w] for w in counts]
    words = np.unique(np.fromiter((f for f, _ in found), np.int64, len(found)))
    values = np.full(len(words), 1 / math.sqrt(max(1, len(words))), np.float32)
    if not shape:
        return words, values
    odd = sum(c for (_, o), c in zip(found, counts.values()) if o)
    more = [_STATS[name, int(np.searchsorted(EDGES[name], v, side="right"))] for name, v in structure(text, tokens, counts, odd).items()]
    for name, value in metadata:
        if value is not None:
            if isinstance(value, (int, float)) and not isinstance(value, bool):
                value = int(math.log2(abs(value) + 1)) if math.isfinite(value) else "not finite"
            more.append(place("meta", f"{name}:{value}"))
    return np.concatenate([words, np.array(more, np.int64)]), np.concatenate([values, np.full(len(more), 0.5, np.float32)])

"""Word and shingle hashes of many texts at once, in numpy over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_M = 0x9E3779B97F4A7C15 | 1
_M_INVERSE = pow(_M, -1, 1 << 64)
_GRAM = _U(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def byte_table(separators: bytes) -> np.ndarray:
    """Maps a byte to its lower-case self plus one, and a separator to 0; bytes of non-ASCII characters are word bytes."""
    table = np.arange(1, 257, dtype=np.uint16)
    table[ord("A") + np.arange(26)] += 32
    table[np.frombuffer(separators, dtype=np.uint8)] = 0
    return table


#: Words of letters and digits: everything else in ASCII separates.
ALNUM = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Words between white space: tab to carriage return, and the blank.
SPACED = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> _U(29))


def _power(base: int, n: int) -> np.ndarray:
    key = f"{base}"
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        steps[0] = 1
        _powers[key] = np.cumprod(steps)
    return _powers[key][:n]


class Words:
    """The words of a list of texts: ``hash``, ``doc`` (index of the text), ``start`` and ``end`` (byte offsets in ``raw``)."""

    def __init__(self, texts: list[str | None], table: np.ndarray) -> None:
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.raw = b"\n".join([*parts, b""])
        sizes = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        codes = table[np.frombuffer(self.raw, dtype=np.uint8)]
        inside = np.concatenate([[False], codes > 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(codes.astype(np.uint64) * _power(_M, len(codes)), out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * _power(_M_INVERSE, len(codes) + 1)[self.start])
        self.doc = np.searchsorted(self.base, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=len(texts)) if len(texts) else np.zeros(0, dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def __len__(self) -> int:
        return len(self.hash)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they all belong to one text."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
        out = self.hash[:n].copy()
        for j in range(1, k):
            out *= _GRAM
            out += self.hash[j : j + n]
        return mix(out), self.doc[:n] == self.doc[k - 1 : k - 1 + n]

    def spans(self, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`grams`, at one cost for every k: differences of prefix sums. Salts make independent hashes."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
        sums = np.zeros(len(self) + 1, dtype=np.uint64)
        np.cumsum((mix(self.hash ^ _U(salt)) if salt else self.hash) * _power(_M, len(self)), out=sums[1:])
        return mix((sums[k:] - sums[:n]) * _power(_M_INVERSE, n)), self.doc[:n] == self.doc[k - 1 : k - 1 + n]


def sliding(grams: np.ndarray, w: int, pick=np.minimum) -> np.ndarray:
    """The least (or what ``pick`` takes) of w consecutive values from each on, over doubling widths."""
    out, width = grams, 1
    while 2 * width <= w:
        out = pick(out[: len(out) - width], out[width:])
        width *= 2
    if rest := w - width:
        out = pick(out[: len(out) - rest], out[rest:])
    return out


def winnow(grams: np.ndarray, inside: np.ndarray, doc: np.ndarray, k: int, w: int) -> np.ndarray:
    """Positions of the grams that are a minimum of some w consecutive grams of one text (every tied one)."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    whole = inside[:n] & inside[w - 1 :] & (doc[:n] == doc[w - 1 : w - 1 + n])
    # a gram is such a minimum where it equals the greatest minimum of the windows that hold it
    least, held = np.zeros(n + 2 * w - 2, dtype=grams.dtype), np.zeros(n + 2 * w - 2, dtype=bool)
    held[w - 1 : w - 1 + n] = whole
    least[w - 1 : w - 1 + n] = np.where(whole, sliding(grams, w), _U(0))
    return np.flatnonzero((sliding(least, w, np.maximum) == grams) & sliding(held, w, np.logical_or))

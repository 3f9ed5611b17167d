"""Encoding with a public byte-level BPE tokenizer, at dictionary-lookup speed.

A byte-level BPE splits text into pre-tokens first, and no pre-token holds a non-space character
followed by white space. Every blank that does not stand between two other white-space characters
therefore starts a new pre-token, so a text may be cut before such blanks, the distinct cuts encoded
once by the tokenizers library, and the results joined. Texts of plain words, numbers and signs fall into pre-tokens at once. Texts with odd white space go to the library whole, as do all texts of
a vocabulary of another kind: one with a normaliser, or with pre-tokens other than the byte-level ones.
"""

from __future__ import annotations

import gc
import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

END_ID = 0
_ODD = re.compile(r"[\s\x1c-\x1f] [\s\x1c-\x1f]")
_PLAIN = re.compile(r" ?[^\s\x1c-\x1f]+")
#: Pre-tokens of plain text: letters, digits or signs with a blank in front or without, and line feeds that stand alone before something.
#: An apostrophe may begin a contraction, so texts with one take the longer way.
_TOKEN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[!-&(-/:-@\[-`{-~]+| ?[0-9]+|\n(?=\S)")
#: Pieces of letters, common signs and single line feeds; each part is a pre-token of its own.
_PART = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+|[.,;:!?*#$%&|()\-]+|\n")
_PARTS = re.compile(r"(?: ?[A-Za-zÀ-ÖØ-öø-ÿ]+|[.,;:!?*#$%&|()\-]+|\n(?=[A-Za-zÀ-ÖØ-öø-ÿ]))+")
_encoders: dict[str, PieceEncoder] = {}


class PieceEncoder:
    """``encode_many(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cache_limit: int = 200_000, part_limit: int = 600_000) -> None:
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}
        self.cache_limit, self.part_limit = cache_limit, part_limit
        before = self.tokenizer.pre_tokenizer
        self.divisible = isinstance(self.tokenizer.model, BPE) and self.tokenizer.normalizer is None and isinstance(before, ByteLevel) and not before.add_prefix_space and before.use_regex
        newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.newline = newline[0] if len(newline) == 1 else None

    def _direct(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Put pieces into the cache, from their parts where they fall into pre-tokens plainly."""
        cache, known = self.cache, self.parts
        single, divided, odd, fresh = [], [], [], set()
        for p in pieces:
            if p.isalpha() or p[1:].isalpha() and p[0] == " ":
                single.append(p)
            elif _PARTS.fullmatch(p):
                parts = _PART.findall(p)
                divided.append((p, parts))
                fresh.update(parts)
            else:
                odd.append(p)
        fresh.update(single)
        plain = [x for x in fresh if x not in known]
        whole = "\n" in plain
        if whole:
            plain.remove("\n")
            known["\n"] = self._direct("\n")
        self._encode(plain, known)
        for p in single:
            cache[p] = known[p]
        for p, parts in divided:
            cache[p] = b"".join([known[x] for x in parts])
        self._encode([p for p in odd if _PLAIN.fullmatch(p)], cache)
        for p in odd:
            if p not in cache:
                cache[p] = self._direct(p)
        if len(known) > self.part_limit:
            self.parts = {x: known[x] for x in fresh}

    def _encode(self, pieces: list[str], into: dict[str, bytes]) -> None:
        """Encode pieces without white space, but for a blank in front: together, with line feeds between."""
        groups = [pieces[at : at + 4096] for at in range(0, len(pieces), 4096)]
        joined = self.tokenizer.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False) if groups and self.newline is not None else []
        for group, got in zip(groups, joined or [None] * len(groups), strict=True):
            ids = np.asarray(got.ids if got else [], dtype="<u4")
            cuts = np.flatnonzero(ids == self.newline)
            if got and len(cuts) == len(group) - 1:
                raw, ends = ids.tobytes(), [*(cuts * 4).tolist(), 4 * len(ids)]
                into.update(zip(group, [raw[a:b] for a, b in zip([0, *[e + 4 for e in ends[:-1]]], ends, strict=True)], strict=True))
            else:
                into.update((p, self._direct(p)) for p in group)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        # a tenth of the time would go to searching these large dictionaries for cycles, of which they have none
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode_many(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode_many(self, texts: list[str]) -> list[bytes]:
        if not self.divisible:
            return [self._direct(t) for t in texts]
        parts = [_TOKEN.findall(t) for t in texts]
        parts = [p if len("".join(p)) == len(t) else None for p, t in zip(parts, texts, strict=True)]
        known, need = self.parts, set()
        for p in parts:
            if p is not None:
                need.update(p)
        missing = need.difference(known)
        if "\n" in missing:
            missing.remove("\n")
            known["\n"] = self._direct("\n")
        self._encode(list(missing), known)
        out = [None if p is None else b"".join(map(known.__getitem__, p)) for p in parts]
        del parts
        if len(known) > self.part_limit:  # what these texts use stays: it holds the common pieces
            self.parts = {x: known[x] for x in need}
        others = [i for i, x in enumerate(out) if x is None]
        for i, got in zip(others, self._by_pieces([texts[i] for i in others]), strict=True):
            out[i] = got
        return out

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        cache = self.cache
        cut = [None if "\0" in t or _ODD.search(t) else t.replace(" ", "\0 ").split("\0") for t in texts]
        need: set[str] = set()
        for pieces in cut:
            if pieces is not None:
                need.update(pieces)
        missing = [p for p in need if p not in cache]
        if missing:
            self._learn(missing)
        out = [self._direct(t) if pieces is None else b"".join(map(cache.__getitem__, pieces)) for t, pieces in zip(texts, cut, strict=True)]
        if len(cache) > self.cache_limit:
            self.cache = {p: cache[p] for p in need} | {"": b""}
        return out


def encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker and vocabulary."""
    if path not in _encoders:
        give_back()  # what operators before in the same worker have freed
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def forget() -> None:
    """Drop this worker's encoders and give their memory back; operators that follow in the same worker need it."""
    _encoders.clear()
    give_back()


def give_back() -> None:
    """Give this worker's freed memory back to the system."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:  # freed blocks stay with the C library otherwise
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of an installed public vocabulary; any other tokenizers file may be passed to the operators instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_groups(texts: list[str | None], most: int = 4_000_000):
    """Index ranges of a batch whose texts hold at most ``most`` characters together (a longer text stands alone)."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def column_groups(texts, most: int = 4_000_000):
    """:func:`text_groups` of an Arrow column, by bytes; only a group's texts need to become Python strings."""
    import pyarrow.compute as pc

    begin, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        n = n or 0
        if size and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)

"""Tokenizer files, one copy a worker, and ids of the distinct segments of a batch."""

from __future__ import annotations

import functools
import re
import struct

import numpy as np
from tokenizers import Tokenizer

#: Entries of one generation of a worker's cache; two generations are held at most.
GENERATION = 100_000


@functools.lru_cache(maxsize=1)
def byte_alphabet() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 in byte order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in shown)
    moved = {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [moved.get(b, chr(b)) for b in range(256)]


_TO_ALPHABET = {b: c for b, c in enumerate(byte_alphabet())}


def as_alphabet(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_TO_ALPHABET)


@functools.lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


class GenerationCache:
    """A dict of bounded size: entries not asked for during a whole generation are forgotten."""

    def __init__(self, most: int = GENERATION):
        self.most, self.young, self.old = most, {}, {}

    def get_many(self, keys: list, make) -> list:
        """Values of ``keys``; ``make`` gets the list of missing keys and returns theirs."""
        young, old = self.young, self.old
        found = [young.get(k) for k in keys]
        missing = []
        for i, v in enumerate(found):
            if v is None:
                k = keys[i]
                v = old.get(k)
                if v is None:
                    missing.append(i)
                else:
                    found[i] = young[k] = v
        if missing:
            for i, v in zip(missing, make([keys[i] for i in missing]), strict=True):
                found[i] = young[keys[i]] = v
        if len(young) > self.most:
            self.old, self.young = young, {}
        return found


#: Segments known to be a single piece whatever stands beside them, and unchanged by the
#: normaliser of a lower-casing tokenizer.
_PLAIN = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_PLAIN_FOLDED = re.compile("[a-zß-öø-ÿ]+").fullmatch
_PLAIN_ASCII = re.compile(b"[ ]?[A-Za-z]+").fullmatch
_PLAIN_ASCII_FOLDED = re.compile(b"[a-z]+").fullmatch


class SegmentIds:
    """Ids, as little-endian unsigned 32-bit integers, of segments by the tokenizers library."""

    def __init__(self, path: str):
        self.tokenizer, self.cache = load(path), GenerationCache()
        self.model = self.tokenizer.model
        self.fold = self.tokenizer.normalizer is not None

    def _make(self, words: list[bytes]) -> list[bytes]:
        plain, ascii_plain = (_PLAIN_FOLDED, _PLAIN_ASCII_FOLDED) if self.fold else (_PLAIN, _PLAIN_ASCII)
        tokenize, space = self.model.tokenize, byte_alphabet()[32]
        out, rest, pack = [None] * len(words), [], _PACK
        for i, w in enumerate(words):
            if ascii_plain(w):
                t = tokenize(w.decode().replace(" ", space))
            elif plain(w.decode()):
                t = tokenize(as_alphabet(w))
            else:
                rest.append(i)
                continue
            out[i] = pack[n](*[x.id for x in t]) if (n := len(t)) < 64 else np.array([x.id for x in t], "<u4").tobytes()
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([words[i].decode() for i in part], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def __call__(self, words: list[bytes]) -> list[bytes]:
        return self.cache.get_many(words, self._make)


@functools.lru_cache(maxsize=4)
def segment_ids(path: str) -> SegmentIds:
    return SegmentIds(path)


def batch_ids(codes: np.ndarray, bounds: np.ndarray, encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch in order, and where each text begins among them."""
    if not len(codes):
        return np.zeros(0, "<u4"), np.zeros(len(bounds), np.int64)
    named = np.empty(len(encoded), object)
    named[:] = encoded
    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
    ends = np.cumsum(lengths[codes])
    return np.frombuffer(b"".join(named[codes].tolist()), "<u4"), np.concatenate([[0], ends])[bounds]

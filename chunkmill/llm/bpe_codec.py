"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a piece there is exactly one token that can be the last one of the
prefix's encoding. It is found among the vocabulary tokens that are suffixes of the prefix
(an automaton with suffix links over the vocabulary lists them) by testing whether it may
stand after the last token of what precedes it: two tokens are *compatible* if, replaying the
merges on both sides of their border in order of rank, no merge ever crosses the border.
Back-pointers from the end then give the ids, with no merge loop over the text.

Both the byte-level and the word-end kind of vocabulary are read. Vocabularies in which two
merges make the same token are refused (the construction needs one derivation a token).
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .segments import segment, slices
from .vocab import GenerationCache, byte_alphabet

_NEVER = 1 << 60
#: Compatibility answers kept before the table starts anew.
_PAIRS = 2_000_000


class PrefixCodec:
    """Exact ids of pieces, and text of ids, for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ending = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.token_text = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_text.update({i: t for t, i in self.special.items()})
        self.joint = "" if spec["decoder"] else " "
        self.lowers = spec["normalizer"] is not None
        pattern = spec["pre_tokenizer"].get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        self.pieces = regex.compile(pattern or r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

        # A symbol is one character: chr(byte), or chr(256 + byte) for the byte that ends a word.
        symbols: dict[int, str] = {}
        for b, c in enumerate(byte_alphabet()):
            if c in vocab:
                symbols[vocab[c]] = chr(b)
            if self.ending and c + self.ending in vocab:
                symbols[vocab[c + self.ending]] = chr(256 + b)
        self.left, self.right, self.rank, self.merge = {}, {}, {}, {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made, a, b = vocab[a + b], vocab[a], vocab[b]
            if made in symbols:
                raise ValueError(f"two derivations of token {made}")
            symbols[made] = symbols[a] + symbols[b]
            self.left[made], self.right[made], self.rank[made], self.merge[a, b] = a, b, r, r
        self.suffixes = ahocorasick.Automaton()
        reachable: set[int] = set()
        for t in symbols:  # bases first, then in order of rank
            if t not in self.rank or (self.left[t] in reachable and self.right[t] in reachable and self._first_crossing(self.left[t], self.right[t]) == self.rank[t]):
                reachable.add(t)
                self.suffixes.add_word(symbols[t], (t, len(symbols[t])))
        self.suffixes.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}

    def _first_crossing(self, a: int, b: int) -> int:
        """Rank of the first merge that crosses the border between tokens ``a`` and ``b`` when
        each is built from its symbols by its own merges; _NEVER if none does."""
        right_edge, left_edge = [a], [b]
        while right_edge[-1] in self.rank:
            right_edge.append(self.right[right_edge[-1]])
        while left_edge[-1] in self.rank:
            left_edge.append(self.left[left_edge[-1]])
        x, y = right_edge.pop(), left_edge.pop()
        while True:
            x_ends = self.rank[right_edge[-1]] if right_edge else _NEVER
            y_ends = self.rank[left_edge[-1]] if left_edge else _NEVER
            crossing = self.merge.get((x, y), _NEVER)
            # merges of one rank go from left to right: x's own pair, the crossing one, y's own
            if crossing < x_ends and crossing <= y_ends and crossing < _NEVER:
                return crossing
            if x_ends == y_ends == _NEVER:
                return _NEVER
            if x_ends <= y_ends:
                x = right_edge.pop()
            else:
                y = left_edge.pop()

    def piece_ids(self, piece: bytes) -> list[int]:
        """Ids of one piece (no piece border inside)."""
        text = piece.decode("latin-1")
        if self.ending:
            text = text[:-1] + chr(256 + piece[-1])
        last, back, known = [0] * len(text), [0] * len(text), self.compatible
        for end, (token, length) in self.suffixes.iter(text):
            before = end - length
            if before >= 0:
                pair = (last[before], token)
                fits = known.get(pair)
                if fits is None:
                    if len(known) > _PAIRS:
                        known.clear()
                    fits = known[pair] = self._first_crossing(*pair) == _NEVER
                if not fits:
                    continue
            last[end], back[end] = token, before
        ids, at = [], len(text) - 1
        while at >= 0:
            ids.append(last[at])
            at = back[at]
        ids.reverse()
        return ids

    def _plain(self, text: str) -> list[int]:
        if self.lowers:
            text = unicodedata.normalize("NFC", text)
            text = text.lower() if text.isascii() else "".join(map(str.lower, text))
        ids: list[int] = []
        for piece in self.pieces.findall(text):
            ids += self.piece_ids(piece.encode())
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text; special strings in it become their ids."""
        if self.specials is None or "<" not in text:
            return self._plain(text)
        ids: list[int] = []
        at = 0
        for m in self.specials.finditer(text):
            ids += self._plain(text[at : m.start()])
            ids.append(self.special[m[0]])
            at = m.end()
        return ids + self._plain(text[at:])

    def encode_segments(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Of each segment: its ids as little-endian unsigned 32-bit integers, and what they decode to."""
        coded = [self.encode(w.decode()) for w in words]
        return [(np.array(ids, "<u4").tobytes(), self.decode(ids).encode()) for ids in coded]

    def decode(self, ids) -> str:
        """Text of ids, special ones included. Without a decoder in the file, token texts are
        joined by a space; with the byte-level one, their bytes are read as UTF-8."""
        parts = [self.token_text[i] for i in ids]
        if self.joint:
            return self.joint.join(parts)
        back = _from_alphabet()
        return b"".join(p.encode() if p in self.special else bytes(back[c] for c in p) for p in parts).decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def _from_alphabet() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_alphabet())}


@functools.lru_cache(maxsize=2)
def codec(path: str) -> PrefixCodec:
    return PrefixCodec(path)


@functools.lru_cache(maxsize=2)
def _codec_cache(path: str) -> GenerationCache:
    return GenerationCache(100_000)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, and decode the ids again.

    Returns ``id_col``, ``n_tokens`` long, ``ids`` array<long>, ``decoded`` string; one row for
    each input row (repeated rows and null ids stay), no other input column. Null text counts as
    empty: no ids, decoded to "". ``tokenizer`` is the path of a tokenizer file on every worker.
    """
    return _run(docs, tokenizer, id_col, text_col, digests=False)


def encode_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, with SHA-256 digests (``ids_sha256`` of the ids as little-endian unsigned
    32-bit integers, ``decoded_sha256`` of the UTF-8 text) in place of ids and text."""
    return _run(docs, tokenizer, id_col, text_col, digests=True)


def _run(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    def work(batches):
        coder, cache = codec(tokenizer), _codec_cache(tokenizer)
        joint = coder.joint.encode()
        for batch in batches:
            for part in slices(batch, "text"):
                cut = segment(part.column("text"), coder.lowers)
                made = cache.get_many(cut.words, coder.encode_segments)
                named = np.empty((len(made), 2), object)
                named[:] = made if made else np.empty((0, 2), object)
                ids, texts, bounds = named[cut.codes, 0], named[cut.codes, 1], cut.bounds.tolist()
                n, first, second = [], [], []
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    raw, text = b"".join(ids[a:b].tolist()), joint.join(filter(None, texts[a:b].tolist()))  # white space alone has no ids
                    n.append(len(raw) // 4)
                    first.append(hashlib.sha256(raw).hexdigest() if digests else np.frombuffer(raw, "<u4").astype(np.int64))
                    second.append(hashlib.sha256(text).hexdigest() if digests else text.decode())
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(n, pa.int64()), pa.array(first, pa.string() if digests else pa.list_(pa.int64())), pa.array(second, pa.string())], names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] if digests else [id_col, "n_tokens", "ids", "decoded"]
    kind = docs.schema[id_col].dataType.simpleString()
    types = ["string", "string"] if digests else ["array<bigint>", "string"]
    schema = f"`{id_col}` {kind}, n_tokens bigint, {names[2]} {types[0]}, {names[3]} {types[1]}"
    return docs.select(docs[id_col].alias("key"), docs[text_col].alias("text")).mapInArrow(work, schema)


def decode(coded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Text of each row's ids: ``id_col``, ``decoded`` string; null ids give null."""

    def work(batches):
        coder = codec(tokenizer)
        for batch in batches:
            texts = [None if ids is None else coder.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], [id_col, "decoded"])

    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(coded[id_col].alias("key"), coded[ids_col].alias("ids")).mapInArrow(work, f"`{id_col}` {kind}, decoded string")

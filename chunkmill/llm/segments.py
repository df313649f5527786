"""Cut texts at places no tokenizer piece can span, and name the distinct parts.

Sub-word tokenizers work piece by piece, and pieces repeat. A batch of texts is cut, on
its raw UTF-8 buffer, into *segments* whose ids do not depend on their neighbours; only
the distinct segments of a batch meet Python. Cuts made, all of them borders for the
byte-level pattern and for the word-end pattern alike:

* before an ASCII white-space byte that follows something other than white space;
* after a single line feed that stands between other things than white space;
* between an ASCII letter and one of ``PUNCTUATION`` (apostrophes and the characters of
  special tokens are left out, so contractions and special strings stay whole).

Where white space is part of the ids, leaving a possible cut out is always right, it only makes
a segment longer; so a cut next to bytes that may end a non-ASCII space is not made. Where it is
dropped (``fold``), the cut before a run of it is always made, as words would be glued without.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

PUNCTUATION = b'.,;:!?()"#$%&*'

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(PUNCTUATION)] = True
#: The last two UTF-8 bytes of the non-ASCII white-space characters (U+0085, U+00A0, U+1680,
#: U+2000..200A, U+2028, U+2029, U+202F, U+205F, U+3000).
_MAYBE_SPACE_END = np.zeros(256, bool)
_MAYBE_SPACE_END[[0x85, 0xA0, 0xA8, 0xA9, 0xAF, 0x9F, *range(0x80, 0x8B)]] = True
_MAYBE_SPACE_LEAD = np.zeros(256, bool)
_MAYBE_SPACE_LEAD[[0xC2, 0x9A, 0x80, 0x81]] = True
#: The first UTF-8 bytes of those characters.
_MAYBE_SPACE_BEGIN = np.zeros(256, bool)
_MAYBE_SPACE_BEGIN[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Segments:
    """``codes[bounds[i]:bounds[i + 1]]`` are the segments of text i, as indexes of ``words``."""

    words: list[bytes]
    codes: np.ndarray
    bounds: np.ndarray


def raw_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and where each text begins; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def borders(data: np.ndarray, fold: bool = False) -> np.ndarray:
    """The cuts listed above: whether a piece begins at each byte, as far as that is sure."""
    n = len(data)
    space = _SPACE[data]
    cut = np.zeros(n + 1, bool)
    soft = _MAYBE_SPACE_END[data]
    soft[1:] &= _MAYBE_SPACE_LEAD[data[:-1]]
    # where white space is dropped, every run of it is a border; else one may go on a non-ASCII space before it
    cut[1:n] = space[1:] & ~space[:-1] & (fold | ~soft[:-1])
    if n > 2:
        # x \n | y : the line feed is a piece of its own
        cut[2:n] |= (data[1:-1] == 10) & ~space[2:] & ~_MAYBE_SPACE_BEGIN[data[2:]] & ~space[:-2] & ~soft[:-2]
    letter, punct = _LETTER[data], _PUNCT[data]
    cut[1:n] |= (letter[:-1] & punct[1:]) | (punct[:-1] & letter[1:])
    return cut


def segment(texts: pa.Array, fold: bool = False) -> Segments:
    """Segments of each text. ``fold``: for tokenizers that lower-case and drop white space;
    ASCII letters are then folded and leading white space is left out of the segments."""
    data, starts = raw_buffer(texts)
    n, docs = len(data), len(starts) - 1
    if not n:
        return Segments([], np.zeros(0, np.int64), np.zeros(docs + 1, np.int64))
    space = _SPACE[data]
    cut = borders(data, fold)
    cut[starts] = True
    cut[n] = True
    at = np.flatnonzero(cut)
    begin = at[:-1]
    if fold:
        if not np.any((data[:-1] == 60) & (data[1:] == 124)):  # "<|": a special string must keep its case
            data = _LOWER[data]
        # without white space, a segment of nothing else is empty
        solid = ~space
        data = data[solid]
        at = np.concatenate([[0], np.cumsum(solid)])[at]
        full = np.flatnonzero(np.diff(at))
        first, count = np.searchsorted(full, np.searchsorted(begin, starts[:-1])), len(full)
        at = np.append(at[full], len(data))
    else:
        first, count = np.searchsorted(begin, starts[:-1]), len(begin)
    bounds = np.append(first, count).astype(np.int64)
    if not count:
        return Segments([], np.zeros(0, np.int64), bounds)
    parts = pa.Array.from_buffers(pa.large_binary(), count, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    named = parts.dictionary_encode()
    return Segments(named.dictionary.to_numpy(zero_copy_only=False).tolist(), named.indices.to_numpy(zero_copy_only=False), bounds)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20):
    """Cut a batch by rows so that the texts of a slice hold about ``most_bytes`` at most (one
    row at least), which bounds a worker's memory whatever the batch size is."""
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > most_bytes:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(lengths):
        yield batch.slice(begin)

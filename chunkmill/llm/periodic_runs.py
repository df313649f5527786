"""Periodic runs of words by repeated k-gram masking and Main-Lorentz.

A run is a stretch of consecutive words with smallest period q that is at least ``exponent`` periods (and
``least`` words) long and that neither neighbour extends. Such a stretch overlaps itself, shifted by q, in
``overlap`` words at least, so each of its words lies in a k-gram of that length that the document holds
twice. Words outside repeated k-grams therefore join no run: they are masked by one sort of k-gram hashes,
and only the stretches that survive are searched.

Main-Lorentz divides and conquers: a run crosses the middle of some node of about its own period, and from
there is as long as the words agree with those one period on, to both sides. Nodes of one size are done
together, for all documents of a batch: at size S only the periods with S < exponent * period <= 2 S are tried
(smaller ones belong to smaller nodes), and both extensions come from names of blocks of 1, 2, 4 ... words, so
that a batch of n words costs about n log n steps of array operations.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import raw_buffer, slices

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that are searched together (one text at least).
HELD = 2 << 20


def overlap(exponent: int, least: int) -> int:
    """Words in which the shortest allowed run overlaps itself, one period on."""
    return min(max(least, exponent * q) - q for q in range(1, least + 2))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a batch, the word of each place as an index, and where each text's words begin."""
    data, starts = raw_buffer(texts)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = starts[:-1][starts[:-1] < len(data)]
    first[inner] |= solid[inner]
    at = np.flatnonzero(first)
    places = np.concatenate([[0], np.cumsum(solid)])
    offsets = np.append(places[at], places[-1]).astype(np.int64)
    packed = np.ascontiguousarray(data[solid])
    # as the white space is gone, a word ends where the next begins
    parts = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
    return parts.dictionary, parts.indices.to_numpy(zero_copy_only=False), np.append(np.searchsorted(at, starts[:-1]), len(at))


def repeated_grams(codes: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """Whether each word lies in a k-gram that its document holds twice. (Equal hashes of different k-grams
    only let more words survive.)"""
    n = len(codes) - k + 1
    covered = np.zeros(len(codes), bool)
    if n <= 0:
        return covered
    document = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    rolled = document[:n].astype(np.uint64) * _M2
    for j in range(k):
        rolled = (rolled ^ (codes[j : j + n].astype(np.uint64) + np.uint64(1))) * _M1
        rolled ^= rolled >> np.uint64(29)
    whole = np.flatnonzero(document[:n] == document[k - 1 :])
    order = whole[np.argsort(rolled[whole], kind="stable")]
    same = rolled[order][1:] == rolled[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] = same
    twice[:-1] |= same
    step = np.zeros(len(codes) + 1, np.int64)
    np.add.at(step, order[twice], 1)
    np.add.at(step, order[twice] + k, -1)
    return np.cumsum(step[:-1]) > 0


def _names(line: np.ndarray, longest: int) -> list[np.ndarray]:
    """Of each power of two up to ``longest``, the name of the block of so many words that begins at each place."""
    levels = [line]
    size = 1
    while 2 * size <= longest:
        a, b = levels[-1][:-size], levels[-1][size:]
        levels.append(np.unique(a.astype(np.int64) * (int(levels[-1].max()) + 1) + b, return_inverse=True)[1].astype(np.int32))
        size *= 2
    return levels


def _agreement(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray, back: bool) -> np.ndarray:
    """How many words from ``x`` on and from ``y`` on agree (``back``: before them, towards the beginning)."""
    x, y, got = x.copy(), y.copy(), np.zeros(len(x), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        size = 1 << j
        able = np.flatnonzero((x >= size) if back else (y + size <= len(levels[0])))
        a, b = (x[able] - size, y[able] - size) if back else (x[able], y[able])
        move = able[levels[j][a] == levels[j][b]]
        x[move] += -size if back else size
        y[move] += -size if back else size
        got[move] += size
    return got


def main_lorentz(line: np.ndarray, room: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, smallest period) of every run. ``line``: the words of all segments, with a word of its own before
    each and at the end; ``room``: the length of the segment at each place."""
    found = [np.zeros((3, 0), np.int64)]
    longest = int(room.max()) if len(room) else 0
    levels = _names(line, longest) if longest else []
    size = 1
    while size < longest:
        periods = np.arange(size // exponent + 1, 2 * size // exponent + 1)
        middles = np.arange(size, len(line), size)
        middles = middles[room[middles] > size]
        if len(periods) and len(middles):
            m, p = np.repeat(middles, len(periods)), np.tile(periods, len(middles))
            for x in (m, m - p):
                fit = np.flatnonzero((x >= 1) & (x + p < len(line)))
                a, q = x[fit], p[fit]
                near = np.flatnonzero((line[a] == line[a + q]) | (line[a - 1] == line[a + q - 1]))
                a, q = a[near], q[near]
                before, after = _agreement(levels, a, a + q, True), _agreement(levels, a, a + q, False)
                length = before + q + after
                hit = length >= np.maximum(least, exponent * q)
                found.append(np.stack([a - before, length, q])[:, hit])
        size *= 2
    start, length, period = np.concatenate(found, axis=1)
    # a stretch is found from several middles, and by multiples of its period
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return start[new], length[new], period[new]


def find_runs(codes: np.ndarray, bounds: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of all documents, by start, then period; starts count from the batch's first word."""
    covered = repeated_grams(codes, bounds, overlap(exponent, least))
    begins = covered.copy()
    begins[1:] &= ~covered[:-1]
    border = bounds[:-1][bounds[:-1] < len(codes)]
    begins[border] |= covered[border]
    at = np.flatnonzero(covered)
    part = np.cumsum(begins[at]) - 1
    sizes = np.bincount(part) if len(part) else np.zeros(0, np.int64)
    long = sizes >= least
    at, part = at[long[part]], part[long[part]]
    part = (np.cumsum(long) - 1)[part]
    sizes = sizes[long]
    place = np.arange(len(at)) + part + 1
    n = len(at) + len(sizes) + 1
    line = np.arange(n, dtype=np.int64) + (int(codes.max()) + 1 if len(codes) else 0)
    line[place] = codes[at]
    room, origin = np.zeros(n, np.int64), np.zeros(n, np.int64)
    room[place], origin[place] = sizes[part], at
    start, length, period = main_lorentz(line, room, exponent, least)
    order = np.lexsort((period, origin[start]))
    return origin[start][order], length[order], period[order]


def collapse_runs(docs: DataFrame, exponent: int = 4, least: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of the words ``[^\\x20\\x09-\\x0D]+`` of every whole text, and the text without their repetitions.

    Returns a row for each input row: ``id_col``, ``n_words`` long, ``runs`` array<struct<start, length, period>> (long; words
    count from 0; by start, then period), ``collapsed`` string: the words that no run holds behind its first period, joined by
    one space. Null text and text without words have no runs and collapse to ""; case counts; repeated rows and
    null ids are searched each; an empty table gives no rows. Other input columns are not read. ``exponent``: at least 2.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_words", "runs", "collapsed"]

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text", HELD):
                known, codes, bounds = split_words(part.column("text"))
                start, length, period = find_runs(codes, bounds, exponent, least)
                step = np.zeros(len(codes) + 1, np.int64)
                np.add.at(step, start + period, 1)
                np.add.at(step, start + length, -1)
                kept = np.cumsum(step[:-1]) == 0
                ends = np.concatenate([[0], np.cumsum(kept)])[bounds].tolist()
                named = known.to_numpy(zero_copy_only=False)[codes[kept]].tolist() if len(codes) else []
                texts = [b" ".join(named[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                owner = np.searchsorted(bounds, start, side="right") - 1
                spans = pa.StructArray.from_arrays([pa.array(start - bounds[owner]), pa.array(length), pa.array(period)], ["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(start, bounds).astype(np.int32)), spans)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(np.diff(bounds)), runs, pa.array(texts, pa.binary()).cast(pa.string())], names)

    schema = f"`{id_col}` {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select(docs[id_col].alias("key"), docs[text_col].alias("text")).mapInArrow(work, schema)


def run_digests(collapsed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of ``collapse_runs``'s rows: ``n_runs``; ``start``, ``length``, ``period`` and ``exponent_milli`` of the longest run (ties:
    smallest start, then period), null without runs; ``runs_sha256`` of every run's ``start,length,period`` and a line feed;
    ``collapsed_sha256``."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = collapsed.withColumn("_b", best)
    return out.select(
        id_col, F.size("runs").cast("bigint").alias("n_runs"), (-F.col("_b.s")).alias("start"), F.col("_b.length").alias("length"), (-F.col("_b.p")).alias("period"),
        F.floor(F.lit(1000).cast("bigint") * F.col("_b.length") / -F.col("_b.p")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def repeat_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``text_col``, with a periodic tail in every tenth text by the crc32 h of its id: with g = h // 10, of n words
    each word i from a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8). Other texts, those without
    words and rows without an id stay as they are."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        for batch in batches:
            keys = batch.column("key").to_pylist()
            hashes = [0 if k is None else zlib.crc32(str(k).encode()) for k in keys]
            chosen = np.array([k is not None and h % 10 == 0 for k, h in zip(keys, hashes, strict=True)], bool)
            chosen &= batch.column("text").is_valid().to_numpy(zero_copy_only=False)
            made = []
            for i in np.flatnonzero(chosen).tolist():
                words, g = batch.column("text")[i].as_py().encode().split(), hashes[i] // 10
                if not words:
                    made.append("")
                    continue
                a = g % len(words)
                p = 1 + (len(words) - a) // (3 + g % 8)
                tail = words[a : a + p]
                made.append(b" ".join(words[:a] + (tail * ((len(words) - a) // p + 1))[: len(words) - a]).decode())
            text = pc.replace_with_mask(batch.column("text"), pa.array(chosen), pa.array(made, batch.column("text").type))
            yield pa.RecordBatch.from_arrays([batch.column("key"), text], [id_col, text_col])

    return docs.select(docs[id_col].alias("key"), docs[text_col].alias("text")).mapInArrow(work, f"`{id_col}` {kind}, `{text_col}` string")

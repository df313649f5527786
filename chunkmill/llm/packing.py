"""Packing documents into sequences of near-equal length by multiway differencing.

Within a group of documents, Karmarkar-Karp differencing builds the windows: every piece begins
as a partial partition (its length in one window, nothing in the others); the two partial
partitions of largest spread are merged again and again, the fullest window of one with the
emptiest of the other, so that imbalances cancel. The number of windows begins at the least that
could hold the group, and rises whenever a window exceeds the capacity. Short documents that
follow each other are one item of the differencing, and a group ends at ITEMS items; those that
would begin another window are left to the next group, so windows of all but a task's last group
are nearly full. Groups follow the order of rows within a task, so packing needs no shuffle and
grows with the number of tasks.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .segments import segment, slices
from .vocab import batch_ids, segment_ids

#: Pieces are at most this share of a window, so that differencing has pieces to balance with.
SHARE = 8
#: Bytes of texts that are tokenized at once, beside which a worker holds the pieces of the items begun.
SLICE = 1 << 19
#: Items that are differenced together, and how many ids of a window may stay free so that they fit.
ITEMS, SLACK = 512, 12


def difference(lengths: list[int], windows: int) -> list[list[int]]:
    """Indexes of ``lengths`` in each of ``windows`` windows of near-equal sums (the largest
    differencing method, for any number of windows)."""
    if windows == 1:
        return [list(range(len(lengths)))]
    heap = []
    for i, n in enumerate(lengths):
        sums = np.zeros(windows, np.int64)
        sums[0] = n
        heap.append((-n, i, sums, [[i], *([] for _ in range(windows - 1))]))
    heapq.heapify(heap)
    order = len(lengths)
    while len(heap) > 1:
        _, _, a, a_sets = heapq.heappop(heap)
        _, _, b, b_sets = heapq.heappop(heap)
        sums = a + b[::-1]
        sets = [x + y for x, y in zip(a_sets, reversed(b_sets), strict=True)]
        by = np.argsort(-sums, kind="stable")
        sums = sums[by]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), order, sums, [sets[j] for j in by.tolist()]))
        order += 1
    return heap[0][3] if heap else []


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity`` (no length exceeds it), as few as differencing fills."""
    total = sum(lengths)
    windows = max(1, -(-total // capacity))
    while True:
        sets = difference(lengths, windows)
        if all(sum(lengths[i] for i in s) <= capacity for s in sets):
            return [s for s in sets if s]
        windows += 1


def cut(length: int, capacity: int, share: int = SHARE) -> list[int]:
    """Lengths of a document's pieces: whole sequences first, then parts of a sequence's ``share``."""
    step = max(1, capacity // share)
    full, rest = divmod(length, capacity)
    return [capacity] * full + [step] * (rest // step) + ([rest % step] if rest % step else [])


def grouped(lengths: list[int], most: int) -> list[list[int]]:
    """Indexes of ``lengths`` in items: neighbours together up to ``most``, but every fourth alone, so that
    there are small ones to fill windows with."""
    items, held = [], most + 1
    for i, n in enumerate(lengths):
        if held + n > most or len(items) % 4 == 0:
            items.append([])
            held = 0
        items[-1].append(i)
        held += n
    return items


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", ids_too: bool = False) -> DataFrame:
    """Pack every whole text, each with ``end_id`` appended, into sequences of ``capacity`` ids.

    Returns a row for each piece: ``id_col``, ``start`` long (ids of its document before it),
    ``length`` long, ``ids_crc32`` long (CRC-32 of its ids as little-endian unsigned 32-bit
    integers), ``doc_tokens`` long (ids of its document, the end id included), ``sequence_id``
    long, ``offset`` long (its place in the sequence; no gaps, from 0), and with ``ids_too``
    ``ids`` array<int>. Null or empty text is the end id alone; repeated rows and null ids are
    packed each; an empty table gives no rows. Sequences of one task share the upper bits of
    ``sequence_id``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * ids_too]

    def work(batches):
        coder = segment_ids(tokenizer)
        task, sequence = TaskContext.get().partitionId() << 33, 0
        whole: list[tuple] = []  # (row, start, length) that fill a sequence alone
        keys, texts, starts, lengths, totals = [], [], [], [], []
        step, n_items, held = max(1, capacity // SHARE), 0, 0  # items begun, and ids in the last

        def packed(end):
            """Windows of the pieces held; unless it is the ``end``, those of a window begun stay."""
            nonlocal sequence, n_items
            items = grouped(lengths, step)
            sums = [sum(lengths[i] for i in item) for item in items]
            if not end:
                room = sum(sums) // capacity * (capacity - SLACK)
                while len(items) > 1 and sum(sums) > room > 0:
                    items.pop()
                    sums.pop()
            rows = []
            for s in pack(sums, capacity):
                at = 0
                for i in (i for j in s for i in items[j]):
                    rows.append((i, task + sequence, at))
                    at += lengths[i]
                sequence += 1
            index = [i for i, _, _ in rows]
            arrays = [
                pa.array([keys[i] for i in index], key_type), pa.array([starts[i] for i in index], pa.int64()), pa.array([lengths[i] for i in index], pa.int64()),
                pa.array([zlib.crc32(texts[i]) for i in index], pa.int64()), pa.array([totals[i] for i in index], pa.int64()),
                pa.array([s for _, s, _ in rows], pa.int64()), pa.array([o for _, _, o in rows], pa.int64()),
            ]
            if ids_too:
                arrays.append(pa.array([np.frombuffer(texts[i], "<u4").astype(np.int32) for i in index], pa.list_(pa.int32())))
            for column in (keys, texts, starts, lengths, totals):
                del column[: len(index)]  # items are in the order of pieces
            n_items = len(grouped(lengths, step))
            return pa.RecordBatch.from_arrays(arrays, names)

        def alone():
            nonlocal sequence
            arrays = [[], [], [], [], [], [], [], *[[]] * ids_too]
            for key, start, ids, total in whole:
                for column, v in zip(arrays, (key, start, len(ids), zlib.crc32(ids), total, task + sequence, 0, ids.astype(np.int32)), strict=False):
                    column.append(v)
                sequence += 1
            kinds = [key_type, *[pa.int64()] * 6, pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(arrays, kinds, strict=False)], names)

        for batch in batches:
            key_type = batch.column("key").type
            for part in slices(batch, "text", SLICE):
                cuts = segment(part.column("text"), coder.fold)
                ids, bounds = batch_ids(cuts.codes, cuts.bounds, coder(cuts.words))
                for key, a, b in zip(part.column("key").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], np.array([end_id], "<u4")).astype("<u4")
                    at = 0
                    for n in cut(len(own), capacity):
                        piece = own[at : at + n]
                        if n == capacity:
                            whole.append((key, at, piece, len(own)))
                        else:
                            if not lengths or held + n > step or n_items % 4 == 0:
                                n_items, held = n_items + 1, 0
                            held += n
                            keys.append(key)
                            starts.append(at)
                            lengths.append(n)
                            texts.append(piece.tobytes())
                            totals.append(len(own))
                        at += n
                    if len(whole) >= 64:
                        yield alone()
                        whole.clear()
                    if n_items >= ITEMS:
                        yield packed(False)
                        held = step
        if whole:
            yield alone()
        if lengths:
            yield packed(True)

    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * ids_too
    return docs.select(docs[id_col].alias("key"), docs[text_col].alias("text")).mapInArrow(work, schema)

"""Facts of bodies that come in parts, so that no body is held as a whole.

A fold goes over a body's parts in order and carries what may go on behind a border: the place of the next top-level
box, and the last bytes in which an index box may have begun.
"""

from __future__ import annotations

import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame

from .bodies import _MOST, MOOV_BYTES, _standalone, box_head, video_facts

FACTS = "size ftyp_offset ftyp_size mdat_offset mdat_size mdat_head moov_offset moov_size cut_offset cut_size".split()


class BodyFold:
    """Facts of one body of ``total`` bytes, whose parts are given in order; bytes that are not given are zeros."""

    def __init__(self, total: int):
        self.total, self.at, self.carry = total, 0, b""
        self.begin, self.box, self.top = b"", 0, {}
        self.hit: tuple[int, int] | None = None
        self.moov = b""

    def add(self, begin: int, content: bytes) -> None:
        gap = begin - self.at
        if gap > 0:
            self._block(bytes(min(gap, MOOV_BYTES[1])))
            if gap > MOOV_BYTES[1]:
                self.carry, self.at = bytes(MOOV_BYTES[1]), begin
        self._block(content)

    def _block(self, block: bytes) -> None:
        old, base = len(self.carry), self.at - len(self.carry)
        held = self.carry + block
        self.at += len(block)
        if len(self.begin) < 8:
            self.begin = (self.begin + block[:8])[:8]
        for m in re.finditer(b"moov", held):
            at = m.start() - 4
            if at < 0:
                continue
            size = struct.unpack_from(">I", held, at)[0]
            # one that ends in the bytes carried was met before
            if MOOV_BYTES[0] <= size <= MOOV_BYTES[1] and old < at + size <= len(held) and (self.hit is None or base + at > self.hit[0]):
                inner = held[at : at + size]
                if b"mvhd" in inner and b"trak" in inner:
                    self.hit, self.moov = (base + at, size), inner
        self._walk(held, base, self.at >= self.total)
        self.carry = held[-(MOOV_BYTES[1] + 8) :]

    def _walk(self, held: bytes, base: int, last: bool) -> None:
        if self.box is not None and self.box < base:  # in zeros that were passed over
            self.box = None
        while self.box is not None and self.box < self.at and (last or self.box + 16 <= self.at):
            found = box_head(held[self.box - base : self.box - base + 16], self.total - self.box)
            if found is None:
                self.box = None
                return
            size, head, kind = found
            self.top.setdefault(kind, (self.box, size, head))
            self.box += size

    def facts(self) -> tuple:
        """The columns of ``bodies.piece_facts``."""
        if self.at < self.total:
            self.add(self.total, b"")
        base, cut = self.at - len(self.carry), (None, None)
        for m in re.finditer(b"moov", self.carry):
            at = m.start() - 4
            if m.start() + base < self.total - MOOV_BYTES[1] or at < 0:
                continue
            size = struct.unpack_from(">I", self.carry, at)[0]
            if MOOV_BYTES[0] <= size <= MOOV_BYTES[1] and at + size > len(self.carry) and b"mvhd" in self.carry[at:]:
                cut = (base + at, size)
        none = (None, None, None)
        return self.total, *self.top.get(b"ftyp", none)[:2], *self.top.get(b"mdat", none), *(self.hit or (None, None)), *cut, _standalone(self.begin), b"moov" in self.top, b"mdat" in self.top


def _folded(parts: DataFrame, keys: list[str], told, schema: str) -> DataFrame:
    """``told(fold)``, a row or None, of each body. ``parts``: ``keys``, ``part``, ``begin``, ``content`` and ``total``, the body's bytes."""
    kinds = ", ".join(f"`{k}` {parts.schema[k].dataType.simpleString()}" for k in keys)
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    types = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}

    def work(batches):
        key, kept, fold = None, None, None

        def ended():
            row = told(fold)
            if row is None:
                return []
            row = [min(v, _MOST) if isinstance(v, int) and not isinstance(v, bool) else v for v in row]
            return [pa.RecordBatch.from_arrays([*kept, *(pa.array([v], types[t]) for v, (_, t) in zip(row, fields, strict=True))], [*keys, *(n for n, _ in fields)])]

        for batch in batches:
            for i in range(batch.num_rows):
                own = tuple(batch.column(k)[i].as_py() if not pa.types.is_struct(batch.column(k).type) else str(batch.column(k)[i].as_py()) for k in keys)
                if own != key:
                    if fold is not None:
                        yield from ended()
                    key, fold = own, BodyFold(batch.column("total")[i].as_py())
                    kept = [pa.concat_arrays([batch.column(k).slice(i, 1)]) for k in keys]
                if batch.column("content")[i].is_valid:
                    fold.add(batch.column("begin")[i].as_py(), batch.column("content")[i].as_py())
        if fold is not None:
            yield from ended()

    ordered = parts.select(*keys, "part", "begin", "content", "total").repartition(*keys).sortWithinPartitions(*keys, "part")
    return ordered.mapInArrow(work, f"{kinds}, {schema}")


def piece_facts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``bodies.piece_facts`` of bodies in parts (``assemble.assemble_plan`` with ``totals``): the same rows at any part size."""
    return _folded(parts, keys, BodyFold.facts, ", ".join(f"{n} bigint" for n in FACTS) + ", standalone boolean, has_moov boolean, has_mdat boolean")


def video_info(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``bodies.video_info`` of bodies in parts."""

    def told(fold: BodyFold) -> tuple | None:
        fold.facts()
        return video_facts(fold.moov) if fold.hit else None

    return _folded(parts, keys, told, "width bigint, height bigint, video_codec string, audio_codec string, duration double")

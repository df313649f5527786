"""Facts of files from a few ranges of their bytes: layouts, first bytes, headers and box heads, whatever the size of their bodies.

Spark lists the files (``bodies.list_cache_files``, which reads no body); each task then opens its files and reads
only the ranges it is asked for: a Simple file's head and trailers, the first bytes of its body, its headers, the heads of its
top-level boxes. Stores: local paths and those that pyarrow opens by URI (HDFS, S3, GCS ...).
"""

from __future__ import annotations

import struct
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from .bodies import box_head, layout_of

#: What may be asked for, and bytes of a headers block that are read at most.
PARTS, MOST_HEADERS = ("layout", "head", "headers", "boxes"), 1 << 20


def opened(path: str):
    """The file at a path or URI, as Spark lists it (``file:/a b``)."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem().open_input_file(path)
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    place, inner = fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")
    return place.open_input_file(inner)


class Ranges:
    """Bytes of an open file by their place; ``count`` is how many were read."""

    def __init__(self, file):
        self.file, self.size, self.count = file, file.size(), 0

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or at >= self.size or n <= 0:
            return b""
        found = self.file.read_at(min(n, self.size - at), at)
        self.count += len(found)
        return found

    def find(self, what: bytes, at: int) -> int:
        """The first place of ``what`` from ``at`` on, or -1; a megabyte is held at once."""
        step = 1 << 20
        while at < self.size:
            hit = self.read(at, step + len(what) - 1).find(what)
            if hit >= 0:
                return at + hit
            at += step
        return -1


def top_kinds(read, begin: int, end: int) -> set[bytes]:
    """Types of the top-level boxes between two places."""
    found, at = set(), begin
    while (head := box_head(read(at, 16), end - at)) is not None:
        size, _, kind = head
        found.add(kind)
        at += size
    return found


def file_facts(listing: DataFrame, keys: list[str], want: tuple[str, ...] = PARTS, n: int = 256, side: bool = False) -> DataFrame:
    """``keys`` and, of each file at ``path``: with ``layout`` (always) ``body_start``, ``body_end``, ``headers_start``, ``headers_end`` as of
    ``bodies.unwrap_simple``; ``head``: the first ``n`` bytes (at most 4096) from the body's start, not cut where the body
    ends; ``headers``: the headers block; ``boxes``: ``has_moov`` and ``has_mdat``, of the top level of the body. What ``want`` leaves out is not read and is null. ``bytes_read``: how many bytes were read.
    A file that cannot be opened has nothing but ``error``."""
    kinds = ", ".join(f"`{k}` {listing.schema[k].dataType.simpleString()}" for k in keys)
    names = ["body_start", "body_end", "headers_start", "headers_end", "head", "headers", "has_moov", "has_mdat", "bytes_read", "error"]
    types = [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.bool_()] * 2 + [pa.int64(), pa.string()]

    def facts(path: str) -> tuple:
        try:
            with opened(path) as file:
                r = Ranges(file)
                begin, end, first, last = layout_of(r.read, r.find, r.size, side) or (0, r.size, None, None)
                head = r.read(begin, min(n, 4096)) if "head" in want else None
                raw = r.read(first, min(last - first, MOST_HEADERS)) if "headers" in want and first is not None else None
                moov = mdat = None
                if "boxes" in want:
                    top = top_kinds(r.read, begin, end)
                    moov, mdat = b"moov" in top, b"mdat" in top
                return begin, end, first, last, head, raw, moov, mdat, r.count, None
        except (OSError, pa.ArrowInvalid) as e:
            return *(None,) * 9, str(e)[:200]

    def work(batches):
        for batch in batches:
            rows = [facts(p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], [*keys, *names])

    schema = "body_start bigint, body_end bigint, headers_start bigint, headers_end bigint, head binary, headers binary, has_moov boolean, has_mdat boolean, bytes_read bigint, error string"
    return listing.select(*dict.fromkeys([*keys, "path"])).mapInArrow(work, f"{kinds}, {schema}")


def file_heads(listing: DataFrame, keys: list[str], n: int = 256) -> DataFrame:
    """``keys``, ``head`` and ``error``: first bytes of each file's body, by ranges."""
    return file_facts(listing, keys, ("head",), n).select(*keys, "head", "error")


def unwrap_files(listing: DataFrame, keys: list[str], side: bool = False) -> DataFrame:
    """``bodies.unwrap_simple`` by ranges: a few dozen bytes of each file, unless its trailer is damaged."""
    return file_facts(listing, keys, ("layout",), side=side).select(*keys, "body_start", "body_end", "headers_start", "headers_end", "error")

"""Bodies of cache files: listing, the Simple layout, sparse ranges, container boxes.

Binary layouts are walked by small helpers over Arrow batches; everything else is built-in. Rows
carry ``content`` only as long as a body is needed.
"""

from __future__ import annotations

import os
import re
import struct
from bisect import bisect_left, bisect_right
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import is_cache_file
from ..functions.values import little_endian
from .resources import kept

#: Layout constants of the Simple cache (little-endian). Fixed values.
FILE_MAGIC, EOF_MAGIC, RANGE_MAGIC = 0xFCFB6D1BA7725C30, 0xF4FA6F45970D41D8, 0xEB97BF016553676B
HEADER_BYTES, EOF_BYTES, RANGE_BYTES, HASH_BYTES, HAS_HASH = 24, 24, 32, 32, 2
#: Boxes that hold boxes, and the plausible size of an index box. Fixed values.
CONTAINERS = frozenset([b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"mvex", b"dinf", b"udta", b"moof", b"traf", b"sinf", b"schi"])
MOOV_BYTES = (500, 2_000_000)
_PRINTABLE = re.compile(rb"[\x20-\x7e]{4}").fullmatch


def _listed(folders: DataFrame) -> DataFrame:
    """``path``, ``size``, ``ms`` and ``folder`` of all that lies directly in each folder (``path``); each is listed by a task, in blocks of rows."""

    def work(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = os.scandir("/" + path.removeprefix("file:").lstrip("/"))
                while block := list(islice(found, 4096)):
                    told = [(f"{path}/{e.name}", e.is_dir(), e.stat()) for e in block if not e.name.startswith((".", "_"))]
                    yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in told], pa.string()), pa.array([t[2].st_size for t in told], pa.int64()), pa.array([t[2].st_mtime_ns // 1_000_000 for t in told], pa.int64()), pa.array([t[1] for t in told], pa.bool_())], ["path", "size", "ms", "folder"])

    return folders.select("path").mapInArrow(work, "path string, size bigint, ms bigint, folder boolean")


def _walked(spark: SparkSession, paths: list[str], with_empty: bool) -> DataFrame:
    """``path``, ``length`` and ``modificationTime`` of all files below local folders, level by level; no list of them meets on the driver."""
    made, level = None, spark.createDataFrame([("file:/" + p.removeprefix("file:").strip("/"),) for p in paths], "path string")
    while True:
        level = kept(_listed(level))
        files = level.where("not folder" if with_empty else "not folder and size > 0").select("path", F.col("size").alias("length"), F.timestamp_millis("ms").alias("modificationTime"))
        made = files if made is None else made.unionByName(files)
        level = level.where("folder")
        n = level.count()
        if not n:
            return made
        level = level.repartition(min(n, spark.sparkContext.defaultParallelism * 8))


def all_files(spark: SparkSession, paths: list[str], with_content: bool = False, with_empty: bool = False) -> DataFrame:
    """``path``, ``length``, ``modificationTime`` (and ``content``) of every file below ``paths``; see ``list_cache_files``."""
    local = all(p.startswith("file:/") or p.startswith("/") and spark.conf.get("spark.hadoop.fs.defaultFS", "file:///").startswith("file:") for p in paths)
    local = local and all(os.path.isdir("/" + p.removeprefix("file:").lstrip("/")) for p in paths)
    if local and not with_content:
        return _walked(spark, paths, with_empty)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    if local and with_empty:
        empty = _walked(spark, paths, True).where("length = 0").withColumn("content", F.lit(b""))
        found = found.unionByName(empty)
    return found


def list_cache_files(spark: SparkSession, paths: list[str], with_content: bool = False, with_empty: bool = False) -> DataFrame:
    """One row a cache file below ``paths``: ``cache_dir``, ``name``, ``path``, ``size``,
    ``modified_at`` (unix seconds); other files are left out. Bodies are not read unless asked for. Local folders are listed
    by tasks; other stores, and with bodies, by Spark, whose driver holds the list. Files without bytes, of which Spark
    lists none, are listed if asked for (in local folders)."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = all_files(spark, paths, with_content, with_empty).withColumn("name", name).where(is_cache_file(F.col("name")))
    columns = [F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("cache_dir"), "name", "path", F.col("length").alias("size"), (F.unix_micros("modificationTime") / F.lit(1e6)).alias("modified_at")]
    return rows.select(*columns, *["content"] * with_content)


def layout_of(read, find, size: int, side: bool = False) -> tuple[int, int, int | None, int | None] | None:
    """(body start, end, headers start, end) of a Simple file of ``size`` bytes; None if it is none. Headers are unknown
    (None) where only a scan finds the body's end, and in side (``_1``) files. ``read(at, n)`` gives bytes, ``find(what, at)``
    the place of some."""
    if size < HEADER_BYTES + EOF_BYTES:
        return None
    head = read(0, HEADER_BYTES)
    if struct.unpack_from("<Q", head)[0] != FILE_MAGIC:
        return None
    start = HEADER_BYTES + struct.unpack_from("<I", head, 12)[0]
    last = size - EOF_BYTES
    magic, flags, _, length = struct.unpack_from("<QIII", read(last, EOF_BYTES))
    if side:
        if start > last:
            return None
        return start, last if magic == EOF_MAGIC else size, None, None
    if start >= size:
        return None
    headers_end = last - (HASH_BYTES if flags & HAS_HASH else 0)
    headers = headers_end - length
    if magic == EOF_MAGIC and headers >= EOF_BYTES and struct.unpack("<Q", read(headers - EOF_BYTES, 8))[0] == EOF_MAGIC:
        return (start, headers - EOF_BYTES, headers, headers_end) if start <= headers - EOF_BYTES else None
    end = find(struct.pack("<Q", EOF_MAGIC), start)
    return None if end < 0 else (start, end, None, None)


def simple_layout(data: bytes, side: bool = False) -> tuple[int, int, int | None, int | None] | None:
    """``layout_of`` a whole file."""
    return layout_of(lambda at, n: data[at : at + n], data.find, len(data), side)


def simple_ranges(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, length, place in the file) of each range of a sparse file. The walk stops at a wrong
    magic; a last range that is cut off is as long as what is there; without ranges, the raw body
    is one range, without its trailer and hash."""
    if len(data) < HEADER_BYTES or struct.unpack_from("<Q", data)[0] != FILE_MAGIC:
        return []
    at = begin = HEADER_BYTES + struct.unpack_from("<I", data, 12)[0]
    found = []
    while at + RANGE_BYTES <= len(data):
        magic, offset, length = struct.unpack_from("<QQQ", data, at)
        if magic != RANGE_MAGIC:
            break
        at += RANGE_BYTES
        there = min(length, len(data) - at)
        if there or there == length:
            found.append((offset, there, at))
        if there < length:
            break
        at += length
    if found or begin >= len(data):
        return found
    end = len(data)
    if end - EOF_BYTES >= begin and struct.unpack_from("<Q", data, end - EOF_BYTES)[0] == EOF_MAGIC:
        hashed = struct.unpack_from("<I", data, end - EOF_BYTES + 8)[0] & HAS_HASH
        end -= EOF_BYTES + (HASH_BYTES if hashed else 0)
    return [(0, end - begin, begin)] if end > begin else []


def box_head(raw: bytes, room: int) -> tuple[int, int, bytes] | None:
    """(size, head size, type) of the box that begins with ``raw`` (its first 16 bytes, or all that are there), of which ``room`` bytes are
    left; None if none does."""
    if room < 8 or len(raw) < 8 or not _PRINTABLE(raw[4:8]):
        return None
    size, head = struct.unpack_from(">I", raw)[0], 8
    if size == 1:
        if len(raw) < 16 or room < 16:
            return None
        size, head = struct.unpack_from(">Q", raw, 8)[0], 16
    elif size == 0:
        size = room
    return None if size < 8 else (size, head, raw[4:8])


def boxes(data: bytes, deep: bool = True) -> list[tuple[int, int, int, str, int]]:
    """(offset, size, header size, type, depth) of every container box, parents before children; only
    the top level unless ``deep``. Boxes still to walk are held in a list, so nesting has no limit."""
    found, todo = [], [(0, len(data), 0)]
    while todo:
        start, end, depth = todo.pop()
        while (top := box_head(data[start : min(start + 16, end)], end - start)) is not None:
            size, head, kind = top
            found.append((start, size, head, kind.decode(), depth))
            if deep and kind in CONTAINERS:
                todo += [(start + size, end, depth), (start + head, min(start + size, end), depth + 1)]
                break
            start += size
    return found


def moov_hits(data: bytes) -> list[tuple[int, int]]:
    """(offset, size) of each plausible index box, wherever it stands."""
    found = []
    for m in re.finditer(b"moov", data):
        at = m.start() - 4
        if at < 0:
            continue
        size = struct.unpack_from(">I", data, at)[0]
        if MOOV_BYTES[0] <= size <= MOOV_BYTES[1] and at + size <= len(data):
            inner = data[at : at + size]
            if b"mvhd" in inner and b"trak" in inner:
                found.append((at, size))
    return found


def video_facts(moov: bytes) -> tuple[int, int, str, str, float]:
    """(width, height, video codec, audio codec, seconds) told by an index box; 0 and "" where it does
    not say. Of several tracks of a kind, the last decides."""
    found = boxes(moov)  # in order of offset
    places = [b[0] for b in found]
    width = height = 0
    codec = {"vide": "", "soun": ""}
    for at, size, _, _, _ in (b for b in found if b[3] == "trak"):
        first = {}
        for inside in found[bisect_right(places, at) : bisect_left(places, at + size)]:
            first.setdefault(inside[3], inside[0])
        if "hdlr" not in first or "stsd" not in first:
            continue
        handler = moov[first["hdlr"] + 16 : first["hdlr"] + 20].decode("latin-1")
        entry = first["stsd"] + 16
        if handler in codec and entry + 8 <= len(moov):
            codec[handler] = moov[entry + 4 : entry + 8].decode("latin-1").strip()
            if handler == "vide" and entry + 28 <= len(moov):
                width, height = struct.unpack_from(">HH", moov, entry + 24)
    seconds = 0.0
    head = next((b[0] for b in found if b[3] == "mvhd"), None)
    if head is not None and head + 9 <= len(moov):
        if moov[head + 8] == 0 and head + 28 <= len(moov):
            scale, units = struct.unpack_from(">II", moov, head + 20)
        elif head + 40 <= len(moov):
            scale, units = struct.unpack_from(">IQ", moov, head + 28)
        else:
            scale = 0
        seconds = units / scale if scale else 0.0
    return width, height, codec["vide"], codec["soun"], seconds


#: Bytes of bodies that a helper holds as Python objects at once (one body at least), and the largest integer of a column.
_HELD, _MOST = 32 << 20, (1 << 63) - 1


def _parts(batches, content: str):
    """Batches cut by rows so that their bodies hold about _HELD bytes."""
    for batch in batches:
        begin, held = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column(content)).fill_null(0).to_pylist()):
            if held and held + n > _HELD:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < batch.num_rows:
            yield batch.slice(begin)


def _rows(df: DataFrame, keys: list[str], content: str, helper, schema: str) -> DataFrame:
    """Each body's helper rows beside its keys. Numbers beyond 64 bits (in damaged files) become the largest."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def work(batches):
        for batch in _parts(batches, content):
            at, out = [], []
            for i, body in enumerate(batch.column(content).to_pylist()):
                for row in helper(body) if body is not None else ():
                    at.append(i)
                    out.append([min(v, _MOST) if isinstance(v, int) else v for v in row])
            index = pa.array(at, pa.int64())
            made = [pa.array([r[j] for r in out], pa.string() if f.endswith("string") else pa.float64() if f.endswith("double") else pa.bool_() if f.endswith("boolean") else pa.int64()) for j, f in enumerate(schema.split(", "))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(index) for k in keys), *made], [*keys, *names])

    return df.select(*dict.fromkeys([*keys, content])).mapInArrow(work, f"{kinds}, {schema}")


def simple_layout_of(raw: Column, side: bool = False) -> Column:
    """``simple_layout`` of a file's bytes as a column expression, a struct; a file that is not in the Simple layout is all body."""
    size = F.octet_length(raw).cast("bigint")
    bytes_at = lambda at, n: F.substring(raw, F.greatest(at + 1, F.lit(1)).cast("int"), F.lit(n))
    eof = struct.pack("<Q", EOF_MAGIC)
    names = ("body_start", "body_end", "headers_start", "headers_end")
    made = lambda *at: F.struct(*(F.lit(x).cast("bigint").alias(n) if x is None or isinstance(x, int) else x.alias(n) for x, n in zip(at, names, strict=True)))
    whole = made(0, size, None, None)
    start, last = HEADER_BYTES + little_endian(raw, 12), size - EOF_BYTES
    trailer = bytes_at(last, EOF_BYTES)
    simple, ended = (size >= HEADER_BYTES + EOF_BYTES) & (F.substring(raw, 1, 8) == F.lit(struct.pack("<Q", FILE_MAGIC))), F.substring(trailer, 1, 8) == F.lit(eof)
    if side:
        return F.when(simple & (start <= last), made(start, F.when(ended, last).otherwise(size), None, None)).otherwise(whole)
    headers_end = last - F.when(little_endian(trailer, 8).bitwiseAND(HAS_HASH) != 0, HASH_BYTES).otherwise(0)
    headers = headers_end - little_endian(trailer, 16)
    body_end = headers - EOF_BYTES
    told = ended & (body_end >= 0) & (bytes_at(body_end, 8) == F.lit(eof))
    # a character a byte, so that the place found is one of bytes
    found = F.position(F.lit(eof.decode("latin-1")), F.decode(raw, "ISO-8859-1"), F.least(start, size).cast("int") + 1).cast("bigint") - 1
    scanned = F.when(found >= 0, made(start, found, None, None)).otherwise(whole)
    return F.when(~simple | (start >= size), whole).when(told, F.when(start <= body_end, made(start, body_end, headers, headers_end)).otherwise(whole)).otherwise(scanned)


def unwrap_simple(df: DataFrame, keys: list[str], content: str = "content", side: bool = False) -> DataFrame:
    """``body_start``, ``body_end``, ``headers_start``, ``headers_end`` of each file; a file that is not
    in the Simple layout is all body. Built-in expressions only, so that bodies, which ``keys`` may name, do not pass through Python.
    As rows of a generator, what makes a body is not copied into each condition on its layout."""
    made = F.when(F.col(content).isNotNull(), F.array(simple_layout_of(F.col(content), side)))
    return df.select(*keys, F.inline(made))


def sparse_ranges(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    return _rows(df, keys, content, simple_ranges, "range_offset bigint, range_length bigint, data_pos bigint")


def mp4_boxes(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    return _rows(df, keys, content, boxes, "box_offset bigint, box_size bigint, header_size bigint, box_type string, depth bigint")


def find_moov(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    return _rows(df, keys, content, moov_hits, "box_offset bigint, box_size bigint")


def video_info(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Facts of each file that has a plausible index box, from the last one."""

    def told(data: bytes):
        hits = moov_hits(data)
        return [video_facts(data[hits[-1][0] : sum(hits[-1])])] if hits else []

    return _rows(df, keys, content, told, "width bigint, height bigint, video_codec string, audio_codec string, duration double")


def _standalone(data: bytes) -> bool:
    """Whether a chunk begins like a whole file of another kind. Fixed values."""
    return len(data) >= 8 and (data[:4] == b"\x1a\x45\xdf\xa3" or data[:8] == b"\x89PNG\r\n\x1a\n" or data[:4] in (b"\xff\xd8\xff\xe0", b"\xff\xd8\xff\xe1") or data[:6] in (b"GIF87a", b"GIF89a"))


def _facts(data: bytes) -> list[tuple]:
    top = {}
    for at, size, head, kind, _ in boxes(data, deep=False):
        top.setdefault(kind, (at, size, head))
    ftyp, mdat = top.get("ftyp", (None, None, None)), top.get("mdat", (None, None, None))
    hits = moov_hits(data)
    kinds = ("moov" in top, "mdat" in top)
    cut = (None, None)
    for m in re.finditer(b"moov", data[-MOOV_BYTES[1] :]):
        at = max(len(data) - MOOV_BYTES[1], 0) + m.start() - 4
        if at >= 0 and MOOV_BYTES[0] <= (size := struct.unpack_from(">I", data, at)[0]) <= MOOV_BYTES[1] and at + size > len(data) and b"mvhd" in data[at:]:
            cut = (at, size)
    return [(len(data), *ftyp[:2], *mdat, *(hits[-1] if hits else (None, None)), *cut, _standalone(data), *kinds)]


def piece_facts(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """What layouts need to know of each body, so that bodies need not move: ``size``, its first top-level
    ftyp (``ftyp_offset``, ``ftyp_size``) and mdat (with ``mdat_head``, bytes of its box head), its last plausible index box
    (``moov_offset``, ``moov_size``), one that begins in it and runs over its end (``cut_offset``, ``cut_size``), and whether
    it looks like a whole file of another kind (``standalone``); ``has_moov`` and ``has_mdat`` of its top level."""
    names = "size ftyp_offset ftyp_size mdat_offset mdat_size mdat_head moov_offset moov_size cut_offset cut_size".split()
    return _rows(df, keys, content, _facts, ", ".join(f"{n} bigint" for n in names) + ", standalone boolean, has_moov boolean, has_mdat boolean")


def file_head(content: Column, start: Column, n: int = 256) -> Column:
    """First bytes of a body (at most 4096), from where it starts."""
    return F.substring(content, start.cast("int") + 1, F.lit(min(n, 4096)))


def concat_bodies(df: DataFrame, keys: list[str], order: str, body: str) -> DataFrame:
    """Bodies of each group in order, as one; for groups that fit a row."""
    return df.groupBy(*keys).agg(F.coalesce(F.expr(f"listagg(`{body}`) within group (order by `{order}`, `{body}`)"), F.lit(b"")).alias("content"))


def assemble_sparse(df: DataFrame, keys: list[str], content: str = "content", most_bytes: int = 1 << 30) -> DataFrame:
    """Each sparse file as one body: ranges by offset, holes zero, a later range over an earlier one.
    A body above ``most_bytes`` is not allocated as one row: its ``content`` is null and ``error`` says so;
    ``assemble.sparse_pieces`` and ``assemble.assemble_plan`` give it in parts."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def work(batches):
        for batch in _parts(batches, content):
            out, errors = [], []
            for data in batch.column(content).to_pylist():
                ranges = sorted(simple_ranges(data or b""), key=lambda r: r[0])
                size = max((o + n for o, n, _ in ranges), default=0)
                buffer = bytearray(size if size <= most_bytes else 0)
                if size <= most_bytes:
                    for o, n, at in ranges:
                        buffer[o : o + n] = data[at : at + n]
                out.append(bytes(buffer) if size <= most_bytes else None)
                errors.append(None if size <= most_bytes else f"{size} bytes exceed {most_bytes}")
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(out, pa.binary()), pa.array(errors, pa.string())], [*keys, "content", "error"])

    return df.select(*keys, content).mapInArrow(work, f"{kinds}, content binary, error string")

"""Index of the blockfile layout: entries of each cache, and the response metadata they hold.

Entries are chained: a table of buckets has the address of each chain's first entry, each entry that of the next. A walk
takes the buckets in order and stops where it meets an address again. Here the chains are followed by doubling, over
rows: every address that a table or a block names is a node, a node learns the first bucket that reaches it and how
far behind that it lies, and jumps twice as far each round; so one cache is as many tasks as it has blocks, and a
chain of n entries takes log n rounds. A bad block costs the rest of its chain and gives a row with ``error``; a bad
index gives the cache's only row.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import decode_cache_addr, little_endian
from ..operators.spread import numbered
from .resources import kept

#: Layout constants (little-endian). Fixed values.
INDEX_MAGIC, BLOCK_MAGIC, VERSIONS = 0xC103CAC3, 0xC104CAC3, (0x20000, 0x20001, 0x30000)
INDEX_HEAD, BLOCK_HEAD, KEY_AT, ENTRY_BYTES, TABLE_DEFAULT = 368, 8192, 0x60, 256, 0x10000
HAS_EXTRA, HAS_ORIGINAL_TIME = 1 << 31, 1 << 2

FIELDS = {"ord": pa.int64(), "url": pa.string(), "state": pa.int64(), "flags": pa.int64(), "creation_time_us": pa.int64(), "sizes": pa.list_(pa.int64()), "addrs": pa.list_(pa.int64()), "meta": pa.binary(), "error": pa.string()}


class _Blocks:
    """The files of one cache by name, and addresses into them."""

    def __init__(self, files: dict[str, bytes], errors: list[str]):
        self.files, self.errors, self.bad = files, errors, set()

    def block_size(self, name: str) -> int | None:
        data = self.files.get(name)
        if data is not None and len(data) >= BLOCK_HEAD and struct.unpack_from("<I", data)[0] == BLOCK_MAGIC:
            return struct.unpack_from("<I", data, 12)[0]
        if name not in self.bad:
            self.bad.add(name)
            self.errors.append(f"{name}: no block file")
        return None

    def read(self, addr: int, size: int | None) -> bytes | None:
        """Bytes at an address: ``size`` of them, as far as they are there, or (None) its whole blocks,
        null if they are not all there."""
        if addr >> 28 & 7 == 0:
            name = f"f_{addr & 0xFFFFFFF:06x}"
            data = self.files.get(name)
            if data is None:
                self.errors.append(f"{name}: not there")
            return data if data is None or size is None else data[:size]
        name = f"data_{addr >> 16 & 255}"
        unit = self.block_size(name)
        if unit is None:
            return None
        begin = BLOCK_HEAD + (addr & 0xFFFF) * unit
        want = ((addr >> 24 & 3) + 1) * unit if size is None else size
        found = self.files[name][begin : begin + want]
        if len(found) < want:
            self.errors.append(f"{name}: {want} bytes at {begin} are beyond its end")
            return None if size is None or not found else found
        return found


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace")


def index_entries(files: dict[str, bytes]) -> list[dict]:
    """Entry rows of one cache that is at hand, in the order of its table, then its error rows: the walk in one pass."""
    failed = lambda why: [{"error": why}]
    head = files.get("index")
    if head is None or len(head) < INDEX_HEAD:
        return failed("index: too short")
    magic, version = struct.unpack_from("<II", head)
    if magic != INDEX_MAGIC:
        return failed(f"index: bad magic {magic:08x}")
    if version not in VERSIONS:
        return failed(f"index: version {version:x} is not known")
    buckets = struct.unpack_from("<I", head, 0x1C)[0] or TABLE_DEFAULT
    if INDEX_HEAD + 4 * buckets > len(head):
        return failed("index: its table is cut off")
    rows, errors, seen = [], [], set()
    blocks = _Blocks(files, errors)
    for addr in struct.unpack_from(f"<{buckets}I", head, INDEX_HEAD):
        while addr & 0x80000000:
            if addr in seen:
                errors.append(f"{addr:08x}: met again in its chain")
                break
            seen.add(addr)
            raw = blocks.read(addr, None)
            if raw is None or len(raw) < ENTRY_BYTES:
                errors.append(f"{addr:08x}: no entry")
                break
            follows = struct.unpack_from("<I", raw, 4)[0]
            state, created, key_bytes, long_key = struct.unpack_from("<IQII", raw, 0x14)
            sizes, addrs = struct.unpack_from("<4i", raw, 0x28), struct.unpack_from("<4I", raw, 0x38)
            flags = struct.unpack_from("<I", raw, 0x48)[0]
            inline = raw[KEY_AT : KEY_AT + key_bytes]
            if long_key & 0x80000000:
                key = blocks.read(long_key, key_bytes) if key_bytes else b""
            else:
                key = inline
                if len(inline) < key_bytes:
                    errors.append(f"{addr:08x}: its key is cut off")
            meta = blocks.read(addrs[0], sizes[0]) if addrs[0] & 0x80000000 and sizes[0] > 0 else None
            rows.append({"ord": len(rows), "url": _text(key or b""), "state": state, "flags": flags, "creation_time_us": min(created, (1 << 63) - 1), "sizes": list(sizes), "addrs": list(addrs), "meta": meta, "error": None})
            addr = follows
    return rows + [{"error": e} for e in errors]


CACHE = "cache_dir"
#: Bytes of a piece of a file: what a block is read from, and so what each read of an address copies.
PIECE = 16 << 10
_ON = 0x80000000
_BLOCK_FILE = r"^data_(0|[1-9]\d*)$"


def _buckets(pieces: DataFrame) -> DataFrame:
    """``cache_dir``, ``bucket`` and ``addr`` of every bucket in use, or ``error`` of the whole index."""
    magic, version, n = (little_endian(F.col("head"), at) for at in (0, 4, 0x1C))
    n = F.when(n == 0, TABLE_DEFAULT).otherwise(n)
    error = F.when(F.coalesce("total", F.lit(0)) < INDEX_HEAD, "index: too short").when(magic != INDEX_MAGIC, F.concat(F.lit("index: bad magic "), F.format_string("%08x", magic)))
    error = error.when(~version.isin(*VERSIONS), F.concat(F.lit("index: version "), F.format_string("%x", version), F.lit(" is not known"))).when(INDEX_HEAD + 4 * n > F.col("total"), "index: its table is cut off")
    tables = pieces.where("file = 'index'").withColumns({"error": error, "n": n})

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part, n, data = (batch.column(c)[i].as_py() for c in ("part", "n", "bytes"))
                first = max(0, -(-(part * PIECE - INDEX_HEAD) // 4))
                begin = INDEX_HEAD + 4 * first - part * PIECE
                table = np.frombuffer(data, "<u4", max(0, min(n - first, -(-(PIECE - begin) // 4))), begin)
                used = np.flatnonzero(table & np.uint32(_ON))
                key = batch.column(CACHE).slice(i, 1).take(pa.array(np.zeros(len(used), np.int64)))
                yield pa.RecordBatch.from_arrays([key, pa.array(used + first), pa.array(table[used].astype(np.int64))], [CACHE, "bucket", "addr"])

    none = F.lit(None).cast("bigint")
    found = tables.where("error is null").select(CACHE, "part", "n", "bytes").mapInArrow(work, "cache_dir string, bucket bigint, addr bigint").withColumn("error", F.lit(None).cast("string"))
    bare = pieces.select(CACHE).distinct().join(tables.select(CACHE), CACHE, "left_anti").withColumn("error", F.lit("index: too short"))
    bad = tables.where("error is not null and part = 0").select(CACHE, "error").unionByName(bare)
    return found.unionByName(bad.select(CACHE, none.alias("bucket"), none.alias("addr"), "error"))


def _named_in_blocks(pieces: DataFrame) -> DataFrame:
    """``cache_dir`` and ``addr`` of what follows each block of each block file, and each external file, if that were an entry."""

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part, total, unit, data = (batch.column(c)[i].as_py() for c in ("part", "total", "unit", "bytes"))
                start = part * PIECE
                # blocks whose address of what follows, four bytes from the fourth on, begins in this piece
                first = BLOCK_HEAD + max(0, -(-(start - 4 - BLOCK_HEAD) // unit)) * unit if unit else BLOCK_HEAD if start <= BLOCK_HEAD + 4 else total
                begins = np.arange(first, min(start + PIECE - 4, total - 7), unit or total)
                words = np.frombuffer(data, np.uint8)
                follows = sum(words[begins + 4 - start + k].astype(np.int64) << 8 * k for k in range(4)) if len(begins) else np.zeros(0, np.int64)
                follows = np.unique(follows[follows >= _ON])
                key = batch.column(CACHE).slice(i, 1).take(pa.array(np.zeros(len(follows), np.int64)))
                yield pa.RecordBatch.from_arrays([key, pa.array(follows)], [CACHE, "addr"])

    outside = pieces.where(F.col("file").startswith("f_") & (F.col("total") >= ENTRY_BYTES) & (F.col("part") == 0)).select(CACHE, little_endian(F.col("head"), 4).alias("addr"))
    inside = pieces.withColumn("unit", _unit()).where("unit is not null").select(CACHE, "part", "total", "unit", "bytes")
    return inside.mapInArrow(work, "cache_dir string, addr bigint").unionByName(outside.where(F.col("addr") >= _ON))


def _unit() -> Column:
    """Bytes of a block of a piece's file, null if that is no block file."""
    return F.when(F.col("file").rlike(_BLOCK_FILE) & (F.col("total") >= BLOCK_HEAD) & (F.substring("head", 1, 4) == F.lit(struct.pack("<I", BLOCK_MAGIC))), little_endian(F.col("head"), 12))


def _located(refs: DataFrame, known: DataFrame) -> DataFrame:
    """``refs`` (with ``addr``, and ``want``: how many bytes of it, null for its whole blocks) with ``file``, ``begin`` and ``length`` of what
    is there (null where nothing is) and ``problem``. ``known``: ``cache_dir``, ``file``, ``bytes``, ``unit`` (null if it is no block file)."""
    refs = refs.withColumn("a", decode_cache_addr(F.col("addr")))
    met = refs.withColumn("file", F.col("a.file_name")).join(known, [CACHE, "file"], "left")
    outside = F.col("a.file_type") == 0
    begin = F.when(outside, F.lit(0)).otherwise(F.col("a.start_block") * F.col("unit") + BLOCK_HEAD)
    wanted = F.when(outside, F.coalesce("want", "bytes")).otherwise(F.coalesce(F.col("want"), F.col("a.block_count") * F.col("unit")))
    met = met.withColumns({"begin": begin.cast("bigint"), "wanted": wanted})
    met = met.withColumn("there", F.greatest(F.least("wanted", F.col("bytes") - F.col("begin")), F.lit(0)))
    short = ~outside & (F.col("there") < F.col("wanted"))
    beyond = F.concat("file", F.lit(": "), F.col("wanted").cast("string"), F.lit(" bytes at "), F.col("begin").cast("string"), F.lit(" are beyond its end"))
    problem = F.when(outside & F.col("bytes").isNull(), F.concat("file", F.lit(": not there"))).when(~outside & F.col("unit").isNull(), F.concat("file", F.lit(": no block file"))).when(short, beyond)
    lost = F.when(outside, F.col("bytes").isNull()).otherwise(F.col("unit").isNull() | short & (F.col("want").isNull() | (F.col("there") == 0)))
    return met.withColumns({"problem": problem, "length": F.when(~lost, F.col("there"))}).drop("a", "bytes", "unit", "wanted", "there")


def _read(located: DataFrame, pieces: DataFrame, keys: list[str], skip: int = 0, most: int | None = None) -> DataFrame:
    """``keys`` and ``raw``, the bytes of each located row (``most`` of them, ``skip`` bytes on). ``pieces``: ``cache_dir``, ``file``, ``part``, ``bytes``."""
    n = F.col("length") - skip if most is None else F.least(F.col("length") - skip, F.lit(most))
    rows = located.select(*keys, "file", (F.col("begin") + skip).alias("begin"), n.alias("n")).where("n > 0")
    cut = rows.withColumn("part", F.explode(F.sequence(F.floor(F.col("begin") / PIECE), F.floor((F.col("begin") + F.col("n") - 1) / PIECE))))
    first, last = F.greatest("begin", F.col("part") * PIECE), F.least(F.col("begin") + F.col("n"), (F.col("part") + 1) * PIECE)
    cut = cut.withColumns({"at": first - F.col("part") * PIECE, "size": last - first})
    met = cut.join(pieces, [CACHE, "file", "part"]).select(*keys, "part", F.expr("substring(bytes, cast(at + 1 as int), cast(size as int))").alias("bytes"))
    held = met.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("part", "bytes"))).alias("p"))
    return held.select(*keys, F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["bytes"])).alias("raw"))


def _owners(nodes: DataFrame) -> DataFrame:
    """``nodes`` (``cache_dir``, ``addr``, ``next``, ``bucket`` of the first chain that begins there or null) with ``owner``: (bucket, depth)
    of the first bucket whose chain reaches it. Each round a node's owner goes on to where the node jumps, and it
    jumps on to where that jumps."""
    first = F.when(F.col("bucket").isNotNull(), F.struct("bucket", F.lit(0).cast("bigint").alias("depth")))
    state = kept(nodes.select(CACHE, "addr", "next", F.col("next").alias("jump"), first.alias("owner")))
    most = state.groupBy(CACHE).count().agg(F.max("count").alias("n")).first()["n"] or 0
    step = 1
    while step <= most and state.where("jump is not null").limit(1).count():
        told = state.where("jump is not null and owner is not null").groupBy(CACHE, F.col("jump").alias("addr")).agg(F.min(F.struct(F.col("owner.bucket").alias("bucket"), (F.col("owner.depth") + step).alias("depth"))).alias("told"))
        far = state.select(CACHE, F.col("addr").alias("jump"), F.col("jump").alias("_far"))
        met = state.join(told, [CACHE, "addr"], "left").join(far, [CACHE, "jump"], "left")
        state = kept(met.select(CACHE, "addr", "next", F.col("_far").alias("jump"), F.least("owner", "told").alias("owner")))
        step *= 2
    return state.select(CACHE, "addr", "next", "owner")


def _parsed(rows: DataFrame) -> DataFrame:
    """Fields of entries from their ``raw`` blocks: a record of fixed layout, and the inline key behind it."""

    def work(batches):
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            heads = [struct.unpack_from("<IQII4i4II", r, 0x14) for r in raw]
            inline = [r[KEY_AT : KEY_AT + h[2]] for r, h in zip(raw, heads, strict=True)]
            column = lambda i: pa.array([h[i] for h in heads], pa.int64())
            created = pa.array([min(h[1], (1 << 63) - 1) for h in heads], pa.int64())
            lists = [pa.array([list(h[i : i + 4]) for h in heads], pa.list_(pa.int64())) for i in (4, 8)]
            yield pa.RecordBatch.from_arrays([batch.column(CACHE), batch.column("addr"), batch.column("owner"), column(0), column(12), created, column(2), column(3), *lists, pa.array(inline, pa.binary())], [CACHE, "addr", "owner", "state", "flags", "creation_time_us", "key_bytes", "long_key", "sizes", "addrs", "inline"])

    schema = "cache_dir string, addr bigint, owner struct<bucket: bigint, depth: bigint>, state bigint, flags bigint, creation_time_us bigint, key_bytes bigint, long_key bigint, sizes array<bigint>, addrs array<bigint>, inline binary"
    return rows.select(CACHE, "addr", "owner", "raw").mapInArrow(work, schema)


def _texts(rows: DataFrame) -> DataFrame:
    """``url`` from the bytes of a key: up to a NUL, bytes that are no UTF-8 replaced."""

    def work(batches):
        for batch in batches:
            at = batch.schema.get_field_index("key")
            yield batch.set_column(at, "url", pa.array([_text(k or b"") for k in batch.column("key").to_pylist()], pa.string()))

    kinds = ", ".join(f"`{'url' if f.name == 'key' else f.name}` {'string' if f.name == 'key' else f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(work, kinds)


def read_index_entries(files: DataFrame) -> DataFrame:
    """Entries of every cache. ``files``: ``cache_dir``, ``name``, ``content`` of its index and block
    files, and of the external files that keys or metadata may lie in. Returns ``cache_dir``, ``ord``,
    ``url``, ``state``, ``flags``, ``creation_time_us`` (since 1601), ``sizes`` and ``addrs`` of the four
    streams, ``meta`` (the first stream), ``error`` (its rows have nothing else)."""
    spread = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.greatest(F.octet_length("content"), F.lit(1)) - 1) / PIECE)))
    pieces = files.select(CACHE, F.col("name").alias("file"), spread.alias("part"), "content")
    # all that follows reads these; a piece goes on for three bytes, so that an address that begins in it is whole
    piece = F.expr(f"substring(content, cast(part * {PIECE} + 1 as int), {PIECE + 3})").alias("bytes")
    pieces = kept(pieces.select(CACHE, "file", "part", F.octet_length("content").cast("bigint").alias("total"), F.substring("content", 1, 32).alias("head"), piece))
    known = kept(pieces.where("part = 0").select(CACHE, "file", F.col("total").alias("bytes"), _unit().alias("unit")))
    buckets = kept(_buckets(pieces))
    chains = buckets.where("error is null").select(CACHE, "bucket", "addr")

    # nodes, what follows each, and which chain reaches it first
    heads = chains.groupBy(CACHE, "addr").agg(F.min("bucket").alias("bucket"))
    named = heads.unionByName(_named_in_blocks(pieces).join(chains.select(CACHE).distinct(), CACHE, "left_semi").distinct().withColumn("bucket", F.lit(None).cast("bigint")))
    named = named.groupBy(CACHE, "addr").agg(F.min("bucket").alias("bucket")).withColumn("want", F.lit(None).cast("bigint"))
    nodes = kept(_located(named, known).withColumn("good", F.coalesce(F.col("length") >= ENTRY_BYTES, F.lit(False))))
    follows = _read(nodes.where("good"), pieces, [CACHE, "addr"], skip=4, most=4).select(CACHE, "addr", little_endian(F.col("raw"), 0).alias("next"))
    linked = nodes.select(CACHE, "addr", "bucket").join(follows.where(F.col("next") >= _ON), [CACHE, "addr"], "left")
    owned = kept(_owners(linked).where("owner is not null"))
    place = nodes.drop("bucket", "want").join(owned, [CACHE, "addr"])

    # entries: fields, then the keys and metadata they point to
    entries = kept(_parsed(_read(place.where("good").withColumnRenamed("owner", "o"), pieces, [CACHE, "addr", "o"]).withColumnRenamed("o", "owner")))
    long = (F.col("long_key") >= _ON) & (F.col("key_bytes") > 0)
    keys = kept(_located(entries.where(long).select(CACHE, F.col("addr").alias("of"), F.col("long_key").alias("addr"), F.col("key_bytes").alias("want")), known))
    metas = kept(_located(entries.where((F.col("addrs")[0] >= _ON) & (F.col("sizes")[0] > 0)).select(CACHE, F.col("addr").alias("of"), F.col("addrs")[0].alias("addr"), F.col("sizes")[0].alias("want")), known))
    told = entries.withColumn("of", F.col("addr")).join(_read(keys, pieces, [CACHE, "of"]).withColumnRenamed("raw", "long"), [CACHE, "of"], "left")
    told = told.join(metas.where("length is not null").select(CACHE, "of").distinct().join(_read(metas, pieces, [CACHE, "of"]), [CACHE, "of"], "left").select(CACHE, "of", F.coalesce("raw", F.lit(b"")).alias("meta")), [CACHE, "of"], "left")
    key = F.when(F.col("long_key") >= _ON, F.coalesce("long", F.lit(b""))).otherwise(F.col("inline"))
    told = told.select(CACHE, F.col("owner.bucket").alias("bucket"), F.col("owner.depth").alias("depth"), key.alias("key"), "state", "flags", "creation_time_us", "sizes", "addrs", "meta")
    rows = numbered(_texts(told), [CACHE], ["bucket", "depth"], "ord").withColumn("ord", F.col("ord") - 1)

    # errors: what is met again, what could not be read
    again = lambda rows: rows.select(CACHE, F.format_string("%08x: met again in its chain", "addr").alias("error"))
    own = owned.select(CACHE, "addr", "owner")
    began = chains.join(own, [CACHE, "addr"]).where("owner.bucket <> bucket")
    ahead = owned.where("next is not null").select(CACHE, F.col("next").alias("addr"), F.col("owner.bucket").alias("b"), (F.col("owner.depth") + 1).alias("d")).join(own, [CACHE, "addr"]).where("owner.bucket <> b or owner.depth <> d")
    empty = place.where("not good").select(CACHE, F.format_string("%08x: no entry", "addr").alias("error"))
    cut = entries.where((F.col("long_key") < _ON) & (F.octet_length("inline") < F.col("key_bytes"))).select(CACHE, F.format_string("%08x: its key is cut off", "addr").alias("error"))
    problems = place.select(CACHE, "problem").unionByName(keys.select(CACHE, "problem")).unionByName(metas.select(CACHE, "problem")).where("problem is not null")
    once = F.col("problem").endswith(": no block file")
    problems = problems.where(~once).unionByName(problems.where(once).distinct()).withColumnRenamed("problem", "error")
    errors = buckets.where("error is not null").select(CACHE, "error")
    for more in (again(began), again(ahead), empty, cut, problems):
        errors = errors.unionByName(more)
    fields = ["ord", "url", "state", "flags", "creation_time_us", "sizes", "addrs", "meta"]
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in fields]
    return rows.select(CACHE, *fields, F.lit(None).cast("string").alias("error")).unionByName(errors.select(CACHE, *none, "error"))


def http_meta(data: bytes | None) -> tuple[int | None, int | None, bytes | None]:
    """(request time, response time, header block) of a serialised response; times in microseconds
    since 1601. Where the fields do not lead to a header block, the first ``HTTP/`` does."""
    if data is None or len(data) < 8:
        return None, None, None
    flags, at = struct.unpack_from("<I", data, 4)[0], 8
    extra = 0
    if flags & HAS_EXTRA:
        if len(data) < 12:
            return None, None, None
        extra, at = struct.unpack_from("<I", data, at)[0], 12
    after = at + 16 + (8 if extra & HAS_ORIGINAL_TIME else 0)
    if len(data) < after:
        return None, None, None
    asked, answered = struct.unpack_from("<qq", data, at)
    if len(data) >= after + 4:
        size = struct.unpack_from("<I", data, after)[0]
        if after + 4 + size <= len(data):
            return asked, answered, data[after + 4 : after + 4 + size]
    begin = data.find(b"HTTP/", 4, len(data) - 1)
    if begin < 0:
        return None, None, None
    size = struct.unpack_from("<i", data, begin - 4)[0]
    if 0 < size and begin + size <= len(data):
        return asked, answered, data[begin : begin + size]
    end = data.find(b"\0\0", begin)
    return asked, answered, data[begin : end + 1] if end >= 0 else data[begin:]


def read_http_meta(entries: DataFrame, keys: list[str], meta: str = "meta") -> DataFrame:
    """``keys``, ``request_time_us``, ``response_time_us`` (since 1601) and ``raw_headers`` (text; bytes that
    are no UTF-8 are replaced) of each entry; null without metadata. Headers are then taken apart by
    ``functions.headers.parse_raw_headers``."""
    kinds = ", ".join(f"`{k}` {entries.schema[k].dataType.simpleString()}" for k in keys)

    def work(batches):
        for batch in batches:
            made = [http_meta(m) for m in batch.column("_meta").to_pylist()]
            text = [None if h is None else h.decode("utf-8", "replace") for _, _, h in made]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array([a for a, _, _ in made], pa.int64()), pa.array([b for _, b, _ in made], pa.int64()), pa.array(text, pa.string())], [*keys, "request_time_us", "response_time_us", "raw_headers"])

    return entries.select(*keys, F.col(meta).alias("_meta")).mapInArrow(work, f"{kinds}, request_time_us bigint, response_time_us bigint, raw_headers string")

"""Index walks over caches written byte by byte."""

import random
import struct

import pytest

from chunkmill.functions.headers import parse_raw_headers
from chunkmill.sources import index

ON = 0x80000000


def block_addr(file_no, start, blocks=1, kind=2):
    return ON | kind << 28 | (blocks - 1) << 24 | file_no << 16 | start


def entry(key, follows=0, key_bytes=None, long_key=0, sizes=(0, 0, 0, 0), addrs=(0, 0, 0, 0), state=0, flags=0, created=13_000_000_000_000_000):
    raw = struct.pack("<IIIIIIQII4i4II", 1, follows, 0, 0, 0, state, created, len(key) if key_bytes is None else key_bytes, long_key, *sizes, *addrs, flags)
    return raw.ljust(0x60, b"\0") + key


def block_file(blocks, unit=256):
    body = b"".join(b.ljust(-(-len(b) // unit) * unit, b"\0") for b in blocks)
    return struct.pack("<IIII", index.BLOCK_MAGIC, 0x20000, 0, unit).ljust(index.BLOCK_HEAD, b"\0") + body


def index_file(table, magic=index.INDEX_MAGIC, version=0x20000):
    return struct.pack("<II", magic, version).ljust(0x1C, b"\0") + struct.pack("<I", len(table)).ljust(index.INDEX_HEAD - 0x1C, b"\0") + struct.pack(f"<{len(table)}I", *table)


def meta(headers, extra=False):
    body = struct.pack("<i", -(1 << 31) + 3) + struct.pack("<i", 4) if extra else struct.pack("<i", 3)
    body += struct.pack("<qq", 10, 20) + (struct.pack("<q", 5) if extra else b"") + struct.pack("<i", len(headers)) + headers
    return struct.pack("<i", len(body)) + body


HTTP = b"HTTP/1.1 200 OK\0content-type: video/mp4\0\0"
CHAIN = {
    "index": index_file([block_addr(1, 0), 0, block_addr(1, 3, 2)]),
    "data_1": block_file([entry(b"one", block_addr(1, 1), sizes=(len(meta(HTTP)), 5, 0, 0), addrs=(block_addr(2, 0, kind=3), 0x80000007, 0, 0)), entry(b"two", block_addr(1, 2), flags=1), entry(b"", 0, key_bytes=900, long_key=0x8000000B), entry(b"k" * 300, 0, state=2)]),
    "data_2": block_file([meta(HTTP)], 1024),
    "f_00000b": b"L" * 900,
}


def test_chain_keys_and_metadata():
    rows = index.index_entries(CHAIN)
    assert [r["url"] for r in rows] == ["one", "two", "L" * 900, "k" * 300]
    assert [r["flags"] for r in rows] == [0, 1, 0, 0] and rows[3]["state"] == 2 and rows[0]["sizes"][1] == 5
    assert index.http_meta(rows[0]["meta"]) == (10, 20, HTTP)


def test_loops_and_bad_blocks_are_errors():
    loop = {"index": index_file([block_addr(1, 0)]), "data_1": block_file([entry(b"a", block_addr(1, 1)), entry(b"b", block_addr(1, 0))])}
    rows = index.index_entries(loop)
    assert [r.get("url") for r in rows] == ["a", "b", None] and "again" in rows[2]["error"]
    far = index.index_entries({"index": index_file([block_addr(1, 9), block_addr(3, 0)]), "data_1": block_file([entry(b"a")])})
    assert all(r.get("url") is None for r in far) and len(far) >= 3


@pytest.mark.parametrize("data", [b"", b"x" * 400, index_file([0], magic=1), index_file([0], version=7), index_file([0, 0])[:-1]])
def test_bad_indexes(data):
    assert len(rows := index.index_entries({"index": data})) == 1 and rows[0]["error"]


@pytest.mark.parametrize("version", index.VERSIONS)
def test_versions(version):
    assert index.index_entries({"index": index_file([0], version=version)}) == []


def test_http_meta():
    assert index.http_meta(meta(HTTP, extra=True)) == (10, 20, HTTP)
    assert index.http_meta(None) == index.http_meta(b"short") == (None, None, None)
    odd = struct.pack("<iiqqi", 0, 3, 1, 2, 9999) + struct.pack("<i", len(HTTP)) + HTTP
    assert index.http_meta(odd) == (1, 2, HTTP)


def test_many_caches(spark):
    rows = [(c, n, bytearray(d)) for c in ("a", "b") for n, d in CHAIN.items()] + [("c", "index", bytearray(b"bad"))]
    df = spark.createDataFrame(rows, "cache_dir string, name string, content binary").repartition(5)
    entries = index.read_index_entries(df)
    got = sorted((r.cache_dir, -1 if r.ord is None else r.ord, r.url) for r in entries.collect())
    assert [g[0] for g in got] == ["a"] * 4 + ["b"] * 4 + ["c"] and got[0][2] == "one" and got[-1][2] is None
    parsed = index.read_http_meta(entries, ["cache_dir", "ord"]).where("raw_headers is not null")
    assert {r.t for r in parsed.select(parse_raw_headers(parsed.raw_headers).content_type.alias("t")).collect()} == {"video/mp4"}
    assert index.read_index_entries(df.limit(0)).count() == 0


def hostile(rng):
    """A cache of chains that loop, meet each other, leave their files or lie in files of other kinds."""
    n = rng.randrange(1, 12)
    addr = lambda: rng.choice([0, block_addr(1, rng.randrange(n + 2), rng.choice((1, 1, 2, 4))), block_addr(rng.choice((1, 2, 7)), rng.randrange(n)), 0x80000000 | rng.randrange(3)])
    meta_ = lambda: rng.choice([(0, 0), (9, block_addr(2, rng.randrange(4), kind=3)), (5000, block_addr(2, 1, kind=3)), (7, 0x80000000 | rng.randrange(3)), (-5, block_addr(2, 0)), (3, 77)])
    blocks = []
    for i in range(n):
        size, at = meta_()
        blocks.append(entry(f"key {i} é".encode() + bytes(rng.randrange(2)) + b"x", addr(), key_bytes=rng.choice([None, None, None, 3, 400, 0]), long_key=rng.choice([0, 0, addr()]), sizes=(size, 1, 2, 3), addrs=(at, 0, 0, 0), state=rng.randrange(3), flags=rng.randrange(4))[:256])
    files = {"index": index_file([addr() for _ in range(rng.randrange(1, 9))]), "data_1": block_file(blocks), "data_2": block_file([meta(HTTP), b"second", entry(b"in data_2", addr())], 1024), "f_000001": b"\xff\0rest" * 60, "f_000002": entry(b"outside", addr()).ljust(256, b"\0")}
    if rng.random() < 0.2:
        files["data_2"] = b"no block file"
    if rng.random() < 0.1:
        files["data_1"] = files["data_1"][:-100]
    return files


def rows_of(found):
    plain = lambda r: (r.get("ord"), r.get("url"), r.get("state"), r.get("flags"), r.get("creation_time_us"), r.get("sizes"), r.get("addrs"), r.get("meta"), r.get("error"))
    return sorted(map(plain, found), key=str)


def test_chains_by_doubling_follow_the_walk(spark, monkeypatch):
    monkeypatch.setattr(index, "PIECE", 1000)  # blocks over the borders of pieces
    rng = random.Random(8)
    caches = {f"c{i}": hostile(rng) for i in range(40)}
    caches["long"] = {"index": index_file([0, block_addr(1, 0), block_addr(1, 150)]), "data_1": block_file([entry(b"%d" % i, block_addr(1, i + 1) if i < 299 else block_addr(1, 200)) for i in range(300)])}
    caches["bare"] = {"data_1": block_file([entry(b"a")])}
    caches["empty"] = {"index": b""}
    df = spark.createDataFrame([(c, n, bytearray(d)) for c, files in caches.items() for n, d in files.items()], "cache_dir string, name string, content binary").repartition(4)
    got = {}
    for r in index.read_index_entries(df).collect():
        own = r.asDict()
        own["meta"] = None if r.meta is None else bytes(r.meta)
        got.setdefault(r.cache_dir, []).append(own)
    for c, files in caches.items():
        assert rows_of(got.get(c, [])) == rows_of(index.index_entries(files)), c


def test_files_are_computed_once(spark):
    read = spark.sparkContext.accumulator(0)

    def work(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [("a", n, bytearray(d)) for n, d in CHAIN.items()]
    schema = "cache_dir string, name string, content binary"
    found = index.read_index_entries(spark.createDataFrame(rows, schema).mapInArrow(work, schema))
    assert found.where("error is null").count() == 4 and read.value == len(rows)

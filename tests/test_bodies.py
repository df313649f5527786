"""Byte layouts against files written by hand."""

import random
import struct

import pytest

from chunkmill.sources import bodies

KEY = b"1/0/https://x.org/a"
HEAD = struct.pack("<QIIQ", bodies.FILE_MAGIC, 5, len(KEY), 0) + KEY


def eof(size, flags=0, magic=bodies.EOF_MAGIC):
    return struct.pack("<QIIII", magic, flags, 0, size, 0)


def span(offset, data, length=None):
    return struct.pack("<QQQQ", bodies.RANGE_MAGIC, offset, len(data) if length is None else length, 0) + data


N = len(HEAD)
FILES = [
    (HEAD + b"body" + eof(4) + b"hdrs!" + eof(5), (N, N + 4, N + 28, N + 33)),
    (HEAD + b"body" + eof(4) + b"hdrs!" + b"h" * 32 + eof(5, 2), (N, N + 4, N + 28, N + 33)),
    (HEAD + eof(0) + eof(0), (N, N, N + 24, N + 24)),
    (HEAD + b"body" + eof(4) + b"hdrs!" + eof(5, magic=7), (N, N + 4, None, None)),
    (HEAD + b"body" + eof(4) + b"hdrs!" + eof(500), (N, N + 4, None, None)),
    (HEAD + b"body without a trailer at all", None),
    (b"not a cache file, but long enough to hold a header and a trailer", None), (b"", None),
]


@pytest.mark.parametrize(("data", "want"), FILES)
def test_simple_layout(data, want):
    assert bodies.simple_layout(data) == want


def test_side_files():
    assert bodies.simple_layout(HEAD + b"side" + eof(4), side=True) == (N, N + 4, None, None)
    assert bodies.simple_layout(HEAD + b"side" * 9, side=True) == (N, N + 36, None, None)


@pytest.mark.parametrize("side", [False, True])
def test_layouts_of_columns_equal_the_walk(spark, side):
    """Without Python in the plan: bodies of any number and size do not pass through a worker."""
    rng = random.Random(5)
    files = [data for data, _ in FILES] + [HEAD[:30], HEAD, HEAD[:12] + b"\xff" * 4 + b"k" * 60, HEAD[:12] + b"\xff\xff\xff\x7f" + b"k" * 60 + eof(4), HEAD + b"body" + eof(4) + eof(1 << 32 - 1), HEAD + bytes(range(256)) + eof(3) + b"\xff\xfe" + eof(90)]
    for _ in range(300):
        data = bytearray(HEAD + rng.randbytes(rng.randrange(40)) + eof(4) + rng.randbytes(rng.randrange(40)) + eof(rng.randrange(60), rng.choice([0, 2, 3])))
        for _ in range(rng.randrange(3)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        files.append(bytes(data[: rng.choice([len(data), rng.randrange(len(data))])]))
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(files)] + [(-1, None)], "k int, content binary")
    made = bodies.unwrap_simple(df, ["k", "content"], side=side)
    assert "InArrow" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r.k: tuple(r[2:]) for r in made.collect()}
    assert got == {i: bodies.simple_layout(d, side) or (0, len(d), None, None) for i, d in enumerate(files)}


RANGES = [
    (HEAD + span(0, b"aaaa") + span(8, b"bb"), [(0, 4), (8, 2)], b"aaaa\0\0\0\0bb"), (HEAD + span(4, b"bb") + span(0, b"aaa"), [(4, 2), (0, 3)], b"aaa\0bb"),
    (HEAD + span(0, b"aaaa") + span(2, b"bbbb"), [(0, 4), (2, 4)], b"aabbbb"), (HEAD + span(0, b"aaaa") + span(4, b"b", 90), [(0, 4), (4, 1)], b"aaaab"),
    (HEAD + b"raw body" + eof(8), [(0, 8)], b"raw body"), (HEAD + b"raw body" + b"h" * 32 + eof(8, 2), [(0, 8)], b"raw body"), (HEAD, [], b""), (HEAD + span(0, b"aa") + b"x" * 40, [(0, 2)], b"aa"), (b"short", [], b""),
]


@pytest.mark.parametrize(("data", "ranges", "body"), RANGES)
def test_sparse(spark, data, ranges, body):
    assert [(o, n) for o, n, _ in bodies.simple_ranges(data)] == ranges
    df = spark.createDataFrame([(1, bytearray(data))], "k int, content binary")
    assert bytes(bodies.assemble_sparse(df, ["k"]).first().content) == body


def test_large_sparse_bodies_are_not_allocated(spark):
    df = spark.createDataFrame([(1, bytearray(HEAD + span(1 << 60, b"x"))), (2, None)], "k int, content binary")
    rows = {r.k: r for r in bodies.assemble_sparse(df, ["k"], most_bytes=1000).collect()}
    assert rows[1].content is None and "exceed" in rows[1].error and bytes(rows[2].content) == b""


def box(kind, body=b"", size=None):
    return struct.pack(">I", len(body) + 8 if size is None else size) + kind + body


def test_boxes():
    wide = struct.pack(">I4sQ", 1, b"mdat", 20) + b"wide"
    data = box(b"ftyp", b"mp42") + box(b"moov", box(b"mvhd", b"1") + box(b"trak", box(b"mdia"))) + wide + box(b"mdat", b"rest", 0)
    found = bodies.boxes(data)
    assert [(t, d) for _, _, _, t, d in found] == [("ftyp", 0), ("moov", 0), ("mvhd", 1), ("trak", 1), ("mdia", 2), ("mdat", 0), ("mdat", 0)]
    assert found[5][1:3] == (20, 16) and found[6][1] == 12
    assert bodies.boxes(b"\0\0\0\x07free") == bodies.boxes(b"\0\0\0\x10\1ree") == bodies.boxes(b"") == []


def test_moov_hits():
    good = box(b"moov", box(b"mvhd", bytes(600)) + box(b"trak"))
    assert bodies.moov_hits(b"junk" + good + b"moov" + good) == [(4, len(good)), (8 + len(good), len(good))]
    assert bodies.moov_hits(box(b"moov", box(b"mvhd") + box(b"trak"))) == bodies.moov_hits(good[:-1]) == bodies.moov_hits(b"moov") == []


def test_listing(spark, tmp_path):
    for name in ("f_00000a", "0123456789abcdef_0", "notes.txt", "data_1"):
        (tmp_path / "Cache").mkdir(exist_ok=True)
        (tmp_path / "Cache" / name).write_bytes(b"xyz")
    rows = bodies.list_cache_files(spark, [str(tmp_path)]).collect()
    assert sorted((r.name, r.size) for r in rows) == [("0123456789abcdef_0", 3), ("f_00000a", 3)] and all(r.cache_dir.endswith("Cache") for r in rows)

"""Files by ranges, and bodies in parts, against whole bodies."""

import random
import struct

import pytest
from pyarrow import fs

from chunkmill.jobs import recovery
from chunkmill.sources import assemble, bodies, parts, ranged
from tests.test_assemble import MOOV, PNG, box, family, noise
from tests.test_recovery import simple

BIG = 3 << 20


def files():
    mp4 = box(b"ftyp", b"mp42" + bytes(8)) + box(b"mdat", bytes(BIG)) + MOOV
    cut = box(b"ftyp", b"mp42" + bytes(8)) + struct.pack(">I", 1 << 24) + b"mdat" + bytes(BIG)
    damaged = bytearray(simple(b"b" * BIG, b"headers"))
    damaged[-8:-4] = struct.pack("<I", 3)  # the last trailer tells a wrong place
    return {
        f"{i:016x}_0": d
        for i, d in enumerate([simple(mp4, b"HTTP/1.1 200\0content-type: video/mp4\0"), simple(cut, b"HTTP/1.1 200\0x: \xe9\xff\0"), simple(PNG, b""), simple(b"", b"content-type: audio/ogg\0"), b"tiny", b"no Simple file " * 9, mp4, bytes(damaged), simple(b"short", b"k" * 300), simple(b"text", b"HTTP/1.1 200\0content-type: video/mp4; q=\xff\0")])
    }


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("caches") / "a b"
    root.mkdir()
    for name, data in files().items():
        (root / name).write_bytes(data)
    return str(root)


def test_layouts_and_heads_by_ranges(spark, folder):
    listing = bodies.list_cache_files(spark, [folder])
    got = {r.name: r for r in ranged.file_facts(listing, ["name"]).collect()}
    for name, data in files().items():
        r = got[name]
        begin, end, first, last = bodies.simple_layout(data) or (0, len(data), None, None)
        assert (r.body_start, r.body_end, r.headers_start, r.headers_end) == (begin, end, first, last), name
        assert bytes(r.head) == data[begin : begin + 256] and (r.headers is None if first is None else bytes(r.headers) == data[first:last])
        top = {b[3] for b in bodies.boxes(data[begin:end], deep=False)}
        assert (r.has_moov, r.has_mdat) == ("moov" in top, "mdat" in top)
    whole = {n for n, r in got.items() if r.bytes_read > 2000}
    assert whole == {f"{7:016x}_0"}  # only the damaged trailer is looked for
    assert {r.name for r in ranged.unwrap_files(listing, ["name"]).collect()} == set(got)
    assert all(r.bytes_read < 400 for n, r in {r.name: r for r in ranged.file_facts(listing, ["name"], ("head",)).collect()}.items() if n not in whole)
    gone = listing.limit(1).selectExpr("name", "concat(path, 'x') AS path")
    assert ranged.file_heads(gone, ["name"]).first().error


def test_simple_caches_by_ranges_and_by_content(spark, folder):
    listing = bodies.list_cache_files(spark, [folder], with_content=True)
    found = []
    for df in (listing, listing.drop("path")):
        got = recovery.recover_simple(df)
        rows = {r.hash[-1]: (r.resource_type, r.size) for r in got["resources"].collect()}
        made = got["parts"].join(got["resources"].select("resource_id", "hash"), "resource_id").collect()
        found.append((rows, {r.hash[-1]: bytes(r.content) for r in made}))
        assert got["errors"].count() == 0
    assert found[0] == found[1]
    assert {k: v[0] for k, v in found[0][0].items()} == {"0": "mp4_complete", "1": "mp4_header_only", "2": "png", "3": "ogg", "6": "mp4_complete", "9": "mp4_header_only"}


@pytest.mark.parametrize("part_bytes", [5, 64, 1000, 1 << 20])
def test_facts_of_parts(spark, part_bytes):
    rng, raw = random.Random(part_bytes), {}
    for k in range(60):
        header, chunks, _ = family(rng)
        raw[k] = header + b"".join(c for _, c in chunks) + (MOOV[: rng.randrange(500, 640)] if rng.random() < 0.3 else b"")
    raw |= {100: bytes(3000) + MOOV, 101: box(b"ftyp", b"x" * 8) + struct.pack(">I", 0) + b"mdat" + noise(rng, 500), 102: box(b"ftyp", b"x" * 8) + box(b"mdat", bytes(4000), wide=True) + MOOV + bytes(2000), 103: b"x"}
    df = spark.createDataFrame([(k, 0, bytearray(v)) for k, v in raw.items()], "k bigint, ord bigint, content binary")
    want = {r.k: r for r in bodies.piece_facts(df, ["k"]).collect()}
    # parts of nothing but zeros are left out, as where no segment lies
    rows = [(k, i // part_bytes, i, bytearray(v[i : i + part_bytes]), len(v)) for k, v in raw.items() for i in range(0, len(v), part_bytes) if any(v[i : i + part_bytes]) or k == 103]
    cut = spark.createDataFrame(rows, "k bigint, part bigint, begin bigint, content binary, total bigint").repartition(5)
    assert {r.k: r for r in parts.piece_facts(cut, ["k"]).collect()} == want
    assert {tuple(r) for r in parts.video_info(cut, ["k"]).collect()} == {tuple(r) for r in bodies.video_info(df, ["k"]).collect()}


def test_long_gaps_and_far_boxes():
    far = parts.BodyFold(20_000_000)
    far.add(0, box(b"ftyp", b"x" * 8) + struct.pack(">I", 9_000_000) + b"mdat")
    far.add(15_000_000, MOOV)
    top = far.facts()
    data = bytearray(20_000_000)
    head = box(b"ftyp", b"x" * 8) + struct.pack(">I", 9_000_000) + b"mdat"
    data[: len(head)], data[15_000_000 : 15_000_000 + len(MOOV)] = head, MOOV
    assert top == bodies._facts(bytes(data))[0]


def test_rebuilt_index_bodies_at_any_part_size(spark):
    raw = {1: box(b"ftyp", b"mp42" + bytes(8)) + struct.pack(">I", 5000) + b"mdat" + b"v" * 900 + MOOV + b"behind", 2: b"none at all"}
    whole = spark.createDataFrame([(k, 0, bytearray(v)) for k, v in raw.items()], "k bigint, ord bigint, content binary")
    from chunkmill.operators import layout

    want = {r.k: bytes(r.content) for r in assemble.assemble_plan(layout.segment_plan_index(bodies.piece_facts(whole, ["k"]), "k"), whole, ["k"]).collect()}
    for size in (7, 100):
        cut = spark.createDataFrame([(k, i // size, i, bytearray(v[i : i + size]), len(v)) for k, v in raw.items() for i in range(0, len(v), size)], "k bigint, part bigint, begin bigint, content binary, total bigint")
        plan = assemble.split_sources(layout.segment_plan_index(parts.piece_facts(cut, ["k"]), "k"), size)
        made = assemble.assemble_plan(plan, cut.selectExpr("k", "part AS ord", "content"), ["k"]).collect()
        assert {r.k: bytes(r.content) for r in made} == want


def test_writes_commit_once_and_move_onto_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x").write_bytes(b"old and longer")
    df = spark.createDataFrame([(1, 0, 0, bytearray(b"new"))], "k bigint, part bigint, begin bigint, content binary")
    targets = spark.createDataFrame([(1, "a/x", 1, 3)], "k bigint, out_path string, ord bigint, total bigint")
    got = assemble.write_bodies(df, targets, ["k"], str(tmp_path))
    assert (tmp_path / "a/x").read_bytes() == b"new"
    assert got.count() == got.count() == 1 and (tmp_path / "a/x").read_bytes() == b"new"
    assert [p.name for p in tmp_path.rglob("*") if p.is_file()] == ["x"] and not list(tmp_path.glob(".staging*"))
    # two attempts of one task stage apart; the one that is not committed leaves nothing
    writer = assemble._BodyWriter(str(tmp_path))
    batch = spark.createDataFrame([("b/y", 4, 0, bytearray(b"data"))], "out_path string, total bigint, begin bigint, content binary").toArrow().to_batches()
    first, second = writer.write(iter(batch)), writer.write(iter(batch))
    assert first.files[0][0] != second.files[0][0] and not (tmp_path / "b").exists()
    writer.commit([second, None])
    assert (tmp_path / "b/y").read_bytes() == b"data" and not list(tmp_path.glob(".staging*"))
    other = assemble._BodyWriter(str(tmp_path))
    other.write(iter(batch))
    other.abort([])
    assert not list(tmp_path.glob(".staging*"))


def test_moves_are_made_by_tasks(spark, tmp_path):
    batch = spark.createDataFrame([(f"b/{i}", 4, 0, bytearray(b"data")) for i in range(50)], "out_path string, total bigint, begin bigint, content binary").toArrow().to_batches()
    writer = assemble._ListedWriter(str(tmp_path), ".staging-1")
    lost, told = writer.write(iter(batch)), writer.write(iter(batch))
    assert len(told.files) == 1 and told.files != lost.files  # a folder, whatever the number of files
    writer.commit([told, None, writer.write(iter([]))])
    assert not (tmp_path / "b").exists()
    moved = [f".staging-1/{told.files[0][0].rpartition('/')[2]}/{i}" for i in (0, 1)]
    assemble._moved(str(tmp_path), [(moved[0], "b/0"), (moved[1], "b/1")])  # an attempt that was lost half way
    assemble._move_committed(spark, str(tmp_path), ".staging-1")
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == sorted(map(str, range(50))) and not list(tmp_path.glob(".staging*"))


@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
def test_attempts_at_once_lose_no_file(tmp_path, monkeypatch, prefix):
    """Another attempt moves the file after this one has seen it, and has its own in place."""
    (tmp_path / "own").write_bytes(b"data")
    local, asked = fs.LocalFileSystem, []

    class Late:
        def get_file_info(self, path):
            found = local().get_file_info(path)
            if not asked:
                asked.append(path)
                assemble._moved(f"{prefix}{tmp_path}", [("own", "a/b")])
            return found

        def __getattr__(self, name):
            return getattr(local(), name)

    place = assemble._place
    monkeypatch.setattr(assemble, "_place", lambda folder: (Late(), place(folder)[1]))
    assemble._moved(f"{prefix}{tmp_path}", [("own", "a/b")])
    assert asked and (tmp_path / "a/b").read_bytes() == b"data" and not (tmp_path / "own").exists()


def test_tasks_list_what_spark_lists(spark, tmp_path, monkeypatch):
    for name in ("a b/f_000001", "a b/c/f_000002", "a b/c/x_000003", ".h/f_000004", "_t/f_000005", "f_000006", "a b/f_000007"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name.endswith("7") else name.encode())
    want = bodies.list_cache_files(spark, [str(tmp_path)], with_content=True).drop("content").collect()
    asked = []
    monkeypatch.setattr(bodies, "_listed", lambda level, f=bodies._listed: asked.append(1) or f(level))
    assert sorted(bodies.list_cache_files(spark, [str(tmp_path)]).collect()) == sorted(want) and len(want) == 3
    assert len(asked) == 3  # a step a level

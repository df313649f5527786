"""Plans of chunked MP4s and their bytes, against one sequential fold over the pieces."""

import random
import struct
from collections import Counter

import pytest

from chunkmill.operators import layout
from chunkmill.sources import assemble, bodies


def box(kind, body, wide=False):
    return struct.pack(">I", 1) + kind + struct.pack(">Q", len(body) + 16) + body if wide else struct.pack(">I", len(body) + 8) + kind + body


MOOV = box(b"moov", box(b"mvhd", bytes(592)) + box(b"trak", b""))
PNG = b"\x89PNG\r\n\x1a\n" + b"p" * 20


def noise(rng, n):
    return bytes(rng.randrange(97, 110) for _ in range(n))


def rebuilt(header, chunks, header_hex):
    """What a chunked MP4 becomes; chunks as (hex or None, bytes) in list order."""
    top = {}
    for at, size, head, kind, _ in bodies.boxes(header, deep=False):
        top.setdefault(kind, (at, size, head))
    if "ftyp" not in top or "mdat" not in top:
        return None
    sizes = Counter(len(c) for _, c in chunks)
    modal = max(sizes, key=lambda s: (sizes[s], s)) if sizes else 0
    has = lambda c: bool(bodies.moov_hits(c))
    tail = next((c for c in chunks if len(c[1]) < modal and has(c[1])), None) or next((c for c in chunks if has(c[1])), None)
    middle = [c for c in chunks if c is not tail and not (len(c[1]) < modal and not has(c[1]) and bodies._standalone(c[1])) and not (len(c[1]) != modal and has(c[1]))]
    middle.sort(key=lambda c: (c[0] is None, c[0] or 0))
    plain = header + b"".join(c for _, c in middle if len(c) == modal or not bodies._standalone(c)) + (tail[1] if tail else b"")
    hits = bodies.moov_hits(plain)
    if not hits or hits[-1][0] <= len(plain) // 2:
        return plain
    (f, fs, _), (m, declared, head) = top["ftyp"], top["mdat"]
    out = bytearray(header[f : f + max(fs, m - f)])
    begin = len(out)
    out += bytes(head) + header[m + head :]
    before = header_hex
    for place, c in middle:
        if place is not None and before is not None:
            gap = max(place - before - 1, 0)
            gap -= gap > 0 and tail is not None and tail[0] is not None and before < tail[0] < place
            out += bytes(gap * modal)
        before = place if place is not None else before
        out += c
    at, n = bodies.moov_hits(tail[1])[-1]
    out += tail[1][:at]
    actual = len(out) - begin
    final = actual if actual > 2 * declared else declared
    out = out[: begin + final] + bytes(max(begin + final - len(out), 0))
    out[begin : begin + head] = (struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", final)) if head == 16 else struct.pack(">I", min(final, (1 << 32) - 1)) + b"mdat"
    return bytes(out + tail[1][at : at + n])


def family(rng):
    declared = rng.choice((40, 300, 1500, 4000, 9000))
    header = box(b"ftyp", b"mp42" + bytes(8)) + (box(b"free", bytes(rng.randrange(20))) if rng.random() < 0.5 else b"")
    header += (struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", declared + 16) if rng.random() < 0.3 else struct.pack(">I", declared + 8) + b"mdat") + noise(rng, rng.randrange(10, 400))
    if rng.random() < 0.1:
        header = header[20:]
    if rng.random() < 0.2:
        header = header[:24] + MOOV + header[24:] if header[4:8] == b"ftyp" else header
    chunks = []
    for place in sorted(rng.sample(range(3, 20), rng.randrange(0, 7))):
        kind = rng.random()
        body = noise(rng, 800) if kind < 0.5 else noise(rng, rng.randrange(1, 700)) if kind < 0.6 else PNG if kind < 0.7 else PNG + noise(rng, 900) if kind < 0.75 else noise(rng, rng.randrange(0, 100)) + MOOV + noise(rng, rng.choice((0, 5, 400)))
        chunks.append((place if rng.random() < 0.9 else None, body))
    return header, chunks, rng.choice((2, None))


def test_chunk_plans_against_a_fold(spark):
    rng, rows, want = random.Random(4), [], {}
    for k in range(150):
        header, chunks, place = family(rng)
        want[k] = rebuilt(header, chunks, place)
        rows.append((k, 0, True, place, bytearray(header)))
        rows += [(k, i, False, h, bytearray(c)) for i, (h, c) in enumerate(chunks, 1)]
    pieces = spark.createDataFrame(rows, "resource_id bigint, ord bigint, is_header boolean, hex_value bigint, content binary").repartition(3).cache()
    facts = pieces.drop("content").join(bodies.piece_facts(pieces, ["resource_id", "ord"]), ["resource_id", "ord"])
    plan = layout.segment_plan_chunks(facts).cache()
    assert {r.resource_id for r in plan.where("error is not null").collect()} == {k for k, v in want.items() if v is None}
    assert sum(v is not None and bodies.moov_hits(v) != [] for v in want.values()) > 50
    for part_bytes in (1 << 20, 97):
        got = {}
        parts = assemble.assemble_plan(plan.where("error is null"), pieces, ["resource_id"], part_bytes=part_bytes).collect()
        sizes = {r.resource_id: r.n for r in plan.where("error is null").selectExpr("resource_id", "out_offset + length AS e").groupBy("resource_id").agg({"e": "max"}).toDF("resource_id", "n").collect()}
        for r in parts:
            whole = got.setdefault(r.resource_id, bytearray(sizes[r.resource_id]))
            whole[r.begin : r.begin + len(r.content)] = r.content
        assert {k: bytes(v) for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_index_plans(spark):
    ftyp, media = box(b"ftyp", b"mp42" + bytes(8)), b"v" * 900
    faststart = ftyp + MOOV + box(b"mdat", media)
    streamed = ftyp + struct.pack(">I", 5000) + b"mdat" + media + MOOV + b"behind"
    wide = ftyp + struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", 7000) + media
    raw = {1: faststart, 2: streamed, 3: wide, 4: b"no container at all", 5: b""}
    want = {1: faststart, 2: ftyp + box(b"mdat", media) + MOOV, 3: ftyp + box(b"mdat", media, wide=True), 4: raw[4]}
    df = spark.createDataFrame([(k, 0, bytearray(v)) for k, v in raw.items()], "resource_id bigint, ord bigint, content binary")
    plan = layout.segment_plan_index(bodies.piece_facts(df, ["resource_id"]))
    assert {r.resource_id: bytes(r.content) for r in assemble.assemble_plan(plan, df, ["resource_id"]).collect()} == want


def test_bodies_are_written_part_by_part(spark, tmp_path):
    df = spark.createDataFrame([(i, 0, bytearray(f"body {i}".encode() * 9)) for i in range(4)], "k bigint, ord bigint, content binary")
    plan = spark.createDataFrame([(i, 1, 0, 0, 54, 30, None) for i in range(3)] + [(3, 1, 0, 0, 54, 1 << 40, None)], "k bigint, seq bigint, source bigint, src_offset bigint, length bigint, out_offset bigint, literal binary")
    parts = assemble.assemble_plan(plan, df, ["k"], part_bytes=16)
    targets = spark.createDataFrame([(0, "a/x.bin", 0, 84), (1, "a/x.bin", 1, 84), (2, "b/y.bin", 2, 90), (3, "b/z.bin", 3, 1 << 41), (9, "empty", 4, 0)], "k bigint, out_path string, ord bigint, total bigint")
    got = {r.out_path: (r.bytes, r.error is None) for r in assemble.write_bodies(parts, targets, ["k"], str(tmp_path), most_bytes=1 << 30).collect()}
    assert got == {"a/x.bin": (84, True), "b/y.bin": (90, True), "b/z.bin": (0, False), "empty": (0, True)}
    body = lambda i: bytes(30) + f"body {i}".encode() * 9
    assert (tmp_path / "a/x.bin").read_bytes() == body(1) and (tmp_path / "b/y.bin").read_bytes() == body(2) + bytes(6) and (tmp_path / "empty").read_bytes() == b""
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith(".")) == ["empty", "x.bin", "y.bin"]


@pytest.mark.parametrize("data", [box(b"moov", b"")[:4] + b"moov" + (b"\0\0\0\0moov" * 3000), struct.pack(">I", 9) * 4000, b"\xff" * 5000, struct.pack(">I4sQ", 1, b"moov", (1 << 64) - 1) * 500])
def test_hostile_containers(data):
    assert isinstance(bodies.boxes(data), list)
    bodies._facts(data)


def test_offsets_beyond_64_bits(spark):
    file = struct.pack("<QIIQ", bodies.FILE_MAGIC, 5, 1, 0) + b"k" + struct.pack("<QQQQ", bodies.RANGE_MAGIC, (1 << 64) - 5, 3, 0) + b"abc"
    df = spark.createDataFrame([(1, bytearray(file))], "k bigint, content binary")
    assert [(r.range_offset, r.range_length) for r in bodies.sparse_ranges(df, ["k"]).collect()] == [((1 << 63) - 1, 3)]
    assert bodies.assemble_sparse(df, ["k"]).first().error


def test_sparse_files_in_parts(spark):
    span = lambda o, d: struct.pack("<QQQQ", bodies.RANGE_MAGIC, o, len(d), 0) + d
    file = struct.pack("<QIIQ", bodies.FILE_MAGIC, 5, 1, 0) + b"k" + span(50, b"later") + span(0, b"x" * 20) + span(10, b"over")
    df = spark.createDataFrame([(1, 0, bytearray(file))], "k bigint, ord bigint, content binary")
    whole = bodies.assemble_sparse(df, ["k"]).first().content
    parts = assemble.assemble_plan(assemble.sparse_pieces(df, bodies.sparse_ranges(df, ["k"]), ["k"]), df, ["k"], part_bytes=16).collect()
    out = bytearray(len(whole))
    for p in parts:
        out[p.begin : p.begin + len(p.content)] = p.content
    assert bytes(out) == bytes(whole) and len(parts) == 3

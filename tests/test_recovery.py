"""The three recoveries end to end, over caches written byte by byte."""

import struct

from pyspark.sql import functions as F

from chunkmill.jobs import recovery
from chunkmill.sources import bodies
from tests.test_assemble import MOOV, box
from tests.test_index import ON, block_addr, block_file, entry, index_file, meta

PNG = b"\x89PNG\r\n\x1a\n" + b"p" * 50


def together(frame, key):
    """Bytes of each resource by a column of it."""
    out = {}
    for r in frame["parts"].join(frame["resources"].select("resource_id", key), "resource_id").collect():
        whole = out.setdefault(r[key], bytearray())
        whole.extend(bytes(max(r.begin + len(r.content) - len(whole), 0)))
        whole[r.begin : r.begin + len(r.content)] = r.content
    return {k: bytes(v) for k, v in out.items()}


def headers(kind, more=b""):
    return meta(b"HTTP/1.1 206 OK\0content-type: " + kind + b"\0" + more + b"\0")


def indexed_cache():
    """An image with a name, a page, an empty entry, a gone file, a video in three children (one in a block file),
    and the image's URL a second time."""
    metas = [headers(b"image/png", b'content-disposition: inline; filename="my pic.png"\0'), headers(b"text/html"), headers(b"video/mp4")]
    m = lambda i: (len(metas[i]), block_addr(2, i, kind=3))
    video = box(b"ftyp", b"mp42" + bytes(8)) + struct.pack(">I", 9_000_000) + b"mdat" + b"v" * 2000
    url = b"1/0/https://x.org/v/clip.mp4"
    ext = lambda i: ON | i
    small = b"in a block file " * 10
    rows = [
        (b"1/0/https://x.org/a/p.png", 0, (m(0)[0], len(PNG), 0, 0), (m(0)[1], ext(1), 0, 0)),
        (b"1/0/https://x.org/b.html", 0, (m(1)[0], 4, 0, 0), (m(1)[1], ext(2), 0, 0)),
        (b"1/0/https://x.org/none", 0, (m(1)[0], 0, 0, 0), (m(1)[1], 0, 0, 0)),
        (b"1/0/https://x.org/gone.png", 0, (m(0)[0], 9, 0, 0), (m(0)[1], ext(99), 0, 0)),
        (url, 1, (m(2)[0], 0, 0, 0), (m(2)[1], 0, 0, 0)),
        (b"Range_" + url + b":00000000000a1b2c:0", 2, (0, 1 << 20, 0, 0), (0, ext(4), 0, 0)),
        (b"Range_" + url + b":00000000000a1b2c:1", 2, (0, 0, len(small), 0), (0, 0, block_addr(2, 8, kind=3), 0)),
        (b"Range_" + url + b":00000000000a1b2c:3", 2, (0, len(MOOV), 0, 0), (0, ext(5), 0, 0)),
        (b"1/0/https://x.org/a/p.png", 0, (m(0)[0], len(PNG), 0, 0), (m(0)[1], ext(6), 0, 0)),
    ]
    blocks = [entry(k, 0, sizes=s, addrs=a, flags=f) for k, f, s, a in rows]
    first = video + bytes((1 << 20) - len(video))
    files = {"f_000001": PNG, "f_000002": b"<htm", "f_000004": first, "f_000005": MOOV, "f_000006": PNG + b"2", "f_000007": b"loose"}
    index = {"index": index_file([block_addr(1, i) for i in range(len(blocks))]), "data_1": block_file(blocks), "data_2": block_file([*metas, *[b""] * 5, small], 1024).ljust(8192 + 9 * 1024, b"\0")}
    # an empty block is none, so the small body is put at its place
    data = bytearray(index["data_2"][:8192] + bytes(9 * 1024))
    for i, b in enumerate(metas):
        data[8192 + 1024 * i : 8192 + 1024 * i + len(b)] = b
    data[8192 + 8 * 1024 : 8192 + 8 * 1024 + len(small)] = small
    index["data_2"] = bytes(data)
    raw = bytearray(3 * (1 << 20) + len(MOOV))
    raw[: 1 << 20], raw[1 << 20 : (1 << 20) + len(small)], raw[3 << 20 :] = first, small, MOOV
    body = bytes(raw[28 : 3 << 20])
    made = bytes(raw[:20]) + struct.pack(">I", len(body) + 8) + b"mdat" + body + MOOV
    return index, files, {"my pic.png": PNG + b"2", "clip.mp4": made}


def test_indexed(spark):
    index, files, want = indexed_cache()
    caches = ("a", "b")
    index_df = spark.createDataFrame([(c, n, bytearray(d)) for c in caches for n, d in index.items()], "cache_dir string, name string, content binary")
    files_df = spark.createDataFrame([(c, n, len(d), bytearray(d)) for c in caches for n, d in files.items()], "cache_dir string, name string, size bigint, content binary").repartition(3)
    got = recovery.recover_indexed(index_df, files_df)
    rows = {(r.cache_dir, r.display_name): r for r in got["resources"].collect()}
    assert set(rows) == {(c, n) for c in caches for n in want}
    video = rows["a", "clip.mp4"]
    assert (video.resource_type, video.action, video.n_children, video.out_path, video.http_status) == ("mp4_chunked", "index_reassemble", 3, "videos/clip_mp4.mp4", 206)
    pic = rows["b", "my pic.png"]
    assert (pic.merged_rows, [f.name for f in pic.files], pic.action) == (2, ["f_000006", "f_000001"], "copy")
    assert sorted((r.cache_dir, r.skip_reason) for r in got["skipped"].collect()) == [(c, s) for c in caches for s in ("empty-body", "no-file-type", "no-files")]
    assert together(got, "display_name") == want
    assert {r.name for r in got["claimed"].collect()} == {"f_000001", "f_000004", "f_000005", "f_000006"}
    none = recovery.recover_indexed(index_df.limit(0), files_df.limit(0))
    assert none["resources"].count() == none["parts"].count() == 0


def test_unclaimed(spark):
    noise = lambda i, n: bytes((97 + i + k) % 26 + 97 for k in range(n))
    header = box(b"ftyp", b"mp42" + bytes(8)) + struct.pack(">I", 1_600_000) + b"mdat" + noise(0, 300)
    rows = {
        16: (header, '"v"', "video/mp4"), 17: (noise(1, 500), '"v"', None), 18: (noise(2, 500), '"other"', None), 19: (noise(3, 500), '"v"', None), 20: (noise(4, 40) + MOOV, '"v"', None),
        100: (b"\x1a\x45\xdf\xa3" + noise(5, 60), None, None), 101: (b"\x1f\x43\xb6\x75" + noise(6, 60), None, None), 102: (noise(7, 9), None, "text/css"), 110: (PNG, None, None), 300: (noise(8, 70), None, None),
    }
    df = spark.createDataFrame([("c", f"f_{h:06x}", len(d), bytearray(d), e, None, t) for h, (d, e, t) in rows.items()], "cache_dir string, name string, size bigint, content binary, etag string, content_range string, content_type string").repartition(3)
    facts = spark.createDataFrame([("c", "f_000013", "1/0/https://x.org/v/the%20film.mp4", "")], "cache_dir string, name string, url string, original_filename string")
    got = recovery.recover_unclaimed(df, facts)
    found = {r.header_file: r for r in got["resources"].collect()}
    assert {k: (r.resource_type, r.action, r.n_files) for k, r in found.items()} == {"f_000010": ("mp4_chunked", "chunk_reassemble", 4), "f_000064": ("webm_mkv", "concat", 2), "f_00006e": ("png", "copy", 1)}
    assert found["f_000010"].display_name == "the film.mp4" and found["f_000064"].display_name.startswith("Video ")
    assert {r.name for r in got["left"].collect()} == {"f_000012", "f_000066", "f_00012c"}
    bytes_of = together(got, "header_file")
    assert bytes_of["f_000064"] == rows[100][0] + rows[101][0] and bytes_of["f_00006e"] == PNG
    media = header[32:] + rows[17][0] + bytes(500) + rows[19][0] + rows[20][0][:40]
    assert bytes_of["f_000010"] == header[:32] + media + bytes(1_600_000 + 20 - 32 - len(media)) + MOOV
    none = recovery.recover_unclaimed(df.limit(0))
    assert none["resources"].count() == none["parts"].count() == 0


def simple(body, raw_headers):
    eof = lambda n: struct.pack("<QIIII", bodies.EOF_MAGIC, 0, 0, n, 0)
    return struct.pack("<QIIQ", bodies.FILE_MAGIC, 5, 1, 0) + b"k" + body + eof(len(body)) + raw_headers + eof(len(raw_headers))


def test_simple(spark):
    span = lambda o, d: struct.pack("<QQQQ", bodies.RANGE_MAGIC, o, len(d), 0) + d
    ogg = b"OggS" + b"o" * 96
    sparse = struct.pack("<QIIQ", bodies.FILE_MAGIC, 5, 1, 0) + b"k" + span(100, b"end") + span(0, ogg)
    files = {"00000000000000aa_0": simple(PNG, b"HTTP/1.1 200\0content-type: text/plain\0"), "00000000000000aa_1": b"side", "00000000000000bb_0": simple(b"", b"HTTP/1.1 200\0content-type: audio/ogg\0"), "00000000000000bb_s": sparse, "00000000000000cc_0": simple(b"just text", b"x"), "00000000000000dd_0": b"broken", "00000000000000ee_0": simple(b"by mime", b"HTTP/1.1 200\0Content-Type: image/gif; q=1\0"), "00000000000000ff_1": b"alone"}
    df = spark.createDataFrame([("c", n, len(d), bytearray(d)) for n, d in files.items()], "cache_dir string, name string, size bigint, content binary").repartition(3)
    got = recovery.recover_simple(df)
    assert {r.hash[-2:]: (r.resource_type, r.action, r.source) for r in got["resources"].collect()} == {"aa": ("png", "copy", "body"), "bb": ("ogg", "sparse_copy", "sparse"), "ee": ("gif", "copy", "body")}
    assert {k[-2:]: v for k, v in together(got, "hash").items()} == {"aa": PNG, "bb": ogg + b"end", "ee": b"by mime"}
    assert recovery.recover_simple(df.limit(0))["resources"].count() == 0


def test_simple_bodies_do_not_pass_through_python(spark):
    rows = [("c", "00000000000000aa_0", bytearray(simple(PNG, b"HTTP/1.1 200\0content-type: image/png\0")))]
    df = spark.createDataFrame(rows, "cache_dir string, name string, content binary").withColumn("size", F.octet_length("content").cast("bigint"))
    parts = recovery.recover_simple(df)["parts"]
    assert "InArrow" not in parts._jdf.queryExecution().executedPlan().toString() and bytes(parts.first().content) == PNG


def test_only_bodies_that_may_be_mp4_are_walked(spark, monkeypatch):
    walk, seen = bodies.piece_facts, []
    monkeypatch.setattr(bodies, "piece_facts", lambda df, keys: seen.append(df) or walk(df, keys))
    box = lambda kind, data: (8 + len(data)).to_bytes(4, "big") + kind + data
    begin = box(b"ftyp", b"mp42" + bytes(8)) + box(b"moov", bytes(600))
    told = b"HTTP/1.1 200\0content-type: %s\0"
    files = {"a0": (begin + box(b"mdat", bytes(50)), b"text/plain"), "a1": (begin, b"x"), "a2": (b"by mime", b"video/mp4"), "b0": (PNG, b"video/mp4"), "b1": (b"just text", b"text/plain"), "b2": (b"by mime", b"image/gif"), "b3": (b"", b"x")}
    rows = [("c", f"{k:0>16}_0", bytearray(simple(body, told % kind))) for k, (body, kind) in files.items()]
    df = spark.createDataFrame(rows, "cache_dir string, name string, content binary").withColumn("size", F.octet_length("content").cast("bigint"))
    got = {r.hash[-2:]: r.resource_type for r in recovery.recover_simple(df)["resources"].collect()}
    assert got == {"a0": "mp4_complete", "a1": "mp4_header_only", "a2": "mp4_header_only", "b0": "png", "b2": "gif"}
    assert {r.hash[-2:] for r in seen[0].select("hash").collect()} == {"a0", "a1", "a2"}

"""One scan over caches that have all kinds of files."""

import os

from pyspark.sql import functions as F

from chunkmill.jobs import scan
from tests.test_recovery import PNG, indexed_cache, simple


def test_scan_of_all_phases(spark):
    index, files, want = indexed_cache()
    webm, more = b"\x1a\x45\xdf\xa3" + b"w" * 60, b"\x1f\x43\xb6\x75" + b"c" * 50
    files |= {"f_000064": webm, "f_000065": more, "f_000200": b"chunk of nothing", "00000000000000aa_0": simple(PNG, b"HTTP/1.1 200\0"), "00000000000000bb_0": simple(b"text", b"content-type: \xff\0")}
    caches = ("a", "b")
    index_df = spark.createDataFrame([(c, n, bytearray(d)) for c in caches for n, d in index.items()] + [("bad", "index", bytearray(b"x"))], "cache_dir string, name string, content binary")
    rows = [(c, n, len(d), i, bytearray(d)) for c in caches for i, (n, d) in enumerate(files.items())]
    files_df = spark.createDataFrame(rows, "cache_dir string, name string, size bigint, modified_at_us bigint, content binary").repartition(3)
    got = scan.scan(index_df, files_df)
    resources = {(r.cache_dir, r.display_name): r for r in got["resources"].collect()}
    own = sorted((r.number, r.display_name, r.resource_type, r.phase) for (c, _), r in resources.items() if c == "a")
    assert [(n, d) for n, d, _, p in own if p == 0] == [(n, d) for n, (_, d, _, _) in enumerate((o for o in own if o[3] == 0), 1)]
    assert {(d, k, p) for _, d, k, p in own} == {("my pic.png", "png", 0), ("clip.mp4", "mp4_chunked", 0), ("Image 3", "png", 1), ("Video 4 (1 chunks)", "webm_mkv", 2)}
    ids = {r.id: r for r in resources.values()}
    made = {}
    for p in got["parts"].collect():
        made.setdefault(ids[p.id].display_name, {})[ids[p.id].cache_dir, p.begin] = bytes(p.content)
    assert made["my pic.png"] == {(c, 0): want["my pic.png"] for c in caches} and made["Image 3"] == {(c, 0): PNG for c in caches}
    assert made["Video 4 (1 chunks)"] == {(c, 0): webm + more for c in caches} and made["clip.mp4"]["a", 0] == want["clip.mp4"]
    stats = {r.cache_dir: r for r in got["stats"].collect()}
    assert set(stats) == {"a", "b"}
    # the page and the loose chunks are unclaimed
    s = stats["a"]
    assert (s.total_files, s.simple_files, s.resources, s.index_entries, s.heuristic_grouped, s.index_claimed) == (len(files), 2, 4, 6, 1, 4) and s.unclaimed >= 2
    assert {r.cache_dir: r.n_files for r in got["unidentified"].collect()} == {c: s.unclaimed for c in caches}
    why = {(r.name, r.method) for r in got["associations"].where("cache_dir = 'a'").collect()}
    assert {("f_000065", "hex-proximity"), ("f_000001", "index"), ("f_000006", "index")} <= why
    assert [r.error for r in got["errors"].collect()] == ["index: too short"]
    assert {r.id for r in got["videos"].collect()} == {r.id for r in resources.values() if r.display_name == "clip.mp4"}
    assert got["playlist"].where("cache_dir = 'a'").count() == 2
    assert got["resource_files"].where("cache_dir = 'a' and name in ('f_000001', 'f_000006')").select("ord").distinct().count() == 1


def test_only_changed_caches(spark):
    done = spark.createDataFrame([("a", "f_1", 1, 5), ("b", "f_1", 1, 5), ("c", "f_1", 1, 5), ("d", "f_1", 1, 5), ("d", "f_2", 1, 5)], "cache_dir string, name string, size bigint, modified_at_us bigint")
    now = done.where("not (cache_dir = 'd' and name = 'f_2')").withColumn("size", F.when(F.col("cache_dir") == "b", 2).otherwise(F.col("size"))).unionByName(spark.createDataFrame([("e", "f_1", 1, 1)], done.schema))
    assert {r.cache_dir for r in scan.changed_caches(now, done).collect()} == {"b", "d", "e"}


def test_what_a_scan_stores_counts_by_its_rows(spark):
    """Not by its files, or tables of any size would be broadcast."""
    index, files, _ = indexed_cache()
    index_df = spark.createDataFrame([("a", n, bytearray(d)) for n, d in index.items()], "cache_dir string, name string, content binary")
    files_df = spark.createDataFrame([("a", n, len(d), 0, bytearray(d)) for n, d in files.items()], "cache_dir string, name string, size bigint, modified_at_us bigint, content binary")
    got = scan.scan(index_df, files_df)
    for name in ("resources", "resource_files"):
        size = int(str(got[name]._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        assert size >= 100 * sum(os.path.getsize(p.removeprefix("file://")) for p in got[name].inputFiles()) > 0

"""Claims and grouping against plain sequential walks."""

import math
import random

import pytest

from chunkmill.operators import group, layout, link, report

M = 1 << 20
SCHEMA = "cache_dir string, hex_value bigint, name string, size bigint, file_type string, etag string, content_range string, content_type string, mdat_size bigint, mdat_offset bigint"
TYPES = [None, None, None, "mp4_fragment", "media_data_chunk", "webm_continuation", "mp4_header_only", "mp4_header_only", "webm_mkv", "mp3", "jpeg", "mp4_complete"]


def corpus(seed, n=400):
    rng, rows = random.Random(seed), []
    for cache in ("a", "b", "c"):
        for x in sorted(rng.sample(range(2 * n), n)):
            kind = rng.choice(TYPES)
            head = kind == "mp4_header_only" and rng.random() < 0.8
            rows.append((cache, x, f"f_{x:06x}", M if kind == "mp4_complete" and rng.random() < 0.7 else rng.randrange(1, M), kind, rng.choice([None, None, "e1", "e2", f"u{x}"]), rng.choice([None, "bytes 0-1/50", "bytes 0-1/60", "bytes 0-1/0"]), rng.choice([None, "text/css", "video/mp4"]), rng.randrange(1, 30 * M) if head else None, 32 if head else None))
    return rows


def walk(rows):
    """One pass over the files of a cache in order, with everything claimed so far in a set."""
    found = []
    for cache in sorted({r[0] for r in rows}):
        files = sorted((r for r in rows if r[0] == cache), key=lambda r: r[1])

        def total(r):
            tail = (r[6] or "").rpartition("/")[2]
            return int(tail) if tail.isdigit() and int(tail) else None

        def members(key, value, files=files):
            return [f[1] for f in files if value is not None and key(f) == value]

        taken = set()
        for i, h in enumerate(files):
            suspect = lambda f: f[4] == "mp4_complete" and f[3] == M
            header = lambda f: f[4] in group.HEADER_TYPES or f[4] == "mp4_header_only" or suspect(f)
            if not header(h):
                continue
            method, gate = "hex-proximity", None
            if len(members(lambda f: f[5], h[5])) > 1:
                method, gate = "etag", set(members(lambda f: f[5], h[5]))
            elif len(members(total, total(h))) > 1:
                method, gate = "content-range", set(members(total, total(h)))
            if h[4] == "mp4_header_only":
                if h[8] is None:
                    continue
                if h[9] + h[8] >= h[3]:
                    most = math.ceil((h[8] - (h[3] - h[9])) / M) + 5
                    reach = most + 10
                else:
                    most = math.ceil((h[8] + h[3]) / M) + 5
                    reach = 2 * most
                near = [f for f in files if h[1] < f[1] <= h[1] + reach and f[4] in (None, "mp4_fragment", "media_data_chunk")]
            else:
                most, near = len(files), []
                for f in files[i + 1 :]:
                    if header(f) or f[1] - h[1] > 50:
                        break
                    if f[4] in (None, "mp4_fragment", "webm_continuation", "media_data_chunk"):
                        near.append(f)
            own = [f for f in near if f[1] not in taken and f[7] != "text/css" and (gate is None or f[1] in gate)][:most]
            taken |= {f[1] for f in own}
            found += [(cache, f[2], f[1], h[2], f[1] - h[1], method) for f in own]
    return sorted(found)


@pytest.mark.parametrize("seed", range(4))
def test_grouped_chunks_follow_the_walk(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(tuple(r) for r in group.grouped_chunks(df).collect()) == walk(rows)
    alone = df.where("cache_dir = 'b'")
    assert sorted(tuple(r) for r in group.grouped_chunks(alone).collect()) == [r for r in walk(rows) if r[0] == "b"]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert group.grouped_chunks(df).count() == group.affinity_by_etag(df).count() == report.cache_inventory(df).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_dedupe_follows_the_fold(spark, seed):
    rng = random.Random(seed)
    rows = [("c", i, rng.choice(["u1", "u2", "u3", None]), [(f"f{rng.randrange(9)}", rng.randrange(5)) for _ in range(rng.randrange(4))], rng.choice([0, 7]), rng.random() < 0.2) for i in range(40)]
    kept, where = {}, {}
    for _, ord_, url, files, size, strong in rows:
        me = {"ord": ord_, "files": [*files], "size": size, "strong": strong}
        if url is None or url not in where:
            kept[ord_] = me
            if url is not None:
                where[url] = me
            continue
        old = where[url]
        keep, drop = (old, me) if old["strong"] else (me, old)
        names = {n for n, _ in keep["files"]}
        keep["files"] += [f for f in drop["files"] if f[0] not in names]
        if keep["files"] and keep["size"] == 0:
            keep["size"] = sum(s for _, s in keep["files"])
        kept.pop(drop["ord"], None)
        kept[keep["ord"]] = keep
        where[url] = keep
    df = spark.createDataFrame(rows, "cache_dir string, ord bigint, index_url string, files array<struct<name:string,size:bigint>>, total_size bigint, authoritative boolean").repartition(3)
    got = {r.ord: r for r in group.dedupe_resources_by_url(df).collect()}
    assert set(got) == set(kept)
    for o, k in kept.items():
        names = list(dict.fromkeys(n for n, _ in k["files"]))
        assert list(dict.fromkeys(f.name for f in got[o].files)) == names


def test_sparse_plan_covers_the_buffer(spark):
    rng = random.Random(1)
    rows = [(r, rng.randrange(0, 60), rng.randrange(0, 25), i) for r in range(40) for i in range(rng.randrange(1, 7))]
    df = spark.createDataFrame(rows, "resource_id bigint, range_offset bigint, range_length bigint, seq bigint")
    plan = {}
    for s in layout.segment_plan_sparse(df).collect():
        plan.setdefault(s.resource_id, []).append((s.out_offset, s.length, s.kind))
    for r in range(40):
        own = sorted((o, n, q) for k, o, n, q in rows if k == r and n)
        size = max((o + n for o, n, _ in own), default=0)
        covered = [any(o <= b < o + n for o, n, _ in own) for b in range(size)]
        parts = sorted(plan.get(r, []))
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:i]) for i in range(len(parts))] and sum(p[1] for p in parts) == size
        assert [k != "zero" for _, n, k in parts for _ in range(n)] == covered


def test_links(spark):
    entries = spark.createDataFrame([("c", "u", True, 1), ("c", "u", True, 2), ("c", "v", True, 3), ("d", "u", False, 4)], "cache_dir string, url string, is_sparse boolean, ord bigint")
    kids = spark.createDataFrame([("c", "Range_u:0000:1", 5, "f_2", True), ("c", "Range_u:0000:0", 4, "f_1", True), ("d", "Range_u:0000:0", 4, "f_9", True), ("c", "bad", 1, "f_3", True)], "cache_dir string, child_key string, size bigint, file_name string, is_external boolean")
    linked = {(r.url, r.ord): r for r in link.link_sparse_children(entries, kids).collect()}
    assert set(linked) == {("u", 1), ("v", 3)}
    assert [(c.child_id, c.offset_bytes, c.file_name) for c in linked["u", 1].children] == [(0, 0, "f_1"), (1, M, "f_2")] and linked["u", 1].body_size == 9
    assert [tuple(r) for r in link.orphan_children(entries, kids).collect()] == [("d", "u", 1)]
    assert [tuple(r) for r in link.unmatched_parents(entries, kids).collect()] == [("c", "v")]


def test_files_of_the_entries_themselves(spark):
    entries = spark.createDataFrame([("c", "u", True, 1), ("c", "v", False, 2), ("c", "w", True, 3), ("c", "e", False, 4), ("c", "v", False, 5)], "cache_dir string, url string, is_sparse boolean, ord bigint")
    kids = spark.createDataFrame([("c", "Range_u:0000:0", 4, "f_1", True)], "cache_dir string, child_key string, size bigint, file_name string, is_external boolean")
    streams = [("u", 1, True, 4, 1, "f_2", True), ("v", 2, False, 9, 1, "/x/f_3", True), ("v", 2, False, 9, 0, "f_4", True), ("w", 3, True, 0, 1, "f_5", True), ("e", 4, False, 0, 0, "f_6", True), ("v", 5, False, 9, 1, "f_7", False)]
    streams = spark.createDataFrame([("c", *s) for s in streams], "cache_dir string, url string, ord bigint, is_sparse boolean, body_size bigint, stream_index int, file_name string, is_external boolean")
    files = spark.createDataFrame([("c", f"f_{i}", i) for i in range(1, 9)], "cache_dir string, name string, size bigint")
    linked = link.link_sparse_children(entries, kids)
    matched = {(r.url, r.ord): [f.name for f in r.files] for r in link.match_entry_files(linked, files, streams).collect()}
    assert matched == {("u", 1): ["f_1"], ("v", 2): ["f_3"], ("w", 3): ["f_5"]}
    assert {r.name: r.url for r in link.file_entry_map(linked, streams).collect()} == {"f_1": "u", "f_2": "u", "f_3": "v", "f_4": "v", "f_5": "w"}
    left = link.unclaimed_files(files, linked, files.where("name = 'f_8'"), streams).collect()
    assert sorted(r.name for r in left) == ["f_3", "f_4", "f_6", "f_7"]

"""De-duplication and search against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from chunkmill.llm import exact_dedup, exact_topk, near_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def folded(text):
    return (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def test_exact(small, edge, empty):
    for df in (small, edge, small.unionByName(small)):
        groups = defaultdict(list)
        rows = df.select("doc_id", "text").collect()
        for r in rows:
            groups[folded(r.text)].append(r.doc_id)
        want = []
        for r in rows:
            own = groups[folded(r.text)]
            keep = max((i for i in own if i is not None), default=None)
            want.append((r.doc_id, keep, len(own), r.doc_id == keep, hashlib.sha256(folded(r.text)).hexdigest()))
        got = [tuple(r) for r in exact_dedup.mark_copies(df).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert exact_dedup.mark_copies(empty).count() == 0


def test_exact_with_few_counters(small):
    a = exact_dedup.mark_copies(small, counters=3).collect()
    assert sorted(a) == sorted(exact_dedup.mark_copies(small).collect())


def test_keep_one_row_of_each_text(edge, empty):
    kept = exact_dedup.keep_one(edge.unionByName(edge))
    assert kept.columns == edge.columns and exact_dedup.keep_one(empty).count() == 0
    last = {}
    for r in edge.collect():
        last[folded(r.text)] = max(r.doc_id if r.doc_id is not None else -1, last.get(folded(r.text), -1))
    got = sorted((folded(r.text), -1 if r.doc_id is None else r.doc_id) for r in kept.collect())
    assert got == sorted(last.items())


def shingles(text, size):
    w = WORD.findall(folded(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def brute_components(rows, size):
    sets = [(k, shingles(t, size)) for k, t in rows]
    parent = {k: k for k, _ in sets if k is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    usable = [(k, s) for k, s in sets if k is not None and s]
    for i, (a, s) in enumerate(usable):
        for b, t in usable[:i]:
            if top(a) != top(b) and min(len(s), len(t)) * 100 >= 80 * max(len(s), len(t)):
                both = len(s & t)
                if 100 * both >= 80 * (len(s) + len(t) - both):
                    x, y = sorted((top(a), top(b)))
                    parent[y] = x
    return sorted(((k, len(s), None if k is None else top(k), k is None or top(k) == k) for k, s in sets), key=str)


@pytest.fixture(scope="module")
def family(spark):
    """Near copies of one text, each with other edits, beside texts that share a passage."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows, passage = [], " ".join(f"p{i}" for i in range(40))
    for i in range(300):
        own = [rng.choice("abcdef") + str(i) if rng.random() < rng.choice((0.01, 0.03, 0.06)) else w for w in base]
        rows.append((i, " ".join(own)))
    for i in range(300, 500):
        rows.append((i, passage + " " + " ".join(f"q{rng.randrange(100000)}" for _ in range(rng.randrange(2, 60)))))
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)


@pytest.mark.parametrize("size", [2, 5])
def test_near(small, edge, family, size):
    for df in (small, edge, family):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = [tuple(r) for r in near_dedup.near_duplicates(df, size=size).collect()]
        assert sorted(got, key=str) == brute_components(rows, size)


def test_near_empty(empty):
    assert near_dedup.near_duplicates(empty).count() == 0


def test_minima_tell_unrelated_sets_apart():
    shingles = np.random.default_rng(3).integers(0, 1 << 63, 3000, np.uint64)
    one, two = np.sort(shingles[:1500]), np.sort(shingles[1500:])
    _, fine = near_dedup.signatures(np.concatenate([one, two, one]), np.array([0, 1500, 3000, 4500]))
    assert (fine[0] == fine[1]).sum() < 10 and (fine[0] == fine[2]).all()


def test_near_blocks(family, monkeypatch):
    want = sorted(tuple(r) for r in near_dedup.near_duplicates(family).collect())
    for name, least in (("BLOCK", 16), ("WIDE", 24), ("PART", 32), ("HASHES", 3000)):
        monkeypatch.setattr(near_dedup, name, least)
    assert sorted(tuple(r) for r in near_dedup.near_duplicates(family).collect()) == want


def test_near_far_members(spark):
    """Copies of a few texts that lie just below and just above the threshold, and chains of links."""
    rng, rows = random.Random(8), []
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    for i in range(1200):
        own = list(base)
        for _ in range(rng.choice((2, 6, 9, 12, 15))):
            own[rng.randrange(len(own))] = f"x{rng.randrange(90)}"
        rows.append((i, " ".join(own)))
    for i in range(1200, 1300):  # each near the one before
        base[(i * 7) % 120] = f"y{i}"
        rows.append((i, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = [tuple(r) for r in near_dedup.near_duplicates(df).collect()]
    assert sorted(got, key=str) == brute_components(rows, 2)


def test_near_short_texts(spark):
    """Texts of fewer words than a shingle has, alone in their batch."""
    rows = [(1, "a"), (2, "A"), (3, "b c"), (4, None), (5, ""), (6, "b c")]
    for size in (2, 5):
        got = [tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), size=size).collect()]
        assert sorted(got, key=str) == brute_components(rows, size)


def test_thresholds():
    assert near_dedup.thresholds(80) == (4, 57)
    assert near_dedup.thresholds(100) == (32, 96)


def brute_topk(rows, k, every):
    import math

    vectors = [(i, [math.floor(float(x) * 64) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in vectors:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in vectors if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_topk(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice((-1.0, -0.5, 0.0, 0.25, 1.0)) for _ in range(8)]) for i in range(700)]
    rows += [(700, None), (701, []), (702, [None] * 8), (703, [float("nan")] * 8), (704, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(i, [0.5] * 8) for i in range(1000, 1100)] + [(3, [1.0] * 8), (3, [1.0] * 8), (705, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    clash = df.selectExpr("*", "1 AS v", "2 AS lot", "3 AS score", "'x' AS ids")
    assert sorted(tuple(r) for r in exact_topk.top_k(clash).collect()) == brute_topk(rows, 20, 20)
    few = df.where("vec_id < 5")
    assert sorted(tuple(r) for r in exact_topk.top_k(few).collect()) == brute_topk([r for r in rows if r[0] is not None and r[0] < 5], 20, 20)
    assert exact_topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1.0, 1e6, 3e13])
def test_topk_over_blocks_and_lots(spark, monkeypatch, size):
    """Many blocks and lots, ties across them, and components whose sums need all 64 bits."""
    for name, least in (("ROWS", 64), ("LOT", 4), ("SEEDS", 1)):
        monkeypatch.setattr(exact_topk, name, least)
    rng = random.Random(6)
    rows = [(i, [float(rng.choice((-3, -1, 0, 1, 2))) * size / 1e7 for _ in range(6)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    assert sorted(tuple(r) for r in exact_topk.top_k(df, every=30).collect()) == brute_topk(rows, 20, 30)


@pytest.mark.parametrize("task_bytes", [1 << 40, 2000])
def test_topk_over_groups(spark, monkeypatch, task_bytes):
    """Several blocks a group (of one task, and of many), several leaves, rows copied for several lots, and a third of all rows alike."""
    for name, least in (("ROWS", 8), ("LOT", 4), ("BOUNDS_BYTES", 1), ("LEAF", 2), ("MEET", 2), ("TASK_BYTES", task_bytes)):
        monkeypatch.setattr(exact_topk, name, least)
    rng = random.Random(8)
    rows = [(i, [float(rng.choice((-3, -1, 0, 1, 2))) / 64 for _ in range(6)] if i % 3 else [2.0 / 64] * 6) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    assert sorted(tuple(r) for r in exact_topk.top_k(df, every=20).collect()) == brute_topk(rows, 20, 20)


def test_topk_refuses_scores_beyond_a_long(spark):
    df = spark.createDataFrame([(i, [1e17 + i]) for i in range(21)], "vec_id bigint, embedding array<double>")
    with pytest.raises(OverflowError):
        exact_topk.top_k(df)


def test_kept_rows_with_clashing_names(spark):
    """Columns named like those that the join once made, and like its own, pass through."""
    rows = [(1, "a b", 7, "x", 1, "s"), (2, "A b", 8, "y", 2, "t"), (2, "A b", 8, "y", 2, "t"), (None, None, 9, "z", None, None), (3, "", 1, None, 3, "u")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _kept_id bigint, _kept_sha string, _id bigint, _sha string")
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[1], rows[4]], key=str)
    assert exact_dedup.keep_one(df.limit(0)).count() == 0

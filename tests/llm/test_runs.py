"""Periodic runs against a search of every period of every document."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkmill.llm import periodic_runs, queries
from tests.llm.conftest import SMALL


def all_runs(words, exponent=4, least=6):
    """Every period, every stretch: (start, length, period) of the runs."""
    found, n = {}, len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q) and j > i:
                found.setdefault((i, j + q - i), q)  # the first period is the smallest
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_overlap_is_that_of_the_shortest_run():
    assert periodic_runs.overlap(4, 6) == 5 and periodic_runs.overlap(2, 2) == 1 and periodic_runs.overlap(3, 6) == 4


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(st.lists(st.integers(0, 2), max_size=90), max_size=4), exponent=st.integers(2, 4), least=st.sampled_from([2, 6, 7]))
def test_runs_of_few_words(texts, exponent, least):
    codes = np.array([c for t in texts for c in t], np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    got = list(zip(*(x.tolist() for x in periodic_runs.find_runs(codes, bounds, exponent, least)), strict=True))
    want = [(a + s, length, q) for a, t in zip(bounds.tolist(), texts, strict=False) for s, length, q in all_runs(t, exponent, least)]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("seed", range(6))
def test_long_periods(seed):
    draw = random.Random(seed)
    block = [draw.randrange(40) for _ in range(draw.randrange(30, 90))]
    inner = block[:7] * 5
    text = [draw.randrange(40) for _ in range(draw.randrange(20))] + block * 3 + inner + block * 4 + block[:11] + [99] + block * 6
    codes, bounds = np.array(text, np.int64), np.array([0, len(text)])
    got = list(zip(*(x.tolist() for x in periodic_runs.find_runs(codes, bounds, 4, 6)), strict=True))
    assert sorted(got) == all_runs(text) and len(got) >= 3


def planted(key, text):
    words = words_of(text)
    h = 1 if key is None else zlib.crc32(str(key).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digests(key, text):
    words = planted(key, text)
    runs = all_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (key, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))), sha(collapsed(words, runs)))


def test_query_against_every_period(spark):
    want = {r.doc_id: digests(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if len(r.text or "") < 12_000}
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, SMALL).collect()}
    assert {k: got[k] for k in want} == want and sum(v[1] > 0 for v in want.values()) > 10


def test_edges(edge, empty):
    rows = [(r.doc_id, words_of(r.text), r.text) for r in edge.collect()]
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.collapse_runs(edge).collect()]
    assert [g for g in got if g[0] == 10] == [(10, 40_000, [(0, 40_000, 1)], "long")]
    want = [(k, len(w), runs := all_runs(w), collapsed(w, runs)) for k, w, _ in rows if k != 10]
    assert sorted((g for g in got if g[0] != 10), key=str) == sorted(want, key=str)
    made = periodic_runs.run_digests(periodic_runs.collapse_runs(periodic_runs.repeat_tails(edge))).collect()
    assert sorted((tuple(r) for r in made if r.doc_id != 10), key=str) == sorted((digests(k, t) for k, _, t in rows if k != 10), key=str)
    assert periodic_runs.run_digests(periodic_runs.collapse_runs(periodic_runs.repeat_tails(empty))).count() == 0

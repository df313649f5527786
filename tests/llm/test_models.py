"""Language model, toxicity and quality: brute force, proper probabilities, held-out accuracy."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chunkmill.llm import lm_ppm, quality, toxicity
from chunkmill.llm.segments import raw_buffer

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def folded(text):
    return (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def in_bucket(k, buckets, held):
    return k is not None and zlib.crc32(str(k).encode()) % buckets == held


def plain_ppm(train, texts, order, resolution):
    """Partial matching with dictionaries, one symbol at a time."""
    counts = [Counter() for _ in range(order + 1)]
    for t in train:
        line = [0] * order + [b + 1 for b in folded(t)] + [257]
        for i in range(order, len(line)):
            for k in range(order + 1):
                counts[k][tuple(line[i - k : i + 1])] += 1
    n = sum(counts[0].values())
    kept = [{g: c for g, c in level.items() if c * resolution > n} for level in counts]
    totals, sets = [Counter() for _ in counts], [{} for _ in counts]
    for k, level in enumerate(counts):
        for g, c in level.items():
            totals[k][g[:-1]] += c
        for g in kept[k]:
            sets[k].setdefault(g[:-1], set()).add(g[-1])
    out = []
    for t in texts:
        line, total = [0] * order + [b + 1 for b in folded(t)] + [257], 0.0
        for i in range(order, len(line)):
            out_of: set = set()
            for k in range(order, -1, -1):
                context = tuple(line[i - k : i])
                own = sets[k].get(context)
                if not own:
                    continue
                base = totals[k][context] - sum(kept[k][(*context, s)] for s in out_of) + len(own - out_of)
                if line[i] in own:
                    total += math.log10(kept[k][(*context, line[i])] / base)
                    break
                over = base - sum(kept[k][(*context, s)] for s in own - out_of)
                total += math.log10(over / base) if over else 0.0
                out_of = own
            else:
                total -= math.log10(257 - len(out_of))
        out.append(total)
    return out


@pytest.mark.parametrize("resolution", [1 << 21, 500])
def test_scores_against_brute_force(small, edge, empty, resolution):
    for df in (small.limit(40), edge.where("length(text) < 1000 or text is null")):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        train = [t for k, t in rows if not in_bucket(k, 7, 2)]
        c = Counter(w for t in train for w in WORD.findall(folded(t)))
        n, v = sum(c.values()) + len(train), len(c) + 1
        ppm = plain_ppm(train, [t for _, t in rows], lm_ppm.ORDER, resolution)
        want = []
        for (k, t), s in zip(rows, ppm, strict=True):
            own = WORD.findall(folded(t))
            base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own) + math.log10((len(train) + 1) / (n + v + 1))
            want.append((k, in_bucket(k, 7, 2), len(own) + 1, sum(c[w] > 0 for w in own) + 1, n, base, s))
        got = [tuple(r) for r in lm_ppm.score(df, resolution=resolution).collect()]
        by = lambda r: (str(r[0]), r[2], r[5])
        for a, b in zip(sorted(got, key=by), sorted(want, key=by), strict=True):
            assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])
    assert lm_ppm.score(empty).count() == 0


@pytest.mark.parametrize("head", [1, 2000, lm_ppm.HEAD])
def test_every_count_is_kept(small, edge, head):
    for df in (small.limit(25), edge.where("length(text) < 1000 or text is null")):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        want = plain_ppm([t for k, t in rows if not in_bucket(k, 7, 2)], [t for _, t in rows], lm_ppm.ORDER, 10**12)
        got = [(r.doc_id, r.score) for r in lm_ppm.score(df, head=head).collect()]
        by = lambda r: (str(r[0]), r[1])
        for a, b in zip(sorted(got, key=by), sorted(zip((k for k, _ in rows), want, strict=True), key=by), strict=True):
            assert a[0] == b[0] and a[1] == pytest.approx(b[1])


def test_a_count_of_one_among_millions_is_kept(spark):
    held, *train = sorted(range(40), key=lambda i: not in_bucket(i, 7, 2))
    train = [i for i in train if not in_bucket(i, 7, 2)]
    df = spark.createDataFrame([(train[0], "ab" * 2_200_000), (train[1], "qzj"), (held, "qzj")], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in lm_ppm.score(df).collect()}
    # one of two first symbols, and then contexts that were seen once
    assert got[train[1]] == got[held] == pytest.approx(math.log10(1 / 4) + 3 * math.log10(1 / 2))


@pytest.mark.parametrize(("order", "resolution"), [(0, 100), (2, 1000), (3, 7), (5, 12), (2, 4)])
def test_probabilities_sum_to_one(order, resolution):
    codes, _ = lm_ppm.grams(*raw_buffer(pa.array(["abab ac", "aab", "", None, "bb"])), order)
    entries, totals = [], []
    for k in range(order + 1):
        key, n = np.unique(codes & lm_ppm._mask(k), return_counts=True)
        context, owner = np.unique(key >> 9, return_inverse=True)
        keep = n * resolution > len(codes)
        held = np.bincount(owner, keep) > 0
        entries.append((key[keep], n[keep]))
        totals.append((context[held], np.bincount(owner, n)[held]))
    trie = lm_ppm.Trie(entries, totals)
    for history in ([0] * order, [98] * order, [98, 99, 98, 99, 101][:order], [200] * order):
        h = 0
        for s in history:
            h = h << 9 | s
        assert (10 ** trie.log10(np.array([h << 9 | s for s in range(1, 258)]))).sum() == pytest.approx(1)


def accuracy(spark, scored, label, positive):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", label)
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 300
    hit = sum(r.predicted == r[label] for r in rows) / len(rows)
    of = [r for r in rows if r[label] == positive]
    return hit, sum(r.predicted == positive for r in of) / len(of)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    hit, found = accuracy(spark, toxicity.score(docs, labels), "toxic", 1)
    assert hit > 0.96 and found > 0.8


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    hit, found = accuracy(spark, quality.score(docs, labels, threshold=0.3), "quality", 0)
    assert hit > 0.93 and found > 0.7


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_edge_rows(edge, empty, some_labels, module, label):
    for labels in (some_labels, some_labels.limit(0)):
        got = module.score(edge, labels, label=label).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in edge.collect())
        for r in got:
            assert 0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out == in_bucket(r.doc_id, 5, 0)
    assert module.score(empty, some_labels, label=label).count() == 0


def test_held_out_labels_are_not_used(small, spark):
    ids = [r.doc_id for r in small.collect()]
    one = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id bigint, toxic int")
    other = spark.createDataFrame([(i, 1 - i % 2 if in_bucket(i, 5, 0) else i % 2) for i in ids], "doc_id bigint, toxic int")
    a, b = (sorted(toxicity.score(small, x).collect()) for x in (one, other))
    assert a == b


def plain_ngrams(text):
    """Buckets of a text's n-grams, byte by byte."""
    line = b" " + bytes(b + 32 if 65 <= b < 91 else 32 if b < 128 and not chr(b).isalnum() else b for b in (text or "").encode()) + b" "
    out = set()
    for n in toxicity.ORDERS:
        for i in range(len(line) - n + 1):
            code = n
            for b in line[i : i + n]:
                code = (code << 8 | b) & (1 << 64) - 1
            out.add((code * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 44)
    return out


def test_toxicity_by_hand(spark, small):
    rows = [(r.doc_id, r.text[:400] if r.text else r.text, int("a" in (r.text or "")[:20]) ^ r.doc_id % 7 // 6) for r in small.limit(60).collect()] + [(900, None, 0), (901, "", 1), (902, "x", 1)]
    sample = spark.createDataFrame([(t or "", y) for _, t, y in rows], "text string, label int").repartition(3)
    model = toxicity.fit(sample, features=300)
    seen = [(plain_ngrams(t), y) for _, t, y in rows]
    count = [Counter(), Counter()]
    for features, y in seen:
        count[y].update(features)
    size = [sum(y == c for _, _, y in rows) for c in (0, 1)]
    every = sorted(count[0].keys() | count[1].keys())
    totals = [sum(c.values()) for c in count]
    ratio = {f: math.log((count[1][f] + 1) / (totals[1] + len(every))) - math.log((count[0][f] + 1) / (totals[0] + len(every))) for f in every}

    def chi(f):
        both, n = count[0][f] + count[1][f], sum(size)
        return (count[1][f] - both * size[1] / n) ** 2 * n**2 / max(size[0] * size[1] * both * max(n - both, 1), 1)

    kept = np.flatnonzero(model.chosen >= 0)
    least = sorted(map(chi, every), reverse=True)[:300][-1]
    assert len(kept) == 300 and all(chi(f) >= least - 1e-9 for f in kept.tolist())
    # each text's score from its features, and no slope left at the weights of the scaled features
    weight = {f: model.weight[model.chosen[f]] for f in kept.tolist()}
    slope, slip = Counter(), 0.0
    for (_, t, y), (features, _) in zip(rows, seen, strict=True):
        p = 1 / (1 + math.exp(-(model.bias + sum(weight[f] for f in features if f in weight))))
        assert model.scores(pa.array([t]))[0] == pytest.approx(p)
        slip += p - y
        for f in features & weight.keys():
            slope[f] += ratio[f] * (p - y) / len(rows)
    worst = max(abs(slope[f] + 1e-4 * weight[f] / ratio[f]) for f in weight if abs(ratio[f]) > 1e-9)
    assert worst < 2e-3 and abs(slip) / len(rows) < 2e-3


def plain_statistics(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    chars, count = max(len(t), 1), max(len(w), 1)
    share = lambda some: sum(c in some for c in t) / chars
    return {
        "s_chars": len(t), "s_words": len(w), "s_upper": share(quality._UPPER), "s_digits": share(quality._DIGITS), "s_marks": share(quality._MARKS), "s_stops": share(quality._STOPS), "s_lines": share("\n"),
        "s_word_length": len(t) / count, "s_distinct": len(set(w)) / count, "s_repeats": sum(a == b for a, b in zip(w, w[1:], strict=False)) / count,
    }


def test_quality_by_hand(spark, small, edge):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality._fitted(small, labels, "quality", 5, 0, 20_000, "doc_id", "text")
    assert 3 < len(model.rules) < 400 and all(r.tests for r in model.rules)
    for df in (small, edge):
        measured, names = quality.with_statistics(df.select("doc_id", "text"))
        for r in measured.withColumn("out", model.column()).collect():
            own = plain_statistics(r.text)
            assert all(r[n] == pytest.approx(own[n]) for n in names)
            margin = model.bias
            for rule, w in zip(model.rules, model.weights, strict=True):
                margin += w * all((r[n] > cut) == above for n, cut, above in rule.tests)
            assert r.out == pytest.approx(1 / (1 + math.exp(-margin)))


def test_rules_are_paths_of_trees_and_lasso_leaves_few():
    rng = np.random.default_rng(1)
    table = {f"x{i}": rng.random(800) for i in range(6)}
    label = ((table["x1"] > 0.6) & (table["x4"] < 0.5)).astype(float)
    model = quality.fit(table, label)
    rules = quality.extract_rules(table, list(table), label)
    assert 0 < len(model.rules) < len(rules) and all(1 <= len(r.tests) <= 3 for r in rules)
    margin = model.bias + sum(w * r.holds(table) for r, w in zip(model.rules, model.weights, strict=True))
    assert ((margin > 0) == (label > 0)).mean() > 0.97
    # a rule that is left out has no slope beyond the penalty
    miss = 1 / (1 + np.exp(-margin)) - label
    left = [r for r in rules if r not in model.rules]
    assert max(abs((r.holds(table) * miss).mean()) for r in left) < 5e-4 * 1.5

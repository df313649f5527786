"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of its bytes (A-Z in lower case, ASCII punctuation and
white space as spaces), hashed into ``BUCKETS``. From labelled texts, each feature gets its naive
Bayes log-count ratio r = log(P(feature | toxic) / P(feature | clean)), add-one smoothed; the
features that tell the classes apart best (chi-square) are kept, and a logistic model with an L2
penalty is trained on the features scaled by r. Scoring looks each n-gram of a text up in one table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import raw_buffer, slices
from .shared import crc32_bucket, stored

ORDERS = (4, 6, 8)
BUCKETS = 1 << 20
#: Features that the linear model keeps.
FEATURES = 2000
#: Labelled rows that a model is fitted on at most (those of smallest hashed id).
FIT_ROWS = 20_000

_MAP = np.arange(256, dtype=np.uint8)
_MAP[65:91] += 32
_MAP[[b for b in range(128) if not chr(b).isalnum()]] = 32


def feature_codes(data: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram that begins at each byte of a batch of texts, and where each text's begin.
    A space is read before and after each text, so that its first and last words end as others do."""
    docs = len(starts) - 1
    lengths = np.diff(starts)
    begins = starts[:-1] + 2 * np.arange(docs)
    line = np.full(len(data) + 2 * docs, 32, np.uint8)
    line[np.arange(len(data)) + np.repeat(begins - starts[:-1] + 1, lengths)] = _MAP[data]
    code = np.full(len(line), n, np.uint64)
    wide = np.zeros(len(line) + n, np.uint64)
    wide[: len(line)] = line
    for j in range(n):
        code = (code << np.uint64(8)) | wide[j : j + len(line)]
    code = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
    # n-grams that reach into the next text are no features
    ends = begins + lengths + 2
    for back in range(1, n):
        at = ends - back
        code[at[at >= begins]] = -1
    return code, begins


def text_features(texts: pa.Array, chosen: np.ndarray | None = None, orders=ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every distinct feature of every text, in order. ``chosen`` maps
    each bucket to a feature number, -1 for buckets that are not kept."""
    data, starts = raw_buffer(texts)
    found = []
    for n in orders:
        code, begins = feature_codes(data, starts, n)
        feature = np.where(code >= 0, code, -1) if chosen is None else np.where(code >= 0, chosen[code], -1)
        at = np.flatnonzero(feature >= 0)
        text = np.searchsorted(begins, at, side="right") - 1
        found.append(np.unique(text * BUCKETS + feature[at]))
    pairs = np.unique(np.concatenate(found))
    return pairs // BUCKETS, pairs % BUCKETS


@dataclass
class NaiveBayesLinear:
    """``chosen``: bucket to feature number or -1; ``weight``: per feature, its ratio included."""

    chosen: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        text, feature = text_features(texts, self.chosen)
        margin = np.bincount(text, self.weight[feature], len(texts)) + self.bias if len(texts) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _logistic(row: np.ndarray, feature: np.ndarray, value: np.ndarray, label: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-penalised logistic model over sparse rows, by Nesterov's method."""
    n, m = len(label), len(value)
    x = value[feature]
    lead = np.ones(m)
    for _ in range(10):  # largest curvature, by power iteration
        lead = np.bincount(feature, x * np.bincount(row, x * lead[feature], n)[row], m)
        lead /= max(np.linalg.norm(lead), 1e-12)
    bound = 0.25 * (np.linalg.norm(np.bincount(row, x * lead[feature], n)) ** 2 / n + 1) / 4 + penalty
    w, b = np.zeros(m), float(np.log((label.sum() + 1) / (n - label.sum() + 1)))
    v, vb, t, last = w.copy(), b, 1.0, np.inf
    for _ in range(rounds):
        margin = np.bincount(row, x * v[feature], n) + vb
        miss = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - label
        loss = float(np.mean(np.logaddexp(0, margin) - label * margin) + penalty / 2 * v @ v)
        if loss > last:  # overshot: smaller steps, no momentum
            bound, t, v, vb, last = bound * 2, 1.0, w.copy(), b, np.inf
            continue
        last = loss
        w2 = v - (np.bincount(feature, x * miss[row], m) / n + penalty * v) / bound
        b2 = vb - miss.mean() / bound
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w * value, b


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, buckets: int, held: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """``key``, ``text``, ``label`` of at most ``rows`` labelled texts that are not held out, those of
    smallest hashed id. Ids with more than one label, or a null one, are not used."""
    usable = labels.select(labels[id_col].alias("key"), labels[label].cast("int").alias("label")).where("key is not null").groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("most"), F.count(F.lit(1)).alias("n"), F.count("label").alias("known"))
    usable = usable.where((F.col("label") == F.col("most")) & (F.col("n") == F.col("known")) & (crc32_bucket(F.col("key"), buckets) != held))
    chosen = stored(usable.select("key", "label").orderBy(F.xxhash64("key"), "key").limit(rows), "labelled-ids")
    texts = docs.select(docs[id_col].alias("key"), docs[text_col].alias("text"))
    # ``rows`` rows of 12 bytes
    return texts.join(F.broadcast(chosen), "key").select("key", F.coalesce("text", F.lit("")).alias("text"), "label")


def fit(sample: DataFrame, features: int = FEATURES, penalty: float = 1e-4) -> NaiveBayesLinear:
    """Fit on ``text`` and ``label``. The driver gets one count a bucket and class, then the kept
    features of each sampled text. With one class only, every text gets that class's rate."""

    def count(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        size = np.zeros(2, np.int64)
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                label = part.column("label").to_numpy()
                text, feature = text_features(part.column("text"))
                for c in (0, 1):
                    total[c] += np.bincount(feature[label[text] == c], minlength=BUCKETS)
                    size[c] += int((label == c).sum())
        at = np.flatnonzero(total.sum(axis=0) >= 1)
        made = pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[0, at], size[0])), pa.array(np.append(total[1, at], size[1]))], ["feature", "clean", "toxic"])
        yield from (made.slice(i, 1 << 15) for i in range(0, made.num_rows, 1 << 15))

    counts = sample.select("text", "label").mapInArrow(count, "feature bigint, clean bigint, toxic bigint").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    at, clean, toxic = (counts.column(i).to_numpy().astype(np.float64) for i in range(3))
    size = at < 0
    n0, n1 = clean[size].sum(), toxic[size].sum()
    at, clean, toxic = at[~size].astype(np.int64), clean[~size], toxic[~size]
    chosen = np.full(BUCKETS, -1, np.int32)
    if not n0 or not n1:
        return NaiveBayesLinear(chosen, np.zeros(1), float(np.log((n1 + 1) / (n0 + 1))))
    ratio = np.log((toxic + 1) / (toxic.sum() + len(at))) - np.log((clean + 1) / (clean.sum() + len(at)))
    expect = (clean + toxic) * n1 / (n0 + n1)
    rest = np.maximum(n0 + n1 - clean - toxic, 1)
    chi = (toxic - expect) ** 2 * (n0 + n1) ** 2 / np.maximum(n0 * n1 * (clean + toxic) * rest, 1)
    keep = np.argsort(-chi, kind="stable")[:features]
    chosen[at[keep]] = np.arange(len(keep))

    def vectors(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                text, feature = text_features(part.column("text"), chosen)
                edges = np.searchsorted(text, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(feature.astype(np.int32)))], ["label", "features"])

    rows = sample.select("text", "label").mapInArrow(vectors, "label int, features array<int>").toArrow()
    label = rows.column("label").to_numpy().astype(np.float64)
    lists = rows.column("features").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    row = np.repeat(np.arange(len(label)), pa.compute.list_value_length(lists).to_numpy())
    weight, bias = _logistic(row, lists.flatten().to_numpy(), ratio[keep], label, penalty)
    return NaiveBayesLinear(chosen, weight, bias)


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", buckets: int = 5, held: int = 0, fit_rows: int = FIT_ROWS, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text; only labels of ids whose crc32 bucket is not ``held`` are learnt from.

    Returns for each input row (repeated rows stay): ``id_col``, ``held_out`` boolean (false for a
    null id), ``score`` double in 0..1, ``predicted`` int (1 if ``score >= threshold``). Null text
    counts as empty and is scored by what a text without features gets. Without labels all scores
    are 0.5.
    """
    sample = stored(labelled_sample(docs, labels, label, buckets, held, fit_rows, id_col, text_col), "labelled-texts")
    model = fit(sample)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("held_out"), pa.array(sent.value.scores(part.column("text")), pa.float64())], ["key", "held_out", "score"])

    rows = docs.select(docs[id_col].alias("key"), docs[text_col].alias("text"), F.coalesce(crc32_bucket(docs[id_col], buckets) == held, F.lit(False)).alias("held_out"))
    scored = rows.mapInArrow(work, f"key {kind}, held_out boolean, score double")
    return scored.select(F.col("key").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, label: str = "toxic", buckets: int = 5, held: int = 0, fit_rows: int = FIT_ROWS, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns of any name, whose text scores below ``threshold``; filtered
    where they are read. Null text is scored as empty; rows without an id, repeated rows and ties are judged
    each for itself; an empty table stays empty."""
    model = fit(stored(labelled_sample(docs, labels, label, buckets, held, fit_rows, id_col, text_col), "labelled-texts"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            for part in slices(batch, text_col, 1 << 19):
                yield part.filter(pa.array(sent.value.scores(part.column(text_col)) < threshold))

    return docs.mapInArrow(work, docs.schema)

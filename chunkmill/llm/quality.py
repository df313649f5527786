"""Quality: a sparse ensemble of rules over text statistics, compiled into column expressions.

Statistics of a text are Spark columns. On labelled texts, small regression trees are boosted; the
path to every node is a conjunction of thresholds, a *rule*. A logistic model with a lasso penalty
over all rules keeps few of them. The kept rules become one Spark column expression, so scoring the
corpus is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import crc32_bucket, words
from .toxicity import FIT_ROWS, labelled_sample

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DIGITS = "0123456789"
_MARKS = "!#$%&*+/<=>@[]^_{|}~\\"
_STOPS = ".,;:?'\"()-"


def with_statistics(texts: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """``texts`` with the statistics of a column, and their names. All are 0 for an empty text."""

    def without(chars: str) -> Column:
        return F.length(F.translate(F.col("_t"), chars, ""))

    out = texts.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_w", words(F.col("_t")))
    out = out.withColumns({"s_chars": F.length("_t").cast("double"), "s_words": F.size("_w").cast("double"), "_distinct": F.size(F.array_distinct("_w")), "_same": F.size(F.filter(F.arrays_zip(F.slice(F.col("_w"), 2, F.greatest(F.size("_w") - 1, F.lit(0))).alias("a"), F.slice(F.col("_w"), 1, F.greatest(F.size("_w") - 1, F.lit(0))).alias("b")), lambda p: p["a"] == p["b"]))})
    chars, count = F.greatest("s_chars", F.lit(1.0)), F.greatest("s_words", F.lit(1.0))
    out = out.withColumns(
        {
            "s_upper": (F.col("s_chars") - without(_UPPER)) / chars,
            "s_digits": (F.col("s_chars") - without(_DIGITS)) / chars,
            "s_marks": (F.col("s_chars") - without(_MARKS)) / chars,
            "s_stops": (F.col("s_chars") - without(_STOPS)) / chars,
            "s_lines": (F.col("s_chars") - without("\n")) / chars,
            "s_word_length": F.col("s_chars") / count,
            "s_distinct": F.col("_distinct") / count,
            "s_repeats": F.col("_same") / count,
        }
    )
    names = ["s_chars", "s_words", "s_upper", "s_digits", "s_marks", "s_stops", "s_lines", "s_word_length", "s_distinct", "s_repeats"]
    return out.drop("_t", "_w", "_distinct", "_same"), names


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, threshold, above): the statistic is above the threshold, or not."""

    tests: tuple[tuple[str, float, bool], ...]

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        out = None
        for name, cut, above in self.tests:
            test = table[name] > cut if above else table[name] <= cut
            out = test if out is None else out & test
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, cut, above in self.tests:
            out = out & (F.col(name) > F.lit(cut) if above else F.col(name) <= F.lit(cut))
        return out


def _tree(table: dict[str, np.ndarray], names: list[str], target: np.ndarray, rows: np.ndarray, depth: int, tests: tuple, rules: list, least: int) -> np.ndarray:
    """Grow a regression tree on ``rows``; adds the path to every node below the root to ``rules``;
    returns the fitted values of ``rows``."""
    mean = target[rows].mean()
    out = np.full(len(rows), mean)
    if depth == 0 or len(rows) < 2 * least:
        return out
    best = (1e-9, None, None, None)
    for name in names:
        x = table[name][rows]
        cuts = np.unique(np.quantile(x, np.linspace(0.02, 0.98, 33)))
        which = np.searchsorted(cuts, x)  # x > cuts[i] from i + 1 on
        n = np.cumsum(np.bincount(which, minlength=len(cuts) + 1))[:-1]
        s = np.cumsum(np.bincount(which, target[rows], len(cuts) + 1))[:-1]
        total, size = target[rows].sum(), len(rows)
        fine = (n >= least) & (size - n >= least)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fine, s * s / n + (total - s) ** 2 / (size - n) - total * total / size, -1)
        i = int(np.argmax(gain)) if len(gain) else 0
        if len(gain) and gain[i] > best[0]:
            best = (float(gain[i]), name, float(cuts[i]), x > cuts[i])
    if best[1] is None:
        return out
    _, name, cut, above = best
    for side, mask in ((True, above), (False, ~above)):
        path = (*tests, (name, cut, side))
        rules.append(Rule(path))
        out[mask] = _tree(table, names, target, rows[mask], depth - 1, path, rules, least)
    return out


def extract_rules(table: dict[str, np.ndarray], names: list[str], label: np.ndarray, trees: int = 40, depth: int = 3, seed: int = 5) -> list[Rule]:
    """Distinct rules of boosted trees, each grown on half of the rows and half of the statistics."""
    rng, rules = np.random.default_rng(seed), []
    n = len(label)
    margin = np.zeros(n)
    for _ in range(trees):
        left = label - 1 / (1 + np.exp(-margin))
        rows = np.sort(rng.choice(n, max(n // 2, min(n, 50)), replace=False))
        own = [names[i] for i in sorted(rng.choice(len(names), max(3, len(names) // 2), replace=False))]
        made: list[Rule] = []
        _tree(table, own, left, rows, depth, (), made, max(5, n // 1000))
        rules += made
        # the tree's step, from the rules of its leaves
        inner = {r.tests[:-1] for r in made}
        for r in made:
            if r.tests not in inner:
                held = r.holds(table)
                if held.any():
                    margin[held] += 1.0 * left[held].mean() / max(1e-3, (0.25 - (left[held].mean() ** 2) / 4))
        margin = np.clip(margin, -6, 6)
    return list(dict.fromkeys(rules))


def lasso(x: np.ndarray, label: np.ndarray, penalty: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Lasso logistic weights (and a free bias) by accelerated proximal gradient steps."""
    n, m = x.shape
    norm = np.ones(m)
    for _ in range(12):  # largest curvature, by power iteration
        norm = x.T @ (x @ norm)
        norm /= max(np.linalg.norm(norm), 1e-12)
    bound = 0.25 * (np.linalg.norm(x @ norm) ** 2 / n + 1) * 1.05
    w, b = np.zeros(m), float(np.log((label.sum() + 1) / (n - label.sum() + 1)))
    v, vb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        miss = 1 / (1 + np.exp(-(x @ v + vb))) - label
        w2 = v - (x.T @ miss) / n / bound
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - penalty / bound, 0)
        b2 = vb - miss.mean() / bound
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


@dataclass
class RuleEnsemble:
    rules: list[Rule]
    weights: list[float]
    bias: float

    def column(self) -> Column:
        """Score in 0..1 as an expression over the statistics."""
        margin = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            margin = margin + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def fit(table: dict[str, np.ndarray], label: np.ndarray, penalty: float = 5e-4) -> RuleEnsemble:
    """Rules and lasso weights from statistics and 0/1 labels. With no row the score is 0.5; with one
    class only, the smoothed rate of that class."""
    names = list(table)
    n = len(label)
    if n < 20 or label.min() == label.max():
        return RuleEnsemble([], [], float(np.log((label.sum() + 1) / (n - label.sum() + 1))))
    rules = extract_rules(table, names, label)
    x = np.stack([r.holds(table) for r in rules], axis=1).astype(np.float64)
    w, b = lasso(x, label, penalty)
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleEnsemble([rules[i] for i in keep], [float(w[i]) for i in keep], b)


def _fitted(docs: DataFrame, labels: DataFrame, label: str, buckets: int, held: int, fit_rows: int, id_col: str, text_col: str) -> RuleEnsemble:
    sample, names = with_statistics(labelled_sample(docs, labels, label, buckets, held, fit_rows, id_col, text_col))
    rows = sample.select("label", *names).toArrow()
    table = {n: rows.column(n).to_numpy() for n in names}
    return fit(table, rows.column("label").to_numpy().astype(np.float64))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", buckets: int = 5, held: int = 0, fit_rows: int = FIT_ROWS, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text; only labels of ids whose crc32 bucket is not ``held`` are learnt from.

    Returns for each input row (repeated rows stay): ``id_col``, ``held_out`` boolean (false for a
    null id), ``score`` double in 0..1, ``predicted`` int (1 if ``score >= threshold``). Null text
    counts as empty. Without labels all scores are 0.5. The driver gets ten numbers of each of at
    most ``fit_rows`` labelled texts.
    """
    model = _fitted(docs, labels, label, buckets, held, fit_rows, id_col, text_col)
    texts = docs.select(docs[id_col].alias("key"), docs[text_col].alias("text"), F.coalesce(crc32_bucket(docs[id_col], buckets) == held, F.lit(False)).alias("held_out"))
    measured, _ = with_statistics(texts)
    scored = measured.withColumn("score", model.column())
    return scored.select(F.col("key").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", buckets: int = 5, held: int = 0, fit_rows: int = FIT_ROWS, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns of any name, whose text scores ``threshold`` or more; filtered
    where they are read. Null and empty texts are scored as texts without words; rows without an id, repeated
    rows and ties are judged each for itself; an empty table stays empty."""
    model = _fitted(docs, labels, label, buckets, held, fit_rows, id_col, text_col)
    held_columns = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[text_col].alias("text"))
    measured, _ = with_statistics(held_columns)
    return measured.where(model.column() >= threshold).select("row.*")

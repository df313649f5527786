"""Language-model scoring: prediction by partial matching over bytes, beside a unigram base.

Training counts every byte with its ``ORDER`` preceding ones; counts of shorter contexts are sums
of these, so one shuffle of counts gives the whole context trie. Every counted entry (context, next
symbol) is kept, in stored tables of contexts. Longest entries that make up more than 1 / HEAD of all
training symbols are broadcast with their code lengths (HEAD at most, at any corpus size); the others
that a text has are joined to the stored tables, so the broadcast changes no result.

A symbol is coded in the longest kept context of its history. If it is not kept there, an escape
is coded, the symbols of that context are excluded, and the next shorter context is tried; after
the empty one, the symbols left are equally likely. Symbols are the bytes of the text (A-Z in
lower case) and one end, so probabilities of all texts sum to one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .segments import raw_buffer, slices
from .shared import crc32_bucket, stored

#: Bytes of the longest context; an entry or word that is broadcast has more than 1 / HEAD of the count.
ORDER = 5
HEAD = 1 << 22
#: Unseen entries that one task gives code lengths to at once.
_UNSEEN = 8_000
#: Symbols are byte + 1; 0 stands before a text, _END after it. Nine bits hold one.
_BITS, _END, _SYMBOLS = 9, 257, 257
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mask(order: int) -> int:
    return (1 << (_BITS * (order + 1))) - 1


def grams(data: np.ndarray, starts: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For every symbol of every text (its end too), the symbol with its ``order`` preceding ones
    as one integer, the symbol in the lowest bits; and where each text begins among them."""
    docs, n = len(starts) - 1, len(data)
    lengths = np.diff(starts)
    # each text: ``order`` blanks, its bytes, the end
    begins = starts[:-1] + np.arange(docs) * (order + 1)
    line = np.zeros(n + docs * (order + 1), np.int64)
    line[np.arange(n) + np.repeat(begins - starts[:-1] + order, lengths)] = _FOLD[data].astype(np.int64) + 1
    line[begins + order + lengths] = _END
    code = line.copy()
    for back in range(1, order + 1):
        code[back:] |= line[:-back] << (_BITS * back)
    real = np.ones(len(line), bool)
    for j in range(order):
        real[begins + j] = False
    return code[real], starts[:-1] + np.arange(docs)


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a batch, the word of each token as an index, and where each text's tokens begin."""
    solid = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[0:-1] = solid
    cut[1:-1] &= ~solid[:-1]
    inner = starts[:-1][starts[:-1] < len(data)]
    cut[inner] |= solid[inner]
    at = np.flatnonzero(cut)
    bounds = np.append(np.searchsorted(at, starts[:-1]), len(at))
    packed = _FOLD[data[solid]]
    places = np.concatenate([[0], np.cumsum(solid)])
    offsets = np.append(places[at], len(packed)).astype(np.int64)
    # as the white space is gone, a word ends where the next begins
    parts = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
    return parts.dictionary, parts.indices.to_numpy(zero_copy_only=False), bounds


class Trie:
    """The kept part of the context trie, with code lengths in log10 units."""

    def __init__(self, entries: list[tuple[np.ndarray, np.ndarray]], totals: list[tuple[np.ndarray, np.ndarray]]):
        """Per order: (keys context << 9 | symbol sorted, counts) and (contexts sorted, all their counts)."""
        self.keys = [k for k, _ in entries]
        self.count = [n.astype(np.float64) for _, n in entries]
        self.contexts = [c for c, _ in totals]
        self.direct, self.escape, self.den_after, self.escape_after = [], [], [], []
        kept, distinct, all_of = [], [], []
        for order, (keys, n) in enumerate(zip(self.keys, self.count, strict=True)):
            owner = np.searchsorted(self.contexts[order], keys >> _BITS)
            size = len(self.contexts[order])
            kept.append(np.bincount(owner, n, size))
            distinct.append(np.bincount(owner, minlength=size).astype(np.float64))
            all_of.append(totals[order][1].astype(np.float64))
            base = all_of[order] + distinct[order]
            self.direct.append(np.log10(n / base[owner]))
            self.escape.append(np.log10(all_of[order] - kept[order] + distinct[order]) - np.log10(base))
            if order:
                shorter = self.contexts[order] & (_mask(order - 1) >> _BITS)
                parent = np.searchsorted(self.contexts[order - 1], shorter)
                excluded = np.bincount(owner, self.count[order - 1][np.searchsorted(self.keys[order - 1], keys & _mask(order - 1))], size)
                left = distinct[order - 1][parent] - distinct[order]
                den = all_of[order - 1][parent] - excluded + left
                over = all_of[order - 1][parent] - kept[order - 1][parent] + left
                with np.errstate(divide="ignore", invalid="ignore"):
                    self.den_after.append(np.log10(den))
                    self.escape_after.append(np.where(over > 0, np.log10(over) - np.log10(den), 0.0))
            else:
                self.den_after.append(None)
                self.escape_after.append(None)
        self.rest = _SYMBOLS - (distinct[0][0] if len(distinct[0]) else 0)

    @staticmethod
    def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Places of ``wanted`` among ``sorted_keys``, -1 where missing."""
        if not len(sorted_keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
        return np.where(sorted_keys[at] == wanted, at, -1)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the symbol of each code after the history of that code."""
        out = np.zeros(len(codes))
        todo = np.ones(len(codes), bool)
        child = np.full(len(codes), -1)  # context of the order above, if one was kept
        for order in range(len(self.keys) - 1, -1, -1):
            at = np.flatnonzero(todo)
            if not len(at):
                return out
            key = codes[at] & _mask(order)
            place = self._find(self.contexts[order], key >> _BITS)
            entry = self._find(self.keys[order], key)
            above, has = child[at], place >= 0
            hit = has & (entry >= 0)
            fresh = above < 0
            first = hit & fresh
            out[at[first]] += self.direct[order][entry[first]]
            later = hit & ~fresh
            if later.any():
                out[at[later]] += np.log10(self.count[order][entry[later]]) - self.den_after[order + 1][above[later]]
            miss = has & ~hit
            out[at[miss & fresh]] += self.escape[order][place[miss & fresh]]
            if (miss & ~fresh).any():
                out[at[miss & ~fresh]] += self.escape_after[order + 1][above[miss & ~fresh]]
            todo[at[hit]] = False
            child[at] = place
        if todo.any():
            out[todo] -= np.log10(max(self.rest, 1))
        return out


def _per_text(text: np.ndarray, code: np.ndarray, texts: int, codes: int, named, name: str) -> pa.ListArray:
    """For each text, its distinct codes by name with their number, from the text and code of each token."""
    pair, n = np.unique(text * codes + code, return_counts=True)
    edges = np.searchsorted(pair, np.arange(texts + 1) * codes)
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.StructArray.from_arrays([named(pair % codes), pa.array(n.astype(np.int64))], [name, "n"]))


def _count(train: DataFrame, order: int) -> DataFrame:
    """``gram`` or ``word``, and ``n``: how often it stands in the training texts."""

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, starts = raw_buffer(part.column("text"))
                gram, n = np.unique(grams(data, starts, order)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.nulls(len(gram), pa.binary()), pa.array(n)], ["gram", "word", "n"])
                names, codes, _ = words_of(data, starts)
                n = np.bincount(codes, minlength=len(names))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(names), pa.int64()), names.cast(pa.binary()), pa.array(n)], ["gram", "word", "n"])

    counted = train.select("text").mapInArrow(work, "gram bigint, word binary, n bigint")
    return counted.groupBy("gram", "word").agg(F.sum("n").alias("n"))


def _contexts(counts: DataFrame, symbols: int, order: int, resolution: int | None) -> DataFrame:
    """The context trie: ``level`` (bytes of the context), ``context``, ``total`` (all its counts) and
    ``kept``, an array of (key, n), for every context that has a kept entry."""
    spark = counts.sparkSession
    held = spark.createDataFrame([], "level int, context bigint, total bigint, kept array<struct<key:bigint,n:bigint>>")
    keep = F.lit(True) if resolution is None else F.col("n") * resolution > symbols
    for k in range(order + 1):
        level = counts.where("gram is not null").groupBy(F.col("gram").bitwiseAND(F.lit(_mask(k))).alias("key")).agg(F.sum("n").alias("n"))
        # a context has 257 symbols at most, so its group is small
        one = level.groupBy(F.shiftright("key", _BITS).alias("context")).agg(F.sum("n").alias("total"), F.filter(F.collect_list(F.when(keep, F.struct("key", "n"))), lambda x: x.isNotNull()).alias("kept"))
        held = held.unionByName(one.where(F.size("kept") > 0).withColumn("level", F.lit(k)))
    return stored(held, "lm-contexts")


def _unseen_lengths(unseen: DataFrame, contexts: DataFrame, order: int) -> DataFrame:
    """``gram`` and ``gain``, its log10 probability, of distinct grams that are not kept in full. Each
    bucket of grams meets the contexts of its grams, all orders of them, and no others."""
    buckets = max(1, -(-unseen.count() // _UNSEEN))
    grams_of = unseen.select("gram", F.pmod(F.xxhash64("gram"), F.lit(buckets)).alias("bucket"))
    levels = F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(F.col("gram").bitwiseAND(F.lit(_mask(k))), _BITS).alias("context")) for k in range(order + 1)))
    own = grams_of.select(F.col("bucket").alias("lot"), F.inline(levels)).distinct().join(contexts, ["level", "context"])

    def work(left, right):
        level = right.column("level").to_numpy()
        entries, totals = [], []
        for k in range(order + 1):
            rows = right.filter(pa.array(level == k)).sort_by("context").combine_chunks()
            totals.append((rows.column("context").to_numpy(), rows.column("total").to_numpy()))
            flat = pc.struct_field(pc.list_flatten(rows.column("kept")), "key").to_numpy(), pc.struct_field(pc.list_flatten(rows.column("kept")), "n").to_numpy()
            by = np.argsort(flat[0])
            entries.append((flat[0][by], flat[1][by]))
        gram = left.column("gram")
        return pa.table({"gram": gram, "gain": Trie(entries, totals).log10(gram.to_numpy())})

    return grams_of.groupBy("bucket").cogroup(own.groupBy("lot")).applyInArrow(work, "gram bigint, gain double")


def score(docs: DataFrame, buckets: int = 7, held: int = 2, order: int = ORDER, resolution: int | None = None, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text by a model of the texts whose crc32 bucket is not ``held``.

    Returns for each input row (repeated rows stay): ``id_col``, ``held_out`` boolean (a null id is
    trained on, so false), ``n_tokens`` long (words and one end), ``n_known`` long (tokens seen in
    training), ``train_tokens`` long, ``base_score`` double (unigram log10 probability with
    add-one smoothing over the training vocabulary and one unknown), ``score`` double (log10
    probability by partial matching). Null text counts as empty: one token, its end. With nothing
    to train on, all symbols are equally likely.

    ``resolution``: if given, entries of at most 1 / resolution of all symbols are left to the escape
    of their context. ``head``: what is broadcast; it changes no result.
    """
    spark: SparkSession = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("key"), docs[text_col].alias("text"), F.coalesce(crc32_bucket(docs[id_col], buckets) == held, F.lit(False)).alias("held_out"))
    train = rows.where("not held_out")
    counts = stored(_count(train, order), "lm-counts")
    sums = counts.agg(F.sum(F.when(F.col("gram").isNotNull(), F.col("n"))), F.sum(F.when(F.col("word").isNotNull(), F.col("n"))), F.count("word"), F.sum(F.when(F.col("gram").bitwiseAND(F.lit(_mask(0))) == _END, F.col("n")))).first()
    symbols, train_words, vocabulary, ends = (x or 0 for x in sums)
    train_tokens = train_words + ends
    vocabulary += 1 if ends else 0
    contexts = _contexts(counts, symbols, order, resolution)
    base = F.log10(F.col("total") + F.size("kept"))
    full = contexts.where(F.col("level") == order).select(base.alias("base"), F.inline("kept")).select(F.col("key").alias("gram"), "n", (F.log10("n") - F.col("base")).alias("gain"))
    # at most ``head`` entries and as many words
    top = full.where(F.col("n") * head > symbols).select("gram", "gain").sort("gram").toArrow()
    frequent = counts.where(F.col("word").isNotNull() & (F.col("n") * head > train_tokens)).select("word", "n").toArrow()
    end_gain = float(np.log10(ends + 1))
    sent = spark.sparkContext.broadcast((top.column("gram").to_numpy(), top.column("gain").to_numpy(), frequent.column("word").combine_chunks().cast(pa.large_binary()), np.log10(frequent.column("n").to_numpy() + 1.0)))

    def work(batches):
        keys, lengths, known, gain = sent.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, starts = raw_buffer(part.column("text"))
                code, begins = grams(data, starts, order)
                own, inverse = np.unique(code, return_inverse=True)
                at = Trie._find(keys, own)
                met = at >= 0
                own_gain = np.zeros(len(own))
                own_gain[met] = lengths[at[met]]
                total = np.add.reduceat(own_gain[inverse], begins) if len(begins) else np.zeros(0)
                away = np.flatnonzero(~met[inverse])
                text_at = np.searchsorted(begins, away, "right") - 1
                tail = _per_text(text_at, inverse[away], part.num_rows, max(len(own), 1), lambda i: pa.array(own[i]), "gram")
                names, codes, bounds = words_of(data, starts)
                place = pc.index_in(names, value_set=known).fill_null(-1).to_numpy() if len(names) else np.zeros(0, np.int64)
                n_docs = part.num_rows
                text_of = np.repeat(np.arange(n_docs), np.diff(bounds))
                spot = place[codes]
                common = spot >= 0
                settled = np.bincount(text_of[common], gain[spot[common]], n_docs) + end_gain
                n_known = np.bincount(text_of[common], minlength=n_docs) + (1 if ends else 0)
                rare = _per_text(text_of[~common], codes[~common], n_docs, max(len(names), 1), lambda i: names.take(pa.array(i)).cast(pa.binary()), "word")
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("held_out"), pa.array(np.diff(bounds) + 1), pa.array(n_known.astype(np.int64)), pa.array(settled), pa.array(total), rare, tail],
                    ["key", "held_out", "n_tokens", "n_known", "gain", "score", "rare", "tail"],
                )

    scored = rows.mapInArrow(work, f"key {kind}, held_out boolean, n_tokens bigint, n_known bigint, gain double, score double, rare array<struct<word:binary,n:bigint>>, tail array<struct<gram:bigint,n:bigint>>")
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    # the words and entries that are not broadcast: none that was trained on stands in more than 1 / head of the training texts
    rest = scored.select("row", F.inline("rare")).join(counts.where("word is not null").select("word", F.col("n").alias("c")), "word")
    pairs = scored.select("row", F.inline("tail"))
    # a training text has no unseen entry, unless entries were left out
    maybe = scored if resolution is not None else scored.where("held_out")
    unseen = stored(maybe.select(F.explode("tail.gram").alias("gram")).distinct().join(full, "gram", "left_anti"), "lm-unseen")
    priced = pairs.join(full.select("gram", "gain").unionByName(_unseen_lengths(unseen, contexts, order)), "gram")
    none = F.lit(0.0)
    parts = rest.select("row", "n", (F.col("n") * F.log10(F.col("c") + F.lit(1.0))).alias("more"), none.alias("tail_score"))
    parts = parts.unionByName(priced.select("row", F.lit(0).cast("bigint").alias("n"), none.alias("more"), (F.col("n") * F.col("gain")).alias("tail_score")))
    gained = parts.groupBy("row").agg(F.sum("n").alias("more_known"), F.sum("more").alias("more"), F.sum("tail_score").alias("tail_score"))
    zero = F.lit(0)
    base = F.col("gain") + F.coalesce("more", zero) - F.col("n_tokens") * F.lit(float(np.log10(train_tokens + vocabulary + 1)))
    return scored.drop("rare", "tail").join(gained, "row", "left").select(
        F.col("key").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(train_tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("tail_score", zero)).alias("score"),
    )

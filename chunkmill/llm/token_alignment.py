"""Alignment of the tokens of two tokenizers by a dangling-suffix transducer.

Both tokenizers cut the same bytes, so of two token sequences one always leads: it has read a *residual* of
bytes that the other has not. The transducer's state is that side and its residual; it reads the next token of
the side behind, which shortens the residual, or takes the lead with what it has more, or leaves nothing: then
both end at one byte and a group closes. States and transitions are few, and are memoised by (side and residual,
token). While it walks, each token that is read overlaps the token that leads: these are the links.

Texts are first cut where no token of either side can lie across: at the places where the first tokenizer's
pattern always begins a new piece (before white space, after a lone line feed, between an ASCII letter and
punctuation), if no piece of the second vocabulary holds the two characters side by side. Both sides end there,
so the alignment of a text is that of its distinct parts, one after another.

How often an id pair is linked is counted over the whole corpus by Spark. Pairs that most documents hold are
broadcast (at most HEAD of them, at any corpus size), the others of a document are joined.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .segments import borders, raw_buffer, slices
from .shared import discard, stored
from .vocab import GenerationCache, byte_alphabet

#: Id pairs that are broadcast at most (16 bytes each), and parts of a doubling in which counts are told apart.
HEAD, STEPS = 1 << 21, 8
#: Transitions that are kept before the table starts anew, and bytes of a part that is remembered.
TRANSITIONS, SHORT = 1_000_000, 64
_SPACE_PIECE = "▁"
_BYTE = re.compile("<0x([0-9A-F]{2})>").fullmatch


class Transducer:
    """Transitions between dangling suffixes. State 0: nothing dangles."""

    def __init__(self, first: list[bytes], second: list[bytes]):
        self.bytes = (first, second)
        self._clear()

    def _clear(self) -> None:
        self.states: dict[tuple[int, bytes], int] = {}
        self.held: list[tuple[int, bytes]] = [(1, b"")]  # the second side has nothing more than the first: the first is read
        self.next: list[dict[int, int]] = [{}]
        self.size = 0

    def _state(self, side: int, residual: bytes) -> int:
        if not residual:
            return 0
        at = self.states.setdefault((side, residual), len(self.held))
        if at == len(self.held):
            self.held.append((side, residual))
            self.next.append({})
        return at

    def _step(self, state: int, token: int) -> int:
        """The state after the next token of the side behind. -1: bytes differ."""
        side, residual = self.held[state]
        read = self.bytes[1 - side][token]
        if len(read) <= len(residual):
            made = self._state(side, residual[len(read) :]) if residual.startswith(read) else -1
        else:
            made = self._state(1 - side, read[len(residual) :]) if read.startswith(residual) else -1
        self.next[state][token] = made
        self.size += 1
        return made

    def align(self, a: list[int], b: list[int]) -> tuple[list[str], list[int]] | None:
        """Groups, as texts ``a1,a2|b1``, and links as ``first id << 32 | second id``; None if the bytes of both differ."""
        if self.size > TRANSITIONS:
            self._clear()
        known, held, at_a, at_b, end_a, end_b = self.next, self.held, 0, 0, len(a), len(b)
        groups, links, state, begun_a, begun_b = [], [], 0, 0, 0
        lead_a = lead_b = 0
        while at_a < end_a or at_b < end_b:
            if held[state][0]:  # the second side leads, or nothing dangles
                if at_a == end_a:
                    return None
                token = lead_a = a[at_a]
                at_a += 1
            else:
                if at_b == end_b:
                    return None
                token = lead_b = b[at_b]
                at_b += 1
            if state:
                links.append(lead_a << 32 | lead_b)
            new = known[state].get(token)
            if new is None:
                new = self._step(state, token)
            if new <= 0:
                if new:
                    return None
                if at_a - begun_a == 1 == at_b - begun_b:
                    groups.append(f"{lead_a}|{lead_b}")
                else:
                    groups.append(",".join(map(str, a[begun_a:at_a])) + "|" + ",".join(map(str, b[begun_b:at_b])))
                begun_a, begun_b = at_a, at_b
            state = new
        return None if state else (groups, links)


class Aligner:
    """Both tokenizers, their tokens' bytes, and the alignments of parts of texts."""

    def __init__(self, byte_path: str, piece_path: str):
        self.first = Tokenizer.from_file(byte_path)
        self.first.no_truncation()
        self.first.no_padding()
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        back = {c: b for b, c in enumerate(byte_alphabet())}
        size = self.first.get_vocab_size(with_added_tokens=True)
        tokens = [self.first.id_to_token(i) or "" for i in range(size)]
        first = [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in tokens]
        pieces = [self.second.id_to_piece(i) for i in range(self.second.vocab_size())]
        second = [bytes([int(m[1], 16)]) if (m := _BYTE(p)) else p.replace(_SPACE_PIECE, " ").encode() for p in pieces]
        #: ASCII characters that some piece has side by side, the space mark as the space it stands for
        self.beside = np.zeros((128, 128), bool)
        for p in pieces:
            p = p.replace(_SPACE_PIECE, " ")
            for x, y in itertools.pairwise(p if not _BYTE(p) else ""):
                if x < "\x80" and y < "\x80":
                    self.beside[ord(x), ord(y)] = True
        if any(re.search(f"[^{_SPACE_PIECE}]{_SPACE_PIECE}", p) for p in pieces) or any("\n" in p for p in pieces):
            raise ValueError("a piece holds a space behind something else, or a line feed")
        self.space = self.second.piece_to_id(_SPACE_PIECE)
        self.transducer = Transducer(first, second)
        self.cache = GenerationCache(100_000)

    def _aligned(self, part: bytes, a: list[int], b: list[int]) -> tuple | None:
        own = self.transducer.bytes[0]
        found = self.transducer.align(a, b)
        if found is None or b"".join([own[i] for i in a]) != part:
            return (False,)
        groups, links = found
        return True, len(a), len(b), len(groups), ";".join(groups).encode(), np.array(links, np.int64)

    def _second(self, parts: list[str]) -> list[list[int]]:
        """Ids of each part by the second tokenizer, which puts a space before what it is given. A part that begins with one goes
        without it; another goes behind a line feed, which no piece spans, and loses the ids of both."""
        coded = self.second.encode([t[1:] if t[0] == " " else "\n" + t for t in parts], num_threads=1)
        return [[self.space] if t == " " else ids if t[0] == " " else ids[2:] for t, ids in zip(parts, coded, strict=True)]

    def _make(self, parts: list[bytes]) -> list[tuple]:
        out = []
        for at in range(0, len(parts), 4096):
            some = [p.decode() for p in parts[at : at + 4096]]
            first = [e.ids for e in self.first.encode_batch_fast(some, add_special_tokens=False)]
            out += map(self._aligned, parts[at : at + 4096], first, self._second(some))
        return out

    def __call__(self, parts: list[bytes]) -> list[tuple]:
        """Of each part: (True, tokens of each side, groups, their text, links), or (False,) if bytes differ. Long parts
        are not remembered."""
        short = [i for i, p in enumerate(parts) if len(p) <= SHORT]
        out: list = [None] * len(parts)
        for i, v in zip(short, self.cache.get_many([parts[i] for i in short], self._make), strict=True):
            out[i] = v
        for i, v in enumerate(out):
            if v is None:
                out[i] = self._make([parts[i]])[0]
        return out


@functools.lru_cache(maxsize=2)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def cut_texts(texts: pa.Array, beside: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct parts of the texts, each text with a space before it, the part of each place as an index, and where each
    text's parts begin. Empty texts have none. ``beside``: ASCII characters that a token may have side by side."""
    data, starts = raw_buffer(texts)
    full = np.diff(starts) > 0
    # the space before each text
    data = np.insert(data, starts[:-1][full], 32)
    moved = starts + np.concatenate([[0], np.cumsum(full)])
    n = len(data)
    if not n:
        return [], np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    cut = borders(data)
    plain = np.minimum(data, 127)  # 127 stands for what is not ASCII; it is a control character, which pieces do not hold
    cut[1:n] &= ~beside[plain[:-1], plain[1:]]
    cut[moved[:-1][full]] = True
    cut[n] = True
    ends = np.flatnonzero(cut)
    parts = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return parts.dictionary.to_numpy(zero_copy_only=False).tolist(), parts.indices.to_numpy(zero_copy_only=False), np.searchsorted(ends, moved)


def align_tokens(docs: DataFrame, byte_tokenizer: str, piece_tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Align the tokens of every whole text, a space before it: those of a byte-level tokenizer file (A) and those of a piece
    model that adds the space by itself (B). Strings of special tokens are plain text.

    Returns a row for each input row: ``id_col``; ``n_a``, ``n_b``, ``n_groups``, ``n_links`` long; ``groups`` string, the decimal ids
    as ``a1,a2|b1;a3|b2,b3``; ``pairs`` array<long> of the distinct id pairs whose bytes overlap somewhere (A id << 32 | B id,
    ascending), ``times`` array<int> how often. A text that is null or empty, or whose tokens of one side are not its
    bytes (as where B's space mark stands in it), has zeros, "" and empty arrays. Repeated rows and null ids
    are aligned each; an empty table gives no rows. Other input columns are not read. Paths: files on every worker.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]

    def work(batches):
        align = aligner(byte_tokenizer, piece_tokenizer)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                parts, codes, bounds = cut_texts(part.column("text"), align.beside)
                made = align(parts)
                fine = np.array([m[0] for m in made], bool)
                figures = np.array([[*m[1:4], len(m[5])] if m[0] else [0] * 4 for m in made], np.int64).reshape(-1, 4)
                texts = np.empty(len(made), object)
                texts[:] = [m[4] if m[0] else b"" for m in made]
                rows, groups, pairs, times, lengths = [], [], [], [], [0]
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own, often = np.unique(codes[a:b], return_counts=True)
                    if a == b or not fine[own].all():
                        rows.append((0, 0, 0, 0))
                        groups.append(b"")
                        lengths.append(lengths[-1])
                        continue
                    rows.append(tuple((figures[own] * often[:, None]).sum(axis=0).tolist()))
                    groups.append(b";".join(texts[codes[a:b]].tolist()))
                    links = np.concatenate([made[i][5] for i in own.tolist()])
                    distinct, of = np.unique(links, return_inverse=True)
                    pairs.append(distinct)
                    times.append(np.bincount(of, np.repeat(often, figures[own, 3]), len(distinct)).astype(np.int32))
                    lengths.append(lengths[-1] + len(distinct))
                offsets = pa.array(np.array(lengths, np.int32))
                arrays = [pa.array(np.array(c, np.int64)) for c in zip(*rows, strict=True)]
                flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
                lists = [pa.ListArray.from_arrays(offsets, flat(pairs, pa.int64())), pa.ListArray.from_arrays(offsets, flat(times, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column("key"), *arrays, pa.array(groups, pa.binary()).cast(pa.string()), *lists], names)

    schema = f"`{id_col}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<int>"
    return docs.select(docs[id_col].alias("key"), docs[text_col].alias("text")).mapInArrow(work, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair`` and ``documents``, the number of rows that hold it linked."""
    return aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("documents"))


def with_link_counts(aligned: DataFrame) -> DataFrame:
    """``aligned`` (rows of ``align_tokens``; its other columns pass) with, over the links of each row, ``count_sum``, the sum of
    their pairs' counts, and ``n_best``, how many have the highest count that their A id has with any B id (ties included).

    The rows and the counts are stored once. Counts that the HEAD most frequent pairs have are looked up in arrays
    that every worker gets; the rarer pairs of a row are joined with their counts.
    """
    spark = aligned.sparkSession
    rows = stored(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = stored(pair_counts(rows), "pair-counts")
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("documents").alias("most")).toArrow()  # a row for each A id at most
    top = np.zeros(int(max(best.column("a").to_pylist(), default=0)) + 1, np.int64)
    top[best.column("a").to_numpy()] = best.column("most").to_numpy()
    # the least count of a frequent pair, by classes of counts of which there are a few hundred
    step = F.floor(F.log2(F.col("documents").cast("double")) * STEPS)
    classes = sorted(((r.step, r.n, r.least) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("documents").alias("least")).collect()), reverse=True)
    least, held = (1 << 62), 0
    for _, n, lowest in classes:
        held += n
        if held > HEAD:
            break
        least = lowest
    head = counts.where(F.col("documents") >= least).toArrow()
    order = np.argsort(head.column("pair").to_numpy())
    shared = spark.sparkContext.broadcast((head.column("pair").to_numpy()[order], head.column("documents").to_numpy()[order], top))

    def work(batches):
        known, documents, most = shared.value
        for batch in batches:
            sums, bests, rest, lengths = [], [], [], [0]
            pairs, times = batch.column("pairs"), batch.column("times")
            for i in range(batch.num_rows):
                p, t = pairs[i].values.to_numpy(), times[i].values.to_numpy().astype(np.int64)
                at = np.minimum(np.searchsorted(known, p), max(len(known) - 1, 0))
                hit = known[at] == p if len(known) else np.zeros(len(p), bool)
                n = documents[at[hit]]
                sums.append(int((n * t[hit]).sum()))
                bests.append(int(t[hit][n == most[p[hit] >> 32]].sum()))
                rest.append(np.stack([p[~hit], t[~hit]]))
                lengths.append(lengths[-1] + rest[-1].shape[1])
            left = np.concatenate(rest, axis=1) if rest else np.zeros((2, 0), np.int64)
            spans = pa.StructArray.from_arrays([pa.array(left[0]), pa.array(left[1])], ["pair", "times"])
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(sums, pa.int64()), pa.array(bests, pa.int64()), pa.ListArray.from_arrays(pa.array(np.array(lengths, np.int32)), spans)], ["_row", "count_sum", "n_best", "rest"])

    found = stored(rows.select("_row", "pairs", "times").mapInArrow(work, "_row bigint, count_sum bigint, n_best bigint, rest array<struct<pair: bigint, times: bigint>>"), "link-counts")
    rare = found.where(F.size("rest") > 0).select("_row", F.inline("rest")).join(counts.where(F.col("documents") < least), "pair")
    is_best = F.col("documents") == F.col("most")
    tops = spark.createDataFrame(best.rename_columns(["a", "most"]))
    rare = rare.join(F.broadcast(tops), F.shiftright("pair", 32) == F.col("a")).groupBy("_row").agg(F.sum(F.col("documents") * F.col("times")).alias("more_sum"), F.sum(F.when(is_best, F.col("times")).otherwise(0)).alias("more_best"))
    zero = F.lit(0).cast("bigint")
    total = found.select("_row", "count_sum", "n_best").unionByName(rare.select("_row", F.col("more_sum").alias("count_sum"), F.col("more_best").alias("n_best")))
    total = stored(total.groupBy("_row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best")), "link-totals")
    discard(found, counts)
    out = rows.join(total, "_row", "left")
    return out.select(*(c for c in rows.columns if c != "_row"), F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))


def alignment_digests(docs: DataFrame, byte_tokenizer: str, piece_tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Figures of ``align_tokens`` and ``with_link_counts`` by document, with the SHA-256 of ``groups`` ("" where there are no tokens)."""
    made = align_tokens(docs, byte_tokenizer, piece_tokenizer, id_col, text_col)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    counted = with_link_counts(made.withColumn("groups_sha256", digest).drop("groups"))
    return counted.select(id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

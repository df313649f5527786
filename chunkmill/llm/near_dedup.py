"""Near-duplicates by an inverted join over the coordinates of MinHash signatures.

A text's shingle set is signed by ``COORDINATES`` values, each made of ``MINIMA`` minima under
random orders, so that two sets agree in a coordinate with the ``MINIMA``-th power of their
similarity. Texts with equal sets are one class, and only one member of a class goes on. Each
class posts its (coordinate, value) pairs; values that no other class has are dropped, the rest
are put in a global order, rarest first. Two classes that agree in at least ``matches``
coordinates must share one of the first (number left - matches + 1) of them, the *prefix*, so only
prefixes are posted, and classes with fewer than ``matches`` values left are skipped altogether.
Within a posting list the signatures are merged, and a pair is retained if it has enough
collisions, in coordinates and in single minima (``thresholds``). A link of similarity 0.8 is
missed with a chance of about two in a million, a closer one with less.

No list is written out as pairs. Links are found in three steps, and each leaves only links between
classes that no link joined before:

1. *Homes.* A class goes with its full set to the list of its most frequent value, in blocks of
   about BLOCK; a block confirms retained pairs on the full sets, skipping pairs it has joined,
   and hands on a star a component. The member nearest to its component's common signature stands
   for it among the other blocks of that list, level by level, until a list is one block.
2. *Neighbours.* Lists in which all classes are joined by now are dropped. In the others, a class
   outside a list's largest component names its closest retained pair; the closest one of each
   class is confirmed, and what is linked is joined.
3. *The rest.* Again over the lists in which not all are joined, a class names the blocks that hold
   its retained pairs, and meets the sets of those blocks, where it is confirmed against every
   retained class of another component.

Long lists are dealt out in parts, in which the members of a list's largest component meet the
others but not each other. Every retained pair is named in one list only, that of its first
coordinate in both prefixes.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lm_ppm import words_of
from .segments import raw_buffer, slices
from .shared import broadcast_if_few, discard, stored

COORDINATES, MINIMA = 32, 3
#: Chance that either threshold misses a link of just the similarity asked for.
MISS = 1.2e-6
#: Classes of a block (WIDE: where others come to it), hashes of its sets, and members of a part of a
#: long posting list.
BLOCK, WIDE, HASHES, PART = 256, 1024, 400_000, 4096
#: Bytes of texts that are taken apart at once; a worker's arrays are some 25 times as large.
TEXTS = 1 << 20
#: Coordinates whose lists name neighbours (which saves work, and decides nothing).
SCOUTS = 8

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BITS = np.arange(COORDINATES, dtype=np.uint64)
_SEEDS = np.random.default_rng(11).integers(0, 1 << 63, COORDINATES * MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles, and where each text's begin.
    A text of fewer words than ``size`` has its whole sequence as one; one without words has none."""
    data, starts = raw_buffer(texts)
    names, codes, bounds = words_of(data, starts)
    named = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names.to_numpy(zero_copy_only=False)), np.uint64, len(names))
    word = named[codes] if len(codes) else np.zeros(0, np.uint64)
    rolled = np.zeros(len(word), np.uint64)
    for j in range(size):
        shifted = np.zeros(len(word), np.uint64)
        shifted[: max(len(word) - j, 0)] = word[j:]
        rolled = rolled * _SEEDS[0] + shifted
    rolled = _mixed(rolled)
    sets, lengths = [], np.zeros(len(bounds) - 1, np.int64)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if b - a >= size:
            own = np.unique(rolled[a : b - size + 1])
        elif b > a:
            whole = np.uint64(b - a)
            for w in word[a:b]:
                whole = np.uint64((int(whole) * int(_SEEDS[1]) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            own = _mixed(np.array([whole]))
        else:
            continue
        sets.append(own)
        lengths[i] = len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(lengths)])


def signatures(shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text that has shingles: its coordinates (32 bits each), and the lowest byte of every
    single minimum."""
    begins = bounds[:-1][np.diff(bounds) > 0]
    values = np.zeros((len(begins), COORDINATES), np.uint64)
    minima = np.zeros((len(begins), COORDINATES * MINIMA), np.uint8)
    if len(begins):
        for c in range(COORDINATES * MINIMA):
            moved = (shingles ^ _SEEDS[c]) * _M1
            moved ^= moved >> np.uint64(32)
            moved *= _SEEDS[c]
            least = np.minimum.reduceat(moved, begins)
            values[:, c // MINIMA] = _mixed(values[:, c // MINIMA] ^ least)
            minima[:, c] = least & np.uint64(0xFF)
    return (values >> np.uint64(32)).astype(np.uint32), minima


def _signed(rows: DataFrame, size: int) -> DataFrame:
    def work(batches):
        for batch in batches:
            for part in slices(batch, "text", TEXTS):
                shingles, bounds = shingle_sets(part.column("text"), size)
                lengths = np.diff(bounds)
                sig, fine = (iter(x) for x in signatures(shingles, bounds))
                digest, signature, minima = [], [], []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    digest.append(xxhash.xxh3_128_digest(shingles[a:b].tobytes()) if b > a else None)
                    signature.append(next(sig).tobytes() if b > a else None)
                    minima.append(next(fine).tobytes() if b > a else None)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(lengths), pa.array(digest, pa.binary()), pa.array(signature, pa.binary()), pa.array(minima, pa.binary())], ["id", "n", "digest", "sig", "fine"])

    return rows.mapInArrow(work, "id bigint, n bigint, digest binary, sig binary, fine binary")


def thresholds(percent: int) -> tuple[int, int]:
    """Collisions that a pair must have, in coordinates and in single minima: the most that a link
    of similarity ``percent`` falls short of with a chance of at most MISS."""

    def least(n: int, p: float) -> int:
        below, k = 0.0, 0
        while k < n and (below := below + math.comb(n, k) * p**k * (1 - p) ** (n - k)) <= MISS:
            k += 1
        return max(k, 1)

    return least(COORDINATES, (percent / 100) ** MINIMA), least(COORDINATES * MINIMA, percent / 100)


def _sets_of(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``id`` and ``shingles`` of the rows whose id is wanted, but for rows without any. Texts are not shuffled
    unless the wanted ids are too many to be broadcast."""

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text", TEXTS):
                shingles, bounds = shingle_sets(part.column("text"), size)
                sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(shingles.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), sets], ["id", "shingles"])

    made = rows.join(broadcast_if_few(wanted), "id", "left_semi").select("id", "text").mapInArrow(work, "id bigint, shingles array<bigint>")
    return made.where(F.size("shingles") > 0)


def _runs(batches, key: list[str]):
    """Tables of whole groups from batches sorted by ``key``: all groups that end in a batch together."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows < 4096 and held.nbytes < 32 << 20:
            continue
        ids = [held.column(k).to_numpy() for k in key]
        new = np.zeros(held.num_rows, bool)
        for x in ids:
            new[1:] |= x[1:] != x[:-1]
        last = np.flatnonzero(new)
        if len(last):
            yield held.slice(0, last[-1])
            held = held.slice(last[-1])
    if held is not None and held.num_rows:
        yield held


def _matrix(column: pa.ChunkedArray, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _edges(*keys: np.ndarray) -> list[int]:
    """Where the groups of equal keys begin, and the end."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return [*np.flatnonzero(new).tolist(), len(new)]


def _tokens(classes: DataFrame) -> DataFrame:
    """``id`` and ``token``, coordinate and value in one integer."""

    def work(batches):
        for batch in batches:
            sig = _matrix(batch.column("sig"), np.uint32, COORDINATES)
            token = (np.arange(COORDINATES, dtype=np.int64) << 32) + sig
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("id").to_numpy(), COORDINATES)), pa.array(token.ravel())], ["id", "token"])

    return classes.select("id", "sig").mapInArrow(work, "id bigint, token bigint")


def _prefixes(classes: DataFrame, matches: int) -> DataFrame:
    """``id``, ``prefix`` (the tokens it posts), ``posted`` (their coordinates as bits), ``home`` (its most
    frequent token) and ``block`` (its part of that) of the classes that share ``matches`` tokens at least."""
    tokens = _tokens(classes)
    shared = tokens.groupBy("token").count().where("count > 1")
    mine = tokens.join(shared, "token").groupBy("id").agg(F.sort_array(F.collect_set(F.struct("count", "token"))).alias("tokens")).where(F.size("tokens") >= matches)
    prefix = F.transform(F.slice("tokens", 1, F.size("tokens") - (matches - 1)), lambda t: t["token"])
    prefixed = stored(mine.select("id", prefix.alias("prefix"), F.element_at("tokens", -1)["token"].alias("home")), "prefixes")
    crowd = prefixed.join(classes.select("id", "n"), "id").groupBy("home").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("hashes"))
    parts = F.ceil(F.greatest(F.col("members") / WIDE, F.col("hashes") / HASHES))
    bits = F.aggregate("prefix", F.lit(0).cast("bigint"), lambda held, t: held.bitwiseOR(F.element_at(F.array(*(F.lit(1 << k).cast("bigint") for k in range(COORDINATES))), (F.shiftright(t, 32) + 1).cast("int"))))
    return prefixed.join(crowd, "home").select("id", "prefix", bits.alias("posted"), "home", F.xxhash64("home", F.pmod(F.xxhash64("id", "home"), parts)).alias("block"))


def _joined_at_home(met: DataFrame, percent: int, close: int) -> DataFrame:
    """(id, root, center) of the classes that links join inside a block of their home: the smallest id of
    their component, and the id nearest to the component's most common minima."""

    def work(batches):
        for table in _runs(batches, ["home", "block"]):
            ids = table.column("id").to_numpy()
            fine = _matrix(table.column("fine"), np.uint8, COORDINATES * MINIMA)
            lists = table.column("shingles").combine_chunks()
            flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sizes = np.diff(at)
            out = []
            edges = _edges(*(table.column(c).to_numpy() for c in ("home", "block")))
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                top, sets = np.arange(e - s), {}

                def own(k, sets=sets):
                    if k not in sets:
                        sets[k] = frozenset(flat[at[k] : at[k + 1]].tolist())
                    return sets[k]

                for k in range(e - s - 1):
                    others = np.arange(k + 1, e - s)
                    small, large = np.minimum(sizes[s + k], sizes[s + others]), np.maximum(sizes[s + k], sizes[s + others])
                    same = (fine[s + others] == fine[s + k]).sum(axis=1)
                    fit = np.flatnonzero((same >= close) & (small * 100 >= large * percent))
                    for m in others[fit[np.argsort(-same[fit], kind="stable")]].tolist():
                        if top[m] == top[k]:
                            continue
                        both = len(own(s + k) & own(s + m))
                        if 100 * both >= percent * (sizes[s + k] + sizes[s + m] - both):
                            top[top == max(top[k], top[m])] = min(top[k], top[m])
                for t in np.flatnonzero(np.bincount(top) > 1).tolist():
                    of = s + np.flatnonzero(top == t)
                    agreed = np.zeros(len(of), np.int64)
                    for c in fine[of].T:
                        agreed += c == np.bincount(c).argmax()
                    center, root = int(ids[of[agreed.argmax()]]), int(ids[of].min())
                    out += [(k, root, center) for k in ids[of].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], ["id", "root", "center"])

    ordered = met.select("home", "block", "id", "fine", "shingles").repartition("home", "block").sortWithinPartitions("home", "block")
    return ordered.mapInArrow(work, "id bigint, root bigint, center bigint")


def _home_links(homes: DataFrame, signed: DataFrame, sets: DataFrame, percent: int, close: int) -> DataFrame:
    """(a, b): links that join classes of one home, found level by level, and the stored tables they are read
    from. A center takes its component's place in the next level, so that levels shrink to a 256th where
    copies are many."""
    found, level, tables = [], homes, []
    while True:
        crowd = level.join(signed.select("id", "n"), "id").groupBy("home").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("hashes")).where("members > 1")
        crowd = crowd.withColumn("blocks", F.ceil(F.greatest(F.col("members") / BLOCK, F.col("hashes") / HASHES)))
        housed = stored(level.join(crowd, "home").select("id", "home", "blocks", F.pmod(F.xxhash64("id", "home"), "blocks").alias("block")), "housed")
        joined = stored(_joined_at_home(housed.join(signed.select("id", "fine"), "id").join(sets, "id"), percent, close), "joined")
        tables += [housed, joined]
        found.append(joined.where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b")))
        crowded = housed.where("blocks > 1")
        if not crowded.limit(1).count():
            return reduce(DataFrame.union, found), tables
        level = crowded.join(joined.where("id = center").select("id").distinct(), "id").select("id", "home")


def _dealt(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """``token``, ``i``, ``j``, ``side``, ``id``, ``component``, ``far`` (outside the list's largest component) of the
    lists that hold several components. In a place (token, i, j) side 0 meets side 1; 2 is both."""
    labelled = posts.join(labels, "id", "left").select("token", "id", F.coalesce("component", "id").alias("component"))
    lists = labelled.groupBy("token", "component").agg(F.count(F.lit(1)).alias("own")).groupBy("token")
    lists = lists.agg(F.sum("own").alias("all"), F.max("own").alias("most"), F.max_by("component", F.struct("own", "component")).alias("largest"), F.count(F.lit(1)).alias("components")).where("components > 1")
    met = labelled.join(lists, "token").withColumns({"few": F.col("all") <= PART, "far": F.col("component") != F.col("largest"), "p": F.ceil(F.col("most") / PART), "q": F.ceil((F.col("all") - F.col("most")) / PART)})
    own = F.pmod(F.xxhash64("id", "token"), F.when(F.col("far"), F.col("q")).otherwise(F.col("p")))
    zero = F.lit(0).cast("bigint")
    all_p, all_q = F.sequence(zero, F.col("p") - 1), F.sequence(zero, F.col("q") - 1)
    place = lambda i, j, side: F.struct(i.cast("bigint").alias("i"), j.cast("bigint").alias("j"), F.lit(side).alias("side"))
    # parts of the largest component are i = -1, -2, ...: each meets each part of the others, and these meet each other
    among = F.transform(all_q, lambda k: F.when(k < F.col("own"), place(k, F.col("own"), 1)).when(k == F.col("own"), place(k, k, 2)).otherwise(place(F.col("own"), k, 0)))
    spread = F.when(F.col("far"), F.concat(F.transform(all_p, lambda k: place(-1 - k, F.col("own"), 1)), among)).otherwise(F.transform(all_q, lambda k: place(-1 - F.col("own"), k, 0)))
    places = F.when(F.col("few"), F.array(place(zero, zero, 2))).otherwise(spread)
    return met.withColumn("own", own).select("token", "id", "component", "far", F.inline(places))


def _retained(dealt: DataFrame, signed: DataFrame, percent: int, matches: int, close: int, nearest: bool) -> DataFrame:
    """Retained pairs of classes in different components. ``nearest``: (id, mate, x, y, same), of each class
    outside the list's largest component the closest one; else distinct (id, component, block): a class
    and the block of another, of the component that has more members here."""

    def work(batches):
        for table in _runs(batches, ["token", "i", "j"]):
            token, i, j, side, ids, comp, far, n, posted, block = (table.column(c).to_numpy() for c in ("token", "i", "j", "side", "id", "component", "far", "n", "posted", "block"))
            sig, fine = _matrix(table.column("sig"), np.uint32, COORDINATES), _matrix(table.column("fine"), np.uint8, COORDINATES * MINIMA)
            edges = _edges(token, i, j)
            out = []
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                first, second = s + np.flatnonzero(side[s:e] != 1), s + np.flatnonzero(side[s:e] != 0)
                here = int(token[s] >> 32)
                _, of, members = np.unique(comp[s:e], return_inverse=True, return_counts=True)
                weight = members[of]
                held = []
                for at in range(0, len(first), 64):
                    x = first[at : at + 64]
                    small, large = np.minimum(n[x][:, None], n[second]), np.maximum(n[x][:, None], n[second])
                    p, q = np.nonzero((small * 100 >= large * percent) & (comp[x][:, None] != comp[second]))
                    for u, v in zip(*(np.array_split(k, len(p) // 32768 + 1) for k in (x[p], second[q])), strict=True):
                        agree = sig[u] == sig[v]
                        hit = agree.sum(axis=1) >= matches
                        if not nearest:
                            # the first coordinate that both have posted under the same value is this one
                            both = (posted[u] & posted[v]).astype(np.uint64)
                            both = agree & ((both[:, None] >> _BITS) & np.uint64(1)).astype(bool)
                            hit &= both.argmax(axis=1) == here
                        u, v = u[hit], v[hit]
                        same = (fine[u] == fine[v]).sum(axis=1)
                        hit = same >= close
                        # a pair is held in both orders if both sides are one
                        u, v, same = np.r_[u[hit], v[hit]], np.r_[v[hit], u[hit]], np.r_[same[hit], same[hit]]
                        if nearest:
                            held.append(_first_of_each(np.stack([u, v, same])[:, far[u]], lambda k: (ids[k[1]], -k[2], k[0]), 1))
                        else:
                            less, more = weight[u - s], weight[v - s]
                            go = (less < more) | ((less == more) & (comp[u] > comp[v]))
                            held.append(_first_of_each(np.stack([ids[u[go]], comp[u[go]], block[v[go]]]), lambda k: (k[1], k[2], k[0]), 3))
                if not held:
                    continue
                if nearest:
                    u, v, same = _first_of_each(np.concatenate(held, axis=1), lambda k: (ids[k[1]], -k[2], k[0]), 1)
                    out.append(np.stack([ids[u], ids[v], comp[u], comp[v], same]))
                else:
                    out.append(_first_of_each(np.concatenate(held, axis=1), lambda k: (k[1], k[2], k[0]), 3))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1)], names)

    names = ["id", "mate", "x", "y", "same"] if nearest else ["id", "component", "block"]
    ordered = dealt.join(signed, "id").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    found = ordered.select("token", "i", "j", "side", "id", "component", "far", "n", "posted", "block", "sig", "fine").mapInArrow(work, ", ".join(f"{k} bigint" for k in names))
    if not nearest:
        return found.distinct()
    best = F.max_by(F.struct("mate", "x", "y"), F.struct("same", "mate"))
    return found.groupBy("id").agg(best.alias("best")).select("id", "best.*")


def _first_of_each(rows: np.ndarray, order, width: int) -> np.ndarray:
    """Of columns that are equal in the first ``width`` rows, the first by ``order`` (keys for lexsort)."""
    rows = rows[:, np.lexsort(order(rows))]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:width, 1:] != rows[:width, :-1]).any(axis=0)
    return rows[:, new]


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the components x, y of pairs (id, mate) whose full sets have the similarity."""
    met = pairs.join(sets.withColumnRenamed("shingles", "own"), "id").join(sets.select(F.col("id").alias("mate"), "shingles"), "mate")
    met = met.withColumn("both", F.size(F.array_intersect("own", "shingles")))
    return met.where(F.col("both") * 100 >= (F.size("own") + F.size("shingles") - F.col("both")) * percent).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _joined_in_blocks(calls: DataFrame, signed: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, close: int) -> DataFrame:
    """(a, b): components that links join, of the classes that come to blocks (id, component, block) and the
    classes of those blocks. Where many come to a block, they come in lots, each to a copy of it."""

    def work(batches):
        for table in _runs(batches, ["block", "lot"]):
            block, lot, guest, comp = (table.column(c).to_numpy() for c in ("block", "lot", "guest", "component"))
            fine = _matrix(table.column("fine"), np.uint8, COORDINATES * MINIMA)
            lists = table.column("shingles").combine_chunks()
            flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sizes = np.diff(at)
            found = []
            edges = _edges(block, lot)
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                names, top = np.unique(comp[s:e], return_inverse=True)
                members = s + np.flatnonzero(~guest[s:e])
                sets: dict[int, frozenset] = {}
                for k in (s + np.flatnonzero(guest[s:e])).tolist():
                    same = (fine[members] == fine[k]).sum(axis=1)
                    small, large = np.minimum(sizes[k], sizes[members]), np.maximum(sizes[k], sizes[members])
                    fit = np.flatnonzero((same >= close) & (small * 100 >= large * percent) & (top[members - s] != top[k - s]))
                    own = None
                    for m in members[fit[np.argsort(-same[fit], kind="stable")]].tolist():
                        x, y = top[k - s], top[m - s]
                        if x == y:
                            continue
                        if own is None:
                            own = frozenset(flat[at[k] : at[k + 1]].tolist())
                        if m not in sets:
                            sets[m] = frozenset(flat[at[m] : at[m + 1]].tolist())
                        both = len(own & sets[m])
                        if 100 * both >= percent * (sizes[k] + sizes[m] - both):
                            found.append((int(names[x]), int(names[y])))
                            top[top == max(x, y)] = min(x, y)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    lots = calls.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / PART).alias("lots"))
    guests = calls.join(lots, "block").select("block", F.pmod(F.xxhash64("id"), "lots").alias("lot"), F.lit(True).alias("guest"), "id", "component")
    own = signed.select("id", "block").join(lots, "block").join(labels, "id", "left")
    hosts = own.select("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lots") - 1)).alias("lot"), F.lit(False).alias("guest"), "id", F.coalesce("component", "id").alias("component"))
    met = guests.union(hosts).join(signed.select("id", "fine"), "id").join(sets, "id")
    ordered = met.select("block", "lot", "guest", "component", "fine", "shingles").repartition("block", "lot").sortWithinPartitions("block", "lot")
    return ordered.mapInArrow(work, "a bigint, b bigint").distinct()


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after links (a, b) between components."""
    lower = components(links)
    known = labels.join(lower.select(F.col("id").alias("component"), F.col("component").alias("lower")), "component", "left").select("id", F.coalesce("lower", "component").alias("component"))
    made = stored(known.union(lower.join(labels, "id", "left_anti").select("id", "component")), "labels")
    discard(labels, lower)
    return made


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (its smallest reachable id) of every id in the links (a, b).
    Labels go to the neighbours and are followed to their own label, until none changes."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).select(F.col("a").alias("id"), "component"), "labels")
    while True:
        met = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("met"))
        lower = labels.join(met, "id").select("id", F.least("component", "met").alias("component"), F.col("component").alias("was"))
        # of the label, its label
        known = labels.select(F.col("id").alias("component"), F.col("component").alias("beyond"))
        lower = stored(lower.join(known, "component", "left").select("id", "was", F.least("component", "beyond").alias("component")), "labels")
        discard(labels)
        labels = lower.select("id", "component")
        if not lower.where("component <> was").limit(1).count():
            discard(both)
            return labels


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of texts linked by word shingles of ``size`` words (A-Z folded) whose sets have
    100 * intersection >= ``percent`` * union.

    Returns for each input row: ``id_col`` long, ``n_shingles`` long, ``component_id`` long (the
    smallest id reachable, its own included), ``kept`` boolean (it is that id). Null text and text
    without words have no shingles and no link. Rows of one id are one document: they are linked,
    and each keeps its own set size. A row without an id links with nothing: its component is null
    and it is kept. Other input columns are not read.
    """
    matches, close = thresholds(percent)
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    signed = stored(_signed(rows, size), "signed")
    able = signed.where("digest is not null and id is not null")
    classes = stored(able.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("fine").alias("fine")), "classes")
    homes = stored(_prefixes(classes, matches), "homes")
    sets = stored(_sets_of(rows, homes.select("id"), size), "shingle-sets")
    signs = stored(homes.select("id", "posted", "block").join(classes.select("id", "n", "sig", "fine"), "id"), "signs")
    links, stars = _home_links(homes.select("id", "home"), signs, sets, percent, close)
    # rows of one id are joined through the classes of their texts
    repeated = able.groupBy("id").agg(F.count_distinct("digest").alias("texts")).where("texts > 1")
    joints = able.join(repeated, "id", "left_semi").join(classes.select("digest", F.col("id").alias("head")), "digest").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    labels = components(links.union(joints))
    discard(*stars)
    posts = stored(homes.select("id", F.explode("prefix").alias("token")), "posts")
    scouts = posts.where(F.shiftright("token", 32) < SCOUTS)
    pairs = stored(_retained(_dealt(scouts, labels), signs, percent, matches, close, True), "neighbours")
    labels = _relabelled(labels, _confirmed(pairs, sets, percent))
    discard(pairs)
    calls = stored(_retained(_dealt(posts, labels), signs, percent, matches, close, False), "calls")
    labels = _relabelled(labels, _joined_in_blocks(calls, signs, labels, sets, percent, close))
    discard(calls, posts, signs, sets, homes)
    heads = classes.select("digest", F.col("id").alias("head"))
    final = signed.join(heads, "digest", "left").join(labels.select(F.col("id").alias("head"), "component"), "head", "left")
    own = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "head", "id"))
    out = final.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.cast("bigint").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id is the smallest of its component. Rows without an id,
    without text or without words stay; an empty table stays empty; rows that repeat an id stay or go together."""
    gone = stored(near_duplicates(docs, size, percent, id_col, text_col).where("not kept").select(F.col(id_col).alias("_gone")).distinct(), "gone")
    gone = broadcast_if_few(gone)
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


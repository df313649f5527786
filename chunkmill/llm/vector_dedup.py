"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its PREFIX nearest reference points (*pivots*), nearest first. Every pivot has a list: a
vector *lives* in the list of its nearest pivot and *visits* the lists of its first few. In a list, visitors meet the
vectors that live there through inverted pivot lists, which count the pivots that two descriptions share; pairs that
share too few go no further, the others are verified by their cosine in double precision. A pair that would meet
twice (each visits the other's list) is taken where its smaller id visits. No pair leaves its list: a list
hands on how many links each vector found, and which vectors are joined.

The index is fitted on a bounded sample: at most SAMPLE vectors, those with the smallest hashed ids. Pivots come from one
half of it: vectors that are not near each other (seeded random directions fill up), about the square root of the
number of vectors, at most half of SAMPLE. How many lists are visited, and how many pivots must be shared, is told by the
other half: the least and the most with which those vectors and each moved to exactly the cosine asked for still
meet with a chance of RECALL. All vectors are indexed, and all visitors of a list meet all that live there.

Equal vectors are one class, counted by its size. A list that is much longer than usual is dealt out in blocks of those
that live there and lots of visitors, each block with each lot.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dedup import _edges, _runs, components
from .shared import discard, stored

#: Vectors that the index is fitted on at most, pivots of a description, least number of pivots.
SAMPLE, PREFIX, FEWEST = 8192, 16, 16
#: Chance with which a pair of just the cosine asked for is to meet, and what part of the misses the shared pivots may cause.
RECALL, SHARED_MISS = 0.97, 0.2
#: Sampled pivots have a smaller cosine with each other.
APART = 0.8
#: Bounds of a block (vectors that live in a list), and how many lots' visitors it has; cells of one comparison.
BLOCK, LOT, CELLS = (256, 16_384), 4, 1 << 20
#: Cosines so close to the threshold are computed again from the vectors as they are.
CLOSE = 1e-9


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def cosine_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, in double precision."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def nearest(units: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest pivots of each row, nearest first (ties: the smaller number)."""
    k = min(k, len(pivots))
    out = np.zeros((len(units), k), np.uint16)
    for at in range(0, len(units), 1024):
        near = units[at : at + 1024] @ pivots.T
        some = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < len(pivots) else np.tile(np.arange(k), (len(near), 1))
        some.sort(axis=1)
        order = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
        out[at : at + 1024] = np.take_along_axis(some, order, axis=1)
    return out


def directions(n: int, width: int) -> np.ndarray:
    return _unit(np.random.default_rng(width).normal(size=(n, width)))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` pivots from the units of a sample: in order, those that are apart from all before; random directions fill up."""
    kept = np.zeros((0, sample.shape[1]))
    for row in sample:
        if len(kept) == n:
            break
        if not len(kept) or (kept @ row).max() < APART:
            kept = np.vstack([kept, row])
    return np.vstack([kept, directions(n - len(kept), sample.shape[1])]) if len(kept) < n else kept


def fit(sample: np.ndarray, pivots: np.ndarray, cosine: float) -> tuple[int, int]:
    """(visits, shared): lists to visit, and pivots that two descriptions must share, by sampled vectors and each moved in a
    random direction to just the cosine."""
    if not len(sample):
        return min(PREFIX, len(pivots)), 1
    sample = np.tile(sample, (-(-2048 // len(sample)), 1))  # each is moved often enough to tell a few in a hundred
    moved = np.random.default_rng(5).normal(size=sample.shape)
    moved -= (moved * sample).sum(axis=1, keepdims=True) * sample
    length = np.sqrt((moved * moved).sum(axis=1, keepdims=True))
    moved = np.divide(moved, length, out=np.zeros_like(moved), where=length > 0)
    other = cosine * sample + math.sqrt(max(0.0, 1 - cosine * cosine)) * moved
    a, b = nearest(sample, pivots, PREFIX), nearest(_unit(other), pivots, PREFIX)
    both = (a[:, :, None] == b[:, None, :]).any(axis=2).sum(axis=1)
    shared = 1
    while shared < PREFIX and (both <= shared).mean() <= (1 - RECALL) * SHARED_MISS:
        shared += 1
    for visits in range(1, a.shape[1] + 1):
        met = (a[:, :visits] == b[:, :1]).any(axis=1) | (b[:, :visits] == a[:, :1]).any(axis=1)
        if (met & (both >= shared)).mean() >= RECALL:
            return visits, shared
    return a.shape[1], shared


def _read(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, offsets, usable) of lists of numbers; null, empty and zero lists and those with a null or non-finite value are not."""
    values = lists.values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) + 0.0  # no negative zero
    offsets = lists.offsets.to_numpy()
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])[offsets]
    full = np.concatenate([[0], np.cumsum(values != 0)])[offsets]
    usable = lists.is_valid().to_numpy(zero_copy_only=False) & (np.diff(bad) == 0) & (np.diff(full) > 0)
    return values, offsets, usable


def _signed(rows: DataFrame, width: str) -> DataFrame:
    """``id``, ``digest`` and ``vec`` (the values as little-endian ``width``), null where the vector takes no part."""

    def work(batches):
        for batch in batches:
            values, offsets, usable = _read(batch.column("vec"))
            held = [values[a:b].astype(width).tobytes() if u else None for a, b, u in zip(offsets[:-1].tolist(), offsets[1:].tolist(), usable.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([None if h is None else xxhash.xxh3_128_digest(h) for h in held], pa.binary()), pa.array(held, pa.binary())], ["id", "digest", "vec"])

    return rows.mapInArrow(work, "id bigint, digest binary, vec binary")


def _described(classes: DataFrame, pivots, width: str) -> DataFrame:
    """``id``, ``weight``, ``vec``, ``dim`` and ``prefix`` (its nearest pivots). ``pivots``: a broadcast matrix; vectors of another
    length than it has get as many random directions."""

    def work(batches):
        given, made = pivots.value, {}
        for batch in batches:
            raw = batch.column("vec").to_pylist()
            size = np.array([len(r) // np.dtype(width).itemsize for r in raw], np.int64)
            prefix: list = [None] * len(raw)
            for dim in np.unique(size).tolist():
                own = np.flatnonzero(size == dim)
                if dim != given.shape[1] and dim not in made:
                    made[dim] = directions(len(given), dim)
                units = _unit(np.frombuffer(b"".join(raw[i] for i in own.tolist()), width).reshape(len(own), dim).astype(np.float64))
                for i, near in zip(own.tolist(), nearest(units, made.get(dim, given), PREFIX), strict=True):
                    prefix[i] = near.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("weight"), batch.column("vec"), pa.array(size), pa.array(prefix, pa.binary())], ["id", "weight", "vec", "dim", "prefix"])

    return classes.select("id", "weight", "vec").mapInArrow(work, "id bigint, weight bigint, vec binary, dim bigint, prefix binary")


def _dealt(described: DataFrame, visits: int, usual: int) -> DataFrame:
    """Rows by list (``dim``, ``pivot``), ``block`` and ``lot``: ``guest`` says whether a vector visits there."""
    number = lambda at: F.conv(F.concat(F.hex(F.substring("prefix", at * 2 + 2, 1)), F.hex(F.substring("prefix", at * 2 + 1, 1))), 16, 10).cast("bigint")
    block = min(max(BLOCK[0], 2 * usual), BLOCK[1])
    first = F.array(*(number(i) for i in range(visits)))
    rows = described.select("*", first.alias("visited"))
    living = rows.groupBy("dim", F.col("visited")[0].alias("pivot")).agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    coming = rows.select("dim", F.explode("visited").alias("pivot")).groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / (block * LOT)).alias("lots"))
    lists = stored(living.join(coming, ["dim", "pivot"]), "pivot-lists")  # a row a list: pivots are bounded
    lists = F.broadcast(lists) if lists.count() <= SAMPLE * 64 else lists
    narrow = ["id", "weight", "vec", "dim", "prefix"]
    hosts = rows.withColumn("pivot", F.col("visited")[0]).join(lists, ["dim", "pivot"])
    hosts = hosts.select(*narrow, "pivot", F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lots") - 1)).alias("lot"), F.lit(False).alias("guest"))
    guests = rows.withColumn("pivot", F.explode("visited")).join(lists, ["dim", "pivot"])
    guests = guests.select(*narrow, "pivot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id", "pivot"), "lots").alias("lot"), F.lit(True).alias("guest"))
    return hosts.unionByName(guests)


def _joined(lab: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels (the smallest member of each component) after links x - y."""
    while True:
        a, b = lab[x], lab[y]
        if (a == b).all():
            return lab
        top = np.arange(len(lab))
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while (top != top[top]).any():
            top = top[top]
        lab = top[lab]


def _met(dealt: DataFrame, visits: int, shared: int, cosine: float, width: str) -> DataFrame:
    """(id, n, root) for each list and vector that has links in it: their number, and the smallest id that they join it with."""

    def group(table, s, e, out):
        guest = table.column("guest").slice(s, e - s).to_numpy(zero_copy_only=False)
        if not guest.any() or guest.all():
            return
        ids, weight = (table.column(c).slice(s, e - s).to_numpy() for c in ("id", "weight"))
        raw = np.frombuffer(b"".join(table.column("vec").slice(s, e - s).to_pylist()), width).reshape(e - s, -1).astype(np.float64)
        prefix = np.frombuffer(b"".join(table.column("prefix").slice(s, e - s).to_pylist()), np.uint16).reshape(e - s, -1)
        units = _unit(raw)
        known, local = np.unique(ids, return_inverse=True)
        lab, n = np.arange(len(known)), np.zeros(len(known), np.int64)
        hosts, guests = np.flatnonzero(~guest), np.flatnonzero(guest)
        # inverted pivot lists of those that live here: all pivots of their descriptions, and the lists they visit
        pivots, of = np.unique(prefix[hosts], return_inverse=True)
        of = of.reshape(len(hosts), -1)
        holds, visit = np.zeros((len(pivots) + 1, len(hosts)), np.uint8), np.zeros((len(pivots) + 1, len(hosts)), bool)
        for k in range(of.shape[1]):
            holds[of[:, k], np.arange(len(hosts))] = 1
            if k < visits:
                visit[of[:, k], np.arange(len(hosts))] = True
        at = np.searchsorted(pivots, prefix[guests])
        at = np.where(pivots[np.minimum(at, len(pivots) - 1)] == prefix[guests], at, len(pivots))
        step = max(1, CELLS // len(hosts))
        for begin in range(0, len(guests), step):
            g, lists = guests[begin : begin + step], at[begin : begin + step]
            count = np.zeros((len(g), len(hosts)), np.uint8)
            for k in range(lists.shape[1]):
                count += holds[lists[:, k]]
            again = visit[lists[:, 0]]  # the other way round, this pair meets in the visitor's own list
            mine, theirs = ids[g][:, None], ids[hosts][None, :]
            i, j = np.nonzero((count >= shared) & ((mine < theirs) | ((mine > theirs) & ~again)))
            if len(i) * 8 > count.size:
                near = (units[g] @ units[hosts].T)[i, j]
            else:
                near = np.concatenate([np.zeros(0), *((units[g[p]] * units[hosts[q]]).sum(axis=1) for p, q in zip(np.array_split(i, len(i) // 65536 + 1), np.array_split(j, len(j) // 65536 + 1), strict=True))])
            edge = np.flatnonzero(np.abs(near - cosine) < CLOSE)
            near[edge] = cosine_of(raw[g[i[edge]]], raw[hosts[j[edge]]])
            x, y = g[i[near >= cosine]], hosts[j[near >= cosine]]
            np.add.at(n, local[x], weight[y])
            np.add.at(n, local[y], weight[x])
            lab = _joined(lab, local[x], local[y])
        hit = np.flatnonzero(n)
        out.append(np.stack([known[hit], n[hit], known[lab[hit]]]))

    def work(batches):
        for table in _runs(batches, ["dim", "pivot", "block", "lot"]):
            out = [np.zeros((3, 0), np.int64)]
            edges = _edges(*(table.column(c).to_numpy() for c in ("dim", "pivot", "block", "lot")))
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                group(table, s, e, out)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1)], ["id", "n", "root"])

    ordered = dealt.repartition("dim", "pivot", "block", "lot").sortWithinPartitions("dim", "pivot", "block", "lot")
    return ordered.mapInArrow(work, "id bigint, n bigint, root bigint")


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Links between vectors whose cosine in double precision is ``cosine`` at least, as far as the index lets them meet (pairs
    of just that cosine with a chance of about RECALL, closer ones with more; never a pair below it).

    Returns for each input row: ``id_col`` long, ``n_links`` long (other rows linked with it), ``component_id`` long (the smallest
    id reachable, its own included), ``kept`` boolean (it is that id). Vectors that are null, empty or zero or hold a null or
    non-finite value link with nothing, nor do vectors of different lengths with each other. Equal vectors are linked. Rows of
    one id are one component, and each has its own links. A row without an id links with nothing: its component is
    null and it is kept. Other input columns are not read.
    """
    spark = vectors.sparkSession
    single = vectors.schema[vec_col].dataType.elementType.simpleString() == "float"
    width = "<f4" if single else "<f8"
    rows = vectors.select(vectors[id_col].cast("bigint").alias("id"), vectors[vec_col].cast("array<float>" if single else "array<double>").alias("vec"))
    signed = _signed(rows, width)
    able = signed.where("digest is not null and id is not null")
    grouped = able.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("vec").alias("vec"))
    classes = stored(grouped.withColumn("id", F.monotonically_increasing_id()), "vector-classes")  # a name of its own for each, as rows may repeat an id
    count = classes.count()
    length = classes.groupBy(F.octet_length("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    sample = classes.where(F.octet_length("vec") == length["n"]).orderBy(F.xxhash64("least"), "digest").limit(SAMPLE).select("vec").collect() if length else []
    units = _unit(np.frombuffer(b"".join(bytes(r.vec) for r in sample), width).reshape(len(sample), -1).astype(np.float64)) if sample else np.zeros((0, 1))
    wanted = min(SAMPLE // 2, max(FEWEST, 1 << max(0, math.ceil(math.log2(max(count, 1)) / 2))))
    pivots = choose_pivots(units[::2], wanted)
    visits, shared = fit(units[1::2], pivots, cosine)
    given = spark.sparkContext.broadcast(pivots)

    described = stored(_described(classes, given, width), "described")
    found = stored(_met(_dealt(described, visits, count // wanted), visits, shared, cosine, width), "vector-links")
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    # rows of one id are joined through the classes of their vectors
    names = stored(able.select("id", "digest"), "vector-digests")
    repeated = names.groupBy("id").agg(F.count_distinct("digest").alias("vectors")).where("vectors > 1")
    owned = names.join(repeated, "id", "left_semi").join(classes.select("digest", F.col("id").alias("class")), "digest").select("id", "class").distinct()
    joints = owned.join(owned.groupBy("id").agg(F.min("class").alias("a")), "id").where("a <> class").select("a", F.col("class").alias("b"))
    labels = components(found.where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b")).union(joints).distinct())
    discard(described)
    smallest = labels.join(classes.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("smallest"))
    labels = labels.join(smallest, "component").select("id", "smallest")
    told = classes.select("digest", "id", "least", "weight").join(links, "id", "left").join(labels, "id", "left")
    told = told.select("digest", F.coalesce("smallest", "least").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"))
    final = signed.select("id", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(told, "digest", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    out = final.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), own.alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))

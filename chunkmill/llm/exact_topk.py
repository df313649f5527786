"""Exact top-k by inner product with block-at-a-time pruning.

Vectors of integers are sorted by their *cell* (the signs of fixed random projections, read as a
number) and cut into *blocks* of ROWS rows, which so point the same way; rows of one cell, however
many, fill several. A block is packed into one row, its forward index, with its *term maxima*: per
dimension the largest component and the smallest (for negative weights). Of a query, the sum over
its terms of weight times the block's maximum bounds every score in the block. A *group* is a run of
neighbouring blocks, with the maxima of all of them.

Queries are packed into *lots* the same way. Blocks keep their size at any number of vectors; groups
grow, so that the maxima of all groups, which are broadcast, stay within BOUNDS_BYTES. The maxima of
blocks are rows, LEAF blocks each, that only lots which reach their group meet. A lot is first scored
in the SEEDS blocks that its queries bound highest, in the SEEDS groups that most of its queries
bound highest, which gives each query a k-th score; after that it is sent only to groups, and of
those only to blocks, in which the bound of one of its queries reaches that query's k-th score.
Inside a block, smaller blocks are taken in order of falling bound until the next bound is below the
k-th score so far. A row that many lots meet is copied for every MEET of them, so that no join key
is hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, stored

#: Rows of a block and of the blocks inside it; queries of a lot; groups, and blocks in them, that a lot begins with.
ROWS, BLOCK, LOT, SEEDS = 4096, 128, 512, 2
#: Bytes of all maxima that are broadcast; blocks whose maxima are one row; lots that meet one copy of a row.
BOUNDS_BYTES, LEAF, MEET = 32 << 20, 64, 64
#: Bytes of vectors that one task packs.
TASK_BYTES = 64 << 20
#: Projections whose signs make a cell.
PLANES = 24


def _finite(vector):
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def quantized(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id``, ``v`` array<long> = floor(scale * x), and ``top`` double, the largest magnitude in it;
    rows whose vector is null or holds a null or non-finite component are left out."""
    whole = F.transform(vectors[vector_col], lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    top = F.array_max(F.transform(vectors[vector_col], lambda x: F.abs(x.cast("double") * scale) + 1))
    return vectors.where(_finite(vectors[vector_col]) & vectors[id_col].isNotNull()).select(vectors[id_col].cast("bigint").alias("vec_id"), whole.alias("v"), F.coalesce(top, F.lit(0.0)).alias("top"))


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def search_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None, block: int = BLOCK) -> tuple[np.ndarray, ...]:
    """(query position, row position, score) of each query's k best rows (ties to the smaller id) whose
    score is not below its ``floor``, its own row left out. Components are integers, held as int64 or,
    where sums stay under 2**53, as float64."""
    least = np.iinfo(np.int64).min if rows.dtype == np.int64 else -np.inf
    order = np.lexsort((ids, *_signs(rows, 8).T))
    rows, ids = rows[order], ids[order]
    begins = np.arange(0, len(rows), block)
    bounds = _bounds(queries, np.maximum.reduceat(rows, begins), np.minimum.reduceat(rows, begins))
    by_bound = np.argsort(-bounds, axis=1, kind="stable")
    n = len(queries)
    best_score = np.full((n, k), least, rows.dtype)
    best_row = np.full((n, k), -1, np.int64)
    floor = np.full(n, least, rows.dtype) if floor is None else floor.astype(rows.dtype)
    live = np.arange(n)
    for turn in range(len(begins)):
        nth = by_bound[live, turn]
        # a bound equal to the k-th score may hide a tie with a smaller id
        live, nth = (x[bounds[live, nth] >= floor[live]] for x in (live, nth))
        if not len(live):
            break
        by_block = np.argsort(nth, kind="stable")
        for part in np.split(by_block, np.flatnonzero(np.diff(nth[by_block])) + 1):
            q, b = live[part], begins[nth[part[0]]]
            own = ids[b : b + block]
            scores = queries[q] @ rows[b : b + block].T
            places = np.broadcast_to(np.arange(b, b + len(own)), scores.shape)
            out = (query_ids[q][:, None] == own[None, :]) | (scores < floor[q][:, None])
            scores, places = np.where(out, least, scores), np.where(out, -1, places)
            pool = np.concatenate([best_score[q], scores], axis=1)
            pool_rows = np.concatenate([best_row[q], places], axis=1)
            pool_ids = np.where(pool_rows >= 0, ids[pool_rows], np.iinfo(np.int64).max)
            top = np.lexsort((pool_ids, ~pool if pool.dtype == np.int64 else -pool), axis=1)[:, :k]
            best_score[q] = np.take_along_axis(pool, top, 1)
            best_row[q] = np.take_along_axis(pool_rows, top, 1)
            floor[q] = np.maximum(floor[q], best_score[q, k - 1])
    q, j = np.nonzero(best_row >= 0)
    return q, order[best_row[q, j]], best_score[q, j]


def _signs(rows: np.ndarray, planes: int) -> np.ndarray:
    """On which side of fixed random planes each row lies."""
    return rows @ np.random.default_rng(7).standard_normal((rows.shape[1], PLANES))[:, :planes] > 0


def _matrix(column: pa.Array | pa.ChunkedArray, width: int, kind=np.float64) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(pa.compute.list_value_length(lists))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), kind)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _cut(batches, size: int):
    """The rows of the batches as tables of ``size`` rows, the last one shorter."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        while n >= size:
            whole = pa.Table.from_batches(held)
            yield whole.slice(0, size)
            held, n = whole.slice(size).to_batches(), n - size
    if n:
        yield pa.Table.from_batches(held)


def _packed(placed: DataFrame, rows: int, size: int, width: int, kind: str, tasks: int, groups: int, name: str) -> DataFrame:
    """Rows in order of their cells, ``size`` as one row: ``name`` (its number), ``group`` (at most ``groups`` of them,
    runs of neighbours), ``ids`` and ``values`` (in bytes), ``high`` and ``low`` (per dimension). ``rows``: about how many there are."""
    runs, joined = max(1, groups // tasks), -(-tasks // groups)
    per = max(1, -(-rows // (tasks * size * runs)))

    def work(batches):
        task = TaskContext.get().partitionId()
        for i, table in enumerate(_cut(batches, size)):
            ids = table.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            values = _matrix(table.column("v"), width, np.int64)[order]
            ends = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (values.max(axis=0), values.min(axis=0))]
            group = task // joined * runs + min(i // per, runs - 1)
            yield pa.RecordBatch.from_arrays([pa.array([task << 32 | i]), pa.array([group]), pa.array([ids[order].tobytes()], pa.binary()), pa.array([values.astype(kind).tobytes()], pa.binary()), *ends], [name, "group", "ids", "values", "high", "low"])

    # the hashed id splits a cell that holds many rows
    sorted_rows = placed.repartitionByRange(tasks, "cell", F.xxhash64("vec_id")).sortWithinPartitions("cell", F.xxhash64("vec_id")).select("vec_id", "v")
    return stored(sorted_rows.mapInArrow(work, f"{name} bigint, group bigint, ids binary, values binary, high array<bigint>, low array<bigint>"), name)


def _meeting(pairs: DataFrame, lots: DataFrame, others: DataFrame, on: str) -> DataFrame:
    """Stored pairs of ``lot`` and ``on`` with the columns of both sides; a row of ``others`` is copied for every MEET lots."""
    nth = F.row_number().over(Window.partitionBy(on).orderBy("lot")) - 1
    dealt = pairs.withColumn("nth", nth).select("lot", on, F.floor(F.col("nth") / MEET).alias("slice"), (F.col("nth") % MEET == 0).alias("leads"))
    copies = dealt.where("leads").select(on, "slice").join(others, on)
    return dealt.drop("leads").join(lots, "lot").join(copies, [on, "slice"]).drop("slice")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best candidates of each query: rows whose id is divisible by ``every`` against all
    other rows, by inner product of floor(scale * x).

    Returns ``query_id`` long, ``rank`` int (from 1), ``vec_id`` long, ``score`` long; ties go to
    the smaller id; fewer rows where there are fewer candidates. Vectors that are null or hold a
    null or non-finite component take no part. Candidates are the rows with another id than the
    query's; repeated rows are candidates each; of several rows with a query's id, the greatest
    vector is the query. Vectors of different lengths are compared as if padded with zeros. Where a
    score could exceed a long, ``OverflowError`` is raised.
    """
    spark = vectors.sparkSession
    rows = stored(quantized(vectors, scale, id_col, vector_col), "vectors")
    n, width, top = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max("top")).first()
    width, top = max(width or 0, 1), top or 0.0
    if top * top * width >= 2.0**63:
        raise OverflowError(f"components up to {top:g} in {width} dimensions could give scores beyond 64 bits")
    exact = np.float64 if top * top * width < 2.0**53 else np.int64
    kind = next(t for t, bits in (("<i2", 15), ("<i4", 31), ("<i8", 64)) if top < 2.0**bits)
    groups = max(BOUNDS_BYTES // (16 * width), 16)
    tasks = max(1, -(-n * width * 8 // TASK_BYTES))

    def cells(batches):
        for batch in batches:
            signs = _signs(_matrix(batch.column("v"), width), PLANES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signs @ (1 << np.arange(PLANES)[::-1]), pa.int64())], ["vec_id", "v", "cell"])

    placed = rows.select("vec_id", "v").mapInArrow(cells, "vec_id bigint, v array<bigint>, cell bigint")
    blocks = _packed(placed, n, ROWS, width, kind, tasks, groups, "block")
    asked = placed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max(F.struct("v", "cell")).alias("q")).select("vec_id", "q.*")
    lots = _packed(asked, -(-n // every), LOT, width, kind, -(-tasks // every), 1, "lot").select("lot", "ids", "values")
    leaves = blocks.groupBy("group", F.shiftright("block", LEAF.bit_length() - 1).alias("leaf")).agg(F.collect_list(F.struct("block", "high", "low")).alias("ends")).drop("leaf")
    ends = blocks.select("group", F.posexplode(F.arrays_zip("high", "low"))).groupBy("group", "pos").agg(F.max("col.high").alias("high"), F.min("col.low").alias("low"))
    ends = ends.toArrow().sort_by([("group", "ascending"), ("pos", "ascending")])  # within BOUNDS_BYTES
    sent = spark.sparkContext.broadcast((ends.column("group").to_numpy()[::width], *(ends.column(c).to_numpy().reshape(-1, width).astype(exact) for c in ("high", "low"))))

    def unpacked(batch, prefix, i):
        ids = np.frombuffer(batch.column(f"{prefix}ids")[i].as_py(), np.int64)
        return ids, np.frombuffer(batch.column(f"{prefix}values")[i].as_py(), kind).reshape(-1, width).astype(exact)

    def leaf(batch, i):
        own = batch.column("ends")[i].values
        return own.field("block").to_numpy(), *(_matrix(own.field(c), width, exact) for c in ("high", "low"))

    def chosen(batch, i, *found):
        return pa.RecordBatch.from_arrays([pa.array([batch.column("lot")[i].as_py()] * len(found[0]), pa.int64()), *map(pa.array, found)], ["lot", "group"] if len(found) == 1 else ["lot", "block", "weight"])

    def seed_groups(batches):
        names, high, low = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                votes = np.bincount(_bounds(unpacked(batch, "", i)[1], high, low).argmax(axis=1), minlength=len(names))
                yield chosen(batch, i, names[[j for j in np.argsort(-votes, kind="stable")[:SEEDS] if votes[j]]])

    def weighed(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                names, high, low = leaf(batch, i)
                yield chosen(batch, i, names, _bounds(unpacked(batch, "", i)[1], high, low).sum(axis=0, dtype=np.float64))

    def reached_groups(batches):
        names, high, low = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, queries = unpacked(batch, "", i)
                floor, _ = _floors(ids, batch.column("floors")[i].as_py(), exact)
                yield chosen(batch, i, names[(_bounds(queries, high, low) >= floor[:, None]).any(axis=0)])

    def reached_blocks(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, queries = unpacked(batch, "", i)
                floor, _ = _floors(ids, batch.column("floors")[i].as_py(), exact)
                names, high, low = leaf(batch, i)
                hit = (_bounds(queries, high, low) >= floor[:, None]).any(axis=0) & ~np.isin(names, batch.column("done")[i].as_py() or [])
                yield chosen(batch, i, names[hit], np.zeros(hit.sum()))

    def scored(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                query_ids, queries = unpacked(batch, "", i)
                ids, values = unpacked(batch, "b_", i)
                floor, last = _floors(query_ids, batch.column("floors")[i].as_py(), exact)
                q, r, score = search_block(queries, query_ids, values, ids, k, floor)
                # a tie with the k-th row so far needs a smaller id
                better = (score > floor[q]) | (ids[r] < last[q])
                q, r, score = q[better], r[better], score[better]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("lot")[i].as_py()] * len(q), pa.int64()), pa.array(query_ids[q]), pa.array(ids[r]), pa.array(score.astype(np.int64))], ["lot", "query_id", "vec_id", "score"])

    packed_blocks = blocks.select("block", F.col("ids").alias("b_ids"), F.col("values").alias("b_values"))
    pair, weighted = "lot bigint, group bigint", "lot bigint, block bigint, weight double"

    def met(pairs, lots):
        return _meeting(pairs, lots.select("lot", "ids", "values", "floors"), packed_blocks, "block").mapInArrow(scored, "lot bigint, query_id bigint, vec_id bigint, score bigint")

    first_groups = stored(lots.mapInArrow(seed_groups, pair), "seed-groups")
    highest = Window.partitionBy("lot").orderBy(F.desc("weight"), "block")
    first = _meeting(first_groups, lots, leaves, "group").mapInArrow(weighed, weighted)
    first = stored(first.withColumn("nth", F.row_number().over(highest)).where(F.col("nth") <= SEEDS).select("lot", "block"), "seeds")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    found = stored(ranked(met(first, lots.withColumn("floors", F.lit(None).cast("array<struct<query_id:bigint,floor:bigint,last:bigint>>")))).drop("rank"), "found")
    floors = found.groupBy("lot", "query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor"), F.min_by("vec_id", F.struct("score", -F.col("vec_id"))).alias("last")).where(F.col("n") >= k)
    floors = floors.groupBy("lot").agg(F.collect_list(F.struct("query_id", "floor", "last")).alias("floors"))
    known = lots.join(floors, "lot", "left").join(first.groupBy("lot").agg(F.collect_list("block").alias("done")), "lot", "left")
    known = stored(known, "lots-known")
    near = stored(known.select("lot", "ids", "values", "floors").mapInArrow(reached_groups, pair), "near-groups")
    rest = stored(_meeting(near, known, leaves, "group").mapInArrow(reached_blocks, weighted).select("lot", "block"), "near-blocks")
    result = stored(ranked(found.unionByName(met(rest, known))).select("query_id", "rank", "vec_id", "score"), "top")
    discard(rows, blocks, lots, first_groups, first, found, known, near, rest)
    return result


def _floors(ids: np.ndarray, known: list | None, kind) -> tuple[np.ndarray, np.ndarray]:
    """The k-th score of each query that has one, else the least value, and the id of that row, else the largest."""
    least, most = np.iinfo(np.int64).min if kind == np.int64 else -np.inf, np.iinfo(np.int64).max
    floor = {x["query_id"]: (x["floor"], x["last"]) for x in known or ()}
    return np.array([floor.get(i, (least, most))[0] for i in ids.tolist()], kind), np.array([floor.get(i, (least, most))[1] for i in ids.tolist()], np.int64)

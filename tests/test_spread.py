"""Hot keys: numbers by ranges, facts beside frequent keys, rows in place of arrays, hostile child keys."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chunkmill.operators import spread
from chunkmill.functions.values import parse_child_key
from chunkmill.llm.shared import stored
from chunkmill.operators import group, link, spread
from chunkmill.sources.resources import BATCH_BYTES, _bytes, kept


def test_numbers_equal_a_sort(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(50)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, x int, i int").repartition(7)
    got = spread.numbered(df, ["k"], [F.asc_nulls_last("x"), "i"], "place", total="n")
    assert got.columns == ["k", "x", "i", "place", "n"]
    want = set()
    for k in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        want |= {(*r, place, len(own)) for place, r in enumerate(own, 1)}
    assert {tuple(r) for r in got.collect()} == want
    assert spread.numbered(df.limit(0), ["k"], ["i"], "place").count() == 0


def test_facts_beside_frequent_and_rare_keys(spark, monkeypatch):
    monkeypatch.setattr(spread, "FREQUENT", 4)
    rows = [("c", k, i) for i, k in enumerate(["hot"] * 90 + ["x", "y", "x", None, "z"])]
    df = spark.createDataFrame(rows, "c string, k string, i int")
    facts = spark.createDataFrame([("c", "hot", 90, 1), ("c", "x", 2, 2)], "c string, k string, members bigint, more int")
    got = {r.i: (r.members, r.more) for r in spread.beside(df, ["c", "k"], facts, "members").collect()}
    assert got == {i: {"hot": (90, 1), "x": (2, 2)}.get(k, (None, None)) for _, k, i in rows}
    assert spread.beside(df, ["c", "k"], facts.limit(0), "members").where("members is null").count() == len(rows)


def test_ids_beyond_64_bits_are_rejected(spark):
    keys = ["Range_u:0000:7fffffffffffff", "Range_u:0000:7ffffffffff", "Range_u:0000:fffffffffffffff", "Range_u:0000:zz"]
    rows = spark.createDataFrame([(k,) for k in keys], "key string").select("key", F.inline(F.array(parse_child_key(F.col("key"))))).collect()
    assert {r.key: (r.child_id, r.offset_bytes, r.reject_reason) for r in rows} == {keys[0]: (0x7FFFFFFFFFFFFF, None, "offset-overflow"), keys[1]: (0x7FFFFFFFFFF, 0x7FFFFFFFFFF << 20, None), keys[2]: (0xFFFFFFFFFFFFFFF, None, "offset-overflow"), keys[3]: (0, 0, None)}
    entries = spark.createDataFrame([("c", "u", True, 1)], "cache_dir string, url string, is_sparse boolean, ord bigint")
    kids = spark.createDataFrame([("c", k, 1, "f_000001", True) for k in keys], "cache_dir string, child_key string, size bigint, file_name string, is_external boolean")
    assert link.linked_parents(entries, kids).first().n_children == 2 and link.child_rows(entries, kids).count() == 2
    assert link.link_sparse_children(entries, kids).first().n_children == 2 and link.link_stats(entries, kids).first().children_linked == 2


def test_a_million_children_and_files_of_one_url(spark):
    n = 1_000_000
    entries = spark.createDataFrame([("c", "u", True, 1)], "cache_dir string, url string, is_sparse boolean, ord bigint")
    kids = spark.range(n).select(F.lit("c").alias("cache_dir"), F.concat(F.lit("Range_u:0000:"), F.lower(F.hex("id"))).alias("child_key"), F.lit(1).cast("bigint").alias("size"), F.format_string("f_%06x", "id").alias("file_name"), F.lit(True).alias("is_external"))
    row = link.linked_parents(entries, kids).first()
    assert (row.n_children, row.body_size, row.last_offset) == (n, n, (n - 1) << 20)
    assert link.child_rows(entries, kids).where("offset_bytes = child_id * 1048576").count() == n
    resources = spark.createDataFrame([("c", i, "u", 0, i == 1) for i in range(3)], "cache_dir string, ord bigint, index_url string, total_size bigint, authoritative boolean")
    files = spark.range(n).select(F.lit("c").alias("cache_dir"), (F.col("id") % 3).alias("ord"), F.col("id").alias("place"), F.format_string("f_%06x", F.floor(F.col("id") / 2)).alias("name"), F.lit(2).cast("bigint").alias("size"))
    one, merged = group.merge_resources_by_url(resources, files)
    assert [tuple(r) for r in one.collect()] == [("c", "u", 1, n, 3)] and merged.count() == n // 2
    assert merged.where("place.turn = 0").count() == -(-(n - 1) // 3)


def test_tasks_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(spread, "TASK_ROWS", 50)
    rows = spark.range(1000).selectExpr("id", "id % 300 as k")
    got = spread.dealt(rows, ["k"])
    assert got.rdd.getNumPartitions() == 20 and got.count() == 1000
    assert max(map(len, got.rdd.glom().collect())) < 150
    assert got.selectExpr("k", "spark_partition_id() as p").distinct().count() == 300
    assert spread.dealt(rows.limit(40), ["k"]).count() == 40


def _sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["bytes"])


@pytest.mark.parametrize("store", [kept, lambda df: stored(df, "sizes")])
def test_stored_frames_send_small_batches(spark, store):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    rows = spark.range(0, 9000, 1, 1).select(F.repeat(F.lit("x"), 2000).alias("text"))
    assert store(rows.mapInArrow(_sizes, "bytes bigint")).agg(F.max("bytes")).first()[0] < 2 * BATCH_BYTES
    assert spark.conf.get(name, None) == before


def test_broadcasts_do_not_grow_with_stored_rows(spark):
    """Files below the threshold, rows above it: by its files' size the table would go through the driver."""
    left, right = (kept(spark.range(n).select(F.lit("dir0").alias("cache_dir"), "id")) for n in (1 << 20, 1 << 19))
    assert 0 < sum(os.path.getsize(p.removeprefix("file://")) for p in right.inputFiles()) < 10 << 20
    for rows, told in ((right, False), (right.where("id < 100000"), False), (right.where("id < 10"), True)):
        met = left.join(rows, ["cache_dir", "id"]).agg(F.count(F.lit(1)).alias("n"))
        assert met.first().n == rows.count()
        run = met._jdf.queryExecution()
        met.collect()
        assert ("BroadcastHashJoin" in run.executedPlan().toString().split("Initial Plan")[0]) == told
    assert [_bytes(x) for x in ("10485760b", "256k", "10MB", "-1", "7")] == [10 << 20, 256 << 10, 10 << 20, -1, 7]

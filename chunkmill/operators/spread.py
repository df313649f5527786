"""Work on hot keys that no single task has to hold: running numbers by ranges, and joins beside frequent keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.resources import kept

#: A key with more than one in so many of all rows is frequent, so there are fewer frequent keys than this.
FREQUENT = 4096
#: Rows that a task holds on average where windows go over keys.
TASK_ROWS = 200_000


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` shuffled by ``keys`` into as many partitions as they have times TASK_ROWS, so that a task's sorts hold no more on a larger
    table; fewer than the session's partitions are left to the next operator."""
    n = -(-rows.count() // TASK_ROWS)
    return rows.repartition(n, *keys) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], number: str, total: str | None = None) -> DataFrame:
    """Adds ``number``, 1, 2 ... within ``keys`` by ``order``, and with ``total`` how many rows the keys have.

    The rows are sorted in ranges of (keys, order), whatever the keys' sizes are, and stored once; each range counts its
    rows of a key, and these counts, a row for each key and range, are added up before they are joined back. ``order``
    decides ties, so it should have none.
    """
    ranged = kept(rows.orderBy(*keys, *order).withColumn("_at", F.monotonically_increasing_id()))
    place = F.shiftright("_at", 33).alias("_range")
    counts = ranged.groupBy(*keys, place).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy(*keys))})
    counts = counts.select("_range", "_first", "_before", "_all", *(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)))
    same = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]
    met = ranged.join(counts, [*same, F.shiftright("_at", 33) == F.col("_range")])
    extra = [F.col("_all").alias(total)] if total else []
    return met.select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(number), *extra)


def beside(rows: DataFrame, keys: list[str], facts: DataFrame, weight: str) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has each of some ``keys`` once (else null). ``weight``, one of them, says how
    many rows a key has. Rows of frequent keys get their facts from a broadcast of these (fewer than FREQUENT, by their
    weights), those of null keys get none, and only the rest is shuffled."""
    facts = kept(facts)
    told = [c for c in facts.columns if c not in keys]
    least = (facts.agg(F.sum(weight).alias("n")).first()["n"] or 0) / FREQUENT
    met = rows.join(F.broadcast(facts.where(F.col(weight) > least)), keys, "left").select(*rows.columns, *told)
    done = F.col(weight).isNotNull()
    for k in keys:
        done = done | F.col(k).isNull()
    rare = met.where(~done).drop(*told).join(facts.where(F.col(weight) <= least), keys, "left")
    return met.where(done).unionByName(rare.select(*rows.columns, *told))

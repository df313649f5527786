"""Exact de-duplication with a heavy-hitter split, in DataFrame functions only.

Only digests move, never texts. A Misra-Gries summary (Spark's frequent-items sketch behind
``approx_top_k``, of a fixed number of counters) names the digests that may be frequent; an exact,
map-side combined count verifies them. The verified winners, at most ``counters`` rows, are
broadcast, so rows of frequent texts are settled where they are read. What is left holds no large
group and is settled by an ordinary shuffle on the digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import broadcast_if_few, folded, stored

#: Counters of the summary; any text that makes up more than about 4 / COUNTERS of the rows is found.
COUNTERS = 4096


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """Mark, of equal texts (after lower-casing A-Z only), the row with the largest id as kept.

    Returns a row for each input row: ``id_col``, ``keep_id`` (the id that stays), ``group_size``
    long, ``kept`` boolean, ``text_sha256`` string (lower-case hex of the normalised text in
    UTF-8). Null text counts as empty. Rows with the same text and the same id are the same
    document and are marked alike; a null id never stays unless its group has no other
    (then ``keep_id`` is null and ``kept`` true). Other input columns are not read.
    """
    digests = stored(docs.select(docs[id_col].alias("key"), F.unhex(F.sha2(folded(docs[text_col]), 256)).alias("digest")), "digests")
    frequent = digests.agg(F.expr(f"approx_top_k(hex(digest), {counters}, {4 * counters})").alias("top"))
    candidates = frequent.select(F.explode("top.item").alias("item")).select(F.unhex("item").alias("digest"))
    settled = (F.max("key").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # at most ``counters`` rows of under 100 bytes
    winners = digests.join(F.broadcast(candidates), "digest").groupBy("digest").agg(*settled).where("group_size > 1")
    winners = stored(winners, "frequent-digests")
    marked = digests.join(F.broadcast(winners), "digest", "left")
    heavy = marked.where(F.col("group_size").isNotNull())
    group = Window.partitionBy("digest")
    light = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select(
        "digest", "key", F.max("key").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size")
    )
    both = heavy.select("digest", "key", "keep_id", "group_size").unionByName(light)
    return both.select(F.col("key").alias(id_col), "keep_id", "group_size", F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts (A-Z folded, null as empty)
    the one with the largest id, null ids being smaller than any. Of rows that repeat this id and its text one stays,
    whichever it is. An empty table stays empty. Columns of any name pass through."""
    marked = mark_copies(docs, id_col, text_col)
    unlike = "_" * max(map(len, docs.columns))  # longer than any name in use
    key, sha = f"{unlike}id", f"{unlike}sha"
    own = docs.select("*", docs[id_col].alias(key), F.sha2(folded(docs[text_col]), 256).alias(sha))
    same = lambda other: own[key].eqNullSafe(other["_id"]) & (own[sha] == other["_sha"])
    gone = marked.where("not kept").select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    repeated = marked.where("kept").groupBy(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id", "_sha")
    repeated = stored(repeated, "repeated-rows")
    other = broadcast_if_few(stored(gone.unionByName(repeated), "rows-apart"), 1 << 19)
    single = own.join(other, same(other), "left_anti")
    if not repeated.limit(1).count():
        return single.drop(key, sha)
    return single.unionByName(own.join(repeated, same(repeated), "left_semi").dropDuplicates([key, sha])).drop(key, sha)

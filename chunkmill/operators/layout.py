"""Layout of recovered bodies as segment rows, before any byte is touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spread import dealt, numbered


def sparse_size(ranges: DataFrame, key: str = "resource_id") -> DataFrame:
    """Size of a sparse body: the largest end of its ranges, 0 if none is valid."""
    end = F.when((F.col("range_offset") >= 0) & (F.col("range_length") >= 0), F.col("range_offset") + F.col("range_length"))
    return ranges.groupBy(key).agg(F.coalesce(F.max(end), F.lit(0)).alias("sparse_size"))


def chunk_size_stats(chunks: DataFrame, key: str, size: str) -> DataFrame:
    """Most common chunk size (the larger one of a tie), the largest, and the number of chunks."""
    counted = chunks.groupBy(key, size).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(key).agg(F.max_by(size, F.struct("n", size)).alias("modal_size"), F.max(size).alias("max_size"), F.sum("n").alias("n_chunks"))


def segment_plan_sparse(ranges: DataFrame, key: str = "resource_id") -> DataFrame:
    """Segments of a sparse body: ``rank`` (of the range they come with), ``kind``, ``out_offset``,
    ``length``. Ranges are written in order of offset (ties by all columns), so where two overlap the
    later one wins: a range's own ``data`` ends where the next begins; ``earlier`` is what a longer
    range before it shows behind its end; ``zero`` is a hole before it, a leading one too. Empty
    ranges are left out.
    """
    order = Window.partitionBy(key).orderBy("range_offset", "range_length", "seq")
    rows = ranges.where("range_length > 0").withColumns({"nxt": F.lead("range_offset").over(order), "reach": F.max(F.col("range_offset") + F.col("range_length")).over(order.rowsBetween(Window.unboundedPreceding, -1)), "rank": F.row_number().over(order)})
    end = F.col("range_offset") + F.col("range_length")
    data = rows.select(key, "rank", F.lit("data").alias("kind"), F.col("range_offset").alias("out_offset"), F.least(F.col("range_length"), F.coalesce(F.col("nxt") - F.col("range_offset"), F.col("range_length"))).alias("length"))
    hole = rows.where(F.col("range_offset") > F.coalesce("reach", F.lit(0))).select(key, "rank", F.lit("zero").alias("kind"), F.coalesce("reach", F.lit(0)).alias("out_offset"), (F.col("range_offset") - F.coalesce("reach", F.lit(0))).alias("length"))
    # the tail of the longest earlier range that shows behind this one
    again = rows.where(F.col("reach") > end).select(key, "rank", F.lit("earlier").alias("kind"), end.alias("out_offset"), (F.least("reach", F.coalesce("nxt", F.col("reach"))) - end).alias("length"))
    return data.unionByName(hole).unionByName(again).where("length > 0")


def recoverable(ranges: DataFrame, key: str = "resource_id") -> DataFrame:
    """Bytes there, missing and in all, of each sparse body."""
    plan = segment_plan_sparse(ranges, key)
    missing = F.coalesce(F.sum(F.when(F.col("kind") == "zero", F.col("length"))), F.lit(0))
    return plan.groupBy(key).agg(F.sum("length").alias("total_bytes"), missing.alias("missing_bytes"))


def strip_duplicate_moov(boxes: DataFrame, key: str = "file_id") -> DataFrame:
    """Top-level boxes without repeated ``moov``: the first stays, if there are several; ``new_offset`` is
    where a kept box then lies, ``moov_found`` how many there were."""
    order = Window.partitionBy(key).orderBy("box_offset", "tie", "box_size", "box_type")
    moov = (F.col("box_type") == "moov").cast("int")
    ranked = boxes.withColumns({"nth": F.sum(moov).over(order), "moov_found": F.sum(moov).over(Window.partitionBy(key))})
    kept = ranked.where((F.col("box_type") != "moov") | (F.col("nth") == 1))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return kept.withColumn("new_offset", F.coalesce(F.sum("box_size").over(before), F.lit(0))).drop("nth")


def last_valid_moov(hits: DataFrame, key: str = "file_id") -> DataFrame:
    """Of the plausible ``moov`` boxes of a file (500 to 2,000,000 bytes), the last."""
    good = hits.where((F.col("box_type") == "moov") & F.col("box_size").between(500, 2_000_000))
    last = F.max(F.struct("box_offset", "box_size", "tie"))
    return good.groupBy(key).agg(last.alias("_m")).select(key, "_m.box_offset", "_m.box_size")


def refine_mp4(boxes: DataFrame, key: str = "file_id") -> DataFrame:
    """``mp4_complete`` if the top-level boxes have both moov and mdat, else ``mp4_header_only``."""
    has = lambda t: F.bool_or(F.col("box_type") == t)
    return boxes.groupBy(key).agg(F.when(has("moov") & has("mdat"), "mp4_complete").otherwise("mp4_header_only").alias("file_type"))


def order_chunks(chunks: DataFrame, key: str, hex_value: str = "hex_value") -> DataFrame:
    """``place`` of each chunk in its group by position, chunks without one last. A group may have any number."""
    return numbered(chunks, [key], [F.asc_nulls_last(hex_value), "name"], "place")


def pick_tail(chunks: DataFrame, key: str = "resource_id") -> DataFrame:
    """The tail of each group: the first chunk below the modal size that holds a valid moov, else the
    first of any size that holds one. Needs ``ord``, ``size``, ``modal_size``, ``has_moov``."""
    hit = chunks.where("has_moov").withColumn("_p", F.struct((F.col("size") >= F.col("modal_size")).cast("int"), F.col("ord")))
    return hit.groupBy(key).agg(F.min_by("ord", "_p").alias("tail_ord"))


def chunk_roles(chunks: DataFrame, key: str = "resource_id") -> DataFrame:
    """Adds ``tail_ord`` and ``role`` of each chunk: ``tail``; ``duplicate``, another one with a valid moov
    that has not the modal size; ``foreign``, one below the modal size that looks like a whole file of
    another kind; else ``middle``. ``plain``: whether a plain concatenation has it, which also leaves out
    foreign ones above the modal size. Needs ``standalone`` besides the columns of ``pick_tail``."""
    known = chunks.join(pick_tail(chunks, key), key, "left")
    odd, moov = F.col("size") != F.col("modal_size"), F.coalesce("has_moov", F.lit(False))
    role = F.when(F.col("ord") == F.col("tail_ord"), "tail").when(odd & moov, "duplicate").when((F.col("size") < F.col("modal_size")) & F.col("standalone"), "foreign").otherwise("middle")
    return known.withColumn("role", role).withColumn("plain", (F.col("role") == "tail") | (F.col("role") == "middle") & ~(odd & F.col("standalone")))


def _be(number: Column, size: int) -> Column:
    """A non-negative integer, most significant byte first."""
    return F.unhex(F.lpad(F.hex(number), 2 * size, "0"))


def _mdat_head(size: Column, head: Column) -> Column:
    """Box head of ``head`` bytes (8 or 16); a size that does not fit 32 bits is capped in the short one."""
    return F.when(head == 16, F.concat(F.lit((1).to_bytes(4, "big") + b"mdat"), _be(size, 8))).otherwise(F.concat(_be(F.least(size, F.lit((1 << 32) - 1)), 4), F.lit(b"mdat")))


_SEGMENT = ["kind", "source", "src_offset", "length", "out_offset", "literal"]


def _segment(kind: str, source, src_offset, length, literal=None) -> list[Column]:
    none = F.lit(None)
    long = lambda c: (none if c is None else c).cast("bigint")
    return [F.lit(kind).alias("kind"), long(source).alias("source"), long(src_offset).alias("src_offset"), length.cast("bigint").alias("length"), (none if literal is None else literal).cast("binary").alias("literal")]


def segment_plan_chunks(pieces: DataFrame, key: str = "resource_id", by_key: bool = False) -> DataFrame:
    """Segments of each chunked MP4, before any byte is touched: ``key``, ``seq``, ``kind``, ``source`` (``ord`` of a piece),
    ``src_offset``, ``length``, ``out_offset``, ``literal``, ``error``.

    ``pieces``: ``key``, ``ord``, ``is_header`` (one a key), ``hex_value`` (null where the name has none) and the columns of
    ``bodies.piece_facts``. The chunks that stay (``chunk_roles``) follow the header by position, those without
    one last, then the tail. Where the last valid moov of that concatenation begins behind its middle, the
    header is taken apart: what lies before its mdat, a new mdat head, its media, each chunk after zeros
    for the positions missing before it, and the tail's bytes before its moov; then mdat is padded with
    zeros to the size it declared, or kept longer if that is more than twice as large, or else cut; the
    tail's moov ends the file. Otherwise the concatenation is the plan. A header without ftyp or mdat
    gives one row with ``error``. A moov that runs over the end of a piece counts if its mvhd is in the piece.

    Pieces are shuffled once, by ``key``, into tasks of bounded size (unless they come so, ``by_key``): all that follows
    are windows of that partitioning, and each piece then makes its own segments from running sums.
    """
    pieces = pieces if by_key else dealt(pieces, [key])
    whole = Window.partitionBy(key)
    line = whole.orderBy("phase", "place")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    chunk, named = ~F.col("is_header"), lambda *c: F.struct(*c)

    # header, most common chunk size, tail: facts of the key beside each of its pieces
    head = F.max(F.when(F.col("is_header"), named("ord", "size", "hex_value", "ftyp_offset", "ftyp_size", "mdat_offset", "mdat_size", "mdat_head"))).over(whole)
    rows = pieces.withColumn("h", head).where("h is not null")
    rows = rows.withColumn("alike", F.count(F.when(chunk, 1)).over(Window.partitionBy(key, "size")))
    rows = rows.withColumn("modal_size", F.max(F.when(chunk, named("alike", "size"))).over(whole)["size"])
    moov = F.col("moov_offset").isNotNull()
    tail = F.min(F.when(chunk & moov, named((F.col("size") >= F.col("modal_size")).alias("late"), "ord", "hex_value", "moov_offset", "moov_size"))).over(whole)
    odd = F.col("size") != F.col("modal_size")
    role = F.when(F.col("is_header"), "header").when(F.col("ord") == F.col("t.ord"), "tail").when(odd & moov, "duplicate").when((F.col("size") < F.col("modal_size")) & F.col("standalone"), "foreign").otherwise("middle")
    rows = rows.withColumn("t", tail).withColumn("role", role).where("role not in ('duplicate', 'foreign')")

    # the concatenation: header, middle chunks, tail
    able = F.col("h.ftyp_offset").isNotNull() & F.col("h.mdat_offset").isNotNull()
    phase = F.when(F.col("role") == "header", 0).when(F.col("role") == "middle", 1).otherwise(2)
    rows = rows.withColumns({"phase": phase, "place": named(F.col("hex_value").isNull().alias("unnamed"), "hex_value", "ord"), "plain": able & ((F.col("role") != "middle") | ~(odd & F.col("standalone")))})
    length = F.when(F.col("plain"), F.col("size")).otherwise(zero)
    middle = F.col("role") == "middle"
    last_hex = F.coalesce(F.last(F.when(middle, F.col("hex_value")), ignorenulls=True).over(before), F.col("h.hex_value"))
    rows = rows.withColumns({"at": F.coalesce(F.sum(length).over(before), zero), "nth": F.count(F.when(F.col("plain"), 1)).over(line), "last_hex": last_hex, "all": F.sum(length).over(whole)})
    over = F.when(F.col("at") + F.col("cut_offset") + F.col("cut_size") <= F.col("all"), F.col("at") + F.col("cut_offset"))
    hit = F.when(F.col("plain"), F.greatest(F.col("at") + F.col("moov_offset"), over))
    gap = F.greatest(F.col("hex_value") - F.col("last_hex") - 1, F.lit(0))
    gap = F.coalesce(F.greatest(gap - F.coalesce((F.col("t.hex_value") > F.col("last_hex")) & (F.col("t.hex_value") < F.col("hex_value")), F.lit(False)).cast("int"), F.lit(0)), F.lit(0))
    rows = rows.withColumns({"streamed": F.coalesce(F.max(hit).over(whole) > F.floor(F.col("all") / 2), F.lit(False)), "hole": F.when(middle, gap * F.col("modal_size")).otherwise(zero)})

    # the header taken apart
    more = F.when(middle, F.col("hole") + F.col("size")).otherwise(zero)
    h = lambda c: F.col(f"h.{c}")
    rows = rows.withColumns({"behind": F.coalesce(F.sum(more).over(before), zero), "chunks": F.sum(more).over(whole), "prefix": F.greatest(h("mdat_offset") - h("ftyp_offset"), h("ftyp_size")), "media_at": h("mdat_offset") + h("mdat_head")})
    rows = rows.withColumn("media", F.greatest(h("size") - F.col("media_at"), zero))
    rows = rows.withColumn("begun", F.col("prefix") + h("mdat_head") + F.col("media"))
    rows = rows.withColumn("end", F.col("begun") + F.col("chunks") + F.coalesce("t.moov_offset", zero))
    actual = F.col("end") - F.col("prefix")
    rows = rows.withColumn("final", F.when(actual > h("mdat_size") * 2, actual).otherwise(h("mdat_size"))).withColumn("stop", F.col("prefix") + F.col("final"))

    none, here = F.lit(None), F.col("begun") + F.col("behind")

    def segment(sub, out, kind, source, src_offset, length, literal=None, cut=True):
        length = F.least(length, F.col("stop") - out) if cut else length
        return F.struct(F.lit(sub).alias("sub"), *_segment(kind, source, src_offset, length, literal), out.cast("bigint").alias("out_offset"))

    parts = F.when(middle, F.array(segment(0, here, "zero", None, None, F.col("hole")), segment(1, here + F.col("hole"), "data", F.col("ord"), zero, F.col("size"))))
    parts = parts.when(F.col("role") == "tail", F.array(segment(0, here, "tail", F.col("ord"), zero, F.col("moov_offset"))))
    parts = parts.otherwise(
        F.array(
            segment(0, zero, "prefix", F.col("ord"), F.col("ftyp_offset"), F.col("prefix"), cut=False), segment(1, F.col("prefix"), "mdat head", None, None, F.col("mdat_head"), _mdat_head(F.col("final"), F.col("mdat_head")), cut=False),
            segment(2, F.col("prefix") + F.col("mdat_head"), "media", F.col("ord"), F.col("media_at"), F.col("media")),
            segment(3, F.col("end"), "zero", None, None, F.col("prefix") + F.col("mdat_size") - F.col("end"), cut=False), segment(4, F.col("stop"), "moov", F.col("t.ord"), F.col("t.moov_offset"), F.col("t.moov_size"), cut=False),
        )
    )
    joined = F.when(F.col("plain"), F.array(segment(0, F.col("at"), "data", F.col("ord"), zero, F.col("size"), cut=False)))
    failed = F.when(F.col("role") == "header", F.array(F.struct(F.lit(0).alias("sub"), none.cast("string").alias("kind"), *(none.cast("binary" if c == "literal" else "bigint").alias(c) for c in ("source", "src_offset", "length", "literal", "out_offset")))))
    made = rows.withColumn("error", F.when(h("ftyp_offset").isNull(), "no ftyp box").when(h("mdat_offset").isNull(), "no mdat box"))
    made = made.withColumn("parts", F.when(F.col("error").isNotNull(), failed).when(F.col("streamed"), parts).otherwise(joined))
    made = made.select(key, "phase", "place", "nth", "streamed", "error", F.explode("parts").alias("p")).select("*", "p.*").where("length > 0 or error is not null")
    # what ends the file comes after the tail
    ranked = whole.orderBy(F.when((F.col("phase") == 0) & F.col("sub").isin(3, 4), 3).otherwise(F.col("phase")), "place", "sub")
    number = F.when(F.col("error").isNotNull(), zero).when(F.col("streamed"), F.row_number().over(ranked).cast("bigint")).otherwise(F.col("nth"))
    return made.select(key, number.alias("seq"), *_SEGMENT, "error")


def segment_plan_index(raw: DataFrame, key: str = "resource_id") -> DataFrame:
    """Segments of a body that was laid out by an index's offsets, piece 0, from its ``bodies.piece_facts``: columns as of
    ``segment_plan_chunks`` but ``error``. With ftyp and mdat: what lies before mdat, an mdat head with the size that is there
    (not the declared one; 64 bits, eight bytes more, where 32 do not hold it), the media up to a moov behind it, and that
    moov. Otherwise the body as it is."""
    behind = F.coalesce(F.col("moov_offset") > F.col("mdat_offset"), F.lit(False))
    media = F.col("mdat_offset") + F.col("mdat_head")
    facts = raw.withColumns({"prefix": F.greatest(F.col("mdat_offset") - F.col("ftyp_offset"), F.col("ftyp_size")), "behind": behind, "media": F.greatest(F.when(behind, F.col("moov_offset")).otherwise(F.col("size")) - media, F.lit(0))})
    whole = facts.where("ftyp_offset is null or mdat_offset is null").where("size > 0").select(key, F.lit(0).alias("rank"), *_segment("data", F.lit(0), F.lit(0), F.col("size")))
    facts = facts.where("ftyp_offset is not null and mdat_offset is not null")
    actual = F.col("mdat_head") + F.col("media")
    head = F.when(actual > (1 << 32) - 1, 16).otherwise(F.col("mdat_head"))
    parts = [whole, facts.select(key, F.lit(0).alias("rank"), *_segment("prefix", F.lit(0), F.col("ftyp_offset"), F.col("prefix")))]
    parts.append(facts.select(key, F.lit(1).alias("rank"), *_segment("mdat head", None, None, head, _mdat_head(F.col("media") + head, head))))
    parts.append(facts.select(key, F.lit(2).alias("rank"), *_segment("media", F.lit(0), media, F.col("media"))))
    parts.append(facts.where("behind").select(key, F.lit(3).alias("rank"), *_segment("moov", F.lit(0), F.col("moov_offset"), F.col("moov_size"))))
    plan = parts[0]
    for other in parts[1:]:
        plan = plan.unionByName(other)
    order = Window.partitionBy(key).orderBy("rank")
    plan = plan.where("length > 0").withColumn("out_offset", F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return plan.select(key, F.row_number().over(order).cast("bigint").alias("seq"), *_SEGMENT)

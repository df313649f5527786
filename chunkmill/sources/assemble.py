"""Bytes of recovered bodies from their plans, in parts of bounded size, and files of them.

A plan has a row a segment: ``seq`` (order of writing), ``source`` (``ord`` of the piece it is read from; null for
zeros and literals), ``src_offset``, ``length``, ``out_offset``, ``literal`` (bytes to write, or null). Where
segments overlap, the one of the larger ``seq`` wins.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .resources import kept

#: Bytes of a part.
PART = 64 << 20


def sparse_pieces(files: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Plan of each sparse file from its ranges (``bodies.sparse_ranges``); the file is piece 0."""
    order = Window.partitionBy(*keys).orderBy("range_offset", "data_pos")
    known = ranges.join(files.select(*keys).distinct(), keys, "left_semi")
    return known.select(*keys, F.row_number().over(order).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("source"), F.col("data_pos").alias("src_offset"), F.col("range_length").alias("length"), F.col("range_offset").alias("out_offset"), F.lit(None).cast("binary").alias("literal"))


def split_sources(plan: DataFrame, part_bytes: int = PART) -> DataFrame:
    """A plan whose pieces (``source`` 0) are there in parts of ``part_bytes`` (``ord`` is the part): each segment is cut where parts
    end, and reads from its part."""
    first, last = F.floor(F.col("src_offset") / part_bytes), F.floor((F.col("src_offset") + F.col("length") - 1) / part_bytes)
    read = F.col("source").isNotNull() & (F.col("length") > 0)
    cut = plan.withColumn("_part", F.explode(F.when(read, F.sequence(first, last)).otherwise(F.array(F.lit(None).cast("bigint")))))
    begin, end = F.greatest("src_offset", F.col("_part") * part_bytes), F.least(F.col("src_offset") + F.col("length"), (F.col("_part") + 1) * part_bytes)
    own = F.col("_part").isNotNull()
    cut = cut.withColumns({"_begin": begin, "_end": end})
    cut = cut.withColumns({"out_offset": F.when(own, F.col("out_offset") + F.col("_begin") - F.col("src_offset")).otherwise(F.col("out_offset")), "length": F.when(own, F.col("_end") - F.col("_begin")).otherwise(F.col("length")), "src_offset": F.when(own, F.col("_begin") - F.col("_part") * part_bytes).otherwise(F.col("src_offset")), "source": F.when(own, F.col("_part")).otherwise(F.col("source"))})
    return cut.select(*plan.columns)


def assemble_plan(plan: DataFrame, pieces: DataFrame, keys: list[str], part_bytes: int = PART, totals: bool = False) -> DataFrame:
    """``keys``, ``part``, ``begin``, ``content`` (and, with ``totals``, ``total``, the bytes of the body): the bytes of each planned body in parts of ``part_bytes`` (the last one
    shorter). Parts that are zeros throughout have no row, nor have empty bodies. ``pieces``: ``keys``, ``ord``,
    ``content``. A segment whose piece is missing or too short leaves zeros.

    A part is put together in one place from its slices, so no body meets as a whole: a segment is cut
    where parts end, and each slice is taken from its piece before anything is shuffled by part.
    """
    full = plan.groupBy(*keys).agg(F.max(F.col("out_offset") + F.col("length")).alias("total"))
    source = plan.where("length > 0 and (source is not null or literal is not null)").select(*keys, "seq", "source", "src_offset", "length", "out_offset", "literal")
    first, last = F.floor(F.col("out_offset") / part_bytes), F.floor((F.col("out_offset") + F.col("length") - 1) / part_bytes)
    cut = source.withColumn("part", F.explode(F.sequence(first, last)))
    begin, end = F.greatest("out_offset", F.col("part") * part_bytes), F.least(F.col("out_offset") + F.col("length"), (F.col("part") + 1) * part_bytes)
    cut = cut.withColumns({"at": begin - F.col("part") * part_bytes, "skip": begin - F.col("out_offset"), "n": end - begin})
    named = pieces.select(*keys, F.col("ord").alias("source"), F.col("content").alias("_body"))
    read = cut.where("literal is null").join(named, [*keys, "source"])
    slices = read.select(*keys, "part", "seq", "at", F.expr("substring(_body, cast(src_offset + skip + 1 as int), cast(n as int))").alias("bytes"))
    slices = slices.unionByName(cut.where("literal is not null").select(*keys, "part", "seq", "at", F.expr("substring(literal, cast(skip + 1 as int), cast(n as int))").alias("bytes")))
    schema = plan.select(*keys).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("seq", "ascending")])
        size = min(part_bytes, table.column("total")[0].as_py() - table.column("part")[0].as_py() * part_bytes)
        buffer = bytearray(size)
        for at, data in zip(table.column("at").to_pylist(), table.column("bytes"), strict=True):
            data = data.as_buffer()
            buffer[at : at + data.size] = memoryview(data)
        one = table.slice(0, 1)
        return pa.table([*(one.column(k) for k in keys), one.column("part"), pa.array([bytes(buffer)], pa.binary()), one.column("total")], [*keys, "part", "content", "total"])

    made = slices.join(full, keys).select(*keys, "part", "seq", "at", "bytes", "total").groupBy(*keys, "part").applyInArrow(work, f"{kinds}, part bigint, content binary, total bigint")
    return made.select(*keys, "part", (F.col("part") * part_bytes).alias("begin"), "content", *["total"] * totals)


def _place(folder: str):
    """File system and inner path of a folder, a path or a URI (Spark's own local ones have one slash)."""
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))


def _moved(folder: str, files: list[tuple[str, str]]) -> None:
    """Moves (source, path), both below ``folder``; what an earlier attempt has moved, or another moves meanwhile, stays."""
    place, root = _place(folder)
    for parent in {path.rpartition("/")[0] for _, path in files}:
        place.create_dir(f"{root}/{parent}", recursive=True)

    def move(pair):
        source, path = f"{root}/{pair[0]}", f"{root}/{pair[1]}"
        if place.get_file_info(source).type != fs.FileType.File:
            return
        try:
            place.move(source, path)
        except OSError:
            # another attempt may have moved it by now; some stores refuse to move onto a file
            if place.get_file_info(source).type == fs.FileType.File:
                if place.get_file_info(path).type == fs.FileType.File:
                    place.delete_file(path)
                place.move(source, path)

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(move, files))


@dataclass
class _Staged(WriterCommitMessage):
    """Files that a task has written: (below its staging folder, final path below the target)."""

    files: list[tuple[str, str]]


class _BodyWriter(DataSourceArrowWriter):
    """Rows (out_path, total, begin, content), sorted by them, into files. A task writes below a staging folder of its own; only
    the tasks that Spark commits are moved into place, so repeated, speculative and failed ones leave nothing."""

    def __init__(self, folder: str):
        self.folder, self.staging = folder, f".staging-{uuid.uuid4().hex}"

    def write(self, batches):
        place, root = _place(self.folder)
        own, done = f"{self.staging}/{uuid.uuid4().hex}", []
        path, stream, at, total = None, None, 0, 0

        def zeros(n):
            while n > 0:
                stream.write(bytes(min(n, 1 << 20)))
                n -= 1 << 20

        def close():
            if stream is not None:
                zeros(total - at)
                stream.close()

        for batch in batches:
            for row in range(batch.num_rows):
                target = batch.column("out_path")[row].as_py()
                if target != path:
                    close()
                    path, at, total = target, 0, batch.column("total")[row].as_py()
                    done.append((f"{own}/{len(done)}", path))
                    if len(done) == 1:
                        place.create_dir(f"{root}/{own}", recursive=True)
                    stream = place.open_output_stream(f"{root}/{done[-1][0]}")
                begin, content = batch.column("begin")[row].as_py(), batch.column("content")[row]
                if content.is_valid:
                    zeros(begin - at)
                    stream.write(content.as_buffer())
                    at = begin + content.as_buffer().size
        close()
        return _Staged(done)

    def commit(self, messages) -> None:
        _moved(self.folder, [pair for m in messages if m is not None for pair in m.files])
        self.abort(messages)

    def abort(self, messages) -> None:
        place, root = _place(self.folder)
        if place.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            place.delete_dir(f"{root}/{self.staging}")


class _ListedWriter(_BodyWriter):
    """A writer whose tasks list their files beside them: the driver gets the name of each task's folder only. On commit these are
    written down, in ``committed``; the moves are tasks again (``_move_committed``)."""

    def __init__(self, folder: str, staging: str):
        self.folder, self.staging = folder, staging

    def write(self, batches):
        files = super().write(batches).files
        if not files:
            return _Staged([])
        own = files[0][0].rpartition("/")[0]
        place, root = _place(self.folder)
        with place.open_output_stream(f"{root}/{own}/files") as listed:
            listed.write(json.dumps(files).encode())
        return _Staged([(own, "")])

    def commit(self, messages) -> None:
        place, root = _place(self.folder)
        place.create_dir(f"{root}/{self.staging}", recursive=True)
        with place.open_output_stream(f"{root}/{self.staging}/committed") as listed:
            listed.write(json.dumps([own for m in messages if m is not None for own, _ in m.files]).encode())


def _move_committed(spark: SparkSession, folder: str, staging: str) -> None:
    """Moves the files of committed tasks into place, a task for each, and deletes the staging folder."""
    place, root = _place(folder)
    with place.open_input_stream(f"{root}/{staging}/committed") as listed:
        tasks = json.loads(listed.read())

    def work(batches):
        inner, base = _place(folder)
        for batch in batches:
            for own in batch.column("own").to_pylist():
                with inner.open_input_stream(f"{base}/{own}/files") as listed:
                    _moved(folder, json.loads(listed.read()))
                yield pa.RecordBatch.from_arrays([pa.array([own])], ["own"])

    if tasks:
        rows = spark.createDataFrame([(i, own) for i, own in enumerate(tasks)], "i int, own string")
        rows.repartitionByRange(len(tasks), "i").select("own").mapInArrow(work, "own string").count()
    place.delete_dir(f"{root}/{staging}")


class BodyFiles(DataSource):
    """``write.format("body_files")`` with ``folder`` and ``staging`` (below it): bodies, in rows (out_path, total, begin, content), as files."""

    @classmethod
    def name(cls) -> str:
        return "body_files"

    def writer(self, schema, overwrite):
        return _ListedWriter(self.options["folder"], self.options["staging"])


def write_bodies(parts: DataFrame, targets: DataFrame, keys: list[str], folder: str, most_bytes: int = 1 << 40) -> DataFrame:
    """Write each body to its planned path below ``folder``: ``out_path``, ``bytes``, ``error``.

    ``parts`` as of ``assemble_plan``; ``targets``: ``keys``, ``out_path`` (relative), ``ord``, ``total`` (bytes of the body).
    Of several bodies with one path the last one by ``ord`` is written, the others are not. Holes are
    written as zeros; a body above ``most_bytes`` is not written and has an ``error``. The files are there, whole, when this
    returns: each body is staged by one task, part by part, and all are moved into place, by tasks, when the job has committed, onto
    files that are there already. Reading the result writes nothing again.
    ``folder``: a path or URI that every worker can write to.
    """
    last = kept(targets.groupBy("out_path").agg(F.max_by(F.struct(*keys, "total"), F.struct("ord", *keys)).alias("t")).select("out_path", "t.*"))
    fits = F.col("total") <= most_bytes
    met = last.where(fits).join(parts.select(*keys, "begin", "content"), keys, "left").select("out_path", "total", F.coalesce("begin", F.lit(0)).alias("begin"), "content")
    parts.sparkSession.dataSource.register(BodyFiles)
    staging = f".staging-{uuid.uuid4().hex}"
    met.repartition("out_path").sortWithinPartitions("out_path", "begin").write.format("body_files").option("folder", folder).option("staging", staging).mode("append").save()
    _move_committed(parts.sparkSession, folder, staging)
    error = F.when(~fits, F.concat(F.col("total").cast("string"), F.lit(f" bytes exceed {most_bytes}")))
    return last.select("out_path", F.when(fits, F.col("total")).otherwise(0).cast("bigint").alias("bytes"), error.alias("error"))

"""Token ids in files of shuffled planes.

The ids of the documents, in ascending order of their ids, are cut into chunks of whole
documents. A chunk's ids are split into blocks of ``block`` ids; each block is transposed into
byte planes (or bit planes), so that the slowly varying high parts of ids lie together, and the
planes of one rank are compressed with zstandard. A stored chunk is one row of a Parquet
dataset: its place (``part``, ``seq``, ``first``), how it was made (``block``, ``bits``, ``end_id`` and the SHA-256 of the
``tokenizer`` file), the chunk index (document ids and lengths), the plane sizes, and the compressed planes one
after another. A chunk can be decoded alone, by what it says itself.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .segments import segment, slices
from .shared import new_folder
from .vocab import batch_ids, segment_ids

BLOCK = 1 << 16
#: A chunk is closed when it holds this many ids (or one longer document).
CHUNK_IDS = 1 << 18


def to_planes(ids: np.ndarray, block: int = BLOCK, bits: bool = False, level: int = 3) -> list[bytes]:
    """Compressed planes of unsigned 32-bit ids: rank r of every block, one after another.
    Planes above the largest id are left out."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()).bit_length() if len(ids) else 0
    planes: list[list[np.ndarray]] = [[] for _ in range(top if bits else (top + 7) // 8)]
    for at in range(0, len(ids), block):
        part = raw[at : at + block]
        for r, plane in enumerate(planes):
            plane.append(np.packbits((part[:, r // 8] >> (r % 8)) & 1) if bits else part[:, r])
    pack = zstandard.ZstdCompressor(level=level).compress
    return [pack(np.concatenate(p).tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int, block: int = BLOCK, bits: bool = False) -> np.ndarray:
    """The ids that ``to_planes`` was given."""
    raw = np.zeros((n, 4), np.uint8)
    unpack = zstandard.ZstdDecompressor().decompress
    for r, plane in enumerate(planes):
        data = np.frombuffer(unpack(plane), np.uint8)
        if not bits:
            raw[:, r] = data
            continue
        at = 0
        for begin in range(0, n, block):
            length = min(block, n - begin)
            held = (length + 7) // 8
            raw[begin : begin + length, r // 8] |= np.unpackbits(data[at : at + held], count=length) << (r % 8)
            at += held
    return raw.view("<u4").reshape(-1)


@functools.lru_cache(maxsize=4)
def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _stored_schema(kind: str) -> str:
    return f"part bigint, seq bigint, first bigint, n_ids bigint, block bigint, bits boolean, end_id bigint, tokenizer string, doc_ids array<{kind}>, lengths array<bigint>, plane_bytes array<bigint>, planes binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, bits: bool = False, chunk_ids: int = CHUNK_IDS, parts: int | None = None) -> None:
    """Encode every whole text, append ``end_id`` to each, and write the ids at ``path``.

    Documents lie in ascending order of ``id_col`` (null ids first; rows of one id by text).
    Null text counts as empty, so only the end id is stored; repeated rows are stored each.
    An empty table gives a dataset without rows. Other input columns are not read. ``parts``:
    number of ranges of ids (the session's shuffle partitions by default).
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        coder, fold = segment_ids(tokenizer), segment_ids(tokenizer).fold
        part_no, seq, first = TaskContext.get().partitionId(), 0, 0
        keys, lengths, held, total = [], [], [], 0

        def stored():
            ids = np.concatenate(held)
            planes = to_planes(ids, block, bits)
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part_no], pa.int64()), "seq": pa.array([seq], pa.int64()), "first": pa.array([first], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()),
                    "block": pa.array([block], pa.int64()), "bits": pa.array([bits]), "end_id": pa.array([end_id], pa.int64()), "tokenizer": pa.array([file_digest(tokenizer)]),
                    "doc_ids": pa.array([keys], pa.list_(key_type)), "lengths": pa.array([lengths], pa.list_(pa.int64())),
                    "plane_bytes": pa.array([[len(p) for p in planes]], pa.list_(pa.int64())), "planes": pa.array([b"".join(planes)], pa.binary()),
                }
            )

        for batch in batches:
            key_type = batch.column("key").type
            for part in slices(batch, "text"):
                cut = segment(part.column("text"), fold)
                ids, bounds = batch_ids(cut.codes, cut.bounds, coder(cut.words))
                n_docs = part.num_rows
                # the end ids, each after its document
                whole = np.empty(len(ids) + n_docs, "<u4")
                ends = bounds[1:] + np.arange(n_docs)
                body = np.ones(len(whole), bool)
                body[ends] = False
                whole[ends], whole[body] = end_id, ids
                begins = np.concatenate([[0], ends[:-1] + 1])
                for key, a, b in zip(part.column("key").to_pylist(), begins.tolist(), (ends + 1).tolist(), strict=True):
                    if total and total + b - a > chunk_ids:
                        yield stored()
                        seq, first = seq + 1, first + total
                        keys, lengths, held, total = [], [], [], 0
                    keys.append(key)
                    lengths.append(b - a)
                    held.append(whole[a:b])
                    total += b - a
        if keys:
            yield stored()

    rows = docs.select(docs[id_col].alias("key"), docs[text_col].alias("text"))
    ranged = rows.repartitionByRange(parts, "key") if parts else rows.repartitionByRange("key")
    ranged.sortWithinPartitions("key", "text").mapInArrow(work, _stored_schema(kind)).write.mode("errorifexists").option("compression", "uncompressed").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The stored chunks with ``base``, the number of ids before each chunk in the whole dataset.
    Only one row a part meets in the running sum."""
    chunks = spark.read.parquet(path)
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    before = F.coalesce(F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chunks.join(parts.select("part", before.alias("before")), "part").withColumn("base", F.col("before") + F.col("first"))


def _decoded(chunks: DataFrame, id_col: str, digest: bool) -> DataFrame:
    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()

    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(n)[row] for n in ("base", "n_ids", "block", "bits", "doc_ids", "lengths", "plane_bytes", "planes")}
                payload, planes, at = one["planes"].as_py(), [], 0
                for n in one["plane_bytes"].as_py():
                    planes.append(payload[at : at + n])
                    at += n
                ids = from_planes(planes, one["n_ids"].as_py(), one["block"].as_py(), one["bits"].as_py())
                lengths = np.array(one["lengths"].as_py(), np.int64)
                ends = np.cumsum(lengths)
                pairs = list(zip((ends - lengths).tolist(), ends.tolist(), strict=True))
                last = pa.array([zlib.crc32(ids[a:b]) for a, b in pairs], pa.int64()) if digest else pa.array([ids[a:b].astype(np.int64) for a, b in pairs], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([one["doc_ids"].values, pa.array(one["base"].as_py() + ends - lengths), pa.array(lengths), last], names)

    names = [id_col, "start", "n_tokens", "ids_crc32" if digest else "ids"]
    schema = f"`{id_col}` {kind}, start bigint, n_tokens bigint, {names[3]} {'bigint' if digest else 'array<bigint>'}"
    return chunks.select("base", "n_ids", "block", "bits", "doc_ids", "lengths", "plane_bytes", "planes").mapInArrow(work, schema)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Documents of a stored dataset: ``id_col``, ``start`` (ids before it), ``n_tokens`` (its end
    id included), ``ids`` array<long>."""
    return _decoded(read_chunks(spark, path), id_col, digest=False)


def stored_digests(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, bits: bool = False) -> DataFrame:
    """Write ``docs`` into a new folder of the shared place and read them back, with the CRC-32 of
    each document's ids (little-endian unsigned 32-bit integers) as ``ids_crc32``."""
    spark = docs.sparkSession
    path = new_folder(spark, "token-store")
    write_tokens(docs, path, tokenizer, end_id, id_col, text_col, block, bits)
    return _decoded(read_chunks(spark, path), id_col, digest=True)

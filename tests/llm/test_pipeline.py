"""The pipeline's stages, each held against its operator or plain Python on its own input."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from chunkmill.llm import packing, quality, toxicity
from chunkmill.sources.resources import BATCH_BYTES
from tests.llm.test_dedup import brute_components, folded

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What went into each stage, and the last result."""
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        seen.append(docs)
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "t")
    return [*seen, docs]


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns


def test_models_decide(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = quality.score(stages[0], labels, threshold=0.3).where("predicted = 1")
    assert ids(stages[1]) == ids(good)
    clean = toxicity.score(stages[1], labels).where("predicted = 0")
    assert ids(stages[2]) == ids(clean)


def test_copies_go(stages):
    last = {}
    for r in stages[2].collect():
        last[folded(r.text)] = max(r.doc_id, last.get(folded(r.text), -1))
    assert ids(stages[3]) == sorted(last.values())
    rows = [(r.doc_id, r.text) for r in stages[3].collect()]
    assert ids(stages[4]) == sorted(k for k, _, _, kept in brute_components(rows, 5) if kept)


def test_packed(spark, stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = stages[5].collect()
    docs = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 1] for r in stages[4].collect()}
    assert {p.doc_id for p in pieces} == set(docs)
    for p in pieces:
        own = docs[p.doc_id]
        assert p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(np.array(own[p.start : p.start + p.length], "<u4").tobytes())
        assert list(p.ids) == own[p.start : p.start + p.length]
    assert sum(p.length for p in pieces) == sum(map(len, docs.values()))
    assert len(corpus_pipeline.run(spark, SF).collect()) == len(pieces)


@pytest.mark.parametrize("rows", ["edge", "short", "none"])
def test_odd_documents_pass_through_every_stage(spark, edge, some_labels, tmp_path, rows):
    """Nulls, empty, short and long texts, repeated rows and clashing column names; an empty table."""
    df = edge.unionByName(edge) if rows == "edge" else edge.where("length(text) < 6 or text is null") if rows == "short" else edge.limit(0)
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    some_labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[2:4]:  # the classifiers may reject all of these
        got = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), "t")
        assert got.columns == docs.columns and (got.count() > 0) == (rows != "none"), name
        docs = got
    texts = [folded(r.text) for r in docs.where("doc_id is not null").collect()]
    assert len(texts) == len(set(texts))
    pieces = corpus_pipeline.packed(spark, docs, str(tmp_path)).collect()
    assert len({(p.doc_id, p.start, p.length) for p in pieces}) <= len(pieces) and (len(pieces) > 0) == (rows != "none")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0


@pytest.mark.parametrize(("module", "stage"), [(toxicity, corpus_pipeline.clean), (packing, corpus_pipeline.packed)])
def test_callers_write_small_batches(spark, tmp_path, monkeypatch, module, stage):
    """What a stage returns sends small batches to Python whoever writes it, not only where it is stored."""
    cut = module.slices

    def watched(batch, column, most_bytes):
        with open(f"{tmp_path}/sizes", "a") as out:
            out.write(f"{batch.nbytes}\n")
        return cut(batch, column, most_bytes)

    monkeypatch.setattr(module, "slices", watched)
    rows = spark.range(0, 600, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" words ")), 2000).alias("text"))
    stage(spark, rows, SF).write.parquet(f"{tmp_path}/out")
    sizes = [int(n) for n in (tmp_path / "sizes").read_text().split()]
    assert sum(sizes) > 5 * BATCH_BYTES
    assert max(sizes) < 2 * BATCH_BYTES

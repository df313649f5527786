"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import lm_ppm, periodic_runs, quality, toxicity
from .bpe_codec import encode_digests
from .exact_dedup import mark_copies
from .exact_topk import top_k
from .near_dedup import near_duplicates
from .packing import pack_documents
from .token_alignment import alignment_digests
from .token_counts import count_tokens
from .token_store import stored_digests
from .vector_dedup import near_vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op3_lm_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_ppm.score(_table(spark, sf_dir, "documents"), buckets=7, held=2)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), label="toxic", threshold=0.5)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(_table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), size=2, percent=80)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=2048)


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), label="quality", threshold=0.3)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tailed = periodic_runs.repeat_tails(_table(spark, sf_dir, "documents"))
    return periodic_runs.run_digests(periodic_runs.collapse_runs(tailed, exponent=4, least=6))


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.9)


QUERIES = {f.__name__: f for f in (op1_bpe_codec, op2_token_counts, op3_lm_ppm, op4_toxicity, op5_exact_dedup, op6_near_dedup, op7_token_store, op8_packing, op9_exact_topk, op10_quality, op11_token_alignment, op12_periodic_runs, op13_vector_dedup)}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op5_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_FOLD} AS folded FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(folded) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY folded)""",
    # the components by all reachable pairs, so only for small tables
    "op6_near_dedup": rf"""
        WITH RECURSIVE f AS (SELECT doc_id, {_FOLD} AS t FROM documents),
        w AS (SELECT doc_id, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM f),
        s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
        u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
        r(x, y) AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
        c AS (SELECT x, min(y) AS least_id FROM r GROUP BY x)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.least_id, s.doc_id)) AS component_id, least(s.doc_id, coalesce(c.least_id, s.doc_id)) = s.doc_id AS kept FROM s LEFT JOIN c ON c.x = s.doc_id""",
    "op9_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    # all pairs and all reachable ones, so only for small tables
    "op13_vector_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
        r(x, y) AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
        c AS (SELECT x, min(y) AS least_id FROM r GROUP BY x), n AS (SELECT x, count(*) AS n FROM p GROUP BY x)
        SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(c.least_id, e.vec_id)) AS component_id, least(e.vec_id, coalesce(c.least_id, e.vec_id)) = e.vec_id AS kept
        FROM embeddings e LEFT JOIN c ON c.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id""",
}

"""Every registered query that has SQL, side by side with DuckDB."""

import os

import duckdb
import pytest

from chunkmill.jobs import body_queries, column_queries, table_queries
from chunkmill.sources import bodies

SF = "/root/testdata/sf0.001"
QUERIES = {**column_queries.QUERIES, **table_queries.QUERIES, **body_queries.QUERIES}
SQL = {**column_queries.SQL, **table_queries.SQL, **body_queries.SQL}


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def _plain(v):
    return repr(round(v, 9)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    found = oracle.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(_plain, r)) for r in found.fetchall())
    assert sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect()) == want


def test_every_query_reads_a_table(spark):
    assert set(SQL) <= set(QUERIES)
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(0 <= r.missing_bytes < r.total_bytes for r in rows)


def test_every_body_is_read_for_inline_images(spark):
    fx = spark.createDataFrame([(6, "000002006d6f6f66"), (7, b"GIF89a".hex()), (15, b"BMW".hex()), (23, b"text".hex()), (31, None)], "doc_id bigint, body_hex string")
    got = {r.doc_id: r.data_url for r in column_queries.u8_inline_image_all(fx).collect()}
    assert got == {6: None, 7: "data:image/gif;base64,R0lGODlh", 15: "data:image/bmp;base64,Qk1X", 23: None, 31: None}


def test_every_body_has_its_head(spark):
    texts = {1: None, 2: "", 3: "ab", 4: "é" * 200}
    docs = spark.createDataFrame([(k, v, "en") for k, v in texts.items()], "doc_id bigint, text string, lang string")
    eof = lambda n: bodies.EOF_MAGIC.to_bytes(8, "little") + bytes(8) + n.to_bytes(4, "little") + bytes(4)
    body = {k: (v or "").encode() for k, v in texts.items()}
    want = {k: (b + eof(len(b)) + b"en" + eof(2))[:256].hex() for k, b in body.items()}
    assert {r.doc_id: r.head for r in body_queries.s2_file_heads_all(docs).collect()} == want


@pytest.mark.parametrize("name", ["job_recover_indexed", "job_scan_stats"])
def test_pages_that_begin_like_media(spark, name):
    """A text with the sync bytes of a transport stream, or the first ones of a bitmap, in a page."""
    texts = ["G" + "x" * 187 + "G" + "y" * 50, "BM and more text", "text", ""]
    rows = [(i, texts[i // 4 % 4], "en") for i in range(40)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    found = con.execute(SQL[name])
    columns = [d[0] for d in found.description]
    want = sorted(tuple(map(_plain, r)) for r in found.fetchall())
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert sorted(tuple(_plain(r[c]) for c in columns) for r in getattr(body_queries, name)(docs).collect()) == want


@pytest.mark.parametrize("name", ["s1_list_cache_files", "s8_write_bodies"])
def test_files_without_bytes_and_ids_beyond_six_digits(spark, name):
    rows = [(1, "ab", "s"), (2, "", "s"), (3, "x", "s"), (4, None, "s"), (0x1000000, "zz", "s"), (0x1000001, "", "s"), (0x1000003, "q", "s"), (5 * 0x1000000 - 1, "é", "s"), (None, "none", "s")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    found = con.execute(SQL[name])
    columns = [d[0] for d in found.description]
    want = sorted(tuple(map(_plain, r)) for r in found.fetchall())
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert sorted(tuple(_plain(r[c]) for c in columns) for r in getattr(body_queries, name)(docs).collect()) == want

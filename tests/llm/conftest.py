import pytest

SMALL = "/root/testdata/sf0.001"

#: Nulls, empty and long texts, ties, repeated rows, special strings, odd spaces.
EDGE = [
    (1, "The cat sat on the mat, the cat sat on the mat."), (2, "the CAT sat on the mat, the cat sat on the mat."), (3, None), (4, ""), (5, "  \t\n "),
    (6, "it's we'll 're 'x <|endoftext|> <|ENDOFTEXT|> a\x1cb"), (7, "word"), (8, "word"), (8, "word"), (9, "É́a ÀB ünï   　 日本語 😀"),
    (10, "long " * 40_000), (11, "x" * 70_000), (None, "no id here"), (None, None), (12, "one two three four five six seven eight nine ten eleven"),
    (13, "one two three four five six seven eight nine ten twelve"), (14, "\x00null byte\x00"), (15, "a b"), (16, "a  b"), (17, "a b c"), (17, "something else entirely, with the same id"),
]


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def edge(spark):
    """Edge cases, with extra columns whose names the operators use inside."""
    rows = [(k, t, 7, "x", 1.5, "d") for k, t in EDGE]
    return spark.createDataFrame(rows, "doc_id bigint, text string, key int, row string, score double, digest string").repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def some_labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2, None) for i in range(1, 15)] + [(1, 0, 1, None), (None, 1, 1, None), (2, None, None, None)], "doc_id bigint, quality int, toxic int, text string")

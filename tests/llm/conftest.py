import pytest
from pyspark.sql import types as T

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a table may have them too.
CLASHING = ("key", "size", "n", "component", "block", "chunk", "word", "score", "evidence", "rate", "path", "found", "base", "spans", "id", "bucket")

LONG = "lorem ipsum dolor sit amet " * 4000
ROWS = [
    (1, "One two three four five six seven.", "en", "src0", 34),
    (2, "one TWO three four five six seven.", "en", "src0", 34),
    (2, "one TWO three four five six seven.", "en", "src0", 34),
    (3, None, "en", None, None),
    (4, "", None, "src1", 0),
    (5, " \t\n ", "fr", "src1", 4),
    (None, "a row without an id, call +1 (462) 555-7216", "en", "src0", 43),
    (7, LONG, "en", "a/b/c", len(LONG)),
    (8, "x" * 50_000, "de", "a/b", 50_000),
    (9, "mail kk.51@mail4.example.com or 4111 1111 1111 1111, 1.2.3.4 and 1.2.3.456", "es", "src2", 76),
    (10, "two words", "es", "src2", 9),
    (11, "Two words", "es", "src2", 9),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with names that operators use."""
    fields = T.StructType([*T._parse_datatype_string(COLUMNS).fields, *(T.StructField(c, T.StringType()) for c in CLASHING)])
    return spark.createDataFrame([(*r, *(None if k % 2 else "x" for k, _ in enumerate(CLASHING))) for r in ROWS], fields)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 1), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")

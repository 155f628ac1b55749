import pytest

LONG = "word " * 30_000 + "end"
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \t\n ", "en", "b"),
    (6, LONG, "en", "a"),
    (7, "éa ß▁ 日本語 \U0001f600 x\x00y <s> <0x0A>\r\nÀ", "fr", "c"),
    (None, "a row without an id", "en", "a"),
    (8, "one", "de", None),
]
#: Names that operators use inside; documents may have columns of these names.
CLASHES = ["fp", "row", "n", "_n", "y", "word", "label", "kept", "shard", "hash", "term"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, long and repeated rows, ties and clashing extra columns."""
    schema = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, *CLASHES) for r in ROWS], schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators use inside
CLASHES = ["fp", "key", "line", "n", "u", "v", "p", "bucket", "digest", "fingerprint", "node", "copies", "size", "whole", "spans", "ids", "hot", "batch", "t", "root"]


@pytest.fixture(scope="session")
def documents(spark):
    """Small table: null and empty columns, exact and near copies, ties, repeated rows, a very long text."""
    prose = "the quick brown fox jumps over the lazy dog while seven wizards mix a jug of liquid gold under the old bridge at night"
    other = "der schnelle braune fuchs springt nicht weit und die alte katze schläft heute lange in der warmen sonne vor dem haus"
    rows = [
        (1, prose, "en", "a", 1), (2, prose, "en", "b", 1), (3, prose.replace(" ", "  \t"), "en", "a", 1),
        (4, other, "de", "b", 1), (5, other + " ganz", "de", None, 1), (6, None, None, None, None),
        (7, "", "en", "a", 0), (8, " \n\t ", None, "b", 4), (9, "12345 67890 !!", "de", "c", 14), (None, prose, "en", "a", 1),
        (None, "no id here but some words", None, "c", 1), (10, f"{prose}\n{other}\n{prose}", "en", "c", 1),
        (10, f"{prose}\n{other}\n{prose}", "en", "c", 1), (11, f"{prose} x\n\n{other}", "de", "a", 1),
        (12, "word " * 30_000, "en", "b", 1), (13, "a" * 50_000, "en", "a", 1), (14, "😀 ünï <|endoftext|> x@y.org", "de", "c", 1),
        (15, prose.upper(), "en", "a", 1), (16, f"{other} und mehr davon", "de", "b", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(documents):
    """The same with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    return documents.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")

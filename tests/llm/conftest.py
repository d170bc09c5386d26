import pytest

TEXTS = [
    "Plain words for a start, then some more of them.",
    "Plain words for a start,  then some\tmore of them.",
    "",
    None,
    "   \n\t ",
    "x",
    "Été à Paris — naïve café ☕ and <|endoftext|> inside 12345 don't",
    "one two three four five six seven eight nine ten " * 40,
    "one two three four five six seven eight nine ten " * 40,
    "ΑΣ Ä ẞ 漢字   end",
    "line a\nline b\nline a\nline a\n###$$$",
]


@pytest.fixture()
def awkward(spark):
    """Nulls in every column, empty and repeated rows, and extra columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, 7, "clash", i) for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[7], (None, "no id", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, rank int")


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    return documents.orderBy("doc_id").toPandas()

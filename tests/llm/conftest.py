import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, size string, kept string, slot int, _t string"
WORDS = [f"w{i}" for i in range(2000)]
LONG = " ".join(WORDS[i * 7 % 2000] for i in range(30_000))


def rows():
    texts = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (4, " \n\t "), (None, "one two three four five six"), (None, None), (5, LONG), (6, LONG + " end"), (7, "a"), (8, "b c"), (9, "One TWO three four five six")]
    texts += [(10 + i, " ".join(WORDS[i : i + 60])) for i in range(40)]
    return [(d, t, None if i % 5 == 0 else "en", None if i % 3 == 0 else f"s{i % 4}", None, "k", i, "x", "no", 3, "y") for i, (d, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, repeated rows, blanks, long texts and columns of clashing names."""
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def many(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

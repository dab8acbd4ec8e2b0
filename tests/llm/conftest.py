import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("key", "h", "n", "salt", "shard", "bucket", "words", "comp", "_row", "_h", "_id", "item_id", "size", "score", "label")


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls, empty and long texts, repeated rows, copies, odd characters."""
    rng = random.Random(5)
    base = "\n".join(sentence(rng, 12) for _ in range(6))
    long = "\n".join(sentence(rng, 40) for _ in range(300))
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "b", 1),
        (2, base, "en", "b", 1),
        (3, base.replace(base.split()[7], "changed", 1), None, "a", None),
        (4, None, "en", "a", 1),
        (5, "", "en", None, 1),
        (6, None, None, None, None),
        (7, long, "de", "c", 1),
        (8, "Ünïcode — “quotes” it's 42 <|endoftext|> x́ 　 İ\n" + base.split("\n")[0].upper(), "fr", "c", 1),
        (9, "!!! ??? \n\n", "en", "c", 1),
        (None, sentence(rng, 30), "en", "a", 1),
        (None, None, "en", "a", 1),
        (10, "one two", "en", "d", 1),
        (-3, "one two", "en", "d", 1),
    ]
    rows += [(100 + i, sentence(rng, 5 + i), "en", "abcd"[i % 4], 1) for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return edge_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    """The same documents with further columns whose names the operators use themselves."""
    return docs.select("*", *[F.lit("x").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def result():
    """Rows as a sorted list of tuples."""

    def rows_of(df, *cols):
        return sorted((tuple(r) for r in df.select(*cols or ["*"]).collect()), key=repr)

    return rows_of

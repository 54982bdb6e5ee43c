import random

import pytest
from helpers import SMALL, make_docs


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows and odd characters."""
    rng = random.Random(4)
    words = ["ver", "tion", "lüge", "El", "niño", "x1", "été", "AND", "the.", "of,", "日本", "🎉", "a b", "\x85", "'s", "it's"]
    long = " ".join(rng.choices(words, k=60_000)) + "\n" + "z" * 50_000
    prose = " ".join(rng.choices(words, k=70))
    return [
        (3, "one two three four five"), (3, "one two three four five"), (None, "one two three four five"), (None, None), (4, None), (5, ""), (6, " \n\t "),
        (7, prose), (8, prose), (9, prose.upper()), (10, prose + " end."), (11, long), (12, "two words"), (13, "Two Words"), (14, "\n\n" + prose + "\r\n" + prose),
        (15, "a" * 3000), (16, "<|endoftext|> and <|startoftext|>x"), (9, "another text for the id nine"), (17, "1 " * 500),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return make_docs(spark, odd_rows).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return make_docs(spark, [])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")

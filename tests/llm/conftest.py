"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing names."""

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size int, shard string, k1 double, "
          "rank string, row string, doc string, id string, n_words string, kept string")


def make(spark, rows):
    full = [(i, t, lang, src, None if t is None else len(t), 7, "x", 0.5, "r", None, "d", "i", "w", "k")
            for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA)


ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "s1"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "s1"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "s1"),
    (3, None, "en", "s2"),
    (4, "", None, "s2"),
    (5, " \t\n\r ", "de", None),
    (6, "één woord 日本語 😀 <|endoftext|> a b", "fr", None),
    (None, "a text without an id", "en", "s3"),
    (7, "word " * 30_000, "en", "s3"),
    (8, "x" * 200_000, None, "s1"),
    (9, "no source and no language", None, None),
    (10, "one", "zz", ""),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return make(spark, ODD).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return make(spark, [])


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda rows: make(spark, rows)

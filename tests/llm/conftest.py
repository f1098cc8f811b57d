import random

import pytest

WORDS = "der the rean onth wert ing sal vor mit une les que dos ando con pa re tion".split()


@pytest.fixture(scope="session")
def prose():
    """A maker of texts of n words."""
    rng = random.Random(5)

    def make(n):
        return " ".join(rng.choice(WORDS) + rng.choice(WORDS) + rng.choice(("", ".", ",")) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Nulls in every column, empty and very long texts, repeated rows, extra columns with names the operators use."""
    long = prose(30_000)
    rows = [
        (1, None, "en", "s", 0), (2, "", None, "s", 0), (3, " \t\n ", "en", None, 3), (4, "one", "en", "s", 3), (4, "one", "en", "s", 3),
        (5, long, "en", "s", len(long)), (6, long + " end", "en", "s", None), (None, "no id here at all", "en", "s", 9), (7, "é漢字🙂 " * 40, "fr", "s", 200),
        (8, "x" * 200_000, "en", "s", 200_000), (9, prose(200), "en", "s", 9),
    ]
    rows = [(*r, "extra", 1.5, 7, "b") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, data string, score double, label int, bucket string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def sf(spark, tmp_path_factory, odd_docs, no_docs):
    """A maker of table folders: sf(documents=..., labels=...)."""

    def make(**tables):
        path = tmp_path_factory.mktemp("sf")
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return make

import os
import pytest

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 977} and" for i in range(60_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", None, 3), (4, long, "en", "a", len(long)),
        (5, "the same words in a line of the same words", "en", "a", 1), (5, "the same words in a line of the same words", "en", "a", 1),
        (6, "the same words in a line of the same words", None, "b", 1), (None, "no id for this one here", "fr", "b", 1),
        (7, "x" * 50_000, "de", "b", 1), (8, "1234 5678 ---", "es", "b", 1), (9, "Été où ça là\n\nÉté où ça là\n", "fr", "c", 1),
        (10, "one", "en", "c", 1), (11, "A</s> ▁odd ￿ 😀 \\ text", "en", "c", 1),
    ] + [(100 + i, f"copy of the very same text number one {'x' if i % 7 == 0 else ''}".strip(), "en", "hot", 1) for i in range(60)]
    df = spark.createDataFrame([(*r, "k", 1, 2.5) for r in rows],
                               DOCS + ", word string, size int, score double")
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def sf():
    assert os.path.isdir(SF)
    return SF

import pytest

from tokentally.llm.sources import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def code_on_workers(spark):
    ship(spark)


@pytest.fixture
def write_tables(spark, tmp_dir):
    """Write small tables as <dir>/<name>.parquet and give the folder."""
    def write(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(2).write.mode("overwrite").parquet(f"{tmp_dir}/{name}.parquet")
        return tmp_dir
    return write


@pytest.fixture
def odd_docs():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    return [(1, "alpha beta gamma delta epsilon zeta", "en", "a", 5), (1, "alpha beta gamma delta epsilon zeta", "en", "a", 5),
            (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \n\t ", "de", None, 4), (None, "some words here", None, "a", 1),
            (5, long_text, "fr", "b", 9), (6, "Alpha BETA gamma delta epsilon zeta", "en", "c", 1), (7, "one", "en", "c", 3)]

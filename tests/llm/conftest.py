"""Small tables that every operator has to take: nulls, empty and long texts, ties, repeats, clashing names."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, id long, key string, h string, row string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    texts = [None, "", "one", "a b c d e f g h", "A B C D E F G H", "a b c d e f g h", long, long + " more", "mail me: x.y@example.org or +49 (30) 1234567, 4111 1111 1111 1111", "中文 \U0001f600 café  \n\t x", "10.0.0.1 and 10.0.0.256"]
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 3}", len(t or ""), 7, 7, "k", "ff", "r") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "a b c d e f g h", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def stored(tmp_path):
    """Writes a frame and reads it back, as every table of a pipeline is."""
    def store(df, name="t"):
        df.write.parquet(str(tmp_path / name))
        return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / name))
    return store

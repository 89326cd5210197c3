import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows and ids, and columns whose names operators might use."""
    long = "very long text with words that repeat " * 40_000
    rows = [
        (1, "a normal text about nothing in particular", "en", "s", 41),
        (1, "a normal text about nothing in particular", "en", "s", 41),
        (2, None, None, None, None),
        (3, "", "en", "s", 0),
        (4, long, "en", "s", len(long)),
        (None, "no id here", "en", None, 10),
        (5, "!!! 123 ...", "en", "s", 11),
        (6, "word", "en", "s", 4),
        (6, "another text with the same id", "en", "s", 29),
    ]
    extra = (0.5, "x", 7, True)
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, fingerprint string, statistics long, held_out boolean"
    return spark.createDataFrame([r + extra for r in rows], schema)


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Write tables as a folder of Parquet, as queries read it."""

    def make(**tables):
        path = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"file://{path}/{name}.parquet")
        return f"file://{path}"

    return make

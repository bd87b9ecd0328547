import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    return (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.driver.host", "127.0.0.1").getOrCreate()
    )


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and one long text, ties, repeated rows and columns of clashing names."""
    words = " ".join(f"wort{i % 97} und die{i % 31}" for i in range(30_000))
    rows = [
        (1, None, "en", "s", 0), (2, "", None, None, 0), (None, "the cat and the dog sat on the mat", "en", "s", 3), (4, " \n\t ", "en", None, 1),
        (5, "the cat and the dog sat on the mat", "en", "s", 3), (5, "the cat and the dog sat on the mat", "en", "s", 3), (6, words, "de", "t", 9),
        (7, words, "de", "t", 9), (8, "12 34 $$ 56", "fr", "t", 2), (9, "le chat et le chien sont sur la table\nle chat\nle chat", "fr", "t", 5),
    ]
    return spark.createDataFrame([r + ("x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size string, score_ int")

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def documents(spark):
    """The small table, with rows that stress each operator added: nulls, empty texts, repeated rows, clashing columns."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    base = "the quick brown fox jumps over a lazy dog and then runs back to its den before night falls on all hills"
    long = " ".join(f"{base} {k}" for k in range(40))
    rows += [
        (None, None, None), (None, base, "en"), (9001, None, "en"), (9002, "", "en"), (9003, " \n\t ", None), (9004, long, "en"), (9004, long, "en"),
        (9005, long.upper(), "en"), (9006, "x " + long, "fr"), (9007, "a", "en"), (9008, "a b c", "de"), (9009, "a b c", "de"), (9010, "1234 !!", "es"),
        (9011, "aa " * 200, "en"), (9012, "zz " + "aa " * 150, "en"), (9013, "é" * 3000, "fr"),
    ]
    return spark.createDataFrame([(i, t, l, "s", 0, "clash") for i, t, l in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string")

import pytest

SF_DIR = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    """{doc_id: text} of the smallest driver table."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r[0]: r[1] for r in rows}


ODD_TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "two words",
    "a b c d e f",
    "A B c D e f",
    "Été  naïve \x1c x\u0085y  double  spaces \n\n end ",
    "it's we'll 123² Ⅷ \U0001f600\U0001f600 don't stop",
    "tail \n",
    "x" * 5000,
    "word " * 3000,
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows and columns with clashing names."""
    rows = [(k, t, "en", "s", len(t or ""), k, "x", None) for k, t in enumerate(ODD_TEXTS)]
    rows += [(None, "a b c d e f", None, None, None, None, None, None), rows[5], (100, rows[5][1], None, None, None, 1, "y", 0.5)]
    return spark.createDataFrame(rows, f"{DOCUMENTS}, row long, fp string, score double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)

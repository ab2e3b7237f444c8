import pytest

from llm_data import SCHEMA, odd_rows, prose


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).checkpoint()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark):
    """Further columns named like those that operators add."""
    extra = ", row string, kept boolean, fp long, id long, score double, length long, `a.b` string, item int, key string"
    rows = [(*r, "r", True, 1, 2, 0.5, 3, "dot", 4, "k") for r in odd_rows()]
    return spark.createDataFrame(rows, SCHEMA + extra)


@pytest.fixture(scope="session")
def corpus(spark):
    """Prose in two languages, exact and near copies."""
    rows = []
    for i in range(120):
        lang = "fr" if i % 3 == 0 else "en"
        rows.append((i, prose(i, 60 + 7 * (i % 40), lang), lang, "s", 0))
    for i in range(120, 150):
        text = rows[i - 120][1]
        rows.append((i, text if i % 2 else text + " and", rows[i - 120][2], "s", 0))
    return spark.createDataFrame(rows, SCHEMA).repartition(4).checkpoint()

"""The registered queries against their SQL, and the driver's contract."""

import pytest

import __spark_entry__ as E
from tests.conftest import DATA
from verification.compare import difference, oracle_connection
from verification.oracle import ORACLE
from verification.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return oracle_connection(DATA)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    found = difference(spark, con, DATA, name)
    assert found is None, found


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(E.oracle_sql()) <= set(E.queries()) and set(QUERIES) <= set(E.queries())


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() == 8 and df.columns[:2] == ["position", "column"]


@pytest.mark.parametrize("name", ["normalise_text", "bag_of_words", "tf_idf"])
def test_text_features_read_documents(spark, name):
    out = QUERIES[f"feature_{name}_documents"](spark, DATA)
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert out.columns[0] == "doc_id" and out.select("doc_id").distinct().count() > 0.9 * n


def test_every_event_is_encoded(spark):
    out = QUERIES["feature_target_encode_unseen"](spark, DATA)
    assert out.count() == spark.read.parquet(f"{DATA}/events.parquet").count()

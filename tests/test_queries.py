"""All queries outside the optional subpackage against SQL on the smallest tables."""

import pytest

from siltline.operators import queries as operators
from siltline.plans import queries as dialect
from tests.oracle import duck, same

QUERIES = dialect.QUERIES | operators.QUERIES
ORACLES = dialect.ORACLES | operators.ORACLES


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, data, con, name):
    same(QUERIES[name](spark, data), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_the_collection_has_all_media(spark, data):
    entries = dialect.QUERIES["collection_document"](spark, data).filter("value LIKE '%\"target\":%'").selectExpr("get_json_object(ltrim(',', value), '$.target') AS id")
    media = spark.read.parquet(f"{data}/media_metadata.parquet").select("id")
    assert entries.exceptAll(media).count() == 0 and media.exceptAll(entries).count() == 0


def test_entry_without_the_optional_part():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())

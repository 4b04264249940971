import duckdb
import pytest

import __spark_entry__ as contract
from compare import differences, tables
from loglens.plans.oracles import ORACLES
from loglens.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return tables(SMALL)


def test_every_query_of_the_library_has_sql():
    assert set(QUERIES) == set(ORACLES) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_against_sql(spark, db, name):
    assert differences(contract.queries()[name](spark, SMALL), db, contract.oracle_sql()[name]) == []


def test_replayed_limit_goes_by_the_stamps_alone(spark, tmp_path):
    # stamps far ahead of this machine's clock, some at the same time
    spark.range(600).selectExpr(
        "id AS event_id", "TIMESTAMP_NTZ '2090-01-01 00:00:00' + make_dt_interval(0, 0, 10 * (id div 4)) AS ts", "id % 9 AS user_id",
        "'click' AS event_type", "1.0D AS value", "'{}' AS props").write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("rate_limit", "stream_rate_limit"):
        assert differences(QUERIES[name](spark, str(tmp_path)), db, ORACLES[name]) == []

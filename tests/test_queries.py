"""Every registered query against its SQL counterpart in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from quayside.catalogue.oracle import oracle_sql
from quayside.catalogue.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] + 0.0 if isinstance(row[i], float) else row[i] for i in order) for row in rows]
    return sorted(picked, key=lambda row: [(value is None, str(value)) for value in row])


def test_each_query_has_a_counterpart():
    assert set(QUERIES) == set(oracle_sql())
    assert QUERIES.items() <= entry.queries().items()
    assert oracle_sql().items() <= entry.oracle_sql().items()


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() == 890


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, FOLDER)
    expected = duck.execute(oracle_sql()[name])
    columns = [column[0] for column in expected.description]
    assert sorted(result.columns) == sorted(columns)
    got = _sorted(result.columns, [tuple(row) for row in result.collect()])
    want = _sorted(columns, expected.fetchall())
    assert len(got) == len(want)
    assert got == want
    if got:
        assert [type(v) for v in got[0]] == [type(v) for v in want[0]]


@pytest.mark.parametrize("name, keys", [
    ("bom_indented", ["FullPath"]),
    ("allocation_report", ["Item Code", "Allocation Priority Rank"]),
    ("forecast_report", ["Year", "Month Number", "Forecast Reference", "Customer Code", "Product Code"]),
])
def test_reports_come_in_the_order_of_the_sql(spark, duck, name, keys):
    """Row by row the same sort keys as the SQL ordered by them, text by bytes."""
    wanted = ", ".join(f'"{key}"' for key in keys)
    expected = duck.execute(f"select {wanted} from ({oracle_sql()[name]}) order by {wanted}").fetchall()
    got = [tuple(row[key] for key in keys) for row in QUERIES[name](spark, FOLDER).collect()]
    assert got == expected

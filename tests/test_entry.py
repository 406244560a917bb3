import duckdb
import pytest

from arborlake.plans import inventory

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", inventory.ORACLE)
def test_query_equals_sql(spark, db, name):
    got = inventory.QUERIES[name](spark, DATA)
    want = db.sql(inventory.ORACLE[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted(map(tuple, got.select(columns).collect()), key=key) == sorted(want.select(*[f'"{c}"' for c in columns]).fetchall(), key=key)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5 and set(inventory.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_scan_of_the_tables_folder(spark):
    got = inventory.QUERIES["scan_files"](spark, DATA).collect()
    assert {f"{t}.parquet" for t in TABLES} <= {r.name for r in got} | {r.name.split("/")[0] for r in got} and set(inventory.QUERIES) - set(inventory.ORACLE) == {"scan_files"}

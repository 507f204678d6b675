import duckdb
import pytest

from bytegrain.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events", "documents", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, tables, name):
    got = QUERIES[name](spark, SF)
    want = tables.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted(repr(tuple(r)) for r in got.select(*columns).collect())
    assert rows == sorted(repr(r) for r in want.select(*(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_crc32(spark):
    import zlib

    texts = {str(r["doc_id"]): r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r["crc32"] == zlib.crc32(texts[r["logical_name"]].encode()) for r in QUERIES["crc32_documents"](spark, SF).collect())

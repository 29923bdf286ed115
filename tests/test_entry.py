import math

import duckdb
import pytest

import __spark_entry__ as driver
from textloom.plans import catalog

TABLES = "events documents labels".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (int, str, bool)) else float(v) if not hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, small, duck, name):
    df = catalog.queries()[name](spark, small)
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in df.collect())
    at = [columns.index(c) for c in sorted(columns)]
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())


def test_entry(spark):
    assert driver.entry(spark).columns == ["doc_id", "n_spans", "body_md5"]
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert "pii_scrub" in driver.queries()

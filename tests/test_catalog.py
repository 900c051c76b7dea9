"""Every registered query against its SQL on the small tables."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from sediment.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(frame, columns):
    return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if sql := catalog.oracle_sql().get(name):
        want = duck.sql(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert rows(got, columns) == rows(want, columns)
    else:
        assert len(got) > 0


def test_places_of_many_and_odd_urls(spark, tmp_path):
    """Nulls, dots and slashes; and ranges whose bounds are sampled from few of the rows, so that two readings could disagree."""
    odd = [None, "", ".", "!", "-", "/", "a/", "a", "./b", "é/x", "Z/x", "a//b"]
    urls = odd + [f"https://m{k % 13}.example/{k * 7919 % 20011}/{'deep/' * (k % 3)}{k}" for k in range(20_000)]
    spark.createDataFrame([(k, u, "") for k, u in enumerate(urls + urls[:500])], "page_id long, url string, html string").repartition(8).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(con.sql(catalog.oracle_sql()["path_order"]).fetchall())
    key = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    spark.conf.set(key, 1)
    try:
        got = [tuple(r) for r in catalog.queries()["path_order"](spark, str(tmp_path)).select("path", "place").collect()]
    finally:
        spark.conf.unset(key)
    assert len(got) == len(want) and dict(got) == want


def test_entry_needs_no_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)

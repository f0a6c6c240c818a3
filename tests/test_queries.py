import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

SF = str(DATA / "sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(SF + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(q for q in entry.queries() if q in entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rel = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(df.columns)
    text = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    assert text(df.select(*columns).collect()) == text(rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_moments_cover_all_tables(spark):
    got = entry.queries()["p1_found"](spark, SF)
    assert got.columns == ["src", "rec_key", "norm"]
    assert {r[0] for r in got.select("src").distinct().collect()} == {"job", "collect_naver_page", "collect_cj_page"}
    assert got.filter("NOT norm RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9:]{8}[.][0-9]{6}Z)?$'").count() == 0

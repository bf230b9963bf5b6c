"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

from loomtide.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    want = db.sql(catalog.ORACLE_SQL[name])
    place = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(str(r[i]) for i in place) for r in want.fetchall())


def test_nearest_tags_of_every_page(spark, db):
    got = catalog.QUERIES["nearest_tags_by_page"](spark, SF)
    assert {r.page_id for r in got.select("page_id").distinct().collect()} == {i for (i,) in db.sql("select vec_id from embeddings").fetchall()}

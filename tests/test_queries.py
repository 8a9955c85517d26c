"""Every core query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from foliary import catalogue
from foliary.plans import files, rows, text

ALL = catalogue.queries()


def plain(v):
    if hasattr(v, "is_finite"):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, sf_dir, db, name):
    df = ALL[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(set(df.columns)) == len(df.columns)
        return
    res = db.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in res.fetchall())
    assert got == want


def test_modules_are_listed():
    assert set(ALL) == set(text.QUERIES) | set(rows.QUERIES) | set(files.QUERIES)

"""Every core query with SQL against DuckDB, over the smallest tables."""

import math

import duckdb
import pytest

from stratalog.plans import extras, integrity, listings, values  # noqa: F401  register more
from stratalog.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    c = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in c.description]
    want = c.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    assert sorted(tuple(plain(r[x]) for x in order) for r in got) == sorted(tuple(plain(r[names.index(x)]) for x in order) for r in want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0

"""Queries over keys, values and folders that the small tables don't have, against their SQL."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from stratalog.functions import scalars as S
from stratalog.plans import extras, integrity, listings, values  # noqa: F401  register more
from stratalog.plans.queries import ORACLE_SQL, QUERIES

from test_queries import plain

#: The SQL's times end with 64 bits, at document 106,751; here they have 128.
NARROW = "CAST(doc_id * 86400000000000 + CASE WHEN doc_id % 11 = k THEN k * 3600000000000 ELSE 0 END AS BIGINT)"
WIDE = "(CAST(doc_id AS HUGEINT) * 86400000000000 + CASE WHEN doc_id % 11 = k THEN k * 3600000000000 ELSE 0 END)"


@pytest.fixture(scope="module")
def far(tmp_path_factory, sf):
    """Documents with small and with large ids."""
    path = tmp_path_factory.mktemp("far")
    duckdb.sql(f"COPY (SELECT * FROM '{sf}/documents.parquet' UNION ALL SELECT * REPLACE (doc_id + 600000 AS doc_id) FROM '{sf}/documents.parquet') TO '{path}/documents.parquet'")
    return str(path)


def rows(names, found):
    return sorted(tuple(plain(r[n]) for n in sorted(names)) for r in found)


def by_sql(sql, **tables):
    c = duckdb.connect()
    for t, path in tables.items():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}', filename = true, file_row_number = true)")
    x = c.execute(sql)
    names = [d[0] for d in x.description]
    return rows(names, (dict(zip(names, r)) for r in x.fetchall()))


@pytest.mark.parametrize("name", ["drifted_files", "find_by_snapshot", "item_columns", "file_cache_hits", "find_items", "reusable_parents", "file_cache_section", "find_totals", "sorted_contents"])
def test_times_beyond_64_bits(spark, far, name):
    df = QUERIES[name](spark, far)
    assert rows(df.columns, df.collect()) == by_sql(ORACLE_SQL[name].replace(NARROW, WIDE).replace("mtime_ns // 1000", "CAST(mtime_ns // 1000 AS BIGINT)"), documents=f"{far}/documents.parquet")


def test_mtime_string_keeps_the_second(spark):
    df = spark.createDataFrame([(1_700_000_000_999_999_999,)], "t long")
    assert df.select(S.mtime_string("t")).first()[0] == "2023-11-14 22:13:20"
    assert df.select(S.mtime_string(-F.col("t"))).first()[0] == "1916-02-18 01:46:39"


def test_savings_round_as_the_sql(spark):
    df = spark.createDataFrame([(216300,), (1218900,), (600000,)], "n long")
    assert [r[0] for r in df.select(S.savings_percent("n", F.lit(600000))).collect()] == [64.0, -103.2, 0.0]


def test_quota_of_equal_numbers_and_nulls(spark, tmp_path):
    """Spark reads the larger, later file first. The SQL leaves the order of equal numbers open; here it is the table's."""
    row = "SELECT CAST({} AS BIGINT) AS l_suppkey, CAST({} AS BIGINT) AS l_orderkey, CAST({} AS INTEGER) AS l_linenumber, CAST({} AS DOUBLE) AS l_quantity"
    (tmp_path / "lineitem.parquet").mkdir()
    first = [row.format(3, 1, 1, 99_950), *(row.format(3, 5, 1, 40) for _ in range(2)), row.format("NULL", 1, 1, 7), row.format(4, "NULL", 1, 60_000), row.format(5, 1, 1, "NULL")]
    later = [*(row.format(3, 5, 1, 5) for _ in range(2)), row.format(4, 9000, 1, 40_000.5), row.format(4, 9000, 2, 1.5), row.format(5, 5000, "NULL", 99_999), row.format(5, 5000, 1, 2), row.format(5, 5000, 2, "NULL")]
    more = "SELECT i % 10 * 10 + 6, 20000 + i, CAST(1 AS INTEGER), CAST(1 + hash(i) % 50 AS DOUBLE) FROM range(20000) AS t(i)"
    for k, parts in enumerate((first, [*later, more])):
        duckdb.sql(f"COPY ({' UNION ALL '.join(parts)}) TO '{tmp_path}/lineitem.parquet/part-{k}.parquet'")
    df = QUERIES["quota_usage"](spark, str(tmp_path))
    got, want = rows(df.columns, df.collect()), by_sql(ORACLE_SQL["quota_usage"].replace("l_linenumber ROWS", "l_linenumber, filename, file_row_number ROWS"), lineitem=f"{tmp_path}/lineitem.parquet/*.parquet")
    assert [x for x in got if x not in want] == [x for x in want if x not in got] == []
    assert got == want


def test_storage_keys_of_tables_in_parts(spark, sf, tmp_path):
    """A table is one key, be it a file or a folder, also below a folder of the same name."""
    top = tmp_path / "store" / "store"
    for f in Path(sf).glob("*.parquet"):
        for part in range(3) if f.stem in ("documents", "pages") else (None,):
            to = top / f.name if part is None else top / f.name / f"part-{part}.parquet"
            to.parent.mkdir(parents=True, exist_ok=True)
            to.symlink_to(f)
    df = QUERIES["storage_keys"](spark, str(top))
    assert rows(df.columns, df.collect()) == by_sql(ORACLE_SQL["storage_keys"])

"""Every registered query of the operators beside its SQL, at the smallest scale."""

import math

import duckdb
import pytest

from framewright import queries

SF = "/root/testdata/sf0.001"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _rows(rows, columns):
    names = sorted(columns)
    at = [columns.index(c) for c in names]
    return sorted(repr(tuple(round(r[i], 9) if isinstance(r[i], float) and math.isfinite(r[i]) else r[i] for i in at)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    mine = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name in queries.ORACLE_SQL:
        found = con.execute(queries.ORACLE_SQL[name])
        columns = [c[0] for c in found.description]
        assert sorted(df.columns) == sorted(columns)
        assert _rows(mine, df.columns) == _rows(found.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.count() > 0 and "caption" in out.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_do_not_count(spark, images, parts):
    from framewright.nodes import ExactDedupe, Sorted, Take

    plain = queries.piped(spark, images, ExactDedupe, lambda: Sorted("score"), lambda: Take(5)).collect()
    again = queries.piped(spark, images.repartition(parts), ExactDedupe, lambda: Sorted("score"), lambda: Take(5)).collect()
    key = lambda rows: [(r.objectid, r.original_path) for r in sorted(rows, key=lambda r: r._pos)]
    assert key(plain) == key(again)

import duckdb
import pytest

import __spark_entry__ as entry
from tallyloom.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE_SQL:
        assert got[1]
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    q = con.execute(ORACLE_SQL[name])
    want = rows_of([c[0] for c in q.description], q.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert all(abs(x - y) < 2e-6 if isinstance(x, float) and y is not None else x == y for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

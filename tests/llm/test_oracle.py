import duckdb
import pytest

from tallyloom.llm.oracle import ORACLE_SQL
from tallyloom.llm.queries import QUERIES


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_matches_sql(spark, name):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    q = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in q.description]
    want = {r[names.index("doc_id")]: r for r in q.fetchall()}
    got = {r["doc_id"]: tuple(r[c] for c in names) for r in QUERIES[name](spark, d).collect()}
    assert got == want

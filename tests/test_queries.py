"""Every query with SQL gives the same rows in DuckDB."""

from pathlib import Path

import pytest

from floorops.plans import curation_queries, document_queries, record_queries, report_queries  # noqa: F401
from floorops.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 4)
    return str(v) if not isinstance(v, (int, bool)) else v


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = con.execute(ORACLE[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == cols
    rows = [tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall()]
    mine = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    assert sorted(mine, key=repr) == sorted(rows, key=repr)


def test_every_message_reaches_task_fold_all(spark, con):
    blocked = {r[0] for r in con.execute("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING l_orderkey % 2 = 1 AND bool_and(l_returnflag = 'R')").fetchall()}
    assert blocked
    got = {r["task_id"]: r["status"] for r in QUERIES["task_fold_all"](spark, SF).collect()}
    assert {got[k] for k in blocked} == {"blocked"}

"""Every query of the engine against its SQL on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from graphloom import queries as core

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(core.QUERIES))
def test_matches_sql(spark, db, name):
    df = core.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = Counter(tuple(map(str, r)) for r in df.select(*columns).collect())
    if name not in core.ORACLE_SQL:
        assert got
        return
    result = db.execute(core.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    expected = Counter(tuple(str(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == expected


def test_plans_stay_narrow(spark):
    """A mapping is one scan and one explode: no exchange, no Python, pruned columns."""
    import __spark_entry__

    plan = __spark_entry__.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    pruned = core.QUERIES["pattern_pruning"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "c_acctbal" not in pruned and "c_mktsegment" not in pruned

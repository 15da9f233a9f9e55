"""Queries against their SQL on the smallest tables (skipped where these aren't)."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
ORACLES = {k: v for k, v in __spark_entry__.oracle_sql().items() if not k.startswith(("p2", "p3", "p6", "p7", "p8", "p9", "p10"))}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "~" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)[:19]
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    df = __spark_entry__.queries()[name](spark, SF)
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(want.fetchall(), columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["product_id", "delta_pct", "cur_price", "prev_price", "cur_date", "prev_date"]

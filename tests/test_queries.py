"""Every query of the registry against its SQL, and a few properties of the registry."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from snapweave.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) or hasattr(x, "dtype") else x

    out = [tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    ours, theirs = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_registry():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_partitioning_does_not_matter(spark):
    """Representatives are minima over total orders."""
    from snapweave.operators import findings
    from snapweave.plans.reference_queries import sides

    b, c = sides(spark, SF)
    once = findings.structural(b, c, ["document", "target"]).toPandas()
    again = findings.structural(b.repartition(7), c.repartition(3, "construct"), ["document", "target"]).toPandas()
    assert rows(once) == rows(again)


def test_spans_of_odd_lines_against_sql(spark, tmp_path):
    """Halves, nulls, spans that end before they start and no document, where the SQL leaves no choice."""
    lines = [(1, 1.5, 2), (1, 2.5, 2), (1, 9.0, 1), (2, -1.5, 1), (2, -2.5, 1), (2, 0.5, 1), (3, None, 2), (3, 4.0, 2), (3, 5.0, None), (3, 5.0, 1)]
    lines += [(4, 4.0, -2), (4, 4.0, -2), (4, 4.0, -1), (4, 9.0, 0), (5, None, None), (5, None, 1), (6, 4.0, None), (None, 4.0, 2), (None, 4.0, 3)]
    con = duckdb.connect()
    con.execute("create table lineitem (l_orderkey bigint, l_quantity double, l_linenumber integer)")
    con.executemany("insert into lineitem values (?, ?, ?)", lines)
    con.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet' (format parquet)")
    ours = [tuple(r) for r in registry.QUERIES["interval_union"](spark, str(tmp_path)).select("document", "start", "end").collect()]
    assert sorted(ours, key=repr) == sorted(con.execute(registry.ORACLE_SQL["interval_union"]).fetchall(), key=repr)

"""Every query with SQL against DuckDB; the others run."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from compare import rows_of, rows_of_sql

from loomlog.plans import library

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(library.queries()))
def test_query(spark, duck, name):
    found = rows_of(library.queries()[name](spark, SF))
    if name in library.oracle_sql():
        assert found == rows_of_sql(duck, library.oracle_sql()[name])
    assert found[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans(spark):
    """No cross joins in the as-of queries, and filters and columns reach the scan."""
    plan = lambda name: library.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan("notify_lag_asof_forward") and "CartesianProduct" not in plan("before_after_windows")
    who = plan("who_touched")
    assert "StringStartsWith(p_name,red)" in who and "p_retailprice" not in who.split("== Physical Plan ==")[1]


def test_chains_longer_than_sixteen_steps(spark, tmp_path):
    """Trees whose deepest nodes are 17 to 22 steps below their root equal their SQL."""
    import duckdb

    con, deep = duckdb.connect(), [0, *(2**i for i in range(22)), 7, 14, 21, 10**6]
    spark.createDataFrame([(k,) for k in deep], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    events = [(n * 10 + i, u, kind) for n, u in enumerate(deep) for i, kind in enumerate(("click", "signup", "error"))]
    df = spark.createDataFrame(events, "event_id long, user_id long, event_type string").selectExpr("*", "timestamp_seconds(1704067200 + event_id) AS ts", "5.0D AS value", "'{\"k\": 7}' AS props")
    df.selectExpr("event_id", "cast(ts AS timestamp_ntz) AS ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    for name in ("customer", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("lineage_recursive", "view_lineage_roots", "view_session_tree"):
        assert rows_of(library.queries()[name](spark, str(tmp_path))) == rows_of_sql(con, library.oracle_sql()[name])

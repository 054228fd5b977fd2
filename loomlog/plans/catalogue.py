"""Registry of the queries over the generic tables: name -> (DataFrame function, the same in DuckDB's SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of a table reader under a name, with its SQL twin."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        _QUERIES[name] = run
        if sql:
            _ORACLES[name] = sql
        return fn

    return register


def queries() -> dict[str, Query]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _ORACLES


@query(
    "tool_reliability",
    """SELECT event_type, count(*) AS n, round(avg((value > 50)::INT), 4) AS slow_rate,
    round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95
    FROM events GROUP BY event_type""",
)
def tool_reliability(t):
    """Calls, share of slow ones and exact latency percentiles by event type."""
    return t("events").groupBy("event_type").agg(
        F.count("*").alias("n"),
        F.round(F.avg((F.col("value") > 50).cast("int")), 4).alias("slow_rate"),
        F.round(F.percentile("value", 0.5), 6).alias("p50"),
        F.round(F.percentile("value", 0.95), 6).alias("p95"),
    )

"""Session factory with the settings that the engine's results rest on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "loomlog", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings given as keywords use __ for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out over all cores if it is a table of so few files and splits that most would be idle (a few row groups).

    For work on texts that costs more than moving them. A table of as many files or splits as cores is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = 0 < len(df.inputFiles()) < cores and df.rdd.getNumPartitions() < cores
    return df.repartition(cores) if few else df

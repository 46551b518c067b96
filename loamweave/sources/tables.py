"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def settle(spark: SparkSession) -> SparkSession:
    """The session with one default of Spark 4.1 put right for its queries.

    A union of inputs partitioned alike is taken as partitioned by the same keys, but
    adaptive execution may coalesce the inputs apart, and then a key's rows end in two
    groups. Without that shortcut a union is shuffled like anything else.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of ``folder``; with ``columns`` only these are read."""
    df = settle(spark).read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df

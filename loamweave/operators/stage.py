"""Shared building blocks: durable stages, newest rows, distributed ordinals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamweave.sources.tables import settle

ROWS_PER_BUCKET = 50_000


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there.

    The folder is the session's ``spark.checkpoint.dir``, which all executors share. A
    session without one raises, except in local mode, where one machine holds driver and
    executors: it gets ``spark.local.dir``.
    """
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    settle(spark)
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(folder or f"{spark.conf.get('spark.local.dir', '/tmp')}/loamweave-{context.applicationId}")
    return df.checkpoint(eager=True)


def newest(df: DataFrame, keys: list[str], when: str, columns: list[str]) -> DataFrame:
    """The row with the greatest ``when`` of each key; one shuffle, combined on the map side.

    A null ``when`` loses to any time. Rows that tie on ``when`` are decided by the
    other columns, so the result does not depend on the order of rows.
    """
    rest = [c for c in columns if c not in keys and c != when]
    ordered = F.max(F.struct(when, *rest))
    picked = df.groupBy(*keys).agg(ordered.alias("_row"))
    return picked.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in columns if c not in keys))


def bucket_count(rows: int, per_bucket: int = ROWS_PER_BUCKET) -> int:
    return max(1, math.ceil(rows / per_bucket))


def running_total(df: DataFrame, keys: list[str], unique: list[str], value: Column, name: str, buckets: int) -> DataFrame:
    """Exclusive running total of ``value`` inside each key group, in a fixed pseudo-random order.

    A group is cut into ``buckets`` hash buckets, each summed on its own and shifted
    by the totals of the buckets before it, so no group has to fit into one task.
    ``unique`` names the columns that tell the rows of a group apart.
    """
    df = df.withColumn("_b", F.pmod(F.xxhash64(*unique), F.lit(buckets)).cast("int")).withColumn("_v", value)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t"))
        .withColumn("_o", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(*unique).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_w", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
        .join(offsets, [*keys, "_b"])
        .withColumn(name, F.col("_w") + F.col("_o")).drop("_b", "_v", "_w", "_o")
    )


def ordered_total(df: DataFrame, keys: list[str], order: str, value: Column, name: str, span: int = 4096) -> DataFrame:
    """Exclusive running total of ``value`` in the order of the integer column ``order``, whose values are distinct within a key.

    Each span of ``order`` is summed on its own and shifted by the totals of the spans
    before it, so no key has to fit into one task.
    """
    df = df.withColumn("_c", F.floor(F.col(order) / span).cast("long")).withColumn("_v", value)
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*keys, "_c").agg(F.sum("_v").alias("_t")).withColumn("_o", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    inside = Window.partitionBy(*keys, "_c").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn("_w", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return summed.join(offsets, [*keys, "_c"]).withColumn(name, F.col("_w") + F.col("_o")).drop("_c", "_v", "_w", "_o")


def numbers(df: DataFrame, order: str, name: str) -> DataFrame:
    """Numbers from 0 in the order of a column of distinct values: ranges of it are numbered on their own and shifted by the sizes of those before."""
    parted = stage(df.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    sizes = [(r["_p"], r["count"]) for r in parted.groupBy("_p").count().orderBy("_p").collect()]  # a row a range
    before, shifts = 0, []
    for p, n in sizes:
        shifts.append((p, before))
        before += n
    offsets = df.sparkSession.createDataFrame(shifts, "_p int, _o long")
    inside = Window.partitionBy("_p").orderBy(order)
    return parted.join(F.broadcast(offsets), "_p").withColumn(name, F.row_number().over(inside) - 1 + F.col("_o")).drop("_p", "_o")  # a row a range

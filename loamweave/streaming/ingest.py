"""Incremental ingest as a stream of files: each micro-batch is diffed against the manifest and chunked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loamweave.operators.chunking import chunk_pages
from loamweave.operators.ingest import diff
from loamweave.operators.stage import newest
from loamweave.sources import files

COMPACT = 16


def page_stream(spark: SparkSession, folder: str, schema: str = "page_id string, title string, content string, updated_at timestamp") -> DataFrame:
    """Pages that arrive as JSON lines in a folder."""
    return spark.readStream.schema(schema).json(folder)


def ingest(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Chunks new and changed pages of every batch into ``out``/chunks and ``out``/manifest, then stops when all is read.

    A batch that is replayed after a failure overwrites its own folder, so nothing is
    written twice. Every ``COMPACT`` batches the manifest folders are put together to one.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        now = df.groupBy("page_id").agg(F.max(F.struct("updated_at", "title", "content")).alias("p")).select("page_id", "p.*")
        current = now.select(F.col("page_id").alias("path"), F.sha2("content", 256).alias("sha256"))
        empty = spark.createDataFrame([], "path string, sha256 string, status string, batch long")
        seen = spark.read.schema(empty.schema).parquet(*folders).where(F.col("batch") < number) if (folders := files.folders(spark, f"{out}/manifest", "batch_")) else empty
        known = seen.groupBy("path").agg(F.max(F.struct("batch", "sha256", "status")).alias("m")).select("path", "m.sha256", "m.status")
        changed = diff(current, known).where("state in ('new', 'modified')")
        chunk_pages(now.join(changed.select(F.col("path").alias("page_id")), "page_id", "left_semi")).write.mode("overwrite").parquet(f"{out}/chunks/batch_{number}")
        new = changed.select("path", "sha256", F.lit("processed").alias("status"), F.lit(number).cast("long").alias("batch"))
        if number and number % COMPACT == 0:
            new = newest(seen.unionByName(new), ["path"], "batch", ["path", "batch", "sha256", "status"]).select("path", "sha256", "status", "batch")
        new.write.mode("overwrite").parquet(f"{out}/manifest/batch_{number}")
        if number and number % COMPACT == 0:
            files.drop(spark, [f for f in folders if int(f.rsplit("_", 1)[1]) < number])

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(events: DataFrame) -> DataFrame:
    """Events per hour and type, late ones up to two hours."""
    return events.withWatermark("ts", "2 hours").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))

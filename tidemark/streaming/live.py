"""Structured Streaming forms of ingest, resolution and throughput. They give what the batch forms give on the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.operators import resolve, validate


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def newest(log: DataFrame) -> DataFrame:
    """Newest revision of each key as a streaming aggregate (update or complete mode).

    A larger (seq, op) replaces a smaller one whatever the order of arrival, and repeats change nothing, so no watermark is needed.
    """
    return resolve.newest(log)


def expiring(log: DataFrame, ts: str, keep: str) -> DataFrame:
    """The same per window of event time, whose state the watermark lets go: for logs whose deletes may be forgotten after `keep`."""
    best = F.max_by(F.struct("seq", "op", "value"), F.struct("seq", "op"))
    grouped = log.withWatermark(ts, keep).groupBy(F.window(ts, keep).alias("w"), "key").agg(best.alias("b"))
    return grouped.select(F.col("w.end").alias("until"), "key", "b.*")


def throughput(events: DataFrame, ts: str = "ts", every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w")).agg(F.count(F.lit(1)).alias("ops"))
    return w.select(F.col("w.start").alias("start"), "ops")


def committed_batches(records: DataFrame, ts: str, late: str) -> DataFrame:
    """Operations of batches (batch_id, type, ...) whose commit arrived; a batch without one is let go with the watermark."""
    marks = records.withWatermark(ts, late)
    body = F.collect_list(F.when(F.col("type").isin(1, 2), F.struct("seq", "type", "key", "value")))
    done = marks.groupBy(F.window(ts, late).alias("w"), "batch_id").agg(body.alias("ops"), F.max(F.col("type") == 4).alias("done"))
    return done.filter("done").select("batch_id", F.explode("ops").alias("o")).select("batch_id", "o.*")


def append_valid(log: DataFrame, path: str, checkpoint: str, rejected: Callable[[DataFrame], None] | None = None) -> DataStreamWriter:
    """A sink that appends rows that pass all checks to a table; the others go to `rejected`."""

    def write(batch: DataFrame, _: int) -> None:
        checked = validate.problems(batch)
        checked.filter("problem is null").drop("problem").write.mode("append").parquet(path)
        if rejected:
            rejected(checked.filter("problem is not null"))

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)

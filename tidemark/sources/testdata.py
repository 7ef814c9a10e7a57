"""The driver tables as mutation logs, file metadata, batches and latencies; each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mutation_log(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    """One mutation an event: the user (or user and event type) is the key, an error deletes, anything else puts its properties."""
    e = table(spark, sf_dir, "events")
    key = F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 10, "0"))
    key = F.concat(key, F.lit(":"), F.col("event_type")) if by_type else key
    gone = F.col("event_type") == "error"
    return e.select(
        F.encode(key, "UTF-8").alias("key"),
        (F.col("event_id") + 1).alias("seq"),
        F.when(gone, 2).otherwise(1).alias("op"),
        F.when(~gone, F.encode("props", "UTF-8")).alias("value"),
        "ts",
        "event_id",
        "user_id",
        "event_type",
    )


LOG_SQL = """L AS (
  SELECT 'user:' || lpad(CAST(user_id AS VARCHAR), 10, '0') AS key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op,
    CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value, ts, event_id, user_id, event_type FROM events
)"""

#: The log of finer keys, by user and event type.
LOG_BY_TYPE_SQL = LOG_SQL.replace("'0') AS key", "'0') || ':' || event_type AS key")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of 24 files: the log cut by sequence number into 8 ranges, each by key range into 3; levels 0 to 3 by file."""
    log = mutation_log(spark, sf_dir)
    return file_metadata(with_file(log))


def with_file(log: DataFrame) -> DataFrame:
    """The log with the number and level of the file that a row stands in."""
    num = (F.col("event_id") % 8) * 3 + F.col("user_id") % 3 + 1
    return log.withColumn("file_num", num).withColumn("level", F.when(num <= 6, 0).when(num <= 12, 1).when(num <= 18, 2).otherwise(3).cast("long"))


def file_metadata(rows: DataFrame) -> DataFrame:
    """(level, file_num, file_size, smallest_key, largest_key, smallest_seq, largest_seq) of rows that name their file."""
    size = F.lit(27) + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return rows.groupBy("level", "file_num").agg(
        F.sum(size).alias("file_size"),
        F.min("key").alias("smallest_key"),
        F.max("key").alias("largest_key"),
        F.min("seq").alias("smallest_seq"),
        F.max("seq").alias("largest_seq"),
    )


FILES_SQL = f"""{LOG_SQL}, LF AS (
  SELECT *, (event_id % 8) * 3 + user_id % 3 + 1 AS file_num,
    CASE WHEN (event_id % 8) * 3 + user_id % 3 + 1 <= 6 THEN 0 WHEN (event_id % 8) * 3 + user_id % 3 + 1 <= 12 THEN 1
      WHEN (event_id % 8) * 3 + user_id % 3 + 1 <= 18 THEN 2 ELSE 3 END AS level FROM L
), F AS (
  SELECT level, file_num, sum(27 + length(key) + coalesce(length(value), 0)) AS file_size, min(key) AS smallest_key, max(key) AS largest_key,
    min(seq) AS smallest_seq, max(seq) AS largest_seq FROM LF GROUP BY level, file_num
)"""


def narrow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level-0 files of narrow key ranges, so that overlap makes several islands: customers by key, in groups with gaps between them."""
    c = table(spark, sf_dir, "customer").filter("c_custkey % 40 < 26")
    key = F.encode(F.lpad(F.col("c_custkey").cast("string"), 10, "0"), "UTF-8")
    rows = c.select((F.expr("c_custkey div 40") * 2 + F.when(F.col("c_custkey") % 40 < 16, 0).otherwise(1)).alias("file_num"), key.alias("key"), F.expr("c_custkey div 7").alias("x"))
    out = rows.groupBy("file_num").agg(F.min("key").alias("smallest_key"), F.max("key").alias("largest_key"), F.count(F.lit(1)).alias("file_size"))
    wide = F.encode(F.lpad((F.decode("largest_key", "UTF-8").cast("long") + F.when(F.col("file_num") % 6 == 0, 30).otherwise(0)).cast("string"), 10, "0"), "UTF-8")
    return out.select(F.lit(0).cast("long").alias("level"), "file_num", "file_size", "smallest_key", wide.alias("largest_key"))


NARROW_FILES_SQL = """N AS (
  SELECT file_num, min(key) AS smallest_key, lpad(CAST(CAST(max(key) AS BIGINT) + CASE WHEN file_num % 6 = 0 THEN 30 ELSE 0 END AS VARCHAR), 10, '0') AS largest_key, count(*) AS file_size
  FROM (SELECT (c_custkey // 40) * 2 + CASE WHEN c_custkey % 40 < 16 THEN 0 ELSE 1 END AS file_num, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS key FROM customer WHERE c_custkey % 40 < 26)
  GROUP BY file_num
)"""


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("op"), (F.col("user_id") % 8).alias("worker"), F.round(F.col("value") * 1000000).cast("long").alias("ns"))


LATENCIES_SQL = "T AS (SELECT event_type AS op, user_id % 8 AS worker, CAST(round(value * 1000000) AS BIGINT) AS ns FROM events)"

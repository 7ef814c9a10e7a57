"""Skewed key workloads and the report of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXACT_ZETA = 10_000


def zeta(n: int, theta: float) -> float:
    """Sum of 1 / i**theta: exact for the first 10,000 terms, beyond by the integral with the trapezoid correction."""
    head = sum(i**-theta for i in range(1, min(n, EXACT_ZETA) + 1))
    if n <= EXACT_ZETA:
        return head
    return head + (n ** (1 - theta) - EXACT_ZETA ** (1 - theta)) / (1 - theta) + (n**-theta - EXACT_ZETA**-theta) / 2


def zipf_probability(rank: Column, n: int, theta: float = 0.99) -> Column:
    return F.pow(rank + 1, F.lit(-theta)) / F.lit(zeta(n, theta))


def zipf_rank(u: Column, n: int, theta: float = 0.99) -> Column:
    """Rank from 0 for a uniform number: the two hottest by their probability, the rest by the inverse of the integral."""
    z, two = zeta(n, theta), 1 + 0.5**theta
    eta = (1 - (2 / n) ** (1 - theta)) / (1 - two / z) if n > 1 else 0.0
    tail = F.floor(F.lit(float(n)) * F.pow(F.lit(eta) * u - F.lit(eta) + 1, F.lit(1 / (1 - theta))))
    return F.when(u * z < 1, 0).when(u * z < two, 1).otherwise(F.least(F.lit(n - 1), F.greatest(F.lit(0), tail))).cast("long")


def key_of(rank: Column, prefix: str = "user") -> Column:
    return F.concat(F.lit(prefix), F.lpad(rank.cast("string"), 10, "0"))


def operations(spark: SparkSession, n: int, keyspace: int, read_ratio: int = 80, seed: int = 42, theta: float = 0.99) -> DataFrame:
    """(seq, op, key): `n` gets and puts on Zipf keys; the same seed gives the same rows. Digits of an MD5 are the random numbers."""
    digits = F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}")))
    number = lambda at, n: F.conv(F.substring(digits, at, n), 16, 10).cast("long")
    rows = spark.range(n).select(F.col("id").alias("seq"), ((number(1, 10) + 0.5) / float(1 << 40)).alias("u"), (number(11, 8) % 100).alias("mix"))
    u, mix = F.col("u"), F.col("mix")
    return rows.select("seq", F.when(mix < read_ratio, "GET").otherwise("PUT").alias("op"), key_of(zipf_rank(u, keyspace, theta)).alias("key"))


def lab_operations(spark: SparkSession, n: int, read_ratio: int) -> DataFrame:
    """(seq, op, key): a fixed round of reads and writes over a thousand keys."""
    return spark.range(n).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 100 < read_ratio, "GET").otherwise("PUT").alias("op"),
        F.concat(F.lit("bench:k:"), F.lpad((F.col("id") % 1000).cast("string"), 8, "0")).alias("key"),
    )


def milliseconds(ns: Column) -> Column:
    return F.format_string("%.2f ms", ns / 1e6)


def report(rows: DataFrame, seconds: float) -> DataFrame:
    """One row: operations by kind with thousands separators, the achieved share of reads, and the throughput."""
    return rows.agg(
        F.format_number(F.count(F.lit(1)), 0).alias("operations"),
        F.format_number(F.count_if(F.col("op") == "GET"), 0).alias("gets"),
        F.format_number(F.count_if(F.col("op") == "PUT"), 0).alias("puts"),
        F.round(100 * F.count_if(F.col("op") == "GET") / F.count(F.lit(1)), 2).alias("read_percent"),
        F.round(F.count(F.lit(1)) / F.lit(seconds), 2).alias("ops_per_second"),
    )

"""Log-linear latency histograms: 128 linear buckets, then 128 for each power of two up to 2**44 nanoseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINEAR, SUB_BITS, TOP_BITS = 128, 7, 44
OVERFLOW = LINEAR + (TOP_BITS - SUB_BITS) * LINEAR
# Bucket bounds in seconds.
SECONDS = (0.0001, 0.00025, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def bucket(ns: str = "ns") -> Column:
    """Index of the bucket of a non-negative value; the leading bit comes from the binary text, not from a float logarithm."""
    v = F.col(ns)
    shift = f"(length(bin({ns})) - 1 - {SUB_BITS})"
    fine = F.expr(f"({shift} + 1) * {LINEAR} + (shiftright({ns}, cast({shift} as int)) & {LINEAR - 1})")
    return F.when(v < LINEAR, v).when(v >= (1 << TOP_BITS), OVERFLOW).otherwise(fine).cast("long")


def upper_bound(index: str = "bucket") -> Column:
    """Largest value of a bucket."""
    shift = f"cast({index} div {LINEAR} - 1 as int)"
    fine = F.expr(f"shiftleft(cast({LINEAR} + {index} % {LINEAR} + 1 as bigint), {shift}) - 1")
    return F.when(F.col(index) < LINEAR, F.col(index)).when(F.col(index) >= OVERFLOW, (1 << 63) - 1).otherwise(fine).cast("long")


def histogram(rows: DataFrame, by: list[str], ns: str = "ns") -> DataFrame:
    """(by..., bucket, count, sum, least, most) of the non-negative values; histograms of parts add up to that of the whole."""
    return rows.filter(F.col(ns) >= 0).groupBy(*by, bucket(ns).alias("bucket")).agg(F.count(F.lit(1)).alias("count"), F.sum(ns).alias("sum"), F.min(ns).alias("least"), F.max(ns).alias("most"))


def combine(parts: DataFrame, by: list[str]) -> DataFrame:
    return parts.groupBy(*by, "bucket").agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("least").alias("least"), F.max("most").alias("most"))


def percentiles(hist: DataFrame, by: list[str], ranks: tuple[float, ...] = (0.5, 0.9, 0.99, 0.999)) -> DataFrame:
    """(by..., p, value): upper bound, or the largest value if smaller, of the first bucket that reaches rank max(1, ceil(p * n)); 0 and
    1 give the smallest and the largest value. Groups without values are absent."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    run = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    seen = hist.withColumn("reached", F.sum("count").over(run)).withColumn("n", F.sum("count").over(w)).withColumn("lo", F.min("least").over(w)).withColumn("hi", F.max("most").over(w))
    each = seen.withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in ranks))))
    rank = F.greatest(F.lit(1), F.ceil(F.round(F.col("p") * F.col("n"), 9)))
    hit = each.filter((F.col("reached") >= rank) & (F.col("reached") - F.col("count") < rank))
    value = F.when(F.col("p") <= 0, F.col("lo")).when(F.col("p") >= 1, F.col("hi")).otherwise(F.least(upper_bound("bucket"), "hi"))
    return hit.select(*by, "p", value.alias("value"))


def means(hist: DataFrame, by: list[str]) -> DataFrame:
    return hist.groupBy(*by).agg(F.sum("count").alias("n"), F.expr("sum(sum) div sum(count)").alias("mean"))


def cumulative(rows: DataFrame, by: list[str], seconds: str, bounds: tuple[float, ...] = SECONDS) -> DataFrame:
    """(by..., bound, cumulative): values at or below each bound, and all of them at the bound +Inf; NaN and negative count as 0.

    One pass counts all bounds; the result is made long afterwards, a few rows a group.
    """
    v = F.when(F.isnan(seconds) | (F.col(seconds) < 0), 0.0).otherwise(F.col(seconds))
    counts = rows.groupBy(*by).agg(*(F.count_if(v <= b).alias(f"b{i}") for i, b in enumerate(bounds)), F.count(F.lit(1)).alias("all"))
    pairs = F.array(*(F.struct(F.lit(str(b)).alias("bound"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(bounds)), F.struct(F.lit("+Inf").alias("bound"), F.col("all").alias("cumulative")))
    return counts.select(*by, F.inline(pairs))


def exposition(counts: DataFrame, name: str, label: str) -> DataFrame:
    """Text lines of cumulative counts, label values escaped."""
    value = F.replace(F.replace(F.replace(F.col(label), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return counts.select(F.format_string(f'{name}_bucket{{{label}="%s",le="%s"}} %d', value, "bound", "cumulative").alias("line"))


def allowed_only(rows: DataFrame, label: str, allowed: list[str]) -> DataFrame:
    """`rows` with a label outside the fixed set counted under one shared name."""
    return rows.withColumn(label, F.when(F.col(label).isin(allowed), F.col(label)).otherwise("other"))

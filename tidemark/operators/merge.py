"""Ordered merge, deduplication, tombstone removal and output files: the dataflow of a compaction."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.ship import ship

MAX_INPUTS = 10_000


def _union(inputs: list[DataFrame]) -> DataFrame:
    if not 1 <= len(inputs) <= MAX_INPUTS:
        raise ValueError("a merge has 1 to 10,000 inputs")
    return reduce(DataFrame.unionByName, (df.select("key", "seq", "op", "value", F.lit(i).alias("input_idx")) for i, df in enumerate(inputs)))


def raw_merge(rows: DataFrame) -> DataFrame:
    """All revisions of `rows` (with input_idx) in canonical order, ties by input."""
    return rows.orderBy(*S.canonical(), F.col("input_idx").asc())


def dedup_merge(rows: DataFrame) -> DataFrame:
    """The newest revision of each key, deletes kept; of equal revisions the one of the lowest input.

    One hash aggregate: partial results leave a row a key and task before the shuffle.
    """
    best = F.min_by(F.struct("seq", "op", "value", "input_idx"), F.struct(-F.col("seq"), -F.col("op"), F.col("input_idx"), F.coalesce("value", F.lit(b""))))
    return rows.groupBy("key").agg(best.alias("b")).select("key", "b.*")


def merge(inputs: list[DataFrame], dedup: bool = True) -> DataFrame:
    rows = _union(inputs)
    return dedup_merge(rows) if dedup else raw_merge(rows)


def drop_tombstones(merged: DataFrame, deeper: DataFrame | None) -> DataFrame:
    """`merged` without those deletes whose key no deeper level has; at the bottom (`deeper` None) without any."""
    deletes = F.col("op") == S.DELETE
    if deeper is None:
        return merged.filter(~deletes)
    kept = merged.filter(deletes).join(deeper.select("key").distinct(), "key", "left_semi")
    return merged.filter(~deletes).unionByName(kept.select(*merged.columns))


def drop_tombstones_by_range(merged: DataFrame, deeper_files: DataFrame) -> DataFrame:
    """As `drop_tombstones`, from key ranges of deeper files alone: a delete inside any of them stays."""
    deletes = F.col("op") == S.DELETE
    inside = (F.col("key") >= F.col("smallest_key")) & (F.col("key") <= F.col("largest_key"))
    kept = merged.filter(deletes).join(deeper_files.select("smallest_key", "largest_key"), inside, "left_semi")
    return merged.filter(~deletes).unionByName(kept)


def droppable(merged: DataFrame, deeper: DataFrame) -> DataFrame:
    """`merged` with droppable: a delete whose key no deeper level has."""
    has = deeper.select("key").distinct().withColumn("deeper", F.lit(True))
    return merged.join(has, "key", "left").withColumn("droppable", (F.col("op") == S.DELETE) & F.col("deeper").isNull()).drop("deeper")


def output_record_bytes() -> F.Column:
    return F.octet_length("key") + 8 + F.coalesce(F.octet_length("value"), F.lit(0)) + 16


def cut_cumulative(rows: DataFrame, target: int, part: str = "part") -> DataFrame:
    """`rows` with file_no: bytes before the row, in key order, by `target`. `part` must ascend with the key (a range of keys each).

    Sums run inside each part; a table of the parts' sums adds what stands before them, so no task gets all rows.
    """
    rows = rows.withColumn("bytes", output_record_bytes())
    sums = rows.groupBy(part).agg(F.sum("bytes").alias("total"))
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(part, F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy(part).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("bytes").over(inside), F.lit(0))).join(starts, part)
    return placed.withColumn("file_no", F.floor((F.col("before") + F.col("inside")) / target)).drop("inside", "before")


def cut_exact(rows: DataFrame, target: int = S.OUTPUT_BYTES, partitions: int | None = None) -> DataFrame:
    """`rows` (key, seq, op, value) with file_no: a file closes when it is not empty and has `target` bytes or would pass them.

    The rule depends on all earlier cuts, so rows are dealt out by key range and each range cuts for itself: files never span two
    ranges and stay disjoint and ordered. file_no is the range's number times 2**32 plus the cut's. With `partitions=1` the cuts are
    those of one sequential pass.
    """
    ship(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, number, base = 0, 0, None
        for f in frames:
            if base is None and len(f):
                base = int(f["part"].iloc[0]) << 32
            cuts = []
            for n in f["bytes"]:
                if size and (size >= target or size + n > target):
                    number, size = number + 1, 0
                size += n
                cuts.append(base + number)
            yield f.assign(file_no=cuts).drop(columns=["part"])

    sized = rows.select("key", "seq", "op", "value", output_record_bytes().cast("long").alias("bytes"))
    ranged = sized.repartitionByRange(partitions, "key") if partitions else sized.repartitionByRange("key")
    ordered = ranged.sortWithinPartitions(*S.canonical()).withColumn("part", F.spark_partition_id())
    return ordered.mapInPandas(run, "key binary, seq long, op int, value binary, bytes long, file_no long")


def output_stats(rows: DataFrame) -> DataFrame:
    """One row: records read, written, omitted and retained deletes, and bytes, of rows with `droppable`."""
    drop = F.col("droppable")
    return rows.agg(
        F.count(F.lit(1)).alias("input_records"),
        F.count_if(~drop).alias("written_records"),
        F.count_if(drop).alias("omitted_tombstones"),
        F.count_if((F.col("op") == S.DELETE) & ~drop).alias("retained_tombstones"),
        F.coalesce(F.sum(F.when(~drop, output_record_bytes())), F.lit(0)).alias("written_bytes"),
    )


def order_violations(rows: DataFrame, part: str) -> DataFrame:
    """Neighbours inside a file (`part`) that are out of canonical order or repeat a revision, by the row's position `pos`."""
    w = Window.partitionBy(part).orderBy("pos")
    before = {c: F.lag(c).over(w) for c in ("key", "seq", "op")}
    seen = rows.select("*", *(x.alias(f"_{c}") for c, x in before.items())).filter("_key is not null")
    ok = (F.col("key") > F.col("_key")) | ((F.col("key") == F.col("_key")) & ((F.col("seq") < F.col("_seq")) | ((F.col("seq") == F.col("_seq")) & (F.col("op") < F.col("_op")))))
    return seen.filter(~ok).drop("_key", "_seq", "_op")


def write_table(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A sorted table: one file a key range, sorted in it, so row-group statistics answer lookups. The commit is Spark's."""
    rows.repartitionByRange("key").sortWithinPartitions(*S.canonical()).write.mode(mode).parquet(path)


def flush(rows: DataFrame, file_num: int) -> DataFrame:
    """The manifest row of a frozen memtable written as one level-0 file: every revision is kept."""
    return rows.agg(
        F.lit(0).cast("long").alias("level"),
        F.lit(file_num).cast("long").alias("file_num"),
        F.sum(S.record_bytes()).alias("file_size"),
        F.min("key").alias("smallest_key"),
        F.max("key").alias("largest_key"),
        F.min("seq").alias("smallest_seq"),
        F.max("seq").alias("largest_seq"),
    )


def shared_prefixes(keys: DataFrame, restart: int = 16) -> DataFrame:
    """(block, pos, key, shared): how many bytes each key has in common with the one before it in its block, 0 at restart points.

    `keys` has block, pos and key; keys are compared as hex text, two characters a byte.
    """
    w = Window.partitionBy("block").orderBy("pos")
    pair = keys.withColumn("prev", F.lag("key").over(w))
    n = F.least(F.octet_length("key"), F.octet_length("prev"))
    same = F.transform(F.sequence(F.lit(1), n), lambda i: F.expr("hex(substring(key, 1, 1))").isNotNull() & (F.substring(F.hex("key"), i * 2 - 1, F.lit(2)) == F.substring(F.hex("prev"), i * 2 - 1, F.lit(2))))
    first_bad = F.array_position(same, F.lit(False))
    shared = F.when(F.col("prev").isNull() | (F.col("pos") % restart == 0) | (n < 1), 0).when(first_bad == 0, n).otherwise(first_bad - 1)
    return pair.select("block", "pos", "key", shared.cast("long").alias("shared"))


def block_index(keys: DataFrame) -> DataFrame:
    """(block, last_key, entries): the sparse index of a sorted file; a lookup takes the first block whose last key is not smaller."""
    return keys.groupBy("block").agg(F.max("key").alias("last_key"), F.count(F.lit(1)).alias("entries"))

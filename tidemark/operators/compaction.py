"""A compaction as one job, flushes, and the journal of what ran."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.operators import levels, manifest, merge

# Bytes of a node, of a level pointer and of a value header in the memory estimate.
NODE_BYTES, POINTER_BYTES, VALUE_BYTES = 72, 8, 24


@dataclass(frozen=True)
class Policy:
    """When levels are due and how large they are."""

    l0_trigger: int = S.L0_FILES
    l1_bytes: int = S.L1_BYTES
    multiplier: int = S.LEVEL_MULTIPLIER
    levels: int = S.LEVELS

    def __post_init__(self) -> None:
        if self.l0_trigger <= 0 or self.l1_bytes <= 0 or self.multiplier < 1 or not 2 <= self.levels <= S.LEVELS:
            raise ValueError("invalid compaction policy")

    def capacity(self, level: int) -> int:
        return self.l0_trigger if level == 0 else self.l1_bytes * self.multiplier ** (level - 1)


def run(rows: DataFrame, files: DataFrame, level: int, target: int = S.OUTPUT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(output rows with file_no, plan) of compacting `level`: the plan's files are merged, deletes that no deeper level needs go, and
    the rest is cut into files. `rows` name their level and file_num; `files` has the metadata of all of them."""
    chosen = levels.plan(files, level)
    inputs = rows.join(chosen.select("level", "file_num"), ["level", "file_num"], "left_semi").withColumn("input_idx", F.col("file_num"))
    merged = merge.dedup_merge(inputs).select("key", "seq", "op", "value")
    deeper = rows.filter(F.col("level") > level + 1) if level + 2 < S.LEVELS else None
    return merge.cut_exact(merge.drop_tombstones(merged, deeper), target), chosen


def edit(output: DataFrame, chosen: DataFrame, level: int, first_file: int) -> DataFrame:
    """Manifest actions of a compaction: its inputs are deleted, its outputs added to the next level under new numbers."""
    per = output.groupBy("file_no").agg(
        F.sum(merge.output_record_bytes()).alias("file_size"), F.min("key").alias("smallest_key"), F.max("key").alias("largest_key"), F.min("seq").alias("smallest_seq"), F.max("seq").alias("largest_seq")
    )

    number = F.row_number().over(Window.orderBy("file_no")) - 1 + first_file
    new = per.select(F.lit("add").alias("action"), F.lit(level + 1).cast("long").alias("level"), number.cast("long").alias("file_num"), "file_size", "smallest_key", "largest_key", "smallest_seq", "largest_seq")
    return chosen.select(F.lit("delete").alias("action"), "level", "file_num").unionByName(new, allowMissingColumns=True)


def publish(spark: SparkSession, actions: DataFrame, edit_no: int, path: str) -> DataFrame:
    """Append the actions of one edit to the manifest at `path`, if they fit what it holds; the current files come back.

    Parquet's commit makes the append whole or absent. The checks look at this edit against the current files, not at all edits.
    """
    numbered = actions.withColumn("edit_no", F.lit(edit_no).cast("long"))
    try:
        before = spark.read.parquet(path)
        if before.agg(F.max("edit_no")).first()[0] >= edit_no:
            raise ValueError("edit numbers must ascend")
        bad = manifest.problems(before.unionByName(numbered, allowMissingColumns=True)).filter(F.col("edit_no") == edit_no)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        bad = manifest.problems(numbered)
    if not bad.isEmpty():
        raise ValueError(f"edit {edit_no} does not fit the manifest")
    numbered.write.mode("append").parquet(path)
    return manifest.replay(spark.read.parquet(path))


def memory_estimate(height: Column | float = 4 / 3) -> Column:
    """Bytes that a row takes in memory: a node, its key, level pointers (4/3 on average) and its value."""
    return F.lit(NODE_BYTES) + F.octet_length("key") + POINTER_BYTES * F.lit(height) + VALUE_BYTES + F.coalesce(F.octet_length("value"), F.lit(0))


def memory_thirds() -> Column:
    """Three times the memory estimate of a row, a whole number."""
    whole = F.lit(NODE_BYTES + VALUE_BYTES).cast("long") + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return 3 * whole + 4 * POINTER_BYTES


def frozen_after(rows: DataFrame, limit: int = S.MEMTABLE_BYTES, group: str = "log") -> DataFrame:
    """(log, memtable, rows, bytes): a memtable is frozen when its bytes reach the limit; by running sums inside a log.

    The sums are of whole numbers, thirds of a byte: sums of doubles miss a limit that is met exactly, by the order they are added in.
    """
    w = Window.partitionBy(group).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sized = rows.withColumn("thirds", memory_thirds())
    placed = sized.withColumn("before", F.coalesce(F.sum("thirds").over(w), F.lit(0))).withColumn("memtable", F.expr(f"before div {3 * limit}"))
    return placed.groupBy(group, "memtable").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("thirds") / 3, 3).alias("bytes"))


def journal_stats(journal: DataFrame) -> DataFrame:
    """One row of a journal (run, ok, level, sources, targets, outputs, bytes): runs, failures, and what the last one did."""
    text = F.format_string("L%d->L%d src=%d tgt=%d out=%d bytes=%d", "level", F.col("level") + 1, "sources", "targets", "outputs", "bytes")
    return journal.agg(F.count(F.lit(1)).alias("runs"), F.count_if(~F.col("ok")).alias("failures"), F.max_by(text, "run").alias("last"))

"""The manifest: edits that add and remove files, folded to the current set, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def actions(edits: DataFrame) -> DataFrame:
    """(edit_no, action, level, file_num, ...) of edits with arrays `adds` and `deletes`; inside an edit deletes come first."""
    gone = edits.select("edit_no", F.explode("deletes").alias("d")).select("edit_no", F.lit("delete").alias("action"), "d.level", "d.file_num")
    new = edits.select("edit_no", F.explode("adds").alias("a")).select("edit_no", F.lit("add").alias("action"), "a.*")
    return gone.unionByName(new, allowMissingColumns=True)


def replay(acts: DataFrame) -> DataFrame:
    """The files that are current after all edits: the last action on each (level, file) was an add."""
    rest = [c for c in acts.columns if c not in ("level", "file_num", "edit_no", "action")]
    order = F.struct("edit_no", F.when(F.col("action") == "add", 1).otherwise(0))
    last = acts.groupBy("level", "file_num").agg(F.max_by(F.struct("action", "edit_no", *rest), order).alias("l"))
    return last.filter("l.action = 'add'").select("level", "file_num", *(F.col(f"l.{c}").alias(c) for c in rest))


def problems(acts: DataFrame) -> DataFrame:
    """(edit_no, level, file_num, problem): a delete of a file that is not there, an add of one that is, a file at two levels."""
    w = Window.partitionBy("level", "file_num").orderBy("edit_no", F.col("action").desc())
    seen = acts.withColumn("before", F.lag("action").over(w))
    missing = seen.filter("action = 'delete' and coalesce(before, 'delete') = 'delete'").select("edit_no", "level", "file_num", F.lit("delete of absent file").alias("problem"))
    again = seen.filter("action = 'add' and before = 'add'").select("edit_no", "level", "file_num", F.lit("file added twice").alias("problem"))
    current = replay(acts).groupBy("file_num").agg(F.count(F.lit(1)).alias("n"), F.min("level").alias("level")).filter("n > 1")
    return missing.unionByName(again).unionByName(current.select(F.lit(None).cast("long").alias("edit_no"), "level", "file_num", F.lit("file at two levels").alias("problem")))


def scalar_problems(edits: DataFrame) -> DataFrame:
    """Edits whose next_file or last_seq is smaller than an earlier one's, by one row an edit."""
    w = Window.orderBy("edit_no").rowsBetween(Window.unboundedPreceding, -1)
    return edits.select("edit_no", "next_file", "last_seq", F.max("next_file").over(w).alias("f"), F.max("last_seq").over(w).alias("s")).filter("next_file < f or last_seq < s").select("edit_no")


def summary(edits: DataFrame, acts: DataFrame) -> DataFrame:
    heads = edits.agg(F.max("next_file").alias("next_file"), F.max("last_seq").alias("last_seq"))
    counts = replay(acts).agg(F.count(F.lit(1)).alias("files"), F.countDistinct("level").alias("levels"))
    return heads.crossJoin(counts)


def obsolete(acts: DataFrame, pinned: DataFrame) -> DataFrame:
    """(level, file_num) that were deleted and that neither the current version nor a pinned one has."""
    gone = acts.filter("action = 'delete'").select("level", "file_num").distinct()
    return gone.join(replay(acts).select("level", "file_num"), ["level", "file_num"], "left_anti").join(pinned.select("level", "file_num"), ["level", "file_num"], "left_anti")


def orphans(names: DataFrame, current: DataFrame) -> DataFrame:
    """(name, kind) of files in a folder that nothing refers to: staging leftovers, and tables the manifest does not list."""
    table, staging = r"^[0-9]{6,}\.sst$", r"^\.tmp_[0-9]+\.sst_.*$"
    kind = F.when(F.col("name").rlike(table), "table").when(F.col("name").rlike(staging), "staging")
    marked = names.select("name", kind.alias("kind")).filter("kind is not null").withColumn("file_num", F.when(F.col("kind") == "table", F.regexp_extract("name", r"^([0-9]+)", 1).cast("long")))
    return marked.join(current.select("file_num").distinct(), "file_num", "left_anti").select("name", "kind")


def counts(current: DataFrame) -> DataFrame:
    """(level, files, bytes) of a version."""
    return current.groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


def current_manifest(names: DataFrame) -> DataFrame:
    """The manifest file of the highest number, by names `MANIFEST-NNNNNN`."""
    number = F.when(F.col("name").rlike("^MANIFEST-[0-9]{6,}$"), F.regexp_extract("name", "([0-9]+)$", 1).cast("long"))
    return names.agg(F.max_by("name", number).alias("name"))


def handles(blocks: DataFrame) -> DataFrame:
    """(file_num, handles): the meta-index of each file, a map from block names to (offset, size)."""
    return blocks.groupBy("file_num").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", F.struct("offset", "size"))))).alias("handles"))

"""Level scores, overlaps of key ranges, and compaction plans over file metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schema as S


def capacity(level: str = "level") -> F.Column:
    """Files of level 0, bytes of the others (ten times more a level)."""
    return F.when(F.col(level) == 0, F.lit(float(S.L0_FILES))).otherwise(F.lit(float(S.L1_BYTES)) * F.pow(F.lit(float(S.LEVEL_MULTIPLIER)), F.col(level) - 1))


def scores(files: DataFrame) -> DataFrame:
    """(level, files, bytes, score): files of level 0, bytes of others, over the level's capacity."""
    per = files.groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"))
    return per.withColumn("score", F.when(F.col("level") == 0, F.col("files").cast("double")).otherwise(F.col("bytes").cast("double")) / capacity())


def pick_level(scored: DataFrame) -> DataFrame:
    """At most one row: level 0 if its score is 1 or more, else the level of 1 to 5 with the highest such score, the lower on a tie."""
    due = scored.filter((F.col("score") >= 1) & (F.col("level") < S.LEVELS - 1))
    return due.orderBy((F.col("level") == 0).desc(), F.col("score").desc(), F.col("level")).limit(1)


def pick_seed(files: DataFrame, level: int) -> DataFrame:
    """The file to start with: the lowest number in level 0, the smallest key elsewhere."""
    order = ["file_num"] if level == 0 else ["smallest_key", "file_num"]
    return files.filter(F.col("level") == level).orderBy(*order).limit(1)


def overlaps(a: str, b: str) -> F.Column:
    """Closed key ranges: touching ones overlap."""
    return (F.col(f"{a}.largest_key") >= F.col(f"{b}.smallest_key")) & (F.col(f"{b}.largest_key") >= F.col(f"{a}.smallest_key"))


def overlap_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a_level, a_file, b_level, b_file) of overlapping files of two sets; a set with itself gives each pair once."""
    a, b = left.alias("a"), right.alias("b")
    return a.join(b, overlaps("a", "b")).select(F.col("a.level").alias("a_level"), F.col("a.file_num").alias("a_file"), F.col("b.level").alias("b_level"), F.col("b.file_num").alias("b_file"))


def islands(files: DataFrame) -> DataFrame:
    """`files` of one level with `island`: a number for each set of files that overlap directly or through others.

    In order of the smallest key a new island starts where no earlier range reaches; this is the closure of every seed at once.
    File metadata is small; the window runs over one row a file of the level.
    """
    w = Window.partitionBy("level").orderBy("smallest_key", "largest_key", "file_num")
    reach = F.max("largest_key").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reach.isNull() | (F.col("smallest_key") > reach), 1).otherwise(0)
    return files.withColumn("starts", starts).withColumn("island", F.sum("starts").over(w)).drop("starts")


def closure(files: DataFrame, seeds: list[int]) -> DataFrame:
    """The level-0 files that the seeds pull in: the set grows by every file that meets the hull of the set until none does.

    One seed's closure is its island. Several seeds also swallow the islands between them, which one more bound does: islands from
    the first to the last seed's.
    """
    marked = islands(files)
    hull = marked.filter(F.col("file_num").isin(seeds)).agg(F.min("island").alias("lo"), F.max("island").alias("hi"))
    return marked.crossJoin(F.broadcast(hull)).filter("island between lo and hi").drop("lo", "hi", "island")


def bounds(files: DataFrame) -> DataFrame:
    """One row: the hull of some files."""
    return files.agg(F.min("smallest_key").alias("smallest_key"), F.max("largest_key").alias("largest_key"), F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


def plan(files: DataFrame, level: int) -> DataFrame:
    """(role, level, file_num, file_size): the source files of a compaction of `level` and the files of the next level they meet."""
    here = files.filter(F.col("level") == level)
    seed = pick_seed(files, level)
    if level == 0:
        marked = islands(here)
        source = marked.join(marked.join(seed.select("file_num"), "file_num").select("island"), "island", "left_semi").drop("island")
    else:
        source = seed
    hull = bounds(source).select(F.col("smallest_key").alias("lo"), F.col("largest_key").alias("hi"))
    target = files.filter(F.col("level") == level + 1).crossJoin(F.broadcast(hull)).filter("largest_key >= lo and smallest_key <= hi").drop("lo", "hi")
    cols = ["level", "file_num", "file_size"]
    return source.select(F.lit("source").alias("role"), *cols).unionByName(target.select(F.lit("target").alias("role"), *cols))


def plan_problems(chosen: DataFrame, level: int) -> DataFrame:
    """Rows (problem, file_num) of a plan that names wrong levels or a file twice."""
    wrong = chosen.filter(((F.col("role") == "source") & (F.col("level") != level)) | ((F.col("role") == "target") & (F.col("level") != level + 1)))
    twice = chosen.groupBy("file_num").count().filter("count > 1")
    return wrong.select(F.lit("wrong level").alias("problem"), "file_num").unionByName(twice.select(F.lit("file twice").alias("problem"), "file_num"))


def level_problems(files: DataFrame) -> DataFrame:
    """Neighbouring files of level 1 and deeper whose ranges overlap."""
    w = Window.partitionBy("level").orderBy("smallest_key", "file_num")
    pair = files.filter("level > 0").withColumn("before", F.lag("largest_key").over(w)).withColumn("before_file", F.lag("file_num").over(w))
    return pair.filter(F.col("before") >= F.col("smallest_key")).select("level", "before_file", "file_num")


def describe(level: int, sources: int, targets: int, outputs: int, size: int) -> str:
    return f"L{level}->L{level + 1} src={sources} tgt={targets} out={outputs} bytes={size}"

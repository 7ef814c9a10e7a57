"""Log replay and integrity checks. Everything is per log (`log`) or per segment, so no window runs over all records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.operators import resolve


#: Sequence numbers of a cell, the part of a log that one window sees.
CELL = 1 << 16


def committed(records: DataFrame, log: str = "log", cell: int = CELL) -> DataFrame:
    """The puts and deletes of `records` (log, seq, type, key, value) that count: single ones, and those of batches with a commit.

    A batch opens at a start marker and closes at its commit; a start before that aborts the open batch, and a batch open at the
    end is dropped. So a record counts unless the last marker up to its number is a start and the next one is no commit; markers of
    one number stand after its records, the commit last. A null number comes first, null logs are one log.

    Windows run inside cells of `cell` numbers of a log; the markers on both sides of a cell come from a table of one row a cell.
    """
    own = records.select(log, "seq", "type", "key", "value", F.coalesce("seq", F.lit(-(1 << 63))).alias("__at"))
    # A struct equals another with a null at the same place, so that the cells of a null log meet too.
    numbered = own.withColumn("__cell", F.struct(F.col(log).alias("log"), F.expr(f"__at div {int(cell)}").alias("no")))
    marker = F.when(F.col("type").isin(S.BATCH_START, S.BATCH_COMMIT), F.struct(F.col("__at").alias("at"), "type"))
    of = lambda kind: F.when(F.col("type") == kind, F.col("__at"))
    ends = numbered.groupBy("__cell").agg(*(f(of(k)).alias(n) for f, k, n in ((F.min, S.BATCH_START, "a"), (F.min, S.BATCH_COMMIT, "b"), (F.max, S.BATCH_START, "y"), (F.max, S.BATCH_COMMIT, "z"))))
    first = F.when(F.col("a") <= F.coalesce("b", "a"), S.BATCH_START).when(F.col("b").isNotNull(), S.BATCH_COMMIT)
    last = F.when(F.col("z") >= F.coalesce("y", "z"), S.BATCH_COMMIT).when(F.col("y").isNotNull(), S.BATCH_START)
    in_log = Window.partitionBy("__cell.log").orderBy("__cell.no")
    cells = ends.select("__cell", first.alias("__first"), last.alias("last")).select(
        "__cell",
        "__first",
        F.last("last", ignorenulls=True).over(in_log.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
        F.expr("lead(__first) IGNORE NULLS OVER (PARTITION BY __cell.log ORDER BY __cell.no)").alias("__after"),
    )
    rows = numbered.withColumn("__marker", marker).withColumn("__next", F.expr("lead(__marker) IGNORE NULLS OVER (PARTITION BY __cell ORDER BY __at, type)"))
    mark = F.when(F.col("__marker").isNotNull(), F.struct("__marker", "__next"))
    rows = rows.withColumn("__mark", F.max(mark).over(Window.partitionBy("__cell").orderBy("__at"))).join(cells, "__cell")
    alone = F.col("__mark").isNull()
    before = F.when(alone, F.col("__before")).otherwise(F.col("__mark.__marker.type"))
    after = F.coalesce(F.when(alone, F.col("__first")).otherwise(F.col("__mark.__next.type")), "__after")
    counts = (F.coalesce(before, F.lit(S.BATCH_COMMIT)) != S.BATCH_START) | (F.coalesce(after, F.lit(S.BATCH_START)) == S.BATCH_COMMIT)
    return rows.filter(F.col("type").isin(S.RECORD_PUT, S.RECORD_DELETE) & counts).select(log, "seq", F.col("type").alias("op"), "key", "value")


def marker_problems(records: DataFrame, log: str = "log") -> DataFrame:
    """(log, seq, problem): a start inside an open batch, a commit without one."""
    w = Window.partitionBy(log).orderBy("seq")
    marks = records.filter(F.col("type").isin(S.BATCH_START, S.BATCH_COMMIT)).withColumn("before", F.lag("type").over(w))
    nested = (F.col("type") == S.BATCH_START) & (F.col("before") == S.BATCH_START)
    stray = (F.col("type") == S.BATCH_COMMIT) & (F.coalesce("before", F.lit(S.BATCH_COMMIT)) == S.BATCH_COMMIT)
    return marks.filter(nested | stray).select(log, "seq", F.when(nested, "nested start").otherwise("stray commit").alias("problem"))


def replay(records: DataFrame, checkpoint: int = 0, log: str = "log", strict: bool = False) -> DataFrame:
    """Live state after the records beyond the checkpoint; strict: batch markers out of place are an error."""
    if strict and not marker_problems(records, log).isEmpty():
        raise ValueError("batch markers out of place")
    return resolve.live(committed(records.filter(F.col("seq") > checkpoint), log))


def large_batches(records: DataFrame, most_records: int = 10_000, most_bytes: int = 64 << 20) -> DataFrame:
    """(batch_id, records, bytes) of batches beyond the bounds of recovery."""
    per = records.groupBy("batch_id").agg(F.count(F.lit(1)).alias("records"), F.sum(S.record_bytes()).alias("bytes"))
    return per.filter((F.col("records") > most_records) | (F.col("bytes") > most_bytes))


def gaps(rows: DataFrame, segment: str = "segment") -> DataFrame:
    """One row (gaps, skipped): jumps of the sequence number. Neighbours are compared inside segments; the ends of segments, one row
    each, are compared with each other."""
    w = Window.partitionBy(segment).orderBy("seq")
    inside = rows.select(segment, "seq", (F.col("seq") - F.lag("seq").over(w) - 1).alias("jump"))
    per = inside.groupBy(segment).agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count_if(F.col("jump") > 0).alias("gaps"), F.coalesce(F.sum(F.when(F.col("jump") > 0, F.col("jump"))), F.lit(0)).alias("skipped"))
    between = F.col("lo") - F.lag("hi").over(Window.orderBy(segment)) - 1
    per = per.withColumn("between", between)
    return per.agg(
        (F.coalesce(F.sum("gaps"), F.lit(0)) + F.count_if(F.col("between") > 0)).alias("gaps"),
        (F.coalesce(F.sum("skipped"), F.lit(0)) + F.coalesce(F.sum(F.when(F.col("between") > 0, F.col("between"))), F.lit(0))).alias("skipped"),
    )


def order_problems(rows: DataFrame, segment: str = "segment", pos: str = "pos") -> DataFrame:
    """(segment, pos, seq, before): records whose number is not larger than that of the record before, across segments too."""
    w = Window.partitionBy(segment).orderBy(pos)
    inside = rows.withColumn("before", F.lag("seq").over(w)).filter(F.col("before") >= F.col("seq")).select(segment, pos, "seq", "before")
    ends = rows.groupBy(segment).agg(F.min_by(F.struct(pos, "seq"), pos).alias("first"), F.max_by("seq", pos).alias("last"))
    across = ends.withColumn("before", F.lag("last").over(Window.orderBy(segment))).filter(F.col("before") >= F.col("first.seq"))
    return inside.unionByName(across.select(segment, F.col(f"first.{pos}").alias(pos), F.col("first.seq").alias("seq"), "before"))


def segment_breaks(segments: DataFrame, segment: str = "segment") -> DataFrame:
    """(segment, before): segment numbers that do not follow the one before, by one row a segment."""
    pair = segments.select(segment).withColumn("before", F.lag(segment).over(Window.orderBy(segment)))
    return pair.filter(F.col(segment) != F.col("before") + 1)


def segments(rows: DataFrame, segment: str = "segment") -> DataFrame:
    """(segment, status, records, bytes, first_seq, last_seq); the highest segment is the active one."""
    per = rows.groupBy(segment).agg(F.count(F.lit(1)).alias("records"), F.sum(S.record_bytes()).alias("bytes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    last = per.agg(F.max(segment).alias("active"))
    return per.crossJoin(F.broadcast(last)).withColumn("status", F.when(F.col(segment) == F.col("active"), "active").otherwise("sealed")).drop("active")


def check_attestations(observed: DataFrame, attested: DataFrame, segment: str = "segment") -> DataFrame:
    """(segment, verdict) of what was found against what was attested (record_count, final_offset, last_seq) when a segment was sealed."""
    a, o = attested.select(segment, *(F.col(c).alias(f"a_{c}") for c in ("record_count", "final_offset", "last_seq"))), observed
    both = o.join(a, segment, "full_outer")
    verdict = (
        F.when(F.col("a_record_count").isNull(), "unattested")
        .when(F.col("record_count").isNull(), "missing")
        .when((F.col("record_count") < F.col("a_record_count")) | (F.col("final_offset") < F.col("a_final_offset")), "loss")
        .when((F.col("record_count") > F.col("a_record_count")) | (F.col("final_offset") > F.col("a_final_offset")) | (F.col("last_seq") != F.col("a_last_seq")), "mismatch")
        .otherwise("ok")
    )
    return both.select(segment, verdict.alias("verdict"))


def offsets(rows: DataFrame, segment: str = "segment") -> DataFrame:
    """`rows` with bytes and offset: where each record starts in its segment."""
    w = Window.partitionBy(segment).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sized = rows.withColumn("bytes", S.record_bytes().cast("long"))
    return sized.withColumn("offset", F.coalesce(F.sum("bytes").over(w), F.lit(0)))


def valid_prefix(records: DataFrame, segment: str = "segment", pos: str = "pos") -> DataFrame:
    """(segment, records, end_offset) of the records before the first that is not ok."""
    bad = records.filter(F.col("status") != "ok").groupBy(segment).agg(F.min(pos).alias("bad"))
    ok = records.join(bad, segment, "left").filter(F.col("bad").isNull() | (F.col(pos) < F.col("bad")))
    return ok.groupBy(segment).agg(F.count(F.lit(1)).alias("records"), F.max(F.col("offset") + F.col("bytes")).alias("end_offset"))


def segment_outcome(records: DataFrame, segment: str = "segment", pos: str = "pos") -> DataFrame:
    """(segment, outcome): a torn tail of the last segment is truncated; anything else that is not ok fails."""
    last = records.agg(F.max(segment).alias("latest"))
    per = records.groupBy(segment).agg(F.min_by("status", F.when(F.col("status") != "ok", F.col(pos))).alias("status"))
    state = F.when(F.coalesce("status", F.lit("ok")) == "ok", "ok").when((F.col("status") == "torn") & (F.col(segment) == F.col("latest")), "truncated").otherwise("error")
    return per.crossJoin(F.broadcast(last)).select(segment, state.alias("outcome"))


def classify_corruption(records: DataFrame) -> DataFrame:
    """`records` (available, length, type, stored_crc, actual_crc) with status: torn, length, type, crc or ok."""
    return records.withColumn(
        "status",
        F.when(F.col("available") < S.RECORD_OVERHEAD - 6, "torn")
        .when(F.col("length") < S.RECORD_OVERHEAD, "length")
        .when(F.col("available") < F.col("length"), "torn")
        .when(~F.col("type").between(S.RECORD_PUT, S.BATCH_COMMIT), "type")
        .when(F.col("stored_crc") != F.col("actual_crc"), "crc")
        .otherwise("ok"),
    )


def report(rows: DataFrame, checkpoint: int, segment: str = "segment") -> DataFrame:
    """One row: segments, records, replayed and skipped records, last number, gaps."""
    counts = rows.agg(
        F.countDistinct(segment).alias("segments"),
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("seq") > checkpoint).alias("replayed"),
        F.count_if(F.col("seq") <= checkpoint).alias("skipped_records"),
        F.coalesce(F.max("seq"), F.lit(0)).alias("last_seq"),
    )
    return counts.crossJoin(gaps(rows, segment).withColumnRenamed("skipped", "skipped_numbers"))


def next_numbers(checkpoint: int, rows: DataFrame, manifest_next: int, file_nums: DataFrame) -> DataFrame:
    """One row (next_seq, next_file) after recovery."""
    seq = rows.agg((F.greatest(F.lit(checkpoint), F.coalesce(F.max("seq"), F.lit(0))) + 1).alias("next_seq"))
    num = file_nums.agg(F.greatest(F.lit(manifest_next), F.coalesce(F.max("file_num"), F.lit(0)) + 1, F.lit(1)).cast("long").alias("next_file"))
    return seq.crossJoin(num)


def block_report(rows: DataFrame) -> DataFrame:
    """(block, records, restarts, first_key, last_key, crc) of sorted rows with block and pos."""
    body = F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("pos", F.hex("key").alias("k")))), lambda x: x["k"]))
    return rows.groupBy("block").agg(
        F.count(F.lit(1)).alias("records"), F.ceil(F.count(F.lit(1)) / 16).alias("restarts"), F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.crc32(body.cast("binary")).alias("crc")
    )


def dump(records: DataFrame, limit: int = 1_000) -> DataFrame:
    """The first records as a report shows them, markers under their own names."""
    kind = F.element_at(F.array(*map(F.lit, ("PUT", "DELETE", "BATCH_START", "BATCH_COMMIT"))), F.col("type").cast("int"))
    return records.orderBy("seq").limit(limit).select("seq", kind.alias("type"), F.coalesce(F.octet_length("key"), F.lit(0)).cast("long").alias("key_bytes"), F.coalesce(F.octet_length("value"), F.lit(0)).cast("long").alias("value_bytes"))

"""Reads of a mutation log: the newest revision of a key decides, a delete hides the key, an empty value is a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S


def newest(log: DataFrame, key: str = "key", carry: tuple[str, ...] = ("seq", "op", "value")) -> DataFrame:
    """The newest revision of every key, deletes included: a hash aggregate with partial results before the one shuffle.

    Equal revisions (key, seq, op) tie by value, so the result does not depend on row order. Nulls among the values rank lowest.
    """
    best = F.max_by(F.struct(*carry), F.struct("seq", "op", F.coalesce("value", F.lit(b""))))
    return log.groupBy(key).agg(best.alias("best")).select(key, *(F.col(f"best.{c}").alias(c) for c in carry))


def live(log: DataFrame) -> DataFrame:
    """(key, seq, value) of the keys whose newest revision is a put."""
    return newest(log).filter(F.col("op") == S.PUT).select("key", "seq", "value")


def get(log: DataFrame, key: bytes) -> DataFrame:
    """At most one row (key, seq, value); the equality reaches the scan."""
    return live(log.filter(F.col("key") == F.lit(key)))


def exists(log: DataFrame, key: bytes) -> DataFrame:
    """One row (present BOOLEAN); values are not read."""
    best = F.max_by("op", F.struct("seq", "op"))
    return log.filter(F.col("key") == F.lit(key)).agg(F.coalesce(best == S.PUT, F.lit(False)).alias("present"))


def get_many(log: DataFrame, requests: DataFrame) -> DataFrame:
    """`requests` (req_id, key) with found and value, in one join; the log is cut to the requested keys before it is resolved."""
    wanted = log.join(requests.select("key").distinct(), "key", "left_semi")
    return requests.join(live(wanted).select("key", "value", F.lit(True).alias("hit")), "key", "left").select("req_id", "key", F.coalesce("hit", F.lit(False)).alias("found"), "value")


def exists_many(log: DataFrame, requests: DataFrame) -> DataFrame:
    """`requests` (req_id, key) with present; of the log only key, seq and op are read."""
    last = log.groupBy("key").agg(F.max_by("op", F.struct("seq", "op")).alias("op"))
    return requests.join(last, "key", "left").select("req_id", "key", F.coalesce(F.col("op") == S.PUT, F.lit(False)).alias("present"))


def in_prefix(prefix: bytes) -> Column:
    """Keys that start with `prefix`, as a range, which unlike a function reaches the scan's row-group statistics."""
    low = F.col("key") >= F.lit(prefix)
    stem = prefix.rstrip(b"\xff")
    return low & (F.col("key") < F.lit(stem[:-1] + bytes([stem[-1] + 1]))) if stem else low


def prefix_scan(log: DataFrame, prefix: bytes, limit: int = S.SCAN_LIMIT, include_tombstones: bool = False) -> DataFrame:
    """The first `limit` (500 at the most) keys that start with `prefix`, in key order, with their newest revision.

    Resolution comes before the limit and covers the whole log. Deleted keys appear, flagged, only on request.
    """
    found = newest(log.filter(in_prefix(prefix)))
    if not include_tombstones:
        found = found.filter(F.col("op") == S.PUT)
    return found.withColumn("is_tombstone", F.col("op") == S.DELETE).orderBy("key").limit(max(0, min(limit, S.MAX_SCAN_LIMIT)))


def scan(log: DataFrame) -> DataFrame:
    """All revisions in canonical order."""
    return log.orderBy(*S.canonical())


def at_or_after(key: bytes, seq: int | None = None, op: int | None = None) -> Column:
    """Rows at or after a key, or after one revision of it, in canonical order."""
    k = F.lit(key)
    if seq is None:
        return F.col("key") >= k
    return (F.col("key") > k) | ((F.col("key") == k) & ((F.col("seq") < seq) | ((F.col("seq") == seq) & (F.col("op") <= (op or S.DELETE)))))


def seek(log: DataFrame, key: bytes, seq: int | None = None, op: int | None = None) -> DataFrame:
    return scan(log.filter(at_or_after(key, seq, op)))


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """Live state of the log up to a sequence number. An extension: the log keeps every revision, so an old state is a filter."""
    return live(log.filter(F.col("seq") <= seq))


def layered(log: DataFrame) -> DataFrame:
    """Lookup of every key through layers (`layer`, lower is newer): the newest revision of the first layer that has the key.

    Equal to `newest` where layers hold disjoint, descending ranges of sequence numbers; the layer that decided is kept.
    """
    best = F.min_by(F.struct("layer", "seq", "op", "value"), F.struct("layer", -F.col("seq"), -F.col("op")))
    return log.groupBy("key").agg(best.alias("b")).select("key", "b.*")


def classify(log: DataFrame, requests: DataFrame) -> DataFrame:
    """`requests` (req_id, key) with put, deleted or absent."""
    last = log.groupBy("key").agg(F.max_by("op", F.struct("seq", "op")).alias("op"))
    return requests.join(last, "key", "left").select("req_id", "key", F.when(F.col("op") == S.PUT, "put").when(F.col("op") == S.DELETE, "deleted").otherwise("absent").alias("state"))


def files_to_read(keys: DataFrame, files: DataFrame) -> DataFrame:
    """For each key the files whose key range holds it, level 0 newest first and below one file a level: what a lookup reads.

    File metadata is small next to keys; Spark broadcasts it while it is below its threshold and joins by range otherwise.
    """
    inside = (F.col("key") >= F.col("smallest_key")) & (F.col("key") <= F.col("largest_key"))
    return keys.join(files, inside).select("key", "level", "file_num")

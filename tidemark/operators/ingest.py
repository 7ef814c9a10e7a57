"""Writes: sequence numbers for puts, deletes and atomic batches, and a client that holds the log as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.operators import resolve, validate


def append(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with `rows` (order, op, key, value) added under new sequence numbers; rows that fail a check are refused.

    The new rows of one call are numbered together, so a call is meant for one batch of writes, not for a whole log.
    """
    bad = validate.problems(rows).filter("problem is not null").select("problem").limit(1).collect()
    if bad:
        raise ValueError(bad[0][0])
    start = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("start"))
    seq = F.row_number().over(Window.orderBy("order"))
    new = rows.withColumn("n", seq).crossJoin(F.broadcast(start)).select("key", (F.col("start") + F.col("n")).alias("seq"), "op", F.when(F.col("op") == S.PUT, F.coalesce("value", F.lit(b""))).alias("value"))
    return log.select("key", "seq", "op", "value").unionByName(new)


def explode_batches(batches: DataFrame, start: int = 0) -> DataFrame:
    """Log records of `batches` (batch_id, ops): a start marker, the operations in order, a commit marker, N + 2 numbers a batch.

    Batches are numbered by a running sum over one row a batch, two-level: sums of groups of ids, then inside each group.
    """
    sized = batches.withColumn("n", F.size("ops") + 2).withColumn("part", F.expr("batch_id div 1024"))
    sums = sized.groupBy("part").agg(F.sum("n").alias("total"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, "part").withColumn("first", F.lit(start) + F.col("before") + F.col("inside") + 1)
    mark = lambda kind: F.struct(F.lit(kind).alias("type"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("binary").alias("value"))
    body = F.transform("ops", lambda x: F.struct(x["op"].alias("type"), x["key"].alias("key"), F.when(x["op"] == S.PUT, F.coalesce(x["value"], F.lit(b""))).alias("value")))
    records = placed.select("batch_id", "first", F.posexplode(F.concat(F.array(mark(S.BATCH_START)), body, F.array(mark(S.BATCH_COMMIT)))).alias("pos", "r"))
    return records.select("batch_id", (F.col("first") + F.col("pos")).alias("seq"), "r.type", "r.key", "r.value")


class WriteBatch:
    """Operations to apply together; later ones on a key win."""

    def __init__(self) -> None:
        self._ops: list[tuple[int, bytes, bytes | None]] = []

    def put(self, key: bytes, value: bytes) -> WriteBatch:
        self._ops.append((S.PUT, key, value))
        return self

    def delete(self, key: bytes) -> WriteBatch:
        self._ops.append((S.DELETE, key, None))
        return self

    def clear(self) -> WriteBatch:
        self._ops.clear()
        return self

    def __len__(self) -> int:
        return len(self._ops)

    @property
    def ops(self) -> list[tuple[int, bytes, bytes | None]]:
        return list(self._ops)


class Store:
    """A client over one log. Writes give a new log; nothing is stored until the caller writes `log` somewhere."""

    def __init__(self, spark: SparkSession, log: DataFrame | None = None) -> None:
        self.spark = spark
        self.log = spark.createDataFrame([], S.MUTATION_LOG) if log is None else log.select("key", "seq", "op", "value")

    def _write(self, ops: list[tuple[int, bytes, bytes | None]]) -> None:
        rows = self.spark.createDataFrame([(i, op, k, v) for i, (op, k, v) in enumerate(ops)], "order int, op int, key binary, value binary")
        self.log = append(self.log, rows)

    def put(self, key: bytes, value: bytes) -> None:
        self._write([(S.PUT, key, value)])

    def delete(self, key: bytes) -> None:
        """Writes a delete whether or not the key exists."""
        self._write([(S.DELETE, key, None)])

    def batch(self, batch: WriteBatch) -> None:
        if not 1 <= len(batch) <= S.MAX_BATCH_OPS:
            raise ValueError("a batch has 1 to 1,024 operations")
        self._write(batch.ops)

    def get(self, key: bytes) -> bytes | None:
        rows = resolve.get(self.log, key).collect()
        return bytes(rows[0]["value"]) if rows else None

    def exists(self, key: bytes) -> bool:
        return resolve.exists(self.log, key).first()["present"]

    def stats(self) -> dict:
        return stats(self.log).first().asDict(recursive=True)

    def pipeline(self) -> Pipeline:
        return Pipeline(self)


class Pipeline:
    """Up to 64 queued requests, answered in order by one query for all reads of a run between writes."""

    def __init__(self, store: Store) -> None:
        self.store, self.queue = store, []

    def _add(self, *request: object) -> Pipeline:
        if len(self.queue) >= S.MAX_PIPELINE:
            raise ValueError("the pipeline is full")
        self.queue.append(request)
        return self

    def put(self, key: bytes, value: bytes) -> Pipeline:
        return self._add("put", key, value)

    def delete(self, key: bytes) -> Pipeline:
        return self._add("delete", key)

    def get(self, key: bytes) -> Pipeline:
        return self._add("get", key)

    def exists(self, key: bytes) -> Pipeline:
        return self._add("exists", key)

    def batch(self, batch: WriteBatch) -> Pipeline:
        return self._add("batch", batch)

    def stats(self) -> Pipeline:
        return self._add("stats")

    def __len__(self) -> int:
        return len(self.queue)

    def execute(self) -> list[object]:
        out: list[object] = [None] * len(self.queue)
        reads: list[tuple[int, str, bytes]] = []

        def answer() -> None:
            if not reads:
                return
            asked = self.store.spark.createDataFrame([(i, k) for i, _, k in reads], "req_id int, key binary")
            found = {r["req_id"]: r for r in resolve.get_many(self.store.log, asked).collect()}
            for i, kind, _ in reads:
                r = found[i]
                out[i] = r["found"] if kind == "exists" else bytes(r["value"]) if r["found"] else None
            reads.clear()

        for i, (kind, *args) in enumerate(self.queue):
            if kind in ("get", "exists"):
                reads.append((i, kind, args[0]))
                continue
            answer()
            out[i] = getattr(self.store, kind)(*args)
        answer()
        self.queue.clear()
        return out


def stats(log: DataFrame) -> DataFrame:
    """One row of nested statistics: sequence numbers, revisions, live and deleted keys, bytes."""
    last = log.groupBy("key").agg(
        F.max_by("op", F.struct("seq", "op")).alias("op"), F.count(F.lit(1)).alias("n"), F.max("seq").alias("seq"), F.sum(S.record_bytes()).alias("bytes")
    )
    return last.agg(
        F.struct(F.coalesce(F.max("seq"), F.lit(0)).alias("last_seq"), F.coalesce(F.sum("n"), F.lit(0)).alias("revisions")).alias("state"),
        F.struct(F.count_if(F.col("op") == S.PUT).alias("live_keys"), F.count_if(F.col("op") == S.DELETE).alias("tombstones"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).alias("storage"),
    )


def stats_json(log: DataFrame) -> DataFrame:
    return stats(log).select(F.to_json(F.struct("state", "storage")).alias("stats"))

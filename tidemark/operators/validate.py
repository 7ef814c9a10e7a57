"""Checks of keys, values, operations and batches as boolean columns, and the rows that fail them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S


def key_ok(key: str = "key") -> Column:
    return F.coalesce(F.octet_length(key).between(1, S.MAX_KEY), F.lit(False))


def value_ok(value: str = "value") -> Column:
    return F.coalesce(F.octet_length(value), F.lit(0)) <= S.MAX_VALUE


def op_ok(op: str = "op") -> Column:
    return F.coalesce(F.col(op).isin(S.PUT, S.DELETE), F.lit(False))


def delete_without_value(op: str = "op", value: str = "value") -> Column:
    return (F.col(op) != S.DELETE) | (F.coalesce(F.octet_length(value), F.lit(0)) == 0)


def encoded_key_ok(encoded: str) -> Column:
    """An encoded internal key: 10 to 65,544 bytes, the last one a known operation."""
    return F.coalesce(F.octet_length(encoded).between(10, S.MAX_KEY + 9) & F.hex(F.expr(f"substring({encoded}, octet_length({encoded}), 1)")).isin("01", "02"), F.lit(False))


def problems(rows: DataFrame) -> DataFrame:
    """`rows` (key, op, value) with the first check that fails, or null."""
    return rows.withColumn(
        "problem",
        F.when(~op_ok(), "invalid op")
        .when(F.coalesce(F.octet_length("key"), F.lit(0)) == 0, "empty key")
        .when(~key_ok(), "key too large")
        .when(~value_ok(), "value too large")
        .when(~delete_without_value(), "delete with value"),
    )


def batch_problem(ops: str = "ops") -> Column:
    """What makes a batch invalid, or null: its length, its size on the wire, or one of its operations."""
    size = F.aggregate(ops, F.lit(0).cast("long"), lambda a, x: a + 9 + F.octet_length(x["key"]) + F.coalesce(F.octet_length(x["value"]), F.lit(0)))
    bad = F.exists(
        ops,
        lambda x: ~x["op"].isin(S.PUT, S.DELETE) | ~F.octet_length(x["key"]).between(1, S.MAX_KEY) | ((x["op"] == S.DELETE) & (F.coalesce(F.octet_length(x["value"]), F.lit(0)) > 0)),
    )
    return (
        F.when(F.coalesce(F.size(ops), F.lit(0)) < 1, "empty batch")
        .when(F.size(ops) > S.MAX_BATCH_OPS, "too many operations")
        .when(bad, "invalid operation")
        .when(size > S.MAX_BATCH_BYTES, "batch too large")
    )


def status_of(error: str = "error") -> Column:
    """Status of a request by the error it met (null: none)."""
    e = F.col(error)
    return (
        F.when(e.isNull(), "OK")
        .when(e == "key not found", "NOT_FOUND")
        .when(e == "writer closed", "SERVER_CLOSED")
        .when(e.isin("deadline exceeded", "canceled"), "THROTTLED")
        .when(e.isin("key too large", "value too large", "empty key", "invalid payload", "invalid op"), "INVALID_REQUEST")
        .otherwise("ERROR")
    )


def split_address(peer: str) -> list[Column]:
    """(node_id, host, port) of `id=host:port`, null where the text has another form."""
    form = r"^\s*([0-9]+)=([^:=\s]+):([0-9]{1,5})\s*$"
    part = lambda i: F.when(F.col(peer).rlike(form), F.regexp_extract(peer, form, i))
    return [part(1).cast("long").alias("node_id"), F.lower(part(2)).alias("host"), part(3).cast("long").alias("port")]


def file_name_number(name: str) -> Column:
    """Number of a `%06d.sst` name, null for any other (no path separators pass)."""
    return F.when(F.col(name).rlike(r"^[0-9]{6,}\.sst$"), F.regexp_extract(name, r"^([0-9]+)", 1).cast("long"))


MAX_SEQ = (1 << 63) - 1


def next_seq(seq: str = "seq") -> Column:
    """The number after a sequence number; at the largest one the query fails rather than wraps."""
    return F.when(F.col(seq) < MAX_SEQ, F.col(seq) + 1).otherwise(F.raise_error(F.lit("sequence number overflow")).cast("long"))


def command_problem() -> Column:
    """What makes a replicated command (op, key, value, ops) invalid, or null."""
    op = F.col("op")
    return (
        F.when(~op.isin("put", "delete", "batch"), "unknown op")
        .when((op == "batch") & batch_problem().isNotNull(), batch_problem())
        .when((op != "batch") & ~key_ok(), "invalid key")
        .when((op == "put") & ~value_ok(), "value too large")
        .when((op == "delete") & (F.coalesce(F.octet_length("value"), F.lit(0)) > 0), "delete with value")
        .when((op != "batch") & (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 7 > MAX_COMMAND), "command too large")
    )


MAX_COMMAND = 4 << 20

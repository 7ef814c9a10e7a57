"""Exact dedup: counting quotient filters find fingerprints that occur more than once, bytes decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import scratch
from tidemark.llm.quotient import CountingQuotientFilter
from tidemark.llm.textops import LOWER, buffers, pieces
from tidemark.ship import ship

#: Fingerprints of one merged filter slice at the most, on average.
SLICE_ITEMS = 250_000
#: Bits of the map that says which fingerprint prefixes repeat: its bytes (8 MB) bound what the driver gathers and broadcasts.
MAP_BITS = 26


def _digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    data, offsets = buffers(texts)
    low = LOWER[data]
    view = memoryview(low)
    return low, offsets, [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _fingerprints(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), dtype=">u8").astype(np.uint64)


def _narrow(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                _, _, digests = _digests(piece.column(1))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(2), pa.array(_fingerprints(digests).view(np.int64)), pa.array([d.hex() for d in digests], pa.string())],
                    names=["id", "uid", "fp", "sha"],
                )

    df = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.monotonically_increasing_id().alias("uid"))
    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(run, f"id {kind}, uid long, fp long, sha string")


def repeated_fingerprints(narrow: DataFrame, slice_bits: int) -> DataFrame:
    """(slice, keys, bitmap): per slice of the fingerprint space, how many fingerprints have a count above one and the slice's part of the map."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.asarray(b.column(0)).view(np.uint64) for b in batches]
        fps = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        slices = (fps >> np.uint64(64 - slice_bits)).astype(np.int64)
        at = np.flatnonzero(np.r_[True, slices[1:] != slices[:-1]]) if len(fps) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(slices[at]), pa.array([CountingQuotientFilter.build(x).to_bytes() for x in np.split(fps, at[1:])] if len(at) else [], pa.binary())], names=["slice", "filter"]
        )

    def merge(table: pa.Table) -> pa.Table:
        keys, counts = CountingQuotientFilter.merge(CountingQuotientFilter.from_bytes(x.as_py()) for x in table.column("filter")).items()
        heavy = keys[counts > 1]
        bits = np.zeros(1 << (MAP_BITS - slice_bits), bool)
        bits[((heavy >> np.uint64(64 - MAP_BITS)) & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        return pa.table({"slice": table.column("slice")[:1], "keys": pa.array([len(heavy)]), "bitmap": pa.array([np.packbits(bits).tobytes() if len(heavy) else b""], pa.binary())})

    filters = narrow.select("fp").mapInArrow(build, "slice long, filter binary")
    return filters.groupBy("slice").applyInArrow(merge, "slice long, keys long, bitmap binary")


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, sha (SHA-256 of the text after A-Z were lower-cased).

    Of rows with equal texts the one with the largest id stays; of repeated rows with that id and text exactly one. Null ids rank
    lowest, null texts count as empty, and an empty text is a text like any other. Other columns of `docs` are not read.

    1. One scan leaves (id, fingerprint, digest). 2. Each partition builds a counting quotient filter a slice of the fingerprint
    space, and the slices' filters merge; only a map of 2**MAP_BITS bits of those with counts above one reaches the driver.
    3. A second scan sends on just the texts whose fingerprint is on the map, and grouping by the text itself compares bytes.
    Partial aggregation leaves one row for each distinct text and task, so that copies in any number meet nowhere.
    """
    spark = docs.sparkSession
    ship(spark)
    narrow = scratch.table(_narrow(docs, id_column, text_column), "digests")
    items = narrow.count()
    slice_bits = min(MAP_BITS - 3, max(4, (items // SLICE_ITEMS + 1).bit_length()))
    bitmap = np.zeros((1 << slice_bits, 1 << (MAP_BITS - slice_bits - 3)), np.uint8)
    for row in repeated_fingerprints(narrow, slice_bits).filter("keys > 0").collect():
        bitmap[row["slice"]] = np.frombuffer(row["bitmap"], np.uint8)
    repeated = spark.sparkContext.broadcast(bitmap.ravel() if bitmap.any() else np.zeros(0, np.uint8))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = repeated.value
        for batch in batches if len(known) else ():
            for piece in pieces(batch, 1):
                low, offsets, digests = _digests(piece.column(1))
                fps = _fingerprints(digests)
                at = (fps >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                hit = np.flatnonzero((known[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
                if len(hit):
                    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(fps), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(low.tobytes())]).take(pa.array(hit))
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(hit)), pa.array(fps[hit].view(np.int64)), texts.cast(pa.binary())], names=["id", "fp", "body"])

    kind = narrow.schema["id"].dataType.simpleString()
    routed = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(route, f"id {kind}, fp long, body binary")
    groups = (
        routed.groupBy("fp", "body")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select(F.sha2("body", 256).alias("g_sha"), "keep_id", "group_size")
    )
    groups = scratch.table(groups, "copies")
    heads = (
        narrow.join(groups, (F.col("sha") == F.col("g_sha")) & F.col("id").eqNullSafe(F.col("keep_id")))
        .groupBy("g_sha", "keep_id", "group_size")
        .agg(F.min("uid").alias("head"))
    )
    return narrow.join(heads, F.col("sha") == F.col("g_sha"), "left").select(
        "id",
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("head").isNull() | (F.col("head") == F.col("uid"))).alias("kept"),
        "sha",
        "uid",
    )


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs` that `exact_groups` keeps, with all their columns.

    `docs` gets a row number that must not change between scans; give it a table that was written, not a random expression.
    """
    mark = scratch.free_name(docs, "row_uid")
    dropped = exact_groups(docs, id_column, text_column).filter(~F.col("kept")).select(F.col("uid").alias(mark))
    return docs.withColumn(mark, F.monotonically_increasing_id()).join(dropped, mark, "left_anti").drop(mark)

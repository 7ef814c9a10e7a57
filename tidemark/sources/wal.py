"""Framed log segments: a reader that tells whole from torn and corrupt records, and a writer of the same frames."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.ship import ship

#: crc, type, seq, time, then each of key and value with its length.
_HEAD = struct.Struct("<IBQQ")
_SCHEMA = "segment long, pos long, offset long, bytes long, type int, seq long, ts_ns long, key binary, value binary, status string"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
#: Records and bytes of one batch of decoded records.
_BATCH_ROWS, _BATCH_BYTES = 1_000, 4 << 20


def encode(kind: int, seq: int, ts_ns: int, key: bytes = b"", value: bytes = b"") -> bytes:
    body = struct.pack("<BQQ", kind, seq, ts_ns) + struct.pack("<H", len(key)) + key + struct.pack("<I", len(value)) + value
    return struct.pack("<I", zlib.crc32(body)) + body


def decode(data: bytes | memoryview) -> Iterator[tuple]:
    """(pos, offset, bytes, type, seq, ts_ns, key, value, status) up to the end or the first record that is not ok."""
    at = pos = 0
    while at < len(data):
        record = _one(data, at)
        yield (pos, at, *record)
        if record[-1] != "ok":
            return
        at, pos = at + record[0], pos + 1


def _one(data: bytes | memoryview, at: int) -> tuple:
    empty = (None, None, None, None, None)
    rest = len(data) - at
    if rest < _HEAD.size + 6:
        return (rest, *empty, "torn")
    crc, kind, seq, ts = _HEAD.unpack_from(data, at)
    (klen,) = struct.unpack_from("<H", data, at + _HEAD.size)
    if rest < _HEAD.size + 2 + klen + 4:
        return (rest, *empty, "torn")
    (vlen,) = struct.unpack_from("<I", data, at + _HEAD.size + 2 + klen)
    if vlen > S.MAX_VALUE:
        return (rest, *empty, "length")
    n = _HEAD.size + 6 + klen + vlen
    if rest < n:
        return (rest, *empty, "torn")
    if zlib.crc32(data[at + 4 : at + n]) != crc:
        return (n, *empty, "crc")
    if not S.RECORD_PUT <= kind <= S.BATCH_COMMIT:
        return (n, *empty, "type")
    key_at = at + _HEAD.size + 2
    return (n, kind, seq, ts, bytes(data[key_at : key_at + klen]), bytes(data[at + n - vlen : at + n]), "ok")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Records of all `wal_NNNNNNNNNNNN.log` files below `path`, a segment a task; segments are bounded in size when written."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "wal_*.log").option("recursiveFileLookup", True).load(path)
    return decoded(files.select(F.regexp_extract("path", r"wal_([0-9]{12})\.log$", 1).cast("long").alias("segment"), "content").filter("segment is not null"))


def decoded(segments: DataFrame) -> DataFrame:
    """Records of `segments` (segment, content), each up to the first that is not ok."""
    ship(segments.sparkSession)
    return segments.select("segment", "content").mapInArrow(record_batches, _SCHEMA)


def record_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of batches of (segment, content), in small batches.

    Contents are read where Arrow has them, and a batch of them (64 MB by Spark's limit, or one longer segment) goes before the next one
    comes, so a worker's memory depends neither on the segments of its task nor on the records of a segment.
    """
    schema = pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in _SCHEMA.split(", "))])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        rows, held = [], 0
        for segment, content in zip(batch.column(0), batch.column(1), strict=True):
            number = segment.as_py()
            for r in decode(memoryview(content.as_buffer())):
                rows.append((number, *r))
                held += r[2]
                if len(rows) >= _BATCH_ROWS or held >= _BATCH_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)
        batch = content = rows = None


def encoded(records: DataFrame) -> DataFrame:
    """(segment, content) of records (segment, type, seq, ts_ns, key, value): frames in order of seq. A segment, bounded in size by
    rotation, is built in one task."""
    ship(records.sparkSession)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        rows = f.sort_values("seq")[["type", "seq", "ts_ns", "key", "value"]].itertuples(index=False)
        body = b"".join(encode(int(t), int(n), int(at), bytes(k or b""), bytes(v or b"")) for t, n, at, k, v in rows)
        return pd.DataFrame({"segment": [f["segment"].iloc[0]], "content": [body]})

    return records.select("segment", "type", "seq", "ts_ns", "key", "value").groupBy("segment").applyInPandas(run, "segment long, content binary")


def rotate(sizes: list[int], limit: int = S.SEGMENT_BYTES) -> list[int]:
    """Segment of each record: a new one starts when the record would pass the limit; a record beyond it gets one of its own."""
    out, used, segment = [], 0, 0
    for n in sizes:
        if used and used + n > limit:
            segment, used = segment + 1, 0
        used += n
        out.append(segment)
    return out

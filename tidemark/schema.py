"""Types, limits and the row order of a versioned mutation log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Operation codes, record types and limits.
PUT, DELETE = 1, 2
RECORD_PUT, RECORD_DELETE, BATCH_START, BATCH_COMMIT = 1, 2, 3, 4
MAX_KEY, MAX_VALUE, MAX_BATCH_OPS, MAX_BATCH_BYTES = 65_535, 4 << 20, 1_024, 5 << 20
MAX_PIPELINE, SCAN_LIMIT, MAX_SCAN_LIMIT = 64, 100, 500
RECORD_OVERHEAD = 27
SEGMENT_BYTES, MEMTABLE_BYTES, OUTPUT_BYTES = 64 << 20, 64 << 20, 2 << 20
LEVELS, L0_FILES, L1_BYTES, LEVEL_MULTIPLIER = 7, 4, 10 << 20, 10

MUTATION_LOG = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.IntegerType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)
BATCH_OPS = T.ArrayType(T.StructType([T.StructField("op", T.IntegerType()), T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())]))
BATCHES = T.StructType([T.StructField("batch_id", T.LongType()), T.StructField("ops", BATCH_OPS)])
FILES = T.StructType(
    [
        T.StructField("level", T.LongType()),
        T.StructField("file_num", T.LongType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("smallest_key", T.BinaryType()),
        T.StructField("largest_key", T.BinaryType()),
        T.StructField("smallest_seq", T.LongType()),
        T.StructField("largest_seq", T.LongType()),
    ]
)


def newest_first() -> list[Column]:
    """Order inside a key: highest sequence number first, a delete before a put of the same number."""
    return [F.col("seq").desc(), F.col("op").desc()]


def canonical() -> list[Column]:
    """Order of a merged log: key as unsigned bytes, then newest first."""
    return [F.col("key").asc(), *newest_first()]


def record_bytes() -> Column:
    return F.lit(RECORD_OVERHEAD) + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))

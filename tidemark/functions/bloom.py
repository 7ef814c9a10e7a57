"""Murmur3 (x64, 128 bits), a Bloom filter of ten bits a key and seven probes, and what its error rate should be."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.ship import ship

BITS_PER_KEY, PROBES, MAX_KEYS = 10, 7, 214_748_364
_C1, _C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _final(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def murmur3(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the hash (seed 0) of each key; keys of one length go through numpy together."""
    h1, h2 = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
    by_length: dict[int, list[int]] = {}
    for i, k in enumerate(keys):
        by_length.setdefault(len(k), []).append(i)
    with np.errstate(over="ignore"):
        for n, rows in by_length.items():
            full = n // 16
            data = np.frombuffer(b"".join(keys[i].ljust((full + 1) * 16, b"\0") for i in rows), "<u8").reshape(len(rows), -1)
            a, b = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint64)
            for k in range(full):
                a ^= _rotate(data[:, 2 * k] * _C1, 31) * _C2
                a = (_rotate(a, 27) + b) * np.uint64(5) + np.uint64(0x52DCE729)
                b ^= _rotate(data[:, 2 * k + 1] * _C2, 33) * _C1
                b = (_rotate(b, 31) + a) * np.uint64(5) + np.uint64(0x38495AB5)
            if n % 16:
                b ^= _rotate(data[:, 2 * full + 1] * _C2, 33) * _C1
                a ^= _rotate(data[:, 2 * full] * _C1, 31) * _C2
            a, b = a ^ np.uint64(n), b ^ np.uint64(n)
            a = a + b
            b = b + a
            a, b = _final(a), _final(b)
            a = a + b
            h1[rows], h2[rows] = a, b + a
    return h1, h2


def filter_bits(keys: int) -> int:
    if not 0 <= keys <= MAX_KEYS:
        raise ValueError("number of keys out of range")
    return keys * BITS_PER_KEY


def probes(keys: list[bytes], bits: int) -> np.ndarray:
    """key x PROBES positions: (h1 mod m + i * (h2 mod m)) mod m."""
    h1, h2 = murmur3(keys)
    m = np.uint64(bits)
    i = np.arange(PROBES, dtype=np.uint64)
    return (((h1 % m)[:, None] + i[None, :] * (h2 % m)[:, None]) % m).astype(np.int64)


def probe_rows(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """`keys` with probes, an array of positions."""
    ship(keys.sparkSession)

    @F.pandas_udf("array<long>")
    def at(values: pd.Series) -> pd.Series:
        return pd.Series(list(probes([bytes(v) for v in values], bits)))

    return keys.withColumn("probes", at(F.col(key)))


def build(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """(word, bits): the filter as 64-bit words that are not 0; each task first unites its own words."""
    each = probe_rows(keys.filter(F.col(key).isNotNull()), key, bits).select(F.explode("probes").alias("p"))
    return each.groupBy(F.expr("p div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))


def query(keys: DataFrame, key: str, words: DataFrame, bits: int) -> DataFrame:
    """`keys` with maybe: all bits of a key are set. A filter without words holds nothing."""
    asked = probe_rows(keys, key, bits).withColumn("_id", F.monotonically_increasing_id())
    each = asked.select("_id", F.explode("probes").alias("p")).withColumn("word", F.expr("p div 64"))
    hits = each.join(words, "word").filter(F.expr("(bits & shiftleft(1L, cast(p % 64 as int))) <> 0")).groupBy("_id").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(hits, "_id", "left").withColumn("maybe", F.coalesce(F.col("n") == PROBES, F.lit(False))).drop("_id", "n", "probes")


def theoretical_rate(bits_per_key: Column, probes: Column) -> Column:
    return F.pow(1 - F.exp(-probes / bits_per_key), probes)


def wilson(successes: Column, trials: Column, z: float = 1.959963984540054) -> list[Column]:
    """(low, high) of the Wilson interval; exactly 0 and 1 where no or all trials succeed."""
    n = trials.cast("double")
    p = successes / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low = F.when(successes == 0, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half))
    high = F.when(successes == trials, 1.0).otherwise(F.least(F.lit(1.0), mid + half))
    return [low.alias("low"), high.alias("high")]


def z_score(successes: Column, trials: Column, p: float) -> Column:
    spread = F.sqrt(trials * F.lit(p) * F.lit(1 - p))
    return F.when((trials > 0) & (spread > 0), (successes - trials * F.lit(p)) / spread).otherwise(0.0)


def rate_experiment(spark, inserted: int, asked: int) -> DataFrame:
    """One row (false_negatives, false_positives): `inserted` keys go in, they and `asked` others are looked up."""
    bits = filter_bits(inserted)
    name = lambda prefix: F.encode(F.concat(F.lit(prefix), F.lpad(F.col("id").cast("string"), 10, "0")), "UTF-8")
    there, absent = (spark.range(n).select(name(p).alias("key")) for p, n in (("insert:", inserted), ("absent:", asked)))
    words = build(there, "key", bits)
    found = query(there.withColumn("in", F.lit(True)).unionByName(absent.withColumn("in", F.lit(False))), "key", words, bits)
    return found.agg(F.count_if(F.col("in") & ~F.col("maybe")).alias("false_negatives"), F.count_if(~F.col("in") & F.col("maybe")).alias("false_positives"))


def encode_filter(bitset: bytes, bits: int, probes: int = PROBES) -> bytes:
    """A filter as one block: the bits, their number and that of probes, and a checksum of it all."""
    body = bitset + struct.pack("<QI", bits, probes)
    return body + struct.pack("<I", zlib.crc32(body))


def decode_filter(block: bytes) -> tuple[bytes, int, int]:
    if len(block) < 16 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("corrupt filter block")
    bits, probes = struct.unpack("<QI", block[-16:-4])
    if len(block) - 16 != (bits + 7) // 8:
        raise ValueError("filter block of the wrong length")
    return block[:-16], bits, probes


def expected_rate(inserted: int, asked: int) -> float:
    return asked * (1 - math.exp(-PROBES / BITS_PER_KEY)) ** PROBES


def shard_of(files: np.ndarray, offsets: np.ndarray, shards: int = 16) -> np.ndarray:
    """Cache shard of (file, offset) pairs: bits 28 and up of the hash of both as little-endian numbers."""
    keys = np.column_stack([files, offsets]).astype("<u8").view("S16").ravel()
    h1, _ = murmur3([k.ljust(16, b"\0") for k in keys.tolist()])
    return ((h1 >> np.uint64(28)) & np.uint64(shards - 1)).astype(np.int64)

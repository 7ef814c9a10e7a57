"""Vectorised text primitives on UTF-8 buffers as Arrow hands them over."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.ship import ship

#: Bytes of text that one vectorised step handles; one longer text is a step of its own.
STEP_BYTES = 1 << 20


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser; returns a new array."""
    with np.errstate(over="ignore"):
        t = x >> np.uint64(30)
        x = x ^ t
        x *= np.uint64(0xBF58476D1CE4E5B9)
        np.right_shift(x, np.uint64(27), out=t)
        x ^= t
        x *= np.uint64(0x94D049BB133111EB)
        np.right_shift(x, np.uint64(31), out=t)
        x ^= t
    return x


BYTE_VALUE = _splitmix(256, 11)
BASE = np.uint64(0xD6E8FEB86659FD93)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes of `[^\x20\x09-\x0D]+`.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`; every byte of a multi-byte character belongs to words.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept up to a bounded length."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1024)
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        filled = 1
        with np.errstate(over="ignore"):
            step = base
            while filled < size:
                take = min(filled, size - filled)
                have[filled : filled + take] = have[:take] * step
                filled += take
                step = step * step
        if size <= 4 * STEP_BYTES:
            _powers[int(base)] = have
    return have[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, pa.scalar("", texts.type))
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def pieces(batch: pa.RecordBatch, column: str | int, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of `batch` with at most `limit` bytes of text each, or a single row."""
    n = batch.num_rows
    if n == 0:
        return
    _, offsets = buffers(batch.column(column))
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), n)
        yield batch.slice(start, end - start)
        start = end


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the maximal runs of word bytes that stay inside one text, and per text the index of its first run (n + 1)."""
    m = is_word[data]
    if not len(m):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    first = m.copy()
    first[1:] &= ~m[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < len(m)]
    first[edge] = m[edge]
    last = m.copy()
    last[:-1] &= ~m[1:]
    edge = edge[edge > 0]
    last[edge - 1] = m[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever the span stands."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * powers(BASE, len(data)), out=total[1:])
        return mix((total[ends] - total[starts]) * powers(BASE_INV, len(data) + 1)[starts])


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive entries of `words`; the caller drops those that cross texts."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(count, n, np.uint64)
        for k in range(n):
            h = h * BASE + words[k : k + count]
        return mix(h)


def map_text(df: DataFrame, column: str, out: str, kind: T.StructType | str, make: Callable[[], Callable[[pa.Array], pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """Append struct column `out`, made from text column `column` by `make()`, one call a partition; `keep` names the columns to return (all)."""
    kind = T.StructType.fromDDL(kind) if isinstance(kind, str) else kind
    keep = list(df.columns) if keep is None else keep
    fields = [f for f in df.schema.fields if f.name in keep]
    at = df.columns.index(column)
    kept = [i for i, c in enumerate(df.columns) if c in keep]
    schema = T.StructType([*fields, T.StructField(out, kind)])
    names = [*(f.name for f in fields), out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for piece in pieces(batch, at):
                yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in kept), work(piece.column(at))], names=names)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)

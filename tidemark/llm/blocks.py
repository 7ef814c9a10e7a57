"""Distinct texts dealt out in blocks, and which hashed tokens stand in more than one text of all blocks.

Both the n-gram join and the suffix dedup need the tokens that several texts share. Texts with equal keys meet in the block that the
key names, so a block counts each once; of a token, a block sends one entry with its count, whatever the number of its texts. A
token in a third of all texts thus costs one entry a block.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textops import mix, pieces
from tidemark.ship import ship

#: Bytes of text of a block (more where there are very many blocks), and of the texts whose tokens make a bucket.
BLOCK_BYTES, MOST_BLOCK_BYTES, BUCKET_BYTES = 1 << 20, 16 << 20, 8 << 20
#: A task sends its texts on when it holds this many bytes.
FLUSH_BYTES = 12 << 20

_KINDS = [np.dtype(x) for x in ("u1", "u2", "u4", "u8", "i4", "i8")]


def pack(*arrays: np.ndarray, compress: bool = False) -> bytes:
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<BQ", _KINDS.index(a.dtype), len(a)) for a in arrays)
    body = head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return struct.pack("<Q", len(body)) + pa.compress(body, codec="zstd", asbytes=True) if compress else struct.pack("<Q", 0) + body


def unpack(data: bytes) -> list[np.ndarray]:
    (size,) = struct.unpack_from("<Q", data)
    data = pa.decompress(memoryview(data)[8:], size, codec="zstd", asbytes=True) if size else data[8:]
    out, at = [], 1 + 9 * data[0]
    for i in range(data[0]):
        kind, n = struct.unpack_from("<BQ", data, 1 + 9 * i)
        out.append(np.frombuffer(data, _KINDS[kind], n, at))
        at += out[-1].nbytes
    return out


def low48(x: np.ndarray) -> np.ndarray:
    """The low six bytes of each entry, one after another."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).ravel()


def from48(x: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(x) // 6, 8), np.uint8)
    wide[:, :6] = x.reshape(-1, 6)
    return wide.view("<u8").ravel()


class Layout:
    """Numbers of blocks and buckets for `total` bytes of text, and what identifies a token between them.

    A token is sent as six bytes beside its bucket, so tokens count as equal when their low 48 bits and leading bits (of the
    bucket's number, 16 at the most) are.
    """

    def __init__(self, total: int, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> None:
        self.blocks = max(8, total // min(MOST_BLOCK_BYTES, max(block_bytes, total // (1 << 16))))
        self.bits = max(4, (total // bucket_bytes).bit_length())
        top = min(self.bits, 16)
        self.top = top
        self.mask = np.uint64((((1 << top) - 1) << (64 - top)) | ((1 << 48) - 1))

    def bucket(self, t: np.ndarray) -> np.ndarray:
        return (t >> np.uint64(64 - self.bits)).astype(np.int64)

    def ident(self, t: np.ndarray) -> np.ndarray:
        return t & self.mask

    def restore(self, bucket: int, low: np.ndarray) -> np.ndarray:
        return np.uint64((bucket >> (self.bits - self.top)) << (64 - self.top)) | low


def collisions(narrow: DataFrame) -> frozenset[int]:
    """Keys of `narrow` (key, check) that stand for different contents, told by a second hash of 64 bits.

    At n distinct contents some n**2 / 2**65 keys are expected, 70 for fifty billion texts, so they fit the driver and a broadcast.
    """
    per = narrow.groupBy("key").agg(F.min("check").alias("lo"), F.max("check").alias("hi"))
    return frozenset(r[0] for r in per.filter("lo <> hi").select("key").collect())


def apart(keys: np.ndarray, checks: np.ndarray, bad: frozenset[int]) -> np.ndarray:
    """`keys`, with the second hash in place of those that several contents share."""
    if not bad:
        return keys
    swap = np.isin(keys, np.fromiter(bad, np.int64, len(bad)))
    return np.where(swap & (checks != 0), checks, keys)


def apart_column(bad: frozenset[int]) -> F.Column:
    """The same for a frame with key and check."""
    return F.when(F.col("key").isin(*bad) & (F.col("check") != 0), F.col("check")).otherwise(F.col("key")) if bad else F.col("key")


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal neighbours."""
    if not len(values):
        return []
    at = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]).tolist()
    return list(zip(at, [*at[1:], len(values)], strict=True))


def _table(**columns: tuple[list, pa.DataType]) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})


def deal(docs: DataFrame, id_column: str, text_column: str, keys_of: Callable[[pa.Array], np.ndarray], layout: Layout) -> DataFrame:
    """(block, payload): each distinct text with its key and the smallest id a task saw it with, once a task and key (and a line without
    the text for a smaller id later on). `keys_of` gives the key of each text, 0 for texts to leave out. Null ids count as largest."""
    ship(docs.sparkSession)
    blocks = layout.blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        held: dict[int, list[tuple[int, int, bytes]]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = []
            for block, found in held.items():
                keys, ids = (np.array([x[i] for x in found], np.int64) for i in (0, 1))
                lengths = np.array([len(x[2]) for x in found], np.int64)
                rows.append((block, pack(keys, ids, lengths, np.frombuffer(b"".join(x[2] for x in found), np.uint8), compress=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "payload"])

        for batch in batches:
            for piece in pieces(batch, 1):
                keys = keys_of(piece.column(1))
                homes = (mix(keys.astype(np.int64).view(np.uint64)) % np.uint64(blocks)).tolist()
                for i, (doc, key) in enumerate(zip(piece.column(0).to_pylist(), keys.tolist(), strict=True)):
                    if key == 0:
                        continue
                    doc = (1 << 63) - 1 if doc is None else doc
                    before = seen.get(key)
                    if before is not None and before <= doc:
                        continue
                    seen[key] = doc
                    body = b"" if before is not None else (piece.column(1)[i].as_py() or "").encode()
                    held.setdefault(homes[i], []).append((key, doc, body))
                    size += len(body)
                if size >= FLUSH_BYTES:
                    yield flush()
                    size = 0
        yield flush()

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(run, "block long, payload binary")


def texts_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Keys, smallest ids and texts of one block, sorted by key."""
    found: dict[int, list] = {}
    for row in table.column("payload"):
        keys, ids, lengths, body = unpack(row.as_py())
        ends = np.cumsum(lengths)
        raw = body.tobytes()
        for k, d, n, e in zip(keys.tolist(), ids.tolist(), lengths.tolist(), ends.tolist(), strict=True):
            x = found.setdefault(k, [d, b""])
            x[0] = min(x[0], d)
            if n:
                x[1] = raw[e - n : e]
    order = sorted(found)
    return np.array(order, np.int64), np.array([found[k][0] for k in order], np.int64), pa.array([found[k][1] for k in order], pa.large_binary()).cast(pa.large_string())


def token_rows(block: int, tokens: np.ndarray, counts: np.ndarray, layout: Layout) -> pa.Table:
    """(bucket, payload) of sorted distinct tokens of a block and the number of its texts that have each."""
    parts = runs(bucket := layout.bucket(tokens))
    rows = [pack(np.array([block]), low48(tokens[a:b]), np.minimum(counts[a:b], 65535).astype(np.uint16)) for a, b in parts]
    return _table(bucket=([int(bucket[a]) for a, _ in parts], pa.int64()), payload=(rows, pa.binary()))


def shared_tokens(rows: DataFrame, layout: Layout) -> DataFrame:
    """(block, payload): back to each block go those of its tokens that stand in two texts or more over all blocks, with that number."""

    def reduce(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts = [unpack(x.as_py()) for x in table.column("payload")]
        low = np.concatenate([from48(p[1]) for p in parts])
        count = np.concatenate([p[2] for p in parts]).astype(np.int64)
        order = np.argsort(low, kind="stable")
        sorted_low = low[order]
        first = np.flatnonzero(np.r_[True, sorted_low[1:] != sorted_low[:-1]])
        total = np.add.reduceat(count[order], first)
        whole = np.empty(len(low), np.int64)
        whole[order] = np.repeat(total, np.diff(np.r_[first, len(low)]))
        out, blocks, at = [], [], 0
        for p in parts:
            n = len(p[2])
            keep = whole[at : at + n] > 1
            if keep.any():
                blocks.append(int(p[0][0]))
                out.append(pack(np.array([bucket]), low48(low[at : at + n][keep]), np.minimum(whole[at : at + n][keep], (1 << 32) - 1).astype(np.uint32)))
            at += n
        return _table(block=(blocks, pa.int64()), payload=(out, pa.binary()))

    return rows.groupBy("bucket").applyInArrow(reduce, "block long, payload binary")


def replies(table: pa.Table, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Sorted identities of a block's shared tokens and their counts."""
    ids, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for row in table.column("payload"):
        bucket, low, count = unpack(row.as_py())
        ids.append(layout.restore(int(bucket[0]), from48(low)))
        counts.append(count.astype(np.int64))
    ids, counts = np.concatenate(ids), np.concatenate(counts)
    order = np.argsort(ids)
    return ids[order], counts[order]


def lookup(ids: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The count of each identity, 0 if it is not among the sorted `known`."""
    if not len(known):
        return np.zeros(len(ids), np.int64)
    at = np.searchsorted(known, ids)
    at[at == len(known)] = 0
    return np.where(known[at] == ids, counts[at], 0)

"""Benchmark decontamination: a prefix-filtered join of benchmark windows with documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import scratch
from tidemark.llm.textops import ALNUM, BASE, BASE_INV, LOWER, buffers, gram_hashes, map_text, pieces, powers, span_hashes, spans
from tidemark.ship import ship

#: Words of a window.
WINDOW = 13
#: Words of a shingle, the token that windows are joined by.
SHINGLE = 5
#: Benchmark text (bytes) that one pass over the documents holds in memory and broadcasts; more makes more passes.
BLOCK_BYTES = 16 << 20

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.LongType())),
    ]
)


def _words(text: str) -> list[bytes]:
    data, offsets = buffers(pa.array([text], pa.large_string()))
    low = LOWER[data]
    starts, ends, _ = spans(low, offsets, ALNUM)
    raw = low.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _hash_words(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return span_hashes(data, np.r_[0, ends[:-1]], ends)


def _running(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * powers(BASE, len(h)), out=total[1:])
    return total


def _between(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words start..end, wherever they stand."""
    with np.errstate(over="ignore"):
        return (total[end] - total[start]) * powers(BASE_INV, len(total))[start]


class WindowIndex:
    """The distinct windows of some benchmark items and the shingles in them, all in flat arrays: a window is a slice of the items'
    words, which are held once."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW, shingle: int = SHINGLE) -> None:
        self.ids: list[str | None] = [i for i, _ in items]
        texts: list[bytes] = []
        parts: list[tuple[np.ndarray, ...]] = []
        grams: dict[int, list[np.ndarray]] = {}
        n_grams: dict[int, int] = {}
        base = 0
        for at, (_, text) in enumerate(items):
            words = _words(text or "")
            if not words:
                continue
            n = min(window, len(words))
            w = min(shingle, n)
            h = _hash_words(words)
            shingles, total = gram_hashes(h, w)[: len(words) - w + 1], _running(h)
            k = np.arange(len(words) - n + 1)
            ends = np.cumsum([len(x) + 1 for x in words])
            begins = np.r_[0, ends[:-1]]
            each = lambda x, k=k: np.full(len(k), x, np.int32)
            parts.append((_between(total, k, k + n), base + begins[k], base + ends[k + n - 1] - 1, each(n), each(w), each(at), n_grams.get(w, 0) + k))
            grams.setdefault(w, []).append(shingles)
            n_grams[w] = n_grams.get(w, 0) + len(shingles)
            texts.append(b" ".join(words) + b" ")
            base += len(texts[-1])
        self.data = b"".join(texts)
        none = (np.zeros(0, np.uint64), *(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int32, np.int64)))
        full, begin, stop, length, width, owner, gram = (np.concatenate(x) for x in zip(none, *parts, strict=True))
        same = self._first_equal(full, begin, stop)
        first, win = np.unique(same, return_inverse=True)
        self.full, self.begin, self.stop, self.length, self.width, self._gram = full[first], begin[first], stop[first], length[first], width[first], gram[first]
        pairs = np.unique(win * max(1, len(items)) + owner)
        self.owner = (pairs % max(1, len(items))).astype(np.int32)
        self.first_owner = np.searchsorted(pairs // max(1, len(items)), np.arange(len(first) + 1))
        self.shingles: dict[int, np.ndarray] = {}
        self._rows: dict[int, np.ndarray] = {}
        for w, found in grams.items():
            self.shingles[w], self._rows[w] = np.unique(np.concatenate(found), return_inverse=True)
        self.prefix: dict[int, tuple[np.ndarray, ...]] = {}

    def _first_equal(self, full: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """For each window the first one of the same words. Those of one hash whose words differ stay apart."""
        order = np.lexsort((stop - begin, full))
        f, n = full[order], (stop - begin)[order]
        new = np.r_[True, (f[1:] != f[:-1]) | (n[1:] != n[:-1])][: len(f)]
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(f)), 0))]
        out = np.empty(len(f), np.int64)
        out[order] = head
        for i in np.flatnonzero(out != np.arange(len(out))).tolist():
            j = out[i]
            if self.data[begin[i] : stop[i]] != self.data[begin[j] : stop[j]]:
                out[i] = i
        return out

    @property
    def texts(self) -> list[bytes]:
        """The words of every window."""
        return [self.text(v) for v in range(len(self.begin))]

    def text(self, window: int) -> bytes:
        return self.data[self.begin[window] : self.stop[window]]

    def owners(self, window: int) -> list[int]:
        return self.owner[self.first_owner[window] : self.first_owner[window + 1]].tolist()

    def choose(self, frequency: dict[int, np.ndarray], step: int = 1 << 16) -> None:
        """Shingles in order of (documents that have it, hash): containment needs every shingle of a window, so its first one is a
        sufficient prefix. A window with a shingle that no document has can't occur and leaves the index."""
        for w, shingles in self.shingles.items():
            n = frequency[w]
            rank = np.empty(len(n), np.int64)
            rank[np.lexsort((shingles, n))] = np.arange(len(n))
            found: list[tuple[np.ndarray, ...]] = []
            for length in np.unique(self.length[self.width == w]).tolist():
                wins = np.flatnonzero((self.width == w) & (self.length == length))
                for at in range(0, len(wins), step):
                    some = wins[at : at + step]
                    rows = self._rows[w][self._gram[some][:, None] + np.arange(length - w + 1)]
                    best = np.argmin(rank[rows], axis=1)
                    row = rows[np.arange(len(some)), best]
                    seen = n[row] > 0
                    found.append((shingles[row[seen]], best[seen], some[seen]))
            key, offset, win = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(key):
                order = np.lexsort((win, offset, key))
                keys, first, count = np.unique(key[order], return_index=True, return_counts=True)
                self.prefix[w] = (keys, first, count, offset[order].astype(np.int32), win[order])
        self._rows, self.shingles, self._gram = {}, {}, np.zeros(0, np.int64)


def _known(h: np.ndarray, keys: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of `h` that are among the sorted `keys`, and which key; a bitmap over the low bits sorts most out."""
    at = np.flatnonzero(bitmap[(h & np.uint64(len(bitmap) - 1)).astype(np.int64)])
    k = np.searchsorted(keys, h[at])
    k[k == len(keys)] = 0
    same = keys[k] == h[at]
    return at[same], k[same]


def _bitmap(keys: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << max(12, min(22, (8 * len(keys)).bit_length())), bool)
    bits[(keys & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return bits


class _Prepared:
    def __init__(self, texts: pa.Array) -> None:
        data, self.offsets = buffers(texts)
        self.low = LOWER[data]
        self.starts, self.ends, self.first = spans(self.low, self.offsets, ALNUM)
        self.hash = span_hashes(self.low, self.starts, self.ends)
        self.doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def grams(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles, and whether each stays inside its text."""
        h = gram_hashes(self.hash, width)
        return h, self.first[self.doc[: len(h)] + 1] >= np.arange(len(h)) + width


def _count(index_of: dict[int, np.ndarray], texts: pa.Array, maps: dict[int, np.ndarray], into: dict[int, np.ndarray]) -> None:
    p = _Prepared(texts)
    for w, keys in index_of.items():
        h, inside = p.grams(w)
        at, k = _known(h, keys, maps[w])
        ok = inside[at]
        pairs = np.unique(p.doc[at[ok]] * len(keys) + k[ok])
        np.add.at(into[w], pairs % len(keys), 1)


def frequencies(docs: DataFrame, text_column: str, shingles: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """In how many texts each benchmark shingle stands, over all of `docs`; as many numbers as the block has shingles come back."""
    ship(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(shingles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = known.value
        maps, counts = {w: _bitmap(k) for w, k in keys.items()}, {w: np.zeros(len(k), np.int64) for w, k in keys.items()}
        for batch in batches:
            for piece in pieces(batch, 0):
                _count(keys, piece.column(0), maps, counts)
        for w, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), w)), pa.array(at), pa.array(n[at])], names=["width", "at", "n"])

    out = {w: np.zeros(len(k), np.int64) for w, k in shingles.items()}
    counts = docs.select(F.col(text_column)).mapInArrow(run, "width long, at long, n long").groupBy("width", "at").agg(F.sum("n").alias("n"))
    for w, at, n in counts.collect():
        out[w][at] = n
    known.unpersist()
    return out


def find_windows(index: WindowIndex, texts: pa.Array) -> tuple[_Prepared, np.ndarray, list[set[int]]]:
    """The prepared texts, for each word whether it is hit, and for each text the items with occurring windows."""
    p = _Prepared(texts)
    change = np.zeros(len(p.starts) + 1, np.int64)
    items: list[set[int]] = [set() for _ in range(len(p.offsets) - 1)]
    total = _running(p.hash) if index.prefix else None
    for w, (keys, first, count, offset, win) in index.prefix.items():
        h, inside = p.grams(w)
        at, k = _known(h, keys, index.maps[w])
        at, k = at[inside[at]], k[inside[at]]
        n = count[k]
        entry = np.repeat(first[k] - np.r_[0, np.cumsum(n)[:-1]] if len(n) else first[k], n) + np.arange(n.sum())
        pos, win_of = np.repeat(at, n), win[entry]
        doc, start = p.doc[pos], pos - offset[entry]
        end = start + index.length[win_of]
        fits = (start >= p.first[doc]) & (end <= p.first[doc + 1])
        start, end, win_of, doc = start[fits], end[fits], win_of[fits], doc[fits]
        same = _between(total, start, end) == index.full[win_of]
        for a, b, v, d in zip(start[same].tolist(), end[same].tolist(), win_of[same].tolist(), doc[same].tolist(), strict=True):
            words = [p.low[x:y].tobytes() for x, y in zip(p.starts[a:b].tolist(), p.ends[a:b].tolist(), strict=True)]
            if b" ".join(words) == index.text(v):
                change[a] += 1
                change[b] -= 1
                items[d].update(index.owners(v))
    return p, np.cumsum(change[:-1]) > 0, items


def _result(index: WindowIndex, texts: pa.Array) -> pa.StructArray:
    p, hit, items = find_windows(index, texts)
    running = np.r_[0, np.cumsum(hit)]
    per_doc: list[list[int]] = [[] for _ in items]
    for d in np.flatnonzero(running[p.first[1:]] > running[p.first[:-1]]).tolist():
        a, b = p.first[d], p.first[d + 1]
        edge = np.flatnonzero(np.diff(np.r_[0, hit[a:b].astype(np.int8), 0]))
        per_doc[d] = edge.tolist()
    names = [sorted({index.ids[i] for i in x if index.ids[i] is not None}) for x in items]
    return pa.StructArray.from_arrays(
        [pa.array(np.diff(p.first)), pa.array(running[p.first[1:]] - running[p.first[:-1]]), pa.array(names, pa.list_(pa.string())), pa.array(per_doc, pa.list_(pa.int64()))],
        fields=[pa.field("n_words", pa.int64()), pa.field("n_hit", pa.int64()), pa.field("items", pa.list_(pa.string())), pa.field("spans", pa.list_(pa.int64()))],
    )


def _blocks(benchmark: DataFrame, id_column: str, text_column: str, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in blocks of at most `block_bytes` of text (or one item), streamed to the driver a partition at a time."""
    block: list[tuple[str | None, str | None]] = []
    size = 0
    for item, text in benchmark.select(F.col(id_column).cast("string"), F.col(text_column)).toLocalIterator():
        n = len((text or "").encode())
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    if block:
        yield block


def _merge(parts: list[str], out: str) -> F.Column:
    """One result from those of several blocks: hit spans are united, items joined."""
    cols = [F.col(f"`{c}`") for c in parts]
    pairs = F.flatten(F.array(*map(_pairs, cols)))
    united = F.aggregate(
        F.array_sort(pairs),
        F.lit([]).cast("array<struct<a:bigint,b:bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= x["a"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["b"]).alias("b")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    hits = F.aggregate(united, F.lit(0).cast("long"), lambda acc, x: acc + x["b"] - x["a"])
    return F.struct(
        cols[0]["n_words"].alias("n_words"),
        hits.alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*(c["items"] for c in cols))))).alias("items"),
        F.flatten(F.transform(united, lambda x: F.array(x["a"], x["b"]))).alias("spans"),
    ).alias(out)


def _pairs(c: F.Column) -> F.Column:
    flat = c["spans"]
    index = F.filter(F.transform(flat, lambda x, i: i), lambda i: i % 2 == 0)
    return F.transform(index, lambda i: F.struct(flat[i].alias("a"), flat[i + 1].alias("b")))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    out: str = "contamination",
    keep: list[str] | None = None,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """`docs` (or its columns `keep`) with a struct column `out`: n_words, n_hit, items, spans.

    Words are maximal runs of letters and digits after A-Z were lower-cased. A window is `window` consecutive words of an item, or
    all words of a shorter one. `n_hit` counts the words inside any occurrence of a window, `spans` lists those words' runs (start,
    end, start, end, ...), `items` the ids, as sorted strings, of the items with occurring windows.

    The windows' shingles are ordered by the number of documents that have them, counted over all documents in a first scan. In a
    second, a document meets a window by the window's rarest shingle; the shingle's offset and both lengths bound where the window
    would stand, a hash of all its words and then the words themselves decide. Benchmark text is held in blocks of `block_bytes`,
    each in two scans of its own, so broadcasts stay bounded; results of blocks are united per row.

    Null and empty texts have no words. Items without words have no windows; windows of an item without id hit words but add no
    id; repeated items count once. If `docs` has a column named `out`, underscores are appended to the name.
    """
    out = scratch.free_name(docs, out)
    kept = list(docs.columns) if keep is None else list(keep)
    current, parts = docs, []
    blocks = _blocks(benchmark, item_column, item_text_column, block_bytes)
    block = next(blocks, [])
    while block or not parts:
        after = next(blocks, [])
        index = WindowIndex(block, window)
        index.choose(frequencies(docs, text_column, index.shingles))
        index.maps = {w: _bitmap(x[0]) for w, x in index.prefix.items()}
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def make(shared=shared):
            index = shared.value
            return lambda texts: _result(index, texts)

        name = scratch.free_name(current, f"{out}_{len(parts)}")
        current = map_text(current, text_column, name, RESULT, make, [*kept, *parts, *([text_column] if after else [])])
        if after:
            current = scratch.table(current, "contamination")
        parts.append(name)
        block = after
    if len(parts) == 1:
        return current.withColumnRenamed(parts[0], out)
    return current.select(*(c for c in kept), _merge(parts, out))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()

"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import scratch
from tidemark.llm.textops import LOWER, NON_SPACE, buffers, gram_hashes, map_text, pieces, span_hashes, spans
from tidemark.ship import ship

#: The trees are fitted on a sample of at most about so many labelled documents.
FIT_ROWS = 30_000
RESULT = "score double"

_UPPER, _LOW, _DIGIT, _SPACE, _WIDE = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = _LOW[97:123] = _DIGIT[48:58] = _WIDE[128:] = True
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ENDS = np.zeros(256, bool)
_ENDS[[33, 46, 63]] = True
_SYMBOL = ~(_UPPER | _LOW | _DIGIT | _SPACE | _WIDE)
_MARKS = _SYMBOL.copy()
_MARKS[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = False
_LINE = np.ones(256, bool)
_LINE[10] = False
FEATURES = (
    "log_bytes log_words word_length upper digit space wide symbol mark ends comma words_a_line log_lines repeated_lines distinct_words top_word "
    "repeated_bigrams repeated_fives capital_words all_caps_words symbol_words long_words short_words distinct_ratio_guiraud one_char_lines"
).split()


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text: the number of distinct hashes, and the count of the most frequent one."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    if not len(key):
        return np.zeros(n), np.zeros(n)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[first, len(key)])
    of = (key[first] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, of, count)
    return np.bincount(of, minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, offsets = buffers(texts)
    n = len(offsets) - 1
    size = np.diff(offsets)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(table[data])]
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1)

    starts, ends, first = spans(data, offsets, NON_SPACE)
    words = np.diff(first)
    doc = np.repeat(np.arange(n), words)
    h = span_hashes(LOWER[data], starts, ends)
    length = ends - starts
    per_word = np.maximum(words, 1)

    def mean(x: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=x, minlength=n) / per_word

    kinds = [np.r_[0, np.cumsum(t[data])] for t in (_UPPER, _LOW, _MARKS)]
    up, low, mark = (k[ends] - k[starts] for k in kinds)
    distinct, most = _distinct(doc, h, n)
    repeated = []
    for k in (2, 5):
        g = gram_hashes(h, k)
        inside = first[doc[: len(g)] + 1] >= np.arange(len(g)) + k
        m = np.bincount(doc[: len(g)][inside], minlength=n)
        repeated.append(1 - _distinct(doc[: len(g)][inside], g[inside], n)[0] / np.maximum(m, 1))
        repeated[-1][m == 0] = 0
    l_starts, l_ends, l_first = spans(data, offsets, _LINE)
    lines = np.diff(l_first)
    l_doc = np.repeat(np.arange(n), lines)
    l_distinct, _ = _distinct(l_doc, span_hashes(data, l_starts, l_ends), n)
    columns = [
        np.log1p(size), np.log1p(words), mean(length), share(_UPPER), share(_DIGIT), share(_SPACE), share(_WIDE), share(_SYMBOL), share(_MARKS), share(_ENDS),
        share(np.arange(256) == 44), words / np.maximum(lines, 1), np.log1p(lines), 1 - l_distinct / np.maximum(lines, 1) * (lines > 0), distinct / per_word, most / per_word,
        *repeated, mean(_UPPER[data[starts]] if len(starts) else starts), mean((up >= 2) & (low == 0)), mean(mark > 0), mean(length > 12), mean(length <= 2), distinct / np.sqrt(per_word),
        np.bincount(l_doc, weights=(l_ends - l_starts) <= 2, minlength=n) / np.maximum(lines, 1),
    ]
    return np.column_stack([np.asarray(c, np.float64) for c in columns]).astype(np.float32) if n else np.zeros((0, len(FEATURES)), np.float32)


@dataclass
class Forest:
    """Complete binary trees of one depth as arrays: node i has children 2i + 1 and 2i + 2, the last level holds values."""

    depth: int
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - len(f)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0, least: float = 5.0) -> Forest:
    """Gradient boosting of log loss on binned features: per level one histogram of gradients by (node, bin) a feature."""
    n, m = x.shape
    mean = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    inner, leaves = (1 << depth) - 1, 1 << depth
    forest = Forest(depth, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)), float(np.log(mean / (1 - mean))))
    if n < 2 or y.min() == y.max():
        return forest
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
    binned = [np.searchsorted(edges[j], x[:, j], "left") for j in range(m)]
    raw, fs, ts, vs = np.full(n, forest.base), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            k = 1 << level
            best = np.full(k, 1e-6)
            choice = np.full((k, 2), -1)
            for j in range(m):
                b = len(edges[j]) + 1
                if b < 2:
                    continue
                at = node * b + binned[j]
                gs = np.bincount(at, g, k * b).reshape(k, b).cumsum(1)
                hs = np.bincount(at, h, k * b).reshape(k, b).cumsum(1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least / 4) | (ht - hl < least / 4)] = -1
                c = gain.argmax(1)
                better = gain[np.arange(k), c] > best
                best[better] = gain[np.arange(k), c][better]
                choice[better] = np.column_stack([np.full(k, j), c])[better]
            right = np.zeros(n, bool)
            for q in range(k):
                j, c = choice[q]
                if j >= 0:
                    feature[k - 1 + q], threshold[k - 1 + q] = j, edges[j][c]
                    mine = node == q
                    right[mine] = binned[j][mine] > c
            node = 2 * node + right
        value = -rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + l2)
        raw += value[node]
        fs.append(feature), ts.append(threshold), vs.append(value)
    return Forest(depth, np.array(fs), np.array(ts), np.array(vs), forest.base)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", fit_rows: int = FIT_ROWS) -> Forest:
    """A forest from the documents that `labels` (id, label) covers: a sample by hash of about `fit_rows` labels at the most, which is
    the bound of what is broadcast and gathered. Null ids and labels are left out; one class alone gives a constant score."""
    ship(docs.sparkSession)
    known = labels.filter(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(label_column).cast("double").alias("y"))
    share = min(1.0, fit_rows / max(1, known.count()))
    picked = known.filter(F.pmod(F.xxhash64(F.col("id"), F.lit("fit")), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(F.broadcast(picked), "id").select("text", "y", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 0):
                x = statistics(piece.column(0))
                yield pa.RecordBatch.from_arrays([piece.column(2), piece.column(1), pa.array(list(x), pa.list_(pa.float32()))], names=["id", "y", "x"])

    kind = picked.schema["id"].dataType.simpleString()
    found = sorted((r["id"], r["y"], r["x"]) for r in rows.mapInArrow(run, f"id {kind}, y double, x array<float>").collect())
    x = np.array([r[2] for r in found], np.float32).reshape(len(found), len(FEATURES))
    return boost(x, np.array([r[1] for r in found]))


def score(docs: DataFrame, forest: Forest, text_column: str = "text", out: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with a struct column `out`: score, the probability (0 to 1) of label 1.

    Statistics are of whole texts; a null text counts as empty and gets the score of an empty text. Repeated rows each give a row;
    a column of `docs` named `out` gets the new one underscores.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def make() -> Callable[[pa.Array], pa.Array]:
        forest = shared.value
        return lambda texts: pa.StructArray.from_arrays([pa.array(forest.score(statistics(texts)), pa.float64())], names=["score"])

    return map_text(docs, text_column, scratch.free_name(docs, out), RESULT, make, keep)

"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, trained with FTRL-proximal."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import sampling, scratch
from tidemark.llm.textops import map_text, pieces
from tidemark.ship import ship

#: Hash buckets of n-grams, as a power of two.
BUCKET_BITS = 16
#: Lengths of character n-grams.
NGRAMS = (1, 2, 3)
#: The classifier is fitted on a sample of at most about so many labelled texts, and so many bytes of text.
FIT_ROWS, FIT_BYTES = 4_000, 16 << 20
#: TF-IDF values are multiplied by this, which puts them near 1.
SCALE = 30.0
RESULT = "lang_pred string, score double"
UNKNOWN = "und"


class _Fold:
    """Code point -> lower-cased letter, or a space for anything else; spaces that follow a space are dropped by the caller."""

    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            t = np.full(0x10000, 32, np.uint32)
            for i in range(0x10000):
                c = chr(i)
                if c.isalpha():
                    low = c.lower()
                    t[i] = ord(low) if len(low) == 1 else i
            cls.table = t
        return cls.table


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts, each between two spaces, runs of other characters as one space; and the n + 1 offsets."""
    lengths = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    raw = np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le", "replace"), np.uint32) if texts else np.zeros(0, np.uint32)
    table = _Fold.get()
    c = table[np.minimum(raw, 0xFFFF)]
    for i in np.flatnonzero(raw > 0xFFFF).tolist():
        x = chr(int(raw[i]))
        c[i] = ord(x.lower()[0]) if x.isalpha() else 32
    ends = np.cumsum(lengths)
    keep = c != 32
    keep[1:] |= c[:-1] != 32
    keep[ends - lengths] = True
    return c[keep], np.r_[0, np.cumsum(keep)[ends - 1]].astype(np.int64)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: buckets of all n-grams with a letter, and offsets of the texts in them."""
    c, offsets = _letters(texts)
    c = c.astype(np.uint32)
    letter = c != 32
    doc_end = np.repeat(offsets[1:], np.diff(offsets))
    with np.errstate(over="ignore"):
        for n in NGRAMS:
            m = len(c) - n + 1
            if m <= 0:
                yield np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
                continue
            h = np.full(m, 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
            some = np.zeros(m, bool)
            for k in range(n):
                h = (h ^ c[k : k + m]) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(15)
                some |= letter[k : k + m]
            ok = some & (np.arange(m) + n <= doc_end[:m])
            total = np.r_[0, np.cumsum(ok)]
            yield ((h[ok] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), total[np.minimum(offsets, m)]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of rows of `values` between offsets; empty ranges give 0."""
    out = np.zeros((len(offsets) - 1, values.shape[1]))
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out


def document_frequencies(docs: DataFrame, text_column: str) -> tuple[np.ndarray, int]:
    """In how many texts each bucket stands, and how many texts there are; over all rows of `docs`."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BUCKET_BITS, np.int64), 0
        for batch in batches:
            for piece in pieces(batch, 0):
                texts = [t or "" for t in piece.column(0).to_pylist()]
                found = list(grams(texts))
                for i in range(len(texts)):
                    has = np.zeros(1 << BUCKET_BITS, bool)
                    for b, at in found:
                        has[b[at[i] : at[i + 1]]] = True
                    df += has
                n += len(texts)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, df[at]])], names=["bucket", "n"])

    df, n = np.zeros(1 << BUCKET_BITS, np.int64), 0
    for bucket, count in docs.select(text_column).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        if bucket < 0:
            n = count
        else:
            df[bucket] = count
    return df, n


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # bucket x label, inverse document frequency and scale included
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by label, and the number of n-grams, of each text."""
        total, count = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        for b, at in grams(texts):
            total += _sums(self.weights[b], at)
            count += np.diff(at)
        return total / np.maximum(count, 1)[:, None] + self.bias, count

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        z, count = self.logits(texts)
        p = _softmax(z / self.temperature)
        best = p.argmax(1) if len(self.labels) else np.zeros(len(texts), int)
        some = (count > 0) & (len(self.labels) > 0)
        return [self.labels[k] if s else UNKNOWN for k, s in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, p.max(1, initial=0.0), 0.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True)) if z.size else z
    return e / e.sum(1, keepdims=True) if z.size else z


def fit(texts: list[str], langs: list[str], idf: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 3) -> Model:
    """FTRL-proximal with elastic-net penalties on four fifths of the sample; the temperature that suits the last fifth best."""
    labels = sorted(set(langs))
    k = len(labels)
    y = np.array([labels.index(x) for x in langs], np.int64)
    buckets, values, lengths = [], [], []
    for start in range(0, len(texts), 64):
        part = texts[start : start + 64]
        found = list(grams(part))
        each = [np.unique(np.concatenate([x[at[i] : at[i + 1]] for x, at in found]), return_counts=True) for i in range(len(part))]
        buckets.append(np.concatenate([b for b, _ in each]).astype(np.uint16))
        values.append(np.concatenate([n / max(n.sum(), 1) * idf[b] * SCALE for b, n in each]).astype(np.float32))
        lengths += [len(b) for b, _ in each]
    flat_b, flat_x = (np.concatenate(x) if x else np.zeros(0) for x in (buckets, values))
    first = np.r_[0, np.cumsum(lengths)].astype(np.int64)
    del buckets, values

    def row(i: int) -> tuple[np.ndarray, np.ndarray]:
        return flat_b[first[i] : first[i + 1]].astype(np.int64), flat_x[first[i] : first[i + 1]].astype(np.float64)

    held = np.arange(len(texts)) % 5 == 4
    size = 1 << BUCKET_BITS
    z, g2 = np.zeros((size + 1, k)), np.zeros((size + 1, k))

    def weights(b: np.ndarray) -> np.ndarray:
        zb = z[b]
        w = -(zb - np.sign(zb) * l1) / ((beta + np.sqrt(g2[b])) / alpha + l2)
        w[np.abs(zb) <= l1] = 0
        return w

    order = np.flatnonzero(~held) if (~held).any() else np.arange(len(texts))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(order):
            b, x = row(i)
            b, x = np.r_[b, size], np.r_[x, 1.0]
            w = weights(b)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p
            new = g2[b] + g * g
            z[b] += g - (np.sqrt(new) - np.sqrt(g2[b])) / alpha * w
            g2[b] = new
    w = weights(np.arange(size + 1))
    model = Model(labels, (w[:size] * (idf * SCALE)[:, None]).astype(np.float32), w[size], 1.0)
    if held.any():
        s = np.array([x @ w[b] + w[size] for b, x in map(row, np.flatnonzero(held).tolist())])
        model.temperature = _temperature(s, y[held])
    return model


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """Golden-section search for the logarithm of the temperature of least log loss.

    As in Platt's targets, the right label counts as (n + 1) / (n + 2) and the rest is spread over the others, so a sample without
    a mistake does not drive the probabilities to 0 and 1.
    """
    n, k = z.shape
    right = (n + 1) / (n + 2)
    goal = np.full((n, k), (1 - right) / max(k - 1, 1))
    goal[np.arange(n), y] = right

    def loss(t: float) -> float:
        return float(-(goal * np.log(np.maximum(_softmax(z / np.exp(t)), 1e-12))).sum())

    lo, hi, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", id_column: str = "doc_id", fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Model:
    """A model from all rows of `docs` with a language: document frequencies over all, weights from a sample bounded by the parameters.

    The sample (`sampling.per_label`) has a text of every language at least, however rare or long its texts. Null texts count as
    empty. Without any language the model has no labels and calls every text unknown; with one, every text with a letter is that.
    """
    known = docs.filter(F.col(lang_column).isNotNull()).select(id_column, F.coalesce(F.col(text_column), F.lit("")).alias(text_column), lang_column)
    df, n = document_frequencies(known, text_column)
    idf = np.log((1 + n) / (1 + df)) + 1
    rows = sorted(tuple(r) for r in sampling.per_label(known, id_column, text_column, lang_column, fit_rows, fit_bytes).collect()) if n else []
    order = np.random.default_rng(3).permutation(len(rows)).tolist()
    return fit([rows[i][0] for i in order], [rows[i][1] for i in order], idf)


def has_letter(text_column: str = "text") -> Column:
    """Whether a text has a letter, by the rule of the model."""

    @F.pandas_udf("boolean")
    def some(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bool(t) and any(map(str.isalpha, t))).astype(bool)

    return some(F.col(text_column))


def identify(docs: DataFrame, model: Model, text_column: str = "text", out: str = "language", keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with a struct column `out`: lang_pred, score (the calibrated probability, 0 to 1).

    Whole texts are read, in steps of bounded size. Null texts and texts without a letter are `und` with score 0, as is every text
    if the model knows no language. Repeated rows each give a row; a column of `docs` named `out` gets the new one underscores.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[pa.Array], pa.Array]:
        model = shared.value

        def work(texts: pa.Array) -> pa.Array:
            lang, score = model.predict([t or "" for t in texts.to_pylist()])
            return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

        return work

    return map_text(docs, text_column, scratch.free_name(docs, out), RESULT, make, keep)

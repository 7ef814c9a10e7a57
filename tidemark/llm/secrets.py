"""Secret scans: fixed patterns, and a linear-chain conditional random field that tags tokens as begin, inside or outside of a secret."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import scratch
from tidemark.llm.textops import LOWER, buffers, map_text, pieces, span_hashes, spans
from tidemark.ship import ship

#: The field is fitted on a sample of at most about so many documents (and bytes of text), half of them with pattern matches.
FIT_ROWS, FIT_BYTES = 1_200, 6 << 20
#: Training sequences with a tag at the most.
FIT_SEQUENCES = 1_500
#: Tokens of a training sequence, and of a block that Viterbi steps through side by side with others.
SEQUENCE, VITERBI_BLOCK = 32, 128
RESULT = "base array<struct<kind:string,start:bigint,end:bigint>>, added array<struct<kind:string,start:bigint,end:bigint>>"
B, I, O = 0, 1, 2  # noqa: E741

# The patterns, their order, and the words that stand before secrets.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
CONTEXT = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api", b"key", b"access", b"auth", b"bearer", b"credential", b"private", b"pwd")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True
_CLASS = np.full(256, 2, np.uint8)  # 0 space, 1 word, 2 mark
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_WORD, _MARK, _TOKEN = _CLASS == 1, _CLASS == 2, _CLASS > 0
_IS = {k: np.zeros(256, bool) for k in ("upper", "lower", "digit", "wide")}
_IS["upper"][65:91] = _IS["lower"][97:123] = _IS["digit"][48:58] = _IS["wide"][128:] = True


def _find_all(raw: bytes, needle: bytes) -> Iterator[int]:
    at = raw.find(needle)
    while at >= 0:
        yield at
        at = raw.find(needle, at + 1)


def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, kind, start, end, start of the secret itself), in bytes of the whole buffer, of all pattern matches."""
    raw, low = data.tobytes(), LOWER[data].tobytes()
    found = []
    for kind, needles, source in ((0, KEYWORDS, low), (1, (b"AKIA",), raw)):
        at = np.array([x for k in needles for x in _find_all(source, k)], np.int64)
        for d in np.unique(np.searchsorted(offsets, at, "right") - 1).tolist():
            lo, hi = int(offsets[d]), int(offsets[d + 1])
            for m in (ASSIGN if kind == 0 else ACCESS).finditer(raw[lo:hi]):
                secret = m.span(2) if kind == 0 else m.span()
                if secret[1] - secret[0] >= (LEAST_ASSIGN if kind == 0 else LEAST_ACCESS):
                    found.append((d, kind, lo + m.start(), lo + m.end(), lo + secret[0]))
    starts, ends, _ = spans(data, offsets, _HEX)
    long = ends - starts >= LEAST_HEX
    for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        found.append((int(np.searchsorted(offsets, a, "right")) - 1, 2, a, b, a))
    return sorted(found, key=lambda x: (x[2], x[1]))


@dataclass
class Tokens:
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # per text, index of its first token; n + 1
    features: np.ndarray  # token x feature template, values are columns of the weight table


#: How many values each feature template has: shape and length, turns between digits and letters, turns of case, distance of a word as in
#: CONTEXT, marks before, next shape, file's digits, file's length, and of all that stands without a space around: turns and length.
SIZES = (128, 12, 12, 5, 8, 128, 6, 6, 80)
SHIFT = np.r_[0, np.cumsum(SIZES)]


def tokenize(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Runs of word characters and runs of marks, with their features."""
    n = len(offsets) - 1
    kinds = [spans(data, offsets, t)[:2] for t in (_WORD, _MARK)]
    starts, ends = (np.concatenate([k[i] for k in kinds]) for i in (0, 1))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(n), np.diff(first))
    t = len(starts)
    if not t:
        return Tokens(starts, ends, first, np.zeros((0, len(SIZES)), np.int64))
    length = ends - starts
    word = _WORD[data[starts]]
    has = {}
    for k, table in _IS.items():
        total = np.r_[0, np.cumsum(table[data])]
        has[k] = total[ends] - total[starts]
    bucket = np.searchsorted([2, 5, 9, 16, 24, 33, 48], length, "right")
    shape = ((has["upper"] > 0) + 2 * (has["lower"] > 0) + 4 * (has["digit"] > 0) + 8 * (has["wide"] > 0)) * 8 + bucket

    def turns_of(table: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        change = np.zeros(len(data), bool)
        change[1:] = table[data[1:]] != table[data[:-1]]
        total = np.r_[0, np.cumsum(change)]
        return total[ends] - total[np.minimum(starts + 1, ends)]

    turns, case_turns = (np.minimum(turns_of(_IS[k], starts, ends), 22) // 2 for k in ("digit", "upper"))
    run_starts, run_ends, _ = spans(data, offsets, _TOKEN)
    run_turns = [np.searchsorted([1, 3, 6], turns_of(_IS[k], run_starts, run_ends), "right") for k in ("digit", "upper")]
    run = (run_turns[0] * 4 + run_turns[1]) * 5 + np.searchsorted([8, 16, 24, 40], run_ends - run_starts, "right")
    run = run[np.searchsorted(run_starts, starts, "right") - 1]
    context = np.isin(span_hashes(LOWER[data], starts, ends), _context()) & word
    since = np.arange(t) - np.maximum.accumulate(np.where(context, np.arange(t), -10))
    new_doc = np.zeros(t, bool)
    new_doc[first[:-1][first[:-1] < t]] = True
    since = np.minimum(since, np.arange(t) - np.maximum.accumulate(np.where(new_doc, np.arange(t), 0)) + 9)
    before = np.where((since >= 1) & (since <= 4), since, 0)
    mark = np.zeros(t, np.int64)
    last = data[ends[:-1] - 1]
    mark[1:] = np.where(word[:-1], 1, np.select([last == 61, last == 58, (last == 34) | (last == 39), (last == 47) | (last == 45) | (last == 95) | (last == 46)], [2, 3, 4, 5], 6))
    mark[new_doc] = 0
    after = np.r_[shape[1:], 0]
    after[np.flatnonzero(new_doc[1:])] = 0
    per = np.maximum(np.bincount(doc, minlength=n), 1)
    digits = np.searchsorted([0.001, 0.01, 0.05, 0.15, 0.4], np.bincount(doc, weights=has["digit"] > 0, minlength=n) / per, "right")
    size = np.searchsorted([8, 64, 512, 4096, 32768], per, "right")
    columns = (np.where(word, shape, bucket), turns, case_turns, before, mark, after, digits[doc], size[doc], run)
    return Tokens(starts, ends, first, np.column_stack([np.minimum(c, s - 1) + o for c, s, o in zip(columns, SIZES, SHIFT[:-1], strict=True)]))


def _context() -> np.ndarray:
    body = np.frombuffer(b"".join(CONTEXT), np.uint8)
    ends = np.cumsum([len(w) for w in CONTEXT])
    return span_hashes(body, np.r_[0, ends[:-1]], ends)


def _max3(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    return np.maximum(np.maximum(x, y), z)


@dataclass
class Field:
    """Weights by (feature value, tag), transitions by (tag, next tag), and scores of the first tag."""

    weights: np.ndarray
    step: np.ndarray
    start: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        w = self.weights.astype(np.float32)
        out = w[features[:, 0]]
        for c in range(1, features.shape[1]):
            out += w[features[:, c]]
        return out

    def decode(self, t: Tokens) -> np.ndarray:
        """The best tag of every token, exactly, each text a chain of its own.

        Max-plus products of the transition matrices within blocks are made for all blocks at once; best scores then run from block
        to block, and a second sweep with back pointers recovers the path.
        """
        n = len(t.starts)
        if not n:
            return np.zeros(0, np.int64)
        blocks = -(-n // VITERBI_BLOCK)
        e = np.zeros((blocks * VITERBI_BLOCK, 3), np.float32)
        e[:n] = self.scores(t.features)
        begins = np.zeros(len(e), bool)
        begins[t.first[:-1][t.first[:-1] < n]] = True
        begins[n:] = True
        e = np.ascontiguousarray(e.reshape(blocks, VITERBI_BLOCK, 3).transpose(1, 0, 2))
        begins = begins.reshape(blocks, VITERBI_BLOCK).T
        step, start = self.step.astype(np.float32), self.start.astype(np.float32)

        def edge(k: int) -> np.ndarray:
            m = step + e[k][:, None, :]
            fresh = np.flatnonzero(begins[k])
            if len(fresh):
                m[fresh] = (start + e[k][fresh])[:, None, :]
            return m

        through = edge(0)
        for k in range(1, VITERBI_BLOCK):
            m = edge(k)
            through = _max3(*(through[:, :, q, None] + m[:, None, q, :] for q in range(3)))
        enter = np.zeros((blocks, 3), np.float32)
        for b in range(1, blocks):
            x = (enter[b - 1][:, None] + through[b - 1]).max(0)
            enter[b] = x - x.max()
        back = np.zeros((VITERBI_BLOCK, blocks, 3), np.int8)
        at = enter
        for k in range(VITERBI_BLOCK):
            m = edge(k)
            x, y, z = (at[:, q, None] + m[:, q, :] for q in range(3))
            at = _max3(x, y, z)
            back[k] = np.where(x == at, 0, np.where(y == at, 1, 2))
        # Backwards, first what each block would do for each tag it may end with, then from the last block to the first.
        from_end = np.broadcast_to(np.arange(3), (blocks, 3)).copy()
        paths = np.zeros((VITERBI_BLOCK, blocks, 3), np.int8)
        for k in range(VITERBI_BLOCK - 1, -1, -1):
            paths[k] = from_end
            from_end = np.take_along_axis(back[k].astype(np.int64), from_end, 1)
        tags = np.zeros((blocks, VITERBI_BLOCK), np.int64)
        tag = int(at[-1].argmax())
        for b in range(blocks - 1, -1, -1):
            tags[b] = paths[:, b, tag]
            tag = int(from_end[b, tag])
        return tags.ravel()[:n]


def _tags(t: Tokens, found: list[tuple[int, int, int, int, int]]) -> np.ndarray:
    """Begin and inside for word tokens of the matched secrets, outside for the rest."""
    y = np.full(len(t.starts), O)
    for _, _, _, end, start in sorted(found, key=lambda x: x[4], reverse=True):
        a, b = np.searchsorted(t.ends, start, "right"), np.searchsorted(t.starts, end, "left")
        y[a:b] = I
        y[a : a + 1] = B
    return y


def _sequences(t: Tokens, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a, b in zip(t.first[:-1].tolist(), t.first[1:].tolist(), strict=True):
        for k in range(a, b, SEQUENCE):
            yield t.features[k : min(b, k + SEQUENCE)].astype(np.int16), y[k : min(b, k + SEQUENCE)].astype(np.int8)


#: Kinds of secrets that are planted, by alphabet and lengths; the last kind is short and stands after a word as in CONTEXT only.
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
PLANTED = (
    (_LOWER + _UPPER + _DIGITS, 20, 64),
    (_LOWER + _UPPER + _DIGITS + "+/", 24, 64),
    (_LOWER + _UPPER + _DIGITS + "-_", 24, 64),
    (_UPPER + _DIGITS, 16, 40),
    (_LOWER + _DIGITS, 20, 48),
    (_DIGITS + "abcdef", 24, 64),
    (_LOWER + _UPPER + _DIGITS, 8, 14),
)
#: Runs of words that are planted in, and the least and most words of each: files of all lengths, few of them long.
PLANTED_TEXTS, PLANTED_WORDS = 800, (10, 5_000)


def _plain_token(rng: np.random.Generator, words: list[str]) -> str:
    """What looks unusual and is no secret: numbers, addresses, dates, names of files and of things in programs."""

    def digits(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def word() -> str:
        return words[int(rng.integers(len(words)))]

    kinds = (
        lambda: digits(int(rng.integers(5, 21))),
        lambda: ".".join(str(x) for x in rng.integers(0, 256, 4)),
        lambda: f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}",
        lambda: f"{digits(4)}-{digits(2)}-{digits(2)}T{digits(2)}:{digits(2)}:{digits(2)}Z",
        lambda: f"{word()}.{digits(2)}@{word()}{digits(1)}.example.com",
        lambda: f"https://{word()}.example.org/{word()}/{word()}-{digits(3)}?{word()}={digits(2)}",
        lambda: word().capitalize() + word().capitalize() + word().capitalize(),
        lambda: f"{word()}_{word()}_{word()}",
        lambda: f"{word()}{word()}{word()}".upper(),
        lambda: f"{word()}/{word()}/{word()}{digits(2)}.txt",
        lambda: f"v{digits(1)}.{digits(2)}.{digits(2)}",
        lambda: f"{word()}{word()}{word()}{word()}{word()}",
    )
    return kinds[int(rng.integers(len(kinds)))]()


def planted(texts: list[str], known: list[str], rng: np.random.Generator, runs: range) -> tuple[list[str], list[tuple[int, int, int, int, int]]]:
    """Runs of words of `texts`, repeated where a text has too few, with secrets planted in three of four, and their spans as `base_spans` gives them.

    A secret is one of `known` (what the patterns matched) or is made by PLANTED; it stands alone, in quotes, or a few words after a
    context word, so neither the patterns' words nor their values decide the tags. Every run gets tokens that are no secrets.
    """
    out: list[str] = []
    found: list[tuple[int, int, int, int, int]] = []
    at = 0
    pool = [w for t in texts[:200] for w in t[:4000].split() if w.isalpha() and w.isascii()][:20_000] or ["word", "other"]
    for i, k in enumerate(runs):
        words = texts[k % len(texts)].split()
        n = int(np.exp(rng.uniform(*np.log(PLANTED_WORDS))))
        words = (words * min(n, -(-n // max(len(words), 1))))[: max(n, 1)] if len(words) < n else words
        begin = int(rng.integers(max(1, len(words) - n + 1)))
        words = [w.encode() for w in words[begin : begin + n] if len(w) < 200]
        for _ in range(int(rng.integers(1, 4))):
            words.insert(int(rng.integers(len(words) + 1)), _plain_token(rng, pool).encode())
        place = int(rng.integers(len(words) + 1))
        before, after, secret = b"", b"", b""
        if k % 4:
            kind = int(rng.integers(len(PLANTED) + (1 if known else 0)))
            if kind < len(PLANTED):
                alphabet, least, most = PLANTED[kind]
                secret = "".join(alphabet[i] for i in rng.integers(0, len(alphabet), int(rng.integers(least, most + 1)))).encode()
            else:
                secret = known[int(rng.integers(len(known)))].encode()
            secret = secret if any(48 <= c < 58 for c in secret) else secret + b"7"
            if kind == len(PLANTED) - 1 or rng.random() < 0.4:
                before = CONTEXT[int(rng.integers(len(CONTEXT)))] + (b" ", b" is ", b": ", b"=", b" = ")[int(rng.integers(5))]
            if rng.random() < 0.3:
                before, after = before + b'"', b'"'
            after += (b"", b"", b",", b".")[int(rng.integers(4))]
        left, right = b" ".join(words[:place]), b" ".join(words[place:])
        head = left + b" " + before
        text = (head + secret + after + b" " + right).decode(errors="replace")
        if secret:
            found.append((i, 3, at + len(head), at + len(head) + len(secret), at + len(head)))
        at += len(text.encode())
        out.append(text)
    return out, found


def fit(texts: list[str], rounds: int = 160, rate: float = 0.5, l2: float = 1e-4) -> Field | None:
    """Maximum likelihood by forward-backward and Adam. None without texts.

    Tags are the pattern matches in `texts` and the secrets planted in runs of their words (`planted`), so that shape and neighbours
    tell a secret where no pattern does. Of the sequences with a tag every n-th is taken, FIT_SEQUENCES at the most, and of those
    without as many and 200 more.
    """
    if not texts:
        return None
    rng = np.random.default_rng(11)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    known: list[str] = []
    for start in range(0, len(texts), 64):
        data, offsets = buffers(pa.array(texts[start : start + 64], pa.large_string()))
        t, found = tokenize(data, offsets), base_spans(data, offsets)
        if len(known) < 1000:
            known += [data[a:b].tobytes().decode() for _, _, _, b, a in found[:64] if b - a < 200]
        rows.extend(_sequences(t, _tags(t, found)))
    for start in range(0, PLANTED_TEXTS, 64):
        made, found = planted(texts, known, rng, range(start, min(start + 64, PLANTED_TEXTS)))
        data, offsets = buffers(pa.array(made, pa.large_string()))
        t = tokenize(data, offsets)
        rows.extend(_sequences(t, _tags(t, found + base_spans(data, offsets))))  # the words may hold matches of their own
    marked = [r for r in rows if (r[1] != O).any()]
    marked = marked[:: -(-len(marked) // FIT_SEQUENCES)] if marked else marked
    plain = [r for r in rows if not (r[1] != O).any()]
    rows = marked + plain[:: max(1, len(plain) // (len(marked) + 200))]
    n = len(rows);
    f = np.zeros((n, SEQUENCE, len(SIZES)), np.int64)
    y = np.full((n, SEQUENCE), O)
    mask = np.zeros((n, SEQUENCE), bool)
    for i, (a, b) in enumerate(rows):
        f[i, : len(a)], y[i, : len(b)], mask[i, : len(b)] = a, b, True
    size = int(SHIFT[-1])
    one = np.eye(3)
    seen = np.flatnonzero(mask.ravel())
    flat, each = np.unique(f.reshape(-1, len(SIZES))[seen], axis=0, return_inverse=True)
    each = each.ravel()
    both = mask[:, 1:]
    real = np.einsum("nip,niq,ni->pq", one[y[:, :-1]], one[y[:, 1:]], both.astype(float))
    # Transitions begin with the shares they have, so that the features need to learn no more than what they tell.
    begins = one[y[:, 0]].sum(0)
    params = [np.zeros((size, 3)), np.log((real + 0.1) / (real + 0.1).sum(1, keepdims=True)), np.log((begins + 0.1) / (begins + 0.1).sum())]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, rounds + 1):
        w, tr, st = params
        e = np.zeros((n * SEQUENCE, 3))
        e[seen] = sum(w[flat[:, c]] for c in range(len(SIZES)))[each]
        e = e.reshape(n, SEQUENCE, 3)
        top = e.max(2, keepdims=True)
        x, step = np.exp(e - top), np.exp(tr)
        # Forward and backward values are scaled to sum to one at each token, so they stay probabilities.
        a, b = np.zeros((n, SEQUENCE, 3)), np.ones((n, SEQUENCE, 3)) / 3
        a[:, 0] = np.exp(st - st.max()) * x[:, 0]
        a[:, 0] /= a[:, 0].sum(1, keepdims=True)
        for i in range(1, SEQUENCE):
            q = (a[:, i - 1] @ step) * x[:, i]
            a[:, i] = np.where(mask[:, i, None], q / q.sum(1, keepdims=True), a[:, i - 1])
        for i in range(SEQUENCE - 2, -1, -1):
            q = (x[:, i + 1] * b[:, i + 1]) @ step.T
            b[:, i] = np.where(mask[:, i + 1, None], q / q.sum(1, keepdims=True), b[:, i + 1])
        post = a * b
        post /= post.sum(2, keepdims=True)
        diff = (post - one[y]) * mask[:, :, None]
        part = diff.reshape(-1, 3)[seen]
        gw = np.zeros((size, 3))
        for s in range(3):
            own = np.bincount(each, part[:, s], len(flat))
            for c in range(len(SIZES)):
                gw[:, s] += np.bincount(flat[:, c], own, size)
        pair = a[:, :-1, :, None] * step * (x[:, 1:] * b[:, 1:])[:, :, None, :]
        pair *= (both / pair.sum((2, 3)))[:, :, None, None]
        grads = [gw / n + l2 * w, (pair.sum((0, 1)) - real) / n + l2 * tr, diff[:, 0].sum(0) / n + l2 * st]
        for p, g, mm, vv in zip(params, grads, m, v, strict=True):
            mm += 0.1 * (g - mm)
            vv += 0.01 * (g * g - vv)
            p -= rate / (1 + k / 100) * (mm / (1 - 0.9**k)) / (np.sqrt(vv / (1 - 0.99**k)) + 1e-9)
    return Field(*params)


def train(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Field | None:
    """A field from a sample by hash of id and text: about `fit_rows` documents and `fit_bytes` bytes at the most, half of each from
    documents with a match of a pattern; equal texts count once. One scan counts both kinds, a second one takes the sample. Texts of
    more than a sixteenth of `fit_bytes` are not taken. Null where the sample is empty: no texts, or only null, empty or such long ones."""
    ship(docs.sparkSession)
    hashed = F.pmod(F.xxhash64(F.col(id_column), F.col(text_column), F.lit("sample")), F.lit(1 << 30))
    size = F.octet_length(text_column)
    some = docs.filter((size > 0) & (size <= fit_bytes // 16)).select(F.col(text_column).alias("text"), hashed.alias("h"))

    def has_match(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = buffers(piece.column(0))
        has = np.zeros(piece.num_rows, bool)
        has[[x[0] for x in base_spans(data, offsets)]] = True
        return has, np.diff(offsets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2), np.int64)
        for batch in batches:
            for piece in pieces(batch, 0):
                has, size = has_match(piece)
                for k in range(2):
                    total[k] += (int((has == k).sum()), int(size[has == k].sum()))
        yield pa.RecordBatch.from_arrays([pa.array([False, True]), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["has", "n", "size"])

    share = {False: 0, True: 0}
    for has, n, size in some.mapInArrow(count, "has boolean, n long, size long").groupBy("has").agg(F.sum("n"), F.sum("size")).collect():
        share[has] = int(min(1.0, fit_rows / 2 / max(n, 1), fit_bytes / 2 / max(size, 1)) * (1 << 30))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 0):
                has, _ = has_match(piece)
                keep = np.flatnonzero(np.asarray(piece.column(1)) < np.where(has, share[True], share[False]))
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(keep))], names=["text"])

    rows = some.filter(F.col("h") < max(share.values())).mapInArrow(take, "text string")
    texts = sorted(r[0] for r in rows.distinct().collect())
    order = np.random.default_rng(5).permutation(len(texts)).tolist()
    return fit([texts[i] for i in order])


def _scan(field: Field | None, texts: pa.Array) -> pa.Array:
    data, offsets = buffers(texts)
    base = base_spans(data, offsets)
    by_doc: dict[int, tuple[list, list]] = {}
    for d, kind, a, b, _ in base:
        by_doc.setdefault(d, ([], []))[0].append((KINDS[kind], a, b))
    if field is not None:
        t = tokenize(data, offsets)
        tags = field.decode(t)
        hit = np.flatnonzero(tags != O)
        if len(hit):
            doc = np.searchsorted(t.first, hit, "right") - 1
            opens = (tags[hit] == B) | np.r_[True, (np.diff(hit) > 1) | (np.diff(doc) > 0)]
            at = np.flatnonzero(opens)
            last = np.r_[at[1:], len(hit)] - 1
            starts, ends = t.starts[hit[at]], t.ends[hit[last]]
            known = np.searchsorted(np.array([x[2] for x in base], np.int64), ends)
            reach = np.maximum.accumulate(np.array([0, *(x[3] for x in base)], np.int64))[known]
            for d, a, b in zip(*(x[reach <= starts].tolist() for x in (doc[at], starts, ends)), strict=True):
                by_doc.setdefault(d, ([], []))[1].append((KINDS[3], a, b))
    rows = []
    for d in range(len(offsets) - 1):
        if d not in by_doc:
            rows.append({"base": [], "added": []})
            continue
        lo = int(offsets[d])
        chars = np.r_[0, np.cumsum((data[lo : offsets[d + 1]] & 0xC0) != 0x80)]
        rows.append({name: [{"kind": k, "start": int(chars[a - lo]), "end": int(chars[b - lo])} for k, a, b in found] for name, found in zip(("base", "added"), by_doc[d], strict=True)})
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    return pa.array(rows, pa.struct([("base", span), ("added", span)]))


def scan(docs: DataFrame, field: Field | None, text_column: str = "text", out: str = "secrets", keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with a struct column `out`: base and added, arrays of (kind, start, end) in code points.

    `base` has the matches of the three patterns by start, then kind as listed; `added` the secrets that the field tags outside of
    them. A span may hold several tokens. Null and empty texts have none; without a field (no match to learn from) nothing is
    added. Whole texts are read; repeated rows each give a row; a column of `docs` named `out` gets the new one underscores.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def make() -> Callable[[pa.Array], pa.Array]:
        field = shared.value
        return lambda texts: _scan(field, texts)

    return map_text(docs, text_column, scratch.free_name(docs, out), RESULT, make, keep)

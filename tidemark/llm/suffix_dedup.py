"""Suffix-array dedup: strings of a fixed length that an earlier document has too, found by a suffix sort that compares hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import blocks, scratch
from tidemark.llm.textops import BASE, BASE_INV, BYTE_VALUE, buffers, mix, pieces, powers, span_hashes
from tidemark.ship import ship

#: Bytes of the strings that count as repeated.
LENGTH = 50
#: Bytes of an anchor: every string of LENGTH bytes belongs to the anchor in it whose hash is least.
ANCHOR = 24


def content_hashes(texts: pa.Array, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """A key of each text (its low `bits`; never 0) and a second hash, from the SHA-256 of its bytes."""
    data, offsets = buffers(texts)
    view = memoryview(data)
    digests = b"".join(hashlib.sha256(view[a:b]).digest()[:16] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
    both = np.frombuffer(digests, "<u8").reshape(-1, 2)
    keys = (both[:, 0] & np.uint64((1 << bits) - 1)).view(np.int64)
    keys[keys == 0] = 1
    return keys, both[:, 1].view(np.int64)


class Prefix:
    """Polynomial prefix hashes of some bytes: the hash of any substring in constant time."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data
        self.total = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(BYTE_VALUE[data] * powers(BASE, len(data)), out=self.total[1:])
        self.back = powers(BASE_INV, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.total[end] - self.total[start]) * self.back[start]

    def grams(self, n: int) -> np.ndarray:
        """Hashes of all substrings of n bytes."""
        with np.errstate(over="ignore"):
            out = self.total[n:] - self.total[:-n]
            out *= self.back[: len(out)]
        return out

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length of the common extension of the suffixes at a and b, `most` at the most, by binary search on hashes."""
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), most)
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self.of(a, a + mid) == self.of(b, b + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, a: np.ndarray, b: np.ndarray, equal: np.ndarray, most: int) -> np.ndarray:
        """Whether the first `most` bytes at a are smaller than those at b, where `equal` says that they are the same."""
        out = np.zeros(len(a), bool)
        rest = np.flatnonzero(~equal)
        x, y = a[rest], b[rest]
        n = np.minimum(self.common(x, y, most), most - 1)
        out[rest] = self.data[x + n] < self.data[y + n]
        return out


def suffix_sort(prefix: Prefix, start: np.ndarray, segment: np.ndarray, length: int) -> np.ndarray:
    """Order of the suffixes at `start`, by their first `length` bytes, inside each segment (`segment` ascends).

    A bottom-up mergesort of all segments at once: in each round the place of a suffix in the merged run is its own place plus its
    rank in the sibling run, found by binary search with hash-compared suffixes.
    """
    n = len(start)
    order = np.arange(n)
    if not n:
        return order
    whole = prefix.of(start, start + length)
    first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    size = np.diff(np.r_[first, n])
    begin, end = np.repeat(first, size), np.repeat(first + size, size)
    width = 1
    while width < size.max():
        live = np.flatnonzero(end - begin > width)
        inside = live - begin[live]
        run = inside // width
        left = run % 2 == 0
        mine = begin[live] + run * width
        other = np.where(left, mine + width, mine - width)
        stop = np.minimum(other + width, end[live])
        has = other < end[live]
        lo, hi = np.where(has, other, 0), np.where(has, stop, 0)
        base = lo.copy()
        me = order[live]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            x, y = order[mid], me[open_]
            equal = whole[x] == whole[y]
            before = prefix.less(start[x], start[y], equal, length) | equal & ~left[open_]
            lo[open_[before]] = mid[before] + 1
            hi[open_[~before]] = mid[~before]
        place = np.where(left, mine, other) + (live - mine) + (lo - base)
        place = np.where(has, place, live)
        new = order.copy()
        new[place] = order[live]
        order = new
        width *= 2
    return order


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether `length` bytes at a and b are equal, byte by byte."""
    out = np.empty(len(a), bool)
    step = np.arange(length)
    for k in range(0, len(a), 1 << 16):
        x, y = a[k : k + (1 << 16), None] + step, b[k : k + (1 << 16), None] + step
        out[k : k + (1 << 16)] = (data[x] == data[y]).all(1)
    return out


def repeated_windows(data: np.ndarray, start: np.ndarray, segment: np.ndarray, ids: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each window (`length` bytes at `start`), whether an equal one in its segment has a smaller id."""
    prefix = Prefix(data)
    order = suffix_sort(prefix, start, segment, length)
    a, seg = start[order], segment[order]
    same = np.zeros(len(a), bool)
    if len(a) > 1:
        near = np.flatnonzero(seg[1:] == seg[:-1])
        equal = prefix.of(a[near], a[near] + length) == prefix.of(a[near + 1], a[near + 1] + length)
        near = near[equal]
        true = _same_bytes(data, a[near], a[near + 1], length)
        if not true.all():
            return _by_bytes(data, start, segment, ids, length)
        same[near + 1] = True
    first = np.flatnonzero(~same)
    out = np.zeros(len(a), bool)
    if len(first):
        least = np.minimum.reduceat(ids[order], first)
        out[order] = ids[order] > np.repeat(least, np.diff(np.r_[first, len(a)]))
    return out


def _by_bytes(data: np.ndarray, start: np.ndarray, segment: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """What `repeated_windows` returns, from the bytes themselves: taken when two different windows have equal hashes."""
    raw = data.tobytes()
    windows = [(s, raw[a : a + length]) for a, s in zip(start.tolist(), segment.tolist(), strict=True)]
    least: dict[tuple[int, bytes], int] = {}
    for w, d in zip(windows, ids.tolist(), strict=True):
        least[w] = min(d, least.get(w, d))
    return np.array([d > least[w] for w, d in zip(windows, ids.tolist(), strict=True)], bool)


def anchor_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, number of windows, anchor hash) of the maximal runs of windows with one anchor; windows by first byte.

    The least hash of a window is a small number, so it is mixed before it names a bucket.
    """
    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(np.uint64)
    h = Prefix(data).grams(ANCHOR)
    width = LENGTH - ANCHOR + 1
    padded = np.concatenate([h, np.full(-len(h) % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = doc[:n] == doc[LENGTH - 1 :]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:n] != doc[: n - 1])
    new &= inside
    first = np.flatnonzero(new)
    ends = np.flatnonzero(inside & np.r_[new[1:] | ~inside[1:], True]) + 1
    return doc[first], first, ends - first, mix(least[first])


def _anchors(table: pa.Table, layout: blocks.Layout) -> pa.Table:
    data, offsets = buffers(blocks.texts_of(table)[2])
    doc, _, _, anchor = anchor_runs(data, offsets)
    ids = layout.ident(anchor)
    order = np.lexsort((doc, ids))
    ids, doc = ids[order], doc[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (doc[1:] != doc[:-1])
    tokens, counts = np.unique(ids[new], return_counts=True)
    return blocks.token_rows(table.column("block")[0].as_py(), tokens, counts, layout)


#: Buckets of contexts are finer than those of anchors by this power of two.
FINER = 2
#: An anchor of more texts is cut up by the bytes around it, for windows whose anchor stands at one of so many neighbouring places in them.
HOT, PLACES = 2_048, 7
#: Windows that one suffix sort handles (more only where one anchor has more).
SORT_WINDOWS = 1 << 18


def _classes(data: np.ndarray, begin: np.ndarray, windows: np.ndarray, anchor: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of contexts by (anchor, content, id), for each place in it the context of smallest id with equal bytes, and whether that
    is itself. Hashes name the classes and bytes confirm them; a context whose bytes differ is a class of its own."""
    size = windows + LENGTH - 1
    content = span_hashes(data, begin, begin + size)
    order = np.lexsort((ids, content, windows, anchor))
    new = np.ones(len(order), bool)
    a, w, c = anchor[order], windows[order], content[order]
    new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1]) | (c[1:] != c[:-1])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    other = np.flatnonzero(head != order)
    for k in range(0, len(other), 1 << 12):
        rows, reps = order[other[k : k + (1 << 12)]], head[other[k : k + (1 << 12)]]
        n = size[rows]
        first = np.r_[0, np.cumsum(n)[:-1]]
        inner = np.arange(n.sum()) - np.repeat(first, n)
        wrong = data[np.repeat(begin[rows], n) + inner] != data[np.repeat(begin[reps], n) + inner]
        differ = np.add.reduceat(wrong, first) > 0
        head[other[k : k + (1 << 12)][differ]] = rows[differ]
    return order, head, head == order


def _ranges(block: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, bytes]]:
    by = np.argsort(block, kind="stable")
    return [(int(block[by[i]]), blocks.pack(*(x[by[i:j]].astype(np.int64) for x in (key, start, end)), compress=True)) for i, j in blocks.runs(block[by])]


def _cut_hot(data: np.ndarray, doc: np.ndarray, first: np.ndarray, windows: np.ndarray, anchor: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs (text, first window, windows, anchor), those of hot anchors cut by the place of the anchor in the window.

    Windows with the anchor at one of PLACES neighbouring places have LENGTH - PLACES + 1 bytes around it in common, whose hash takes
    the anchor's part. Equal windows have their anchor at one place, so they meet again; others of the anchor part.
    """
    if not hot.any():
        return doc, first, windows, anchor
    rows, reach = np.flatnonzero(hot), LENGTH - ANCHOR
    prefix = Prefix(data)
    size = windows[rows] + reach
    base = np.r_[0, np.cumsum(size)[:-1]]
    flat = np.arange(size.sum())
    owner = np.repeat(np.arange(len(rows)), size)
    at = first[rows][owner] + flat - base[owner]
    its = mix(prefix.of(at, at + ANCHOR)) == anchor[rows][owner]
    following = np.minimum.accumulate(np.where(its, flat, len(flat))[::-1])[::-1]
    is_start = flat - base[owner] < windows[rows][owner]
    start, place, run = at[is_start], (following - flat)[is_start], owner[is_start]
    group = place // PLACES
    middle = start + place - group * PLACES
    new = np.r_[True, (run[1:] != run[:-1]) | (middle[1:] != middle[:-1]) | (group[1:] != group[:-1])]
    head = np.flatnonzero(new)
    n = np.diff(np.r_[head, len(start)])
    name = mix(prefix.of(middle[head], middle[head] + LENGTH - PLACES + 1) + group[head].astype(np.uint64))
    cold = ~hot
    return (
        np.r_[doc[cold], doc[rows[run[head]]]],
        np.r_[first[cold], start[head]],
        np.r_[windows[cold], n],
        np.r_[anchor[cold], name],
    )


def _contexts(left: pa.Table, right: pa.Table, layout: blocks.Layout) -> pa.Table:
    """The bytes around each anchor that several texts have, with the text's key and id, by bucket.

    Of equal contexts in the block the one of smallest id goes out. The others repeat it as a whole, which the block says itself, in
    a row of the negative bucket -1 - block that comes back as it is.
    """
    known, counts = blocks.replies(right, layout)
    keys, ids, texts = blocks.texts_of(left)
    data, offsets = buffers(texts)
    doc, first, windows, anchor = anchor_runs(data, offsets)
    texts_with = blocks.lookup(layout.ident(anchor), known, counts)
    hit = np.flatnonzero(texts_with > 1)
    doc, first, windows, anchor = _cut_hot(data, doc[hit], first[hit], windows[hit], anchor[hit], texts_with[hit] > HOT)
    order, head, is_head = _classes(data, first, windows, anchor, ids[doc])
    again = order[~is_head & (ids[doc[order]] > ids[doc[head]])]
    goes = np.ones(len(doc), bool)
    goes[again] = False
    rows: list[tuple[int, bytes]] = []
    if len(again):
        start = first[again] - offsets[doc[again]]
        home = left.column("block")[0].as_py()
        rows += [(-1 - home, x) for _, x in _ranges(np.zeros(len(again), np.int64), keys[doc[again]], start, start + windows[again] + LENGTH - 1)]
    x_all = order[goes[order]]
    bucket = (anchor[x_all] >> np.uint64(64 - layout.bits - FINER)).astype(np.int64)
    for a, b in blocks.runs(bucket):
        x = x_all[a:b]
        size = windows[x] + LENGTH - 1
        index = np.repeat(first[x] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        rows.append((int(bucket[a]), blocks.pack(anchor[x], keys[doc[x]], ids[doc[x]], first[x] - offsets[doc[x]], windows[x], data[index], compress=True)))
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "payload": pa.array([r[1] for r in rows], pa.binary())})


def _window_rows(anchor: np.ndarray, windows: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """`rows` (in order of anchor) in parts of about SORT_WINDOWS windows that split no anchor."""
    total = np.cumsum(windows[rows])
    cuts = np.flatnonzero(np.r_[anchor[rows[1:]] != anchor[rows[:-1]], True]) + 1 if len(rows) else np.zeros(0, np.int64)
    at, used = 0, 0
    for cut in cuts.tolist():
        if total[cut - 1] - used >= SORT_WINDOWS or cut == len(rows):
            yield rows[at:cut]
            at, used = cut, total[cut - 1]


def _distinct(data: np.ndarray, start: np.ndarray, whole: np.ndarray, ids: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Of the windows `pick` those that stand for all equal ones of one id, and the others beside theirs: texts that repeat themselves
    have the same window many times over. Hashes name equals and bytes confirm them."""
    order = pick[np.lexsort((ids[pick], whole[pick]))]
    if not len(order):
        return pick, (pick, pick)
    new = np.r_[True, (whole[order[1:]] != whole[order[:-1]]) | (ids[order[1:]] != ids[order[:-1]])]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    other = np.flatnonzero(~new)
    new[other[~_same_bytes(data, start[order[other]], start[head[other]], LENGTH)]] = True
    return np.sort(order[new]), (order[~new], head[~new])


def _again(data: np.ndarray, begin: np.ndarray, windows: np.ndarray, anchor: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last): runs of windows of `rows` that a row of smaller id has too.

    Windows whose hash no other window has are equal to none and stay out of the sort. Windows of one anchor are equal only if it
    stands at the same place in them, so (anchor, place) are the sort's segments.
    """
    size = windows[rows] + LENGTH - 1
    at = np.r_[0, np.cumsum(size)[:-1]]
    local = data[np.repeat(begin[rows] - at, size) + np.arange(size.sum())]
    n = windows[rows]
    owner = np.repeat(np.arange(len(rows)), n)
    step = np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
    start = at[owner] + step
    prefix = Prefix(local)
    whole = prefix.of(start, start + LENGTH)
    ranked = np.sort(whole)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    pick = np.flatnonzero(np.isin(whole, twice)) if len(twice) else np.zeros(0, np.int64)
    pick, like = _distinct(local, start, whole, ids[rows][owner], pick)
    its = mix(prefix.grams(ANCHOR)) == np.repeat(anchor[rows], size)[: len(local) - ANCHOR + 1]
    grams = np.arange(len(its))
    following = np.minimum.accumulate(np.where(its, grams, len(local))[::-1])[::-1]
    place = following[start[pick]] - start[pick]
    place[place > LENGTH - ANCHOR] = 0  # runs of hot anchors go by the hash of other bytes
    group = np.cumsum(np.r_[False, anchor[rows[1:]] != anchor[rows[:-1]]])[owner[pick]]
    order = np.lexsort((place, group))
    g, p = group[order], place[order]
    segment = np.cumsum(np.r_[False, (g[1:] != g[:-1]) | (p[1:] != p[:-1])]) if len(g) else g
    repeated = np.zeros(len(start), bool)
    repeated[pick[order]] = repeated_windows(local, start[pick[order]], segment, ids[rows][owner[pick[order]]])
    repeated[like[0]] = repeated[like[1]]
    hit = np.flatnonzero(repeated)
    if not len(hit):
        return hit, hit, hit
    opens = np.r_[True, (np.diff(hit) > 1) | (owner[hit[1:]] != owner[hit[:-1]])]
    lo, hi = hit[opens], hit[np.r_[np.flatnonzero(opens)[1:] - 1, len(hit) - 1]]
    return rows[owner[lo]], step[lo], step[hi]


def _repeats(table: pa.Table, layout: blocks.Layout) -> pa.Table:
    """(block, payload): for each text with windows that a text of a smaller id has, its key and those windows' byte ranges.

    Equal contexts are one class, whose smallest id decides for the others; the contexts that are left are compared window by
    window where their anchor has different ones.
    """
    bucket = table.column("bucket")[0].as_py()
    if bucket < 0:
        return pa.table({"block": pa.array([-1 - bucket] * table.num_rows, pa.int64()), "payload": table.column("payload").combine_chunks()})
    parts = [blocks.unpack(x.as_py()) for x in table.column("payload")]
    anchor, keys, ids, place, windows, data = (np.concatenate([p[i] for p in parts]) for i in range(6))
    del parts
    size = windows + LENGTH - 1
    begin = np.r_[0, np.cumsum(size)[:-1]]
    order, head, is_head = _classes(data, begin, windows, anchor, ids)
    whole = order[~is_head & (ids[order] > ids[head])]
    out = [(keys[whole], place[whole], place[whole] + size[whole])]
    left = np.ones(len(order), bool)
    left[whole] = False
    a = anchor[order]
    group = np.cumsum(np.r_[False, a[1:] != a[:-1]]) if len(a) else a
    several = np.bincount(group, weights=is_head)[group] > 1 if len(a) else left
    for rows in _window_rows(anchor, windows, order[left[order] & several]):
        row, lo, hi = _again(data, begin, windows, anchor, ids, rows)
        out.append((keys[row], place[row] + lo, place[row] + hi + LENGTH))
    key, start, end = (np.concatenate([o[i] for o in out]) for i in range(3))
    block = (mix(key.astype(np.int64).view(np.uint64)) % np.uint64(layout.blocks)).astype(np.int64)
    rows = _ranges(block, key, start, end)
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "payload": pa.array([r[1] for r in rows], pa.binary())})


_RESULT = "key long, least long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary"


def _finish(left: pa.Table, right: pa.Table) -> pa.Table:
    keys, ids, texts = blocks.texts_of(left)
    data, offsets = buffers(texts)
    position = {k: i for i, k in enumerate(keys.tolist())}
    change = np.zeros(len(data) + len(keys) + 1, np.int64)  # one place more a text, so that ranges may end with it
    for row in right.column("payload"):
        key, start, end = blocks.unpack(row.as_py())
        doc = np.array([position[k] for k in key.tolist()], np.int64)
        np.add.at(change, offsets[doc] + doc + start, 1)
        np.add.at(change, offsets[doc] + doc + end, -1)
    gone = np.cumsum(change) > 0
    raw, rows = data.tobytes(), []
    for i, (key, least, a, b) in enumerate(zip(keys.tolist(), ids.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        g = gone[a + i : b + i]
        edge = np.flatnonzero(np.diff(np.r_[0, g.astype(np.int8), 0]))
        kept = data[a:b][~g].tobytes() if len(edge) else raw[a:b]
        rows.append((key, least, b - a, int(g.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), edge.astype(np.int64).tobytes()))
    kinds = (pa.int64(),) * 5 + (pa.string(), pa.binary())
    return pa.table([pa.array(list(c), t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 7, kinds, strict=True)], names=[x.split()[0] for x in _RESULT.split(", ")])


def _narrow(docs: DataFrame, id_column: str, text_column: str, key_bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                size = np.diff(buffers(piece.column(1))[1])
                keys, checks = content_hashes(piece.column(1), key_bits)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(keys), pa.array(checks), pa.array(size)], names=["id", "key", "check", "bytes"])

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(run, "id long, key long, check long, bytes long")


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", key_bits: int = 64) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans), a row for each row of `docs`: the bytes covered by a string of LENGTH
    bytes that also starts in a row of a smaller id. `spans` holds the removed ranges, as 64-bit numbers start, end, start, end, ...

    Texts are UTF-8 bytes; null counts as empty. Ids are integers; null counts as larger than every id, and rows of one id remove
    nothing from each other. Copies of a text travel as one with the smallest id; a copy of a larger id is removed as a whole (if it
    has LENGTH bytes). Nothing is capped; columns other than the two are not read.

    Texts are named by 64 bits of a hash (`key_bits`), and by 64 others where different texts share a name.

    1. Texts are dealt out in blocks. In each window of LENGTH bytes the anchor of least hash stands for the window, and anchors in
    one text alone are sorted out. 2. The windows of the others meet by anchor; there the suffix sort finds equal ones; windows of
    an anchor that very many texts have meet by more of their bytes. 3. Back in
    the blocks, ranges are united.
    """
    ship(docs.sparkSession)
    narrow = scratch.table(_narrow(docs, id_column, text_column, key_bits), "contents")
    total = narrow.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    layout = blocks.Layout(total)
    bad = blocks.collisions(narrow)
    narrow = narrow.withColumn("key", blocks.apart_column(bad)).drop("check")
    dealt = blocks.deal(docs, id_column, text_column, lambda texts: blocks.apart(*content_hashes(texts, key_bits), bad), layout).groupBy("block")
    anchors = dealt.applyInArrow(lambda t: _anchors(t, layout), "bucket long, payload binary")
    shared = blocks.shared_tokens(anchors, layout)
    contexts = dealt.cogroup(shared.groupBy("block")).applyInArrow(lambda a, b: _contexts(a, b, layout), "bucket long, payload binary")
    repeats = contexts.groupBy("bucket").applyInArrow(lambda t: _repeats(t, layout), "block long, payload binary")
    found = scratch.table(dealt.cogroup(repeats.groupBy("block")).applyInArrow(_finish, _RESULT), "removed")
    found = found.withColumnRenamed("key", "k")
    copy = (F.coalesce("id", F.lit((1 << 63) - 1)) > F.col("least")) & (F.col("n_bytes") >= LENGTH)
    all_of_it = F.concat(F.unhex(F.lit("00" * 8)), F.unhex(F.concat_ws("", *(F.lpad(F.hex(F.shiftright("n_bytes", s).bitwiseAND(255)), 2, "0") for s in range(0, 64, 8)))))
    return narrow.join(found, F.col("key") == F.col("k"), "left").select(
        "id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(copy, all_of_it).otherwise(F.col("spans")).alias("spans"),
    )

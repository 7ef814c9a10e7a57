"""N-gram Jaccard join: exact links between documents whose word-shingle sets are alike, and the components they make."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import blocks, scratch
from tidemark.llm.components import connected_components
from tidemark.llm.textops import LOWER, NON_SPACE, buffers, gram_hashes, mix, pieces, span_hashes, spans
from tidemark.ship import ship

#: Words of a shingle.
SHINGLE = 5
#: Two sets link when PER * intersection >= LINK * union.
LINK, PER = 75, 100
#: Sets of one tile at the most.
TILE = 4096
#: Sets of a group, and of its visitors, that one comparison between groups takes.
PART, VISITORS = 256, 4096
#: Tiles that each set takes part in before the join on prefix tokens.
ROUNDS = 2
#: Bits of a signature.
SIGNATURE_BITS = 1024


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has one, of them all; none without words."""
    data, offsets = buffers(texts)
    low = LOWER[data]
    starts, ends, first = spans(low, offsets, NON_SPACE)
    h = span_hashes(low, starts, ends)
    grams = gram_hashes(h, SHINGLE)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        g = grams[a : b - SHINGLE + 1] if b - a >= SHINGLE else gram_hashes(h[a:b], b - a) if b > a else grams[:0]
        g = np.sort(g)
        out.append(g[np.r_[True, g[1:] != g[:-1]]] if len(g) else g)
    return out


def set_hashes(sets: list[np.ndarray], bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """A key of each set (its low `bits`; never 0, and 0 for the empty one) and a second hash."""
    with np.errstate(over="ignore"):
        keys, checks = (np.array([mix(s + np.uint64(k)).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64) for k in (0x1F83D9ABFB41BD6B, 0xCBBB9D5DC1059ED8))
    keys &= np.uint64((1 << bits) - 1)
    keys[(keys == 0) & np.array([len(s) > 0 for s in sets], bool)] = 1
    return keys.view(np.int64), checks.view(np.int64)


def _narrow(docs: DataFrame, id_column: str, text_column: str, key_bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                sets = shingle_sets(piece.column(1))
                size = np.diff(buffers(piece.column(1))[1])
                keys, checks = set_hashes(sets, key_bits)
                columns = [piece.column(0), piece.column(2), pa.array(keys), pa.array(checks), pa.array([len(s) for s in sets], pa.int64()), pa.array(size)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "uid", "key", "check", "n", "bytes"])

    df = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.monotonically_increasing_id().alias("uid"))
    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, uid long, key long, check long, n long, bytes long")


def least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """The overlap that a set of size n needs with any set it links with."""
    return -(-n * LINK // PER)


def candidates(docs: DataFrame, id_column: str, text_column: str, layout: blocks.Layout, bad: frozenset[int] = frozenset(), key_bits: int = 64) -> DataFrame:
    """(key, n, tokens, prefix, tiles) of the distinct sets that can link with another one.

    In the order of (number of sets that have it, hash), the first n - least_overlap(n) + 1 tokens of two sets that link meet. A
    token of one set alone meets nothing, so a set with that many of them leaves; of the others, the tokens that several sets have
    are enough to count overlaps. `prefix` has the rest of those first tokens, `tiles` the least tokens by ROUNDS other hashes.
    """
    dealt = blocks.deal(docs, id_column, text_column, lambda texts: blocks.apart(*set_hashes(shingle_sets(texts), key_bits), bad), layout)

    def count(table: pa.Table) -> pa.Table:
        sets = shingle_sets(blocks.texts_of(table)[2])
        tokens, counts = np.unique(layout.ident(np.concatenate([np.zeros(0, np.uint64), *sets])), return_counts=True)
        return blocks.token_rows(table.column("block")[0].as_py(), tokens, counts, layout)

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        known, counts = blocks.replies(right, layout)
        keys, _, texts = blocks.texts_of(left)
        rows: list[tuple] = []
        for key, s in zip(keys.tolist(), shingle_sets(texts), strict=True):
            n = len(s)
            ids = layout.ident(s)
            df = blocks.lookup(ids, known, counts)
            keep = df > 1
            ids, df = ids[keep], df[keep]
            spare = n - least_overlap(n) + 1 - (n - len(ids))
            if n and spare > 0:
                order = np.lexsort((ids, df))[:spare]
                tiles = {int(mix(ids ^ np.uint64(0x5BE0CD19137E2179 + i)).min().view(np.int64)) for i in range(ROUNDS)}
                rows.append((key, n, np.sort(ids).tobytes(), ids[order].tobytes(), sorted(tiles)))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.table({c: pa.array(list(v), t) for c, v, t in zip(("key", "n", "tokens", "prefix", "tiles"), cols, kinds, strict=True)})

    shared = blocks.shared_tokens(dealt.groupBy("block").applyInArrow(count, "bucket long, payload binary"), layout)
    return dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(choose, "key long, n long, tokens binary, prefix binary, tiles array<long>")


class Tile:
    """Sets with their signatures, in order of size."""

    def __init__(self, keys: list[int], sizes: list[int], tokens: list[bytes]) -> None:
        order = np.argsort(np.array(sizes), kind="stable")
        self.keys = [keys[i] for i in order]
        self.n = np.array(sizes, np.int64)[order]
        self.tokens = [np.frombuffer(tokens[i], np.uint64) for i in order]
        self.shared = np.array([len(t) for t in self.tokens], np.int64)
        self.bits = np.stack([signature(t) for t in self.tokens]) if keys else np.zeros((0, SIGNATURE_BITS // 64), np.uint64)

    def band(self, n: int) -> tuple[int, int]:
        """Sets whose size allows a link with a set of size n."""
        return int(np.searchsorted(self.n, -(-n * LINK // PER))), int(np.searchsorted(self.n, n * PER // LINK, "right"))

    def linked(self, n: int, tokens: np.ndarray, bits: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Which of the sets `among` link with the given one.

        Every bit in which two signatures differ stands for a token of one set alone, so the overlap is at most half of both token
        numbers less the differing bits. Sets that this leaves are intersected as sorted arrays.
        """
        need = -(-(n + self.n[among]) * LINK // (PER + LINK))
        apart = np.bitwise_count(self.bits[among] ^ bits).sum(1, dtype=np.int64)
        keep = (len(tokens) + self.shared[among] - apart) // 2 >= need
        among, need = among[keep], need[keep]
        if not len(among):
            return among
        parts = [self.tokens[i] for i in among.tolist()]
        flat = np.concatenate(parts)
        at = np.searchsorted(tokens, flat)
        at[at == len(tokens)] = 0
        hits = np.r_[0, np.cumsum(tokens[at] == flat)]
        ends = np.cumsum([len(p) for p in parts])
        return among[hits[ends] - hits[np.r_[0, ends[:-1]]] >= need]

    def components(self) -> list[int]:
        """For each set, the index of the first set of its component: each found set is compared with those not yet found."""
        label = np.full(len(self.keys), -1)
        for seed in range(len(self.keys)):
            if label[seed] >= 0:
                continue
            label[seed], queue = seed, [seed]
            while queue:
                i = queue.pop()
                lo, hi = self.band(int(self.n[i]))
                free = lo + np.flatnonzero(label[lo:hi] < 0)
                if len(free):
                    new = self.linked(int(self.n[i]), self.tokens[i], self.bits[i], free)
                    label[new] = seed
                    queue.extend(new.tolist())
        return label.tolist()


def signature(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(SIGNATURE_BITS, np.uint8)
    bits[(mix(tokens) & np.uint64(SIGNATURE_BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def first_groups(found: DataFrame) -> DataFrame:
    """`found` with `comp`: the smallest key of the sets it is connected with by links inside tiles.

    A tile has the sets with one value among `tiles`, TILE of them at a time. Tiles are dealt out by ranges of (tile, key), so one
    with very many sets spreads over tasks. Most links are found here; what this misses, `later_links` finds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            tile = Tile([r[0] for r in held], [r[1] for r in held], [r[2] for r in held])
            held.clear()
            links = [(tile.keys[c], k) for k, c in zip(tile.keys, tile.components(), strict=True) if tile.keys[c] != k]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in range(2)], names=["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in zip(*(batch.slice(at, 256).column(c).to_pylist() for c in ("key", "n", "tokens", "tile")), strict=True):
                    if held and (row[3] != held[-1][3] or len(held) >= TILE):
                        if len(held) > 1:
                            yield done()
                        held.clear()
                    held.append(row)
        if len(held) > 1:
            yield done()

    tiles = found.select("key", "n", "tokens", F.explode("tiles").alias("tile"))
    links = tiles.repartitionByRange("tile", "key").sortWithinPartitions("tile", "key").mapInArrow(run, "a long, b long")
    roots = connected_components(links)
    return found.join(roots, F.col("key") == F.col("node"), "left").select("key", "n", "tokens", "prefix", F.coalesce("root", "key").alias("comp"))


def later_links(found: DataFrame) -> DataFrame:
    """(a, b): pairs of `comp` with a link between them.

    Sets of two groups that link meet in a prefix token. For each such token the sets of every group visit the smaller-numbered
    groups where sizes and positions allow a link: from their first common token on, both sets must hold the overlap that their
    sizes ask for. A visit compares one set with the sets of a group, PART of them at a time and beside VISITORS others, and one link
    is enough.
    """
    spark = found.sparkSession

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                tokens = [np.frombuffer(x, np.int64) for x in part.column(4).to_pylist()]
                lengths = [len(t) for t in tokens]
                if sum(lengths):
                    cols = [np.repeat(np.asarray(part.column(c)), lengths) for c in range(4)]
                    place = np.arange(sum(lengths)) - np.repeat(np.r_[0, np.cumsum(lengths)[:-1]], lengths)
                    cols[3] = cols[3] - place  # tokens that several sets have, from this one on: all that can be common
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.concatenate(tokens), *cols)], names=["token", "key", "comp", "n", "reach"])

    shared = (F.octet_length("tokens") / 8).cast("long")
    entries = found.select("key", "comp", "n", shared.alias("shared"), "prefix").mapInArrow(prefix, "token long, key long, comp long, n long, reach long")
    mixed = entries.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    met = scratch.table(entries.join(mixed, "token"), "met")
    band = F.floor(F.log("n") / F.log(F.lit(PER / LINK)))
    groups = met.groupBy("token", F.col("comp").alias("home"), band.alias("band")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("reach").alias("far"))
    allowed = F.expr(f"home < comp and hi * {PER} >= n * {LINK} and lo * {LINK} <= n * {PER} and least(reach, far) * {PER + LINK} >= (n + lo) * {LINK}")
    visits = scratch.table(met.join(groups, "token").filter(allowed).select("key", "comp", "home").distinct(), "visits")
    sizes = found.groupBy("comp").agg(F.count(F.lit(1)).alias("members"))
    coming = visits.groupBy("home").agg(F.count(F.lit(1)).alias("coming"))
    homes = coming.join(sizes, F.col("home") == F.col("comp")).select("home", F.ceil(F.col("members") / PART).alias("parts"), F.ceil(F.col("coming") / VISITORS).alias("turns"))
    homes = scratch.table(homes, "homes")
    # A group's sets and their visitors meet in cells (part, turn): each set in one part, each visitor in one turn.
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    members = found.join(homes, F.col("comp") == F.col("home")).select("home", F.pmod(F.xxhash64("key"), F.col("parts")).alias("part"), every("turns").alias("turn"), F.lit(None).cast("long").alias("comp"), "key", "n", "tokens")
    arriving = visits.join(homes, "home").join(found.select("key", "n", "tokens"), "key")
    arriving = arriving.select("home", every("parts").alias("part"), F.pmod(F.xxhash64("key"), F.col("turns")).alias("turn"), "comp", "key", "n", "tokens")

    def compare(table: pa.Table) -> pa.Table:
        home = table.column("home")[0].as_py()
        rows = list(zip(*(table.column(c).to_pylist() for c in ("comp", "key", "n", "tokens")), strict=True))
        tile = Tile(*map(list, zip(*[r[1:] for r in rows if r[0] is None], strict=True))) if any(r[0] is None for r in rows) else None
        joined: set[int] = set()
        for comp, _, n, raw in rows if tile else ():
            if comp is None or comp in joined:
                continue
            tokens = np.frombuffer(raw, np.uint64)
            lo, hi = tile.band(n)
            if len(tile.linked(n, tokens, signature(tokens), np.arange(lo, hi))):
                joined.add(comp)
        return pa.table({"a": pa.array([home] * len(joined), pa.int64()), "b": pa.array(sorted(joined), pa.int64())})

    both = members.unionByName(arriving)
    return scratch.table(both.groupBy("home", "part", "turn").applyInArrow(compare, "a long, b long"), "links")


def join_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", key_bits: int = 64) -> DataFrame:
    """(id, uid, n, component): a row for each row of `docs`, with the size of its set and the smallest id it is connected with.

    A set holds the distinct runs of SHINGLE words (`[^\\x20\\x09-\\x0D]+` after A-Z were lower-cased), or the one run of all words
    if they are fewer. Rows with equal sets are one class and travel as one; links between classes are exact: no candidate is
    dropped and none is sampled. Rows without words, and null texts, have an empty set, size 0, and are their own component. Null
    ids never are a component's smallest id unless it has no other. Repeated rows each give a row; other columns are not read.
    Sets are named by 64 bits of a hash (`key_bits`), and by 64 others where different sets share a name.
    """
    return _components(docs, id_column, text_column, key_bits).drop("root")


def _components(docs: DataFrame, id_column: str, text_column: str, key_bits: int = 64) -> DataFrame:
    """`join_components` with root, the smallest key of the component's sets, which tells components apart where ids repeat; null without words."""
    ship(docs.sparkSession)
    narrow = scratch.table(_narrow(docs, id_column, text_column, key_bits), "sets")
    total = narrow.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    layout = blocks.Layout(total)
    bad = blocks.collisions(narrow)
    narrow = narrow.withColumn("key", blocks.apart_column(bad)).drop("check")
    found = scratch.table(candidates(docs, id_column, text_column, layout, bad, key_bits), "candidates")
    grouped = scratch.table(first_groups(found), "groups")
    merged = connected_components(later_links(grouped), "a", "b")
    final = grouped.select("key", "comp").join(merged, F.col("comp") == F.col("node"), "left").select("key", F.coalesce("root", "comp").alias("root"))
    classes = narrow.filter("n > 0").groupBy("key").agg(F.min("id").alias("least"))
    classes = scratch.table(classes, "classes")
    by_root = final.join(classes, "key").groupBy("root").agg(F.min("least").alias("component"))
    large = final.join(by_root, "root").select("key", "component", "root")
    of_key = scratch.table(classes.join(large, "key", "left").select(F.col("key").alias("k"), F.coalesce("component", "least").alias("component"), F.coalesce("root", "key").alias("root")), "components")
    return narrow.join(of_key, F.col("key") == F.col("k"), "left").select("id", "uid", "n", F.coalesce("component", "id").alias("component"), "root")


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs` with one document of each component: the one with the smallest id, of several the first; null ids come last.

    As in `exact_dedup.drop_copies`, `docs` must be a table that reads the same each time. Rows that share an id are told apart by
    their components; of rows without words one of each id stays, and all with a null id.
    """
    mark = scratch.free_name(docs, "row_uid")
    found = scratch.table(_components(docs, id_column, text_column), "near")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid"))["uid"].alias(mark)
    alone = found.filter("root is null and id is null").select(F.col("uid").alias(mark))
    wordless = found.filter("root is null and id is not null").groupBy("id").agg(first).select(mark)
    keep = found.filter("root is not null").groupBy("root").agg(first).select(mark).union(wordless).union(alone)
    return docs.withColumn(mark, F.monotonically_increasing_id()).join(keep, mark, "left_semi").drop(mark)

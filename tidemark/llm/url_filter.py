"""URL filters as a Bloom filter cascade: exact membership for every key of the corpus, without a join."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import scratch
from tidemark.llm.textops import map_text
from tidemark.ship import ship

#: Levels at the most; the false positives shrink by a constant factor from level to level.
MOST_LEVELS = 64
#: Keys of a level that may reach the driver, as a multiple of the listed keys; beyond it the first level is built with more bits.
MOST_FALSE = 4


RESULT = "host string, path string, rule string, verdict string"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


class Bloom:
    def __init__(self, keys: Iterable[str], level: int, bits_per_key: float) -> None:
        keys = list(keys)
        self.level, self.size = level, max(64, math.ceil(len(keys) * bits_per_key))
        self.probes = max(1, round(bits_per_key * math.log(2)))
        self.bits = np.zeros(self.size, bool)
        for k in keys:
            self.bits[self._at(k)] = True
        self.bits = np.packbits(self.bits)

    def _at(self, key: str) -> list[int]:
        d = hashlib.blake2b(key.encode(), digest_size=16, salt=self.level.to_bytes(2, "little")).digest()
        a, b = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little") | 1
        return [(a + i * b) % self.size for i in range(self.probes)]

    def __contains__(self, key: str) -> bool:
        return all(self.bits[i >> 3] >> (7 - (i & 7)) & 1 for i in self._at(key))


class Cascade:
    """Levels in turn hold the listed keys that the levels before let slip, and the unlisted keys that they wrongly hold."""

    def __init__(self) -> None:
        self.levels: list[Bloom] = []

    def __contains__(self, key: str) -> bool:
        for n, level in enumerate(self.levels):
            if key not in level:
                return n % 2 == 1
        return len(self.levels) % 2 == 1

    def passes(self, key: str) -> bool:
        """Whether every level so far holds `key`."""
        return all(key in level for level in self.levels)


def build(listed: Iterable[str], universe: int, wrongly_held: Callable[[Cascade], list[str] | None]) -> Cascade:
    """A cascade exact for the listed keys and every key that `wrongly_held` looks at.

    `wrongly_held` returns the unlisted keys of the universe that pass all levels, or None if they are more than it may return.
    Only the first level is tested against the whole universe; later ones hold subsets of what came back.
    """
    listed = sorted(set(listed))
    cascade = Cascade()
    if not listed:
        return cascade
    bits = max(2.0, math.log2(max(2.0, universe / len(listed))) / math.log(2))
    while True:
        cascade.levels = [Bloom(listed, 0, bits)]
        false = wrongly_held(cascade)
        if false is not None:
            break
        bits *= 1.5
    members = set(listed)
    false = sorted(set(false) - members)
    inside, outside = listed, false
    while outside:
        if len(cascade.levels) >= MOST_LEVELS:
            raise RuntimeError("the cascade does not converge")
        cascade.levels.append(Bloom(outside, len(cascade.levels), 2.0 / math.log(2)))
        inside, outside = outside, [k for k in inside if k in cascade.levels[-1]]
    return cascade


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): what stands after the first `://` up to `/`, `?`, `#` (A-Z lower-cased), and from there up to `?` or `#`."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end], rest[end:]
    cut = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:cut]


def keys_of(host: str, path: str, lengths: list[int]) -> Iterator[str]:
    """The keys of rules that could fit: the host or a parent domain, and a start of the path of one of the rules' lengths."""
    at = 0
    while True:
        for n in lengths:
            if n <= len(path):
                yield host[at:] + path[:n]
        at = host.find(".", at) + 1
        if not at:
            return


def judge(pages: DataFrame, rules: list[Rule], url_column: str = "url", out: str = "filter", default: str = "allow", keep: list[str] | None = None) -> DataFrame:
    """`pages` with a struct column `out`: host, path, rule, verdict.

    A rule fits its host and all subdomains of it where the path starts with the rule's; the longest rule (host and path together)
    wins, of equally long ones the first by code point. Without a rule the verdict is `default`.

    Two cascades hold the rules' keys: one all of them, one those that block. Their universe is every key of every url of `pages`
    (parent domains, path starts); one scan finds the keys that the first levels wrongly hold. As many rules as the list has, and a
    number of false keys bounded by it, reach the driver and are broadcast. Since the cascades are exact over the universe, a
    second scan asks them alone, longest key first.

    Null urls and urls without `://` have empty host and path, fit no rule, and get `default`. Repeated rows each give a row. If
    `pages` has a column named `out`, underscores are appended.
    """
    spark = pages.sparkSession
    ship(spark)
    out = scratch.free_name(pages, out)
    by_key: dict[str, Rule] = {}
    for r in sorted(rules, key=lambda r: (r.key, r.host)):
        by_key.setdefault(r.key, r)
    lengths = sorted({len(r.path) for r in rules}, reverse=True)
    limit = max(1024, MOST_FALSE * len(by_key))

    def wrongly_held(members: set[str]) -> Callable[[Cascade], list[str] | None]:
        def search(cascade: Cascade) -> list[str] | None:
            shared = spark.sparkContext.broadcast((cascade, members))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                cascade, members = shared.value
                found: set[str] = set()
                for batch in batches:
                    for url in set(batch.column(0).to_pylist()):
                        found.update(k for k in keys_of(*split_url(url), lengths) if k not in found and k not in members and cascade.passes(k))
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["key"])

            rows = pages.select(url_column).mapInArrow(run, "key string").distinct().limit(limit + 1).collect()
            return None if len(rows) > limit else [r[0] for r in rows]

        return search

    universe = max(1, pages.count()) * max(1, len(lengths)) * 3
    listed = build(by_key, universe, wrongly_held(set(by_key)))
    blocked_keys = {k for k, r in by_key.items() if r.verdict == "block"}
    blocked = build(blocked_keys, universe, wrongly_held(blocked_keys))
    shared = spark.sparkContext.broadcast((listed, blocked))

    def make() -> Callable[[pa.Array], pa.Array]:
        listed, blocked = shared.value
        known: dict[str, bool] = {}

        def work(urls: pa.Array) -> pa.Array:
            rows = []
            for url in urls.to_pylist():
                host, path = split_url(url)
                best = None
                for k in keys_of(host, path, lengths):
                    hit = known.get(k)
                    if hit is None:
                        hit = known[k] = k in listed
                        if len(known) > 100_000:
                            known.clear()
                    if hit and (best is None or (-len(k), k) < (-len(best), best)):
                        best = k
                rows.append({"host": host, "path": path, "rule": best, "verdict": default if best is None else "block" if best in blocked else "allow"})
            return pa.array(rows, pa.struct([("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())]))

        return work

    return map_text(pages, url_column, out, RESULT, make, keep)

"""A counting quotient filter over 64-bit fingerprints.

The high `q` bits of a fingerprint are its quotient and the rest its remainder. Quotients are kept as an `occupied` bitmap and
remainders as one array in order of (quotient, remainder), where a `runend` bit closes the run of each quotient; a counter of one
byte, or of eight in an overflow list, stands beside each remainder. Slots are packed without gaps, so a slot is found by rank in
the bitmaps. Nothing of a fingerprint is lost, so filters of any two `q` merge exactly.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np


class CountingQuotientFilter:
    def __init__(self, q: int, occupied: np.ndarray, runend: np.ndarray, remainders: np.ndarray, counters: np.ndarray, large: np.ndarray) -> None:
        self.q, self.occupied, self.runend, self.remainders, self.counters, self.large = q, occupied, runend, remainders, counters, large

    @classmethod
    def build(cls, fingerprints: np.ndarray) -> CountingQuotientFilter:
        keys, counts = np.unique(fingerprints.astype(np.uint64, copy=False), return_counts=True)
        return cls._packed(keys, counts.astype(np.uint64))

    @classmethod
    def _packed(cls, keys: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        """keys: sorted and distinct."""
        q = max(1, min(32, int(len(keys)).bit_length()))
        shift = np.uint64(64 - q)
        quotient = (keys >> shift).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        runend = np.ones(len(keys), bool)
        runend[:-1] = quotient[1:] != quotient[:-1]
        remainders = keys & ((np.uint64(1) << shift) - np.uint64(1))
        big = counts >= 255
        return cls(q, np.packbits(occupied), np.packbits(runend), remainders, np.where(big, 255, counts).astype(np.uint8), counts[big])

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct fingerprints and their counts."""
        n = len(self.remainders)
        quotients = np.flatnonzero(np.unpackbits(self.occupied, count=1 << self.q)).astype(np.uint64)
        ends = np.unpackbits(self.runend, count=n).astype(np.int64)
        run = np.cumsum(ends) - ends
        counts = self.counters.astype(np.uint64)
        counts[self.counters == 255] = self.large
        return (quotients[run] << np.uint64(64 - self.q)) | self.remainders, counts

    @classmethod
    def merge(cls, filters: Iterable[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Counters of equal fingerprints add up; the inputs are sorted runs, which the stable sort merges."""
        parts = [f.items() for f in filters]
        if not parts:
            return cls.build(np.zeros(0, np.uint64))
        keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(first)
        return cls._packed(keys[at], np.add.reduceat(counts, at) if len(at) else counts)

    def to_bytes(self) -> bytes:
        return struct.pack("<BQQ", self.q, len(self.remainders), len(self.large)) + b"".join(x.tobytes() for x in (self.occupied, self.runend, self.remainders, self.counters, self.large))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        q, n, large = struct.unpack_from("<BQQ", data)
        at, out = struct.calcsize("<BQQ"), []
        for count, kind in (((1 << q) + 7 >> 3, np.uint8), (n + 7 >> 3, np.uint8), (n, np.uint64), (n, np.uint8), (large, np.uint64)):
            out.append(np.frombuffer(data, kind, count, at))
            at += out[-1].nbytes
        return cls(q, *out)

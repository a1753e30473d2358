"""A wavelet matrix over token ids: bit planes with rank directories in one compressed byte string.

Plane p holds bit ``n_bits - 1 - p`` of the ids in the order that the planes
above leave: zeros first, ones after, both in their old order. Rank samples
every 512 bits make access, counting and occurrence look-up a few popcounts per
plane, without decoding the sequence.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import zstandard

MAGIC = b"WVM1"
SAMPLE = 512  # bits between two rank samples
STRETCH = 1 << 16  # ids moved at once, so that their places stay in the processor's cache


class WaveletMatrix:
    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.ranks, self.zeros = n, planes, ranks, zeros

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n_bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        kind = np.uint16 if n_bits <= 16 else np.uint32 if n_bits <= 32 else np.uint64
        now = ids.astype(kind)
        planes, ranks, zeros = [], [], []
        for bit in reversed(range(n_bits)):
            ones = (now >> kind(bit) & kind(1)).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            packed = np.concatenate((packed, np.zeros(-len(packed) % (SAMPLE // 8), np.uint8)))
            planes.append(packed)
            ranks.append(cls._samples(packed))
            zeros.append(len(ids) - int(ranks[-1][-1]))
            down = np.empty_like(now)
            for (a, b), rows, which in cls._stretches(ones, zeros[-1]):
                down[a:b] = now[rows][which]
            now = down
        return cls(len(ids), planes, ranks, zeros)

    @staticmethod
    def _stretches(ones: np.ndarray, zeros: int) -> Iterator[tuple[tuple[int, int], slice, np.ndarray]]:
        """Where the zeros, then the ones, of each stretch lie on the plane below, the stretch, and their places in it."""
        ends = [0, zeros]
        for low in range(0, len(ones), STRETCH):
            rows = slice(low, low + STRETCH)
            for kind, bits in enumerate((~ones[rows], ones[rows])):
                which = np.flatnonzero(bits)
                a, ends[kind] = ends[kind], ends[kind] + len(which)
                yield (a, ends[kind]), rows, which

    @staticmethod
    def _samples(packed: np.ndarray) -> np.ndarray:
        counts = np.bitwise_count(packed.view(np.uint64)).reshape(-1, SAMPLE // 64).sum(axis=1, dtype=np.uint32)
        return np.concatenate((np.zeros(1, np.uint32), np.cumsum(counts, dtype=np.uint32)))

    def to_bytes(self) -> bytes:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        out = [MAGIC, struct.pack("<QB", self.n, len(self.planes))]
        for packed, ranks in zip(self.planes, self.ranks):
            for part in (packed.tobytes(), np.diff(ranks).astype("<u2").tobytes()):
                held = squeeze(part)
                out += [struct.pack("<Q", len(held)), held]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, n_bits = struct.unpack_from("<QB", data, 4)
        at, planes, ranks, zeros = 13, [], [], []
        spread = zstandard.ZstdDecompressor().decompress

        def part() -> bytes:
            nonlocal at
            (size,) = struct.unpack_from("<Q", data, at)
            at += 8 + size
            return spread(data[at - size : at])

        for _ in range(n_bits):
            planes.append(np.frombuffer(part(), np.uint8))
            steps = np.frombuffer(part(), "<u2").astype(np.uint32)
            ranks.append(np.concatenate((np.zeros(1, np.uint32), np.cumsum(steps, dtype=np.uint32))))
            zeros.append(n - int(ranks[-1][-1]))
        return cls(n, planes, ranks, zeros)

    def _ones(self, p: int, i: int) -> int:
        """Ones among the first ``i`` bits of plane ``p``."""
        block, rest = divmod(i, SAMPLE)
        word = int.from_bytes(self.planes[p][block * SAMPLE // 8 : (i + 7) // 8].tobytes(), "little")
        return int(self.ranks[p][block]) + (word & ((1 << rest) - 1)).bit_count()

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p, packed in enumerate(self.planes):
            bit = int(packed[i >> 3]) >> (i & 7) & 1
            ones = self._ones(p, i)
            i = self.zeros[p] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        """Where the token's occurrences of [low, high) lie below the last plane."""
        if token < 0 or token >> len(self.planes):
            return 0, 0
        for p in range(len(self.planes)):
            a, b = self._ones(p, low), self._ones(p, high)
            if token >> (len(self.planes) - 1 - p) & 1:
                low, high = self.zeros[p] + a, self.zeros[p] + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of ``token`` in positions [low, high)."""
        low, high = self._range(token, low, self.n if high is None else high)
        return high - low

    def find(self, token: int, k: int) -> int:
        """Position of the ``k``-th occurrence of ``token``, from 0; -1 if there are fewer."""
        low, high = self._range(token, 0, self.n)
        if k >= high - low:
            return -1
        at = low + k
        for p in reversed(range(len(self.planes))):
            if token >> (len(self.planes) - 1 - p) & 1:
                want = at - self.zeros[p] + 1
                at = bisect_left(range(self.n + 1), want, key=lambda i, p=p: self._ones(p, i)) - 1
            else:
                at = bisect_left(range(self.n + 1), at + 1, key=lambda i, p=p: i - self._ones(p, i)) - 1
        return at

    def decode(self) -> np.ndarray:
        """All ids in order, from the lowest plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32 if len(self.planes) <= 32 else np.uint64
        now = np.zeros(self.n, kind)
        for p in reversed(range(len(self.planes))):
            ones = np.unpackbits(self.planes[p], count=self.n, bitorder="little").astype(bool)
            now[self.zeros[p] :] |= kind(1) << kind(len(self.planes) - 1 - p)
            up = np.empty_like(now)
            for (a, b), rows, which in self._stretches(ones, self.zeros[p]):
                up[rows][which] = now[a:b]
            now = up
        return now

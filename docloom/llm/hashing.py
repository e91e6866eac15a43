"""Rolling hashes of word runs, and Bloom filters of bounded size that tasks build and use."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(29))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


class Rolling:
    """Polynomial hashes modulo 2^64 of all runs of k tokens, by prefix sums."""

    def __init__(self, base: int):
        self.base = base | 1
        self.powers, self.inverse = self._table(base | 1, 1 << 12), self._table(pow(base | 1, -1, 1 << 64), 1 << 12)

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        return np.cumprod(np.concatenate([np.ones(1, U), np.full(n, U(base & _MASK), U)]))

    def prefix(self, tokens: np.ndarray) -> np.ndarray:
        if len(tokens) >= len(self.powers):
            self.powers, self.inverse = self._table(self.base, 2 * len(tokens)), self._table(pow(self.base, -1, 1 << 64), 2 * len(tokens))
        out = np.zeros(len(tokens) + 1, U)
        np.cumsum(tokens * self.powers[: len(tokens)], out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, k: int) -> np.ndarray:
        n = len(prefix) - k
        return mix((prefix[k:] - prefix[:-k]) * self.inverse[:n]) if n > 0 else np.zeros(0, U)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    if len(x) < width:
        return np.zeros(0, x.dtype)
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Bloom:
    """A Bloom filter in parts that tasks build apart. Past MOST_BITS a set of hashes is told apart into several filters."""

    MOST_BITS, PARTS, HASHES, BITS_A_KEY = 1 << 29, 256, 4, 16

    def __init__(self, bits: np.ndarray):
        self.bits, self.n = bits, U(len(bits) * 8)

    @staticmethod
    def places(h: np.ndarray, n: np.uint64) -> Iterator[np.ndarray]:
        """The part of a hash (its top eight bits) and the bits in it are taken from different mixes."""
        a, per = mix(h ^ U(0x5851F42D4C957F2D)), n // U(Bloom.PARTS)
        start = (a >> U(56)) * per
        for k in range(Bloom.HASHES):
            yield start + mix(a + U(k * 0x9E3779B97F4A7C15 & _MASK)) % per

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in self.places(h, self.n):
            out &= (self.bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 == 1
        return out

    @staticmethod
    def turn(h: np.ndarray, turns: int) -> np.ndarray:
        """Which of `turns` filters a hash belongs to."""
        return (mix(h ^ U(0xC6BC279692B5C323)) % U(turns)).astype(np.int64)

    @classmethod
    def of(cls, df: DataFrame, col: str) -> list[np.ndarray]:
        """Filters of a column of distinct 64-bit numbers, BITS_A_KEY bits each: one, or more where one would be too large.

        Hashes are dealt to the tasks by the part of the filter that they set, so each task makes its own part whole and
        sends it to the driver once: MOST_BITS in all for one filter.
        """
        n = df.count()
        turns = max(1, -(-n * cls.BITS_A_KEY // cls.MOST_BITS))
        size = 1 << 16
        while size < min(cls.MOST_BITS, cls.BITS_A_KEY * n // turns):
            size *= 2
        per = size // cls.PARTS

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = b.column("h").to_numpy(zero_copy_only=False).astype(np.int64).view(U)
                part = (mix(h ^ U(0x5851F42D4C957F2D)) >> U(56)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(cls.turn(h, turns)), pa.array(part)], names=["h", "turn", "part"])

        def build(turn: int):  # noqa: ANN202
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                parts: dict[int, np.ndarray] = {}
                for b in batches:
                    h, of = b.column("h").to_numpy(zero_copy_only=False).view(U), b.column("part").to_numpy(zero_copy_only=False)
                    for p in np.unique(of).tolist():
                        flags = parts.setdefault(p, np.zeros(per // 8, np.uint8))
                        for own in cls.places(h[of == p], U(size)):
                            own = own - U(p * per)
                            np.bitwise_or.at(flags, (own >> U(3)).astype(np.int64), np.left_shift(np.uint8(1), (own & U(7)).astype(np.uint8)))
                yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([v.tobytes() for v in parts.values()], pa.binary())], names=["part", "bits"])

            return run

        dealt = df.select(F.col(col).cast("bigint").alias("h")).mapInArrow(deal, "h bigint, turn bigint, part bigint")
        out = []
        for turn in range(turns):
            bits = np.zeros(size // 8, np.uint8)
            own = dealt.where(F.col("turn") == turn).repartition("part").mapInArrow(build(turn), "part bigint, bits binary")
            for r in own.collect():  # PARTS pieces, MOST_BITS in all at most
                bits[r["part"] * per // 8 : (r["part"] + 1) * per // 8] = np.frombuffer(r["bits"], np.uint8)
            out.append(bits)
        return out

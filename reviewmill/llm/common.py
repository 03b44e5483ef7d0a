"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import reviewmill

# Python workers may start in another folder, so functions travel by value.
cloudpickle.register_pickle_by_value(reviewmill)

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL twin where there is one."""

    def register(fn):
        REGISTRY[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(c: Column | str = "text") -> Column:
    """The text; a null one counts as empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to ``names`` that ``df`` does not use yet, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def hash40(*parts: Column) -> Column:
    """A number in [0, 2**40) from an MD5 digest of ``parts``, the same in any engine."""
    text = F.concat_ws("\x1f", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 10), 16, 10).cast("bigint")


# --- byte text in numpy ------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words of a byte text, without a Python object per word.

    A word's hash is a polynomial over random values of its bytes, read off one running sum
    over the whole text and scrambled. Powers are kept up to the longest text seen, at most
    ``LIMIT`` bytes; a longer text is hashed word by word from sub-sums of its pieces.
    """

    LIMIT = 1 << 22

    def __init__(self, seed: int = 20_011):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 2**63, 256, dtype=np.uint64)
        self.base = 0x9E3779B97F4A7C15
        self.inverse = pow(self.base, -1, 2**64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n <= len(self.powers):
            return
        n = max(n, 1 << 16, min(2 * len(self.powers), self.LIMIT))
        for name, base in (("powers", self.base), ("inverses", self.inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def words(self, text: bytes) -> np.ndarray:
        """Hashes of the words (runs of non-space bytes) of ``text``, in order."""
        return self.places(text)[2]

    def places(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of every word."""
        b = np.frombuffer(text, np.uint8)
        space = np.ones(len(b) + 2, np.int8)
        space[1:-1] = _SPACE[b]
        edges = np.flatnonzero(np.diff(space))
        starts, ends = edges[0::2], edges[1::2]
        out, first = np.empty(len(starts), np.uint64), 0
        while first < len(starts):
            # As many whole words as fit into LIMIT bytes, one at least.
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + self.LIMIT, "right")))
            lo, hi = int(starts[first]), int(ends[last - 1])
            self._grow(hi - lo)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(self.values[b[lo:hi]] * self.powers[: hi - lo], out=sums[1:])
            s, e = starts[first:last] - lo, ends[first:last] - lo
            out[first:last] = mix64((sums[e] - sums[s]) * self.inverses[s] + (e - s).astype(np.uint64))
            first = last
        return starts, ends, out

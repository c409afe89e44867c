"""SetSketch registers of word shingles.

A document is the set of its runs of five consecutive words. Register i of its sketch is floor(1 - log_b(m_i)), clipped to
[0, LIMIT], where m_i is the least of independent exponential values that hash function i gives the elements. Registers
are maxima on an exponential scale: the sketch of a union is the register-wise maximum of the sketches, and for a base
close to 1 two sketches agree in a register about as often as their sets overlap. Bands of registers therefore find
similar documents, and the counts of larger, smaller and equal registers of a pair give its most likely similarity.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

WORDS = re.compile(r"\w+")
SPAN = 5


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five consecutive words; empty for fewer than five words."""
    words = WORDS.findall(text.lower()) if text else []
    if len(words) < SPAN:
        return np.zeros(0, "uint64")
    h = word_hashes(words)
    with np.errstate(over="ignore"):
        out = h[: len(h) - SPAN + 1].copy()
        for k in range(1, SPAN):
            out = _mix(out * ODD + h[k : len(h) - SPAN + 1 + k])
    return np.unique(out)


ODD = np.uint64(0x9E3779B97F4A7C15)
_seen: dict[str, int] = {}


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hash of each word; distinct words are hashed once, in a memory that is emptied when it grows large."""
    if len(_seen) > 400_000:
        _seen.clear()
    for w in set(words).difference(_seen):
        _seen[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_seen.__getitem__, words), "uint64", len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class SetSketch:
    """``bands`` bands of ``rows`` registers; ``base`` and ``rate`` as in the sketch's definition, 16-bit registers."""

    bands: int = 64
    rows: int = 4
    base: float = 1.001
    rate: float = 20.0
    seed: int = 7

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def _constants(self) -> tuple[np.ndarray, np.ndarray]:
        g = np.random.default_rng(self.seed)
        return g.integers(1, 2**63, self.size, dtype="uint64") * np.uint64(2) + np.uint64(1), g.integers(0, 2**63, self.size, dtype="uint64")

    def registers(self, sets: list[np.ndarray]) -> np.ndarray:
        """Registers, one row per non-empty set."""
        mul, add = self._constants()
        least = np.empty((len(sets), self.size), "uint64")
        with np.errstate(over="ignore"):
            for k, s in enumerate(sets):
                block = None
                for at in range(0, len(s), 512):  # blocks stay in the processor's cache however long the text
                    part = (s[at : at + 512, None] * mul[None, :] + add[None, :]).min(0)
                    block = part if block is None else np.minimum(block, part)
                least[k] = block
        u = (least >> np.uint64(11)).astype("float64") * 2.0**-53 + 2.0**-54
        value = 1 - np.log(-np.log1p(-u) / self.rate) / math.log(self.base)
        return np.clip(np.floor(value), 0, 65535).astype("uint16")

    def band_keys(self, registers: np.ndarray) -> np.ndarray:
        """One 64-bit key per band, as signed integers."""
        with np.errstate(over="ignore"):
            r = registers.astype("uint64").reshape(len(registers), self.bands, self.rows)
            h = np.broadcast_to(_mix(np.arange(1, self.bands + 1, dtype="uint64") * ODD), r.shape[:2]).copy()
            for k in range(self.rows):
                h = _mix(h * ODD + r[:, :, k] + np.uint64(1))
        return h.view("int64")

    def similarity(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 60) -> np.ndarray:
        """Most likely Jaccard similarity of pairs, jointly from larger, smaller and equal registers and the set sizes."""
        more, less = (a > b).sum(1), (a < b).sum(1)
        same = a.shape[1] - more - less
        u = na / (na + nb)
        v = 1 - u
        top = np.minimum(u / v, v / u)
        best, value = np.zeros(len(u)), np.full(len(u), -np.inf)
        scale = (self.base - 1) / self.base
        p = lambda x: -np.log1p(-np.clip(x, 0, 1) * scale) / math.log(self.base)
        for k in range(steps + 1):
            j = top * k / steps
            plus, minus = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
            zero = np.maximum(1 - plus - minus, 1e-12)
            got = more * np.log(plus) + less * np.log(minus) + same * np.log(zero)
            better = got > value
            best, value = np.where(better, j, best), np.where(better, got, value)
        return best


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact similarity of two sorted sets of distinct hashes."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def packed(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary()) if len(rows) else pa.array([], pa.binary())


def unpacked(column: pa.Array, kind: str) -> np.ndarray:
    """Inverse of ``packed`` for values of one width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), -1)


def estimate_pairs(pairs: DataFrame, sketch: SetSketch, threshold: float, sigmas: float = 5.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop candidate pairs whose likeliest similarity lies so far below the threshold that they can't reach it.

    ``pairs`` has id_a, id_b, n_a, n_b, r_a, r_b (set sizes, packed registers); the result has id_a, id_b and the columns
    of ``keep``. The margin is ``sigmas`` standard errors of the estimate at the threshold.
    """
    floor = threshold - sigmas * math.sqrt(threshold * (1 - threshold) / sketch.size)
    kind = pairs.schema["id_a"].dataType.simpleString()
    more = "".join(f", `{c}` {pairs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                num = lambda k: b.column(k).to_numpy(zero_copy_only=False).astype("float64")
                got = sketch.similarity(unpacked(b.column(4), "uint16"), unpacked(b.column(5), "uint16"), num(2), num(3))
                chosen = pa.array(got >= floor)
                yield pa.RecordBatch.from_arrays([b.column(k).filter(chosen) for k in (0, 1, *range(6, 6 + len(keep)))], names=["id_a", "id_b", *keep])

    return pairs.select("id_a", "id_b", "n_a", "n_b", "r_a", "r_b", *keep).mapInArrow(run, f"id_a {kind}, id_b {kind}{more}")

"""Around search and indexing: embedding in batches, isolation of bad rows, a circuit breaker, and the shape of results."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]


def hashed_bits(texts: list[str], size: int = 8) -> list[list[float]]:
    """A stand-in for a model: bits of md5 and a constant, the same on every machine."""
    digest = [int(hashlib.md5(t.encode()).hexdigest(), 16) for t in texts]
    return [[((d >> k) & 1) + 0.1 for k in range(size)] for d in digest]


def isolate(items: list, work: Callable[[list], list]) -> tuple[list, list[int]]:
    """(results with None for bad items, positions of bad items): a batch that fails is halved until single items fail."""
    try:
        return list(work(items)), []
    except Exception:
        if len(items) <= 1:
            return [None] * len(items), list(range(len(items)))
    mid = len(items) // 2
    left, bad_left = isolate(items[:mid], work)
    right, bad_right = isolate(items[mid:], work)
    return left + right, bad_left + [mid + k for k in bad_right]


def embed(docs: DataFrame, embedder: Embedder, key: str = "id", body: str = "body", batch: int = 256) -> DataFrame:
    """``(key, embedding, status)``: searchable with a vector, or failed without one; a bad row doesn't fail its batch."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, embedding array<float>, status string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                vectors, _ = isolate([t or "" for t in b.column(1).to_pylist()], embedder)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float32())), pa.array(["failed" if v is None else "searchable" for v in vectors])], names=[key, "embedding", "status"])

    return docs.select(key, body).mapInArrow(run, schema)


@dataclass
class Breaker:
    """Closed while calls succeed; open after ``threshold`` failures in a row; half open after ``cooldown`` seconds, for one call."""

    threshold: int = 3
    cooldown: float = 30.0
    clock: Callable[[], float] = time.monotonic
    failures: int = 0
    opened: float | None = None
    probing: bool = field(default=False)

    @property
    def state(self) -> str:
        if self.opened is None:
            return "closed"
        return "half_open" if self.clock() - self.opened >= self.cooldown else "open"

    def call(self, work: Callable, *args):
        """The result of ``work``; raises at once while the breaker is open or another call probes."""
        if self.state == "open" or self.state == "half_open" and self.probing:
            raise RuntimeError("the breaker is open")
        self.probing = self.state == "half_open"
        try:
            got = work(*args)
        except Exception:
            self.failures += 1
            if self.probing or self.failures >= self.threshold:
                self.opened = self.clock()
            raise
        else:
            self.failures, self.opened = 0, None
            return got
        finally:
            self.probing = False


def shaped(results: DataFrame, columns: tuple[str, ...], score: str = "score", extra: str | None = None) -> DataFrame:
    """One JSON object per result: score with four digits, nulls left out, ``extra`` (JSON text) as an object."""
    parts: list[Column] = [F.round(score, 4).alias("score"), *[F.col(c) for c in columns]]
    if extra:
        parts.append(F.from_json(extra, "map<string,string>").alias("extra"))
    return results.select(F.to_json(F.struct(*parts), {"ignoreNullFields": "true"}).alias("result"))

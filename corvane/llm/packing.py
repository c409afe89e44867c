"""Items of varying size into containers of fixed capacity, improved by swaps.

Items are packed in chunks as they stream by, in the same pass that counts their tokens: no shuffle, no group larger than
a chunk. Within a chunk every item first goes into the fullest container that has room, largest items first. Then the
search takes the emptiest container and tries to empty it: an item moves into a container with room, or changes places
with a smaller item, or with two smaller ones, of a fuller container. Every exchange raises the sum of squared fills, so
the search ends; a container that gets empty is saved. It goes on until as many containers are left as the sizes need at
least, or as many containers in a row resist as ``patience`` says; without it, until no exchange out of any is left.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from corvane.llm.tokens import VOCABULARY, encoding
from corvane.session import bounded_rows


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item (all at most capacity), largest first into the fullest container with room."""
    out = np.empty(len(sizes), "int64")
    room: list[tuple[int, int]] = []
    bins = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        k = bisect_left(room, (s, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            free, b = capacity, bins
            bins += 1
        out[i] = b
        if free > s:
            insort(room, (free - s, b))
    return out


class _Pairs:
    """Sums of two items of one container, for all containers; made anew only after something has moved."""

    def __init__(self) -> None:
        self.of: int | None = None

    def at(self, moves: int, sizes: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first item, second item, sum)."""
        if self.of != moves:
            order = np.argsort(where, kind="stable")
            count = np.bincount(where)
            behind = np.repeat(np.cumsum(count), count) - np.arange(len(order)) - 1  # items of the container after each one
            i = np.repeat(np.arange(len(order)), behind)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(behind) - behind, behind)
            self.i, self.j = order[i], order[j]
            self.sum = sizes[self.i] + sizes[self.j]
            self.of = moves
        return self.i, self.j, self.sum


def improve(sizes: np.ndarray, where: np.ndarray, capacity: int, patience: int | None = 40) -> np.ndarray:
    """Local search over moves, one-for-one and two-for-one exchanges out of the emptiest container that isn't stuck.

    A container is stuck when no exchange is left for any of its items. The search ends after ``patience`` of them in a
    row; with None it goes on through all, and over again while anything moves.
    """
    where = where.copy()
    n_bins = int(where.max()) + 1 if len(where) else 0
    fill = np.bincount(where, sizes, n_bins).astype("int64")
    least = -(-int(sizes.sum()) // capacity)
    stuck: set[int] = set()
    pairs, moves, last_round = _Pairs(), 0, 0
    while int((fill > 0).sum()) > least and (patience is None or len(stuck) < patience):
        loose = [b for b in np.flatnonzero((fill > 0) & (fill < capacity)).tolist() if b not in stuck]
        if not loose:
            if patience is not None or moves == last_round:
                break
            last_round = moves
            stuck.clear()
            continue
        victim = loose[int(np.argmin(fill[loose]))]
        before = moves
        items = np.flatnonzero(where == victim)
        for x in items[np.argsort(-sizes[items])].tolist():
            moves += _place(x, victim, sizes, where, fill, capacity, pairs, moves)
        if fill[victim] == 0 and patience is not None:
            stuck.clear()
        elif moves == before:
            stuck.add(victim)
    used = np.flatnonzero(fill > 0)
    number = np.full(n_bins, -1, "int64")
    number[used] = np.arange(len(used))
    return number[where]


def _place(x: int, victim: int, sizes: np.ndarray, where: np.ndarray, fill: np.ndarray, capacity: int, pairs: _Pairs, moves: int) -> bool:
    """Move item x out of its container, alone or against smaller items, where that raises the sum of squared fills."""
    s = int(sizes[x])
    room = capacity - fill
    room[fill == 0] = -1
    room[victim] = -1
    fits = np.flatnonzero(room >= s)
    if len(fits):
        b = int(fits[np.argmin(room[fits])])
        where[x] = b
        fill[victim] -= s
        fill[b] += s
        return True
    # one for one: the item that comes back is smaller, and the other container ends up fuller than both were
    gain = s - sizes
    to = room[where] - gain  # room left in the other container
    ok = np.flatnonzero((gain > 0) & (to >= 0) & (room[where] >= 0) & (fill[where] + gain > fill[victim] - gain))
    if len(ok):
        ok = ok[fill[where[ok]] + gain[ok] > fill[victim]]
    if len(ok):
        y = int(ok[np.argmin(to[ok])])
        b = int(where[y])
        where[x], where[y] = b, victim
        fill[b] += gain[y]
        fill[victim] -= gain[y]
        return True
    # two for one: two items of one container that together are a little smaller than x
    i, j, both = pairs.at(moves, sizes, where)
    b = where[i]
    ok = np.flatnonzero((both < s) & (both >= s - room[b]) & (room[b] >= 0) & (fill[b] + s - both > fill[victim]))
    if len(ok):
        k = int(ok[np.argmin(room[b[ok]] - s + both[ok])])
        back, to_bin = int(both[k]), int(b[k])
        where[x], where[i[k]], where[j[k]] = to_bin, victim, victim
        fill[to_bin] += s - back
        fill[victim] += back - s
        return True
    return False


def pack(sizes: np.ndarray, capacity: int, patience: int | None = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, piece, size, container) of each piece; only items larger than the capacity have more than one piece."""
    sizes = np.asarray(sizes, "int64")
    pieces = np.maximum(1, -(-sizes // capacity))
    item = np.repeat(np.arange(len(sizes)), pieces)
    piece = np.arange(len(item)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.where(piece < pieces[item] - 1, capacity, sizes[item] - capacity * (pieces[item] - 1))
    whole = size == capacity
    where = np.empty(len(item), "int64")
    full = int(whole.sum())
    where[whole] = np.arange(full)
    rest = np.flatnonzero(~whole)
    if len(rest):
        where[rest] = full + improve(size[rest], best_fit(size[rest], capacity), capacity, patience)
    return item, piece, size, where


def pack_documents(
    df: DataFrame, capacities: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, chunk: int = 8192, max_capacities: int = 1000, patience: int | None = 40
) -> DataFrame:
    """``(capacity_id, key, piece, first_token, tokens, container)``: every document in containers of every capacity.

    A document stays whole unless it is larger than the container; its pieces are then full but for the last one. No
    container holds more than its capacity. Containers are numbered within the task, so the numbers are unique over the
    result and the same when a task is repeated. ``chunk`` documents are packed together, and the search for exchanges is
    as patient as ``improve`` says. Null and empty texts have no
    tokens and need no container; capacities that are null or not positive are left out; a null key stays null; repeated
    rows are documents of their own; empty tables give no rows; other columns are not read.
    """
    sizes_of = [(r["capacity_id"], int(r["capacity_tokens"])) for r in bounded_rows(capacities.select("capacity_id", "capacity_tokens"), max_capacities, "capacities") if (r["capacity_tokens"] or 0) > 0]
    kind = df.schema[key].dataType
    id_kind = capacities.schema["capacity_id"].dataType.simpleString()
    schema = f"capacity_id {id_kind}, `{key}` {kind.simpleString()}, piece int, first_token bigint, tokens bigint, container bigint"
    names = ["capacity_id", key, "piece", "first_token", "tokens", "container"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(vocabulary)
        task = TaskContext.get().partitionId()
        ids, sizes, used = [], [], {c: 0 for c, _ in sizes_of}

        def flush() -> Iterator[pa.RecordBatch]:
            column = pa.concat_arrays(ids)
            for c, capacity in sizes_of:
                item, piece, size, where = pack(np.array(sizes), capacity, patience)
                number = (task << 40) + used[c] + where
                used[c] += int(where.max()) + 1
                columns = [pa.array([c] * len(item)).cast(pa.int32() if id_kind == "int" else pa.int64()), column.take(pa.array(item)), pa.array(piece.astype("int32")), pa.array(piece * capacity), pa.array(size), pa.array(number)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        for b in batches:
            counts = [len(e.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            rows = [k for k, n in enumerate(counts) if n]
            for at in range(0, len(rows), chunk):
                part = rows[at : at + chunk]
                ids.append(b.column(0).take(pa.array(part, pa.int64())))
                sizes += [counts[k] for k in part]
                if len(sizes) >= chunk:
                    yield from flush()
                    ids.clear()
                    sizes.clear()
        if sizes:
            yield from flush()

    return df.select(key, text).mapInArrow(run, schema)

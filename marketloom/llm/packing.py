"""Operator 7: best-fit packing of token sequences by bin completion.

Documents longer than the capacity are cut into full pieces and a rest. What is packed is the histogram of piece lengths,
which has no more entries than the capacity, so the search is on the driver and as large for any corpus. Around the
largest piece left, undominated fillings are enumerated: one whose pieces, or some of them together, fit one larger piece that
also fits is never tried, and of the fillings with the same sum the one with the larger pieces stands first. A branch is cut
when its waste shows that it can't beat the incumbent, at first the best-fit solution; where that meets the lower bound
there is nothing to search. The search is exact with ``width=None``. Else it looks at ``looks`` second pieces for ``width``
fillings, uses each as often as the counts allow, and keeps the incumbent after ``nodes`` steps; branches wait, none is dropped.
A piece finds its place by its rank among pieces of its length: tasks number their own pieces, a small table adds what the
tasks before hold, and slots are looked up in a table of the fillings used.

Defined cases: null text counts as empty (the end id alone); repeated rows, and those of null doc_id, are packed each; very long
texts are cut into pieces; ties of one length go by task and place; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import map_batches, raw, staged, steps
from marketloom.llm.tokens import coder, vocabulary_path

CAPACITY = 2048
END_ID = 0
#: Fillings tried around a largest piece, second pieces looked at for them, and steps of the search before the incumbent stands.
WIDTH, LOOKS, NODES = 3, 400, 20_000


def pieces(docs: DataFrame, capacity: int, end_id: int, path: str, with_ids: bool) -> DataFrame:
    """Each document's pieces; task and place number the pieces of one length within a task."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"] + ["ids"] * with_ids

    def run(batches):
        code, task, met = coder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in steps(batches):
            data, rows = raw(b.column("text"))
            flat, first = code.encode(data, rows)
            flat = np.insert(flat.astype("<u4"), first[1:], end_id)
            first = first + np.arange(len(first))
            n = np.diff(first)
            cuts = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), cuts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = piece * capacity
            length = np.minimum(n[row] - start, capacity)
            order = np.argsort(length, kind="stable")
            same = np.arange(len(row)) - np.searchsorted(length[order], length[order])
            place = np.empty(len(row), np.int64)
            place[order] = met[length[order]] + same
            met += np.bincount(length, minlength=capacity + 1)
            text = [flat[x : x + y].tobytes() for x, y in zip((first[row] + start).tolist(), length.tolist(), strict=True)]
            arrays = [b.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in text], pa.int64()), pa.array(np.full(len(row), task, np.int32)), pa.array(place)]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(text, pa.binary())] * with_ids, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long" + ", ids binary" * with_ids
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


class Left:
    """Counts of the lengths not placed yet, with the lengths sorted for search."""

    def __init__(self, counts: dict[int, int]):
        self.counts = dict(counts)
        self.keys = sorted(counts)

    def take(self, filling: tuple[int, ...], times: int) -> None:
        for x in set(filling):
            self.counts[x] -= filling.count(x) * times
            if not self.counts[x]:
                del self.counts[x]
                self.keys.pop(bisect_right(self.keys, x) - 1)

    def largest(self, most: int, taken: tuple[int, ...] = ()) -> int:
        """The largest length of at most ``most`` that is left when ``taken`` are used; 0: none."""
        at = bisect_right(self.keys, most) - 1
        while at >= 0 and self.counts[self.keys[at]] <= taken.count(self.keys[at]):
            at -= 1
        return self.keys[at] if at >= 0 else 0

    def times(self, filling: tuple[int, ...]) -> int:
        return min(self.counts[x] // filling.count(x) for x in set(filling))


def best_fit(left: Left, room: int, begun: tuple[int, ...]) -> tuple[int, ...]:
    while x := left.largest(room, begun):
        begun, room = (*begun, x), room - x
    return begun


def every_filling(left: Left, capacity: int) -> list[tuple[int, ...]]:
    """All undominated fillings around the largest length left, least waste first."""
    found: list[tuple[int, ...]] = []

    def go(chosen: tuple[int, ...], room: int, most: int) -> None:
        if not left.largest(room, chosen):
            sums = {0}
            for x in chosen[1:]:
                sums |= {s + x for s in sums}
            if not any(n > chosen.count(z) and any(s <= z <= s + room and s != z for s in sums) for z, n in left.counts.items()):
                found.append(chosen)
            return
        for x in reversed(left.keys[: bisect_right(left.keys, min(room, most))]):
            if left.counts[x] > chosen.count(x):
                go((*chosen, x), room - x, x)

    go((left.keys[-1],), capacity - left.keys[-1], capacity)
    return sorted(found, key=lambda f: (capacity - sum(f), tuple(-x for x in f)))


def fillings(left: Left, capacity: int, width: int, looks: int) -> list[tuple[int, ...]]:
    """Undominated fillings around the largest length left, least waste first."""
    top = left.keys[-1]
    room = capacity - top
    one = left.largest(room, (top,))
    if not one:
        return [(top,)]
    if one == room:
        return [(top, one)]  # dominates every other
    found = {best_fit(left, room, (top,))}
    tried = 0
    at = bisect_right(left.keys, room)
    for x in reversed(left.keys[:at]):
        if tried >= looks or sum(sum(f) == capacity for f in found) >= width:
            break
        tried += 1
        if left.counts[x] <= (top,).count(x):
            continue
        y = left.largest(min(x, room - x), (top, x))
        if y and x + y > one:
            found.add((top, x, y) if x + y == room else best_fit(left, room - x - y, (top, x, y)))
        if room - x > 2 and y and x + y < room:
            y = left.largest(min(x, (room - x) * 2 // 3), (top, x))
            if y:
                found.add(best_fit(left, room - x - y, (top, x, y)))
    return sorted(found, key=lambda f: (capacity - sum(f), tuple(-x for x in f)))[:width]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that no packing goes below: by volume beside pieces that can't share with large ones."""
    best = 0
    n, size = np.zeros(capacity + 1, np.int64), np.arange(capacity + 1)
    for x, k in counts.items():
        n[x] = k
    many, volume = np.cumsum(n), np.cumsum(n * size)
    for k in range(capacity // 2 + 1):
        alone = many[-1] - many[capacity - k]  # > capacity - k
        halves = many[capacity - k] - many[capacity // 2]  # they can't share with each other
        small = volume[capacity // 2] - (volume[k - 1] if k else 0)
        room = halves * capacity - (volume[capacity - k] - volume[capacity // 2])
        best = max(best, int(alone + halves + max(0, -(-(small - room) // capacity))))
    return best


def greedy(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    left, out = Left(counts), []
    while left.keys:
        f = best_fit(left, capacity, ())
        out.append((f, k := left.times(f)))
        left.take(f, k)
    return out


def complete(counts: dict[int, int], capacity: int, width: int | None = WIDTH, nodes: float = NODES, looks: int = LOOKS) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how often each is used; all pieces are placed. width None: in as few sequences as there can be."""
    counts = {x: k for x, k in counts.items() if k}
    best = greedy(counts, capacity)
    most, least = sum(k for _, k in best), lower_bound(counts, capacity)
    volume = sum(x * k for x, k in counts.items())
    used, limit = 0, math.inf if width is None else nodes
    stack: list[tuple[list, int, int]] = [([], 0, 0)]
    while stack and most > least and used < limit:
        plan, bins, waste = stack.pop()
        left = Left(counts)
        for f, k in plan:
            left.take(f, k)
        while left.keys and used < limit:
            used += 1
            if waste > (most - 1) * capacity - volume or width is None and bins + lower_bound(left.counts, capacity) >= most:
                break
            options = every_filling(left, capacity) if width is None else fillings(left, capacity, width, looks)
            often = [1 if width is None else left.times(f) for f in options]
            longer = [([*plan, (f, k)], bins + k, waste + k * (capacity - sum(f))) for f, k in zip(options, often, strict=True)]
            stack += longer[:0:-1]
            left.take(options[0], often[0])
            plan, bins, waste = longer[0]
        if not left.keys and bins < most:
            best, most = plan, bins
    return best


def slot_table(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> np.ndarray:
    """Rows length, first rank, first sequence, copies, offset; sorted by length and rank."""
    rows, ranks, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for filling, k in plan:
        offset = 0
        for x in dict.fromkeys(filling):
            copies = filling.count(x)
            rows.append((x, ranks[x], sequence, copies, offset))
            ranks[x] += copies * k
            offset += copies * x
        sequence += k
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, little-endian unsigned 32-bit) of every piece."""
    spark = docs.sparkSession
    table = staged(pieces(docs, capacity, end_id, path or vocabulary_path(), with_ids), "pieces")
    counts = table.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    shared = spark.sparkContext.broadcast(slot_table(complete(histogram, capacity), capacity))
    before = counts.select("task", "length", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches):
        slots = shared.value
        key = slots[:, 0] << 44 | slots[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            s = slots[np.searchsorted(key, length << 44 | rank, side="right") - 1] if len(slots) else slots
            nth = rank - s[:, 1]
            done = {"sequence_id": pa.array(s[:, 2] + nth // s[:, 3]), "offset": pa.array(s[:, 4] + nth % s[:, 3] * length)}
            yield pa.RecordBatch.from_pydict({n: b.column(n) for n in kept} | done)

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    ranked = table.join(before, ["task", "length"]).withColumn("rank", F.col("place") + F.col("before")).select(*kept, "rank")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    return map_batches(ranked, run, schema)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)

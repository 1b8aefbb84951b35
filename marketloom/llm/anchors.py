"""Which windows of W consecutive units (bytes or words) recur in a corpus, without a row for each window.

The smallest hash of a window's k-grams is its anchor: equal windows have equal anchors at the same place. Consecutive windows
with one anchor form a piece, so about one row for (W - k) / 2 windows is sent, in binary packets to the shard of the
anchor's hash. Pieces equal as a whole are settled there by a hash of their contents; where one anchor stands in different
pieces, one piece of each kind goes on to be compared window by window. A window reaches half its rest to the left of its
anchor or to the right, so pieces of which no other kind shares either side are done.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import map_batches, repeat_rows, span_hashes, window_hashes

#: Low bits of a k-gram's sort key that hold its position, so the leftmost of equal k-grams is the anchor.
PLACE = np.uint64((1 << 26) - 1)
#: Anchors that a shard is meant to hold, and that a task gathers before it sends them.
SHARD_ANCHORS, PACKET_ANCHORS = 1 << 19, 1 << 19
#: What a packet holds of each piece, and as which type. A shard needs 32 bits of the anchor's hash: chance equals cost time only.
FIELDS = {"h": np.uint32, "content": np.uint64, "sides": np.uint16, "doc": np.int64, "low": np.int32, "more": np.uint8}
#: Besides, where several rows are one document: doc is then the row's number, and this its document.
OF = {"of": np.int64}


def pieces(values: np.ndarray, first: np.ndarray, width: int, k: int) -> tuple[np.ndarray, ...]:
    """Hash of the anchor, of the content, of both sides, row, first and last window start (within the row) of every piece."""
    grams = window_hashes(values, k)
    span = width - k + 1
    none = np.zeros(0, np.int64)
    if len(grams) < span:
        return none.view(np.uint64), none.view(np.uint64), none.astype(np.uint16), none, none, none
    key = (grams & ~PLACE) | (np.arange(len(grams), dtype=np.uint64) & PLACE)
    have = 1
    while have < span:  # key[i]: the least of the next `have` keys
        more = min(have, span - have)
        key = np.minimum(key[:-more], key[more:])
        have += more
    row = repeat_rows(first)
    at = np.arange(len(key))
    own = row[: len(key)]
    valid = np.flatnonzero(at + width <= first[1:][own])
    place = valid - (valid & int(PLACE)) + (key[valid] & PLACE).astype(np.int64)
    place[place < valid] += int(PLACE) + 1
    new = np.concatenate(([True], (place[1:] != place[:-1]) | (valid[1:] != valid[:-1] + 1))) if len(valid) else np.zeros(0, bool)
    low = valid[new]
    high = valid[np.append(np.flatnonzero(new)[1:] - 1, len(valid) - 1)] if len(valid) else none
    anchor = place[new]
    content = span_hashes(values, low, high + width) + (anchor - low).astype(np.uint64)
    r = own[low]
    reach = (width - k) // 2
    side = lambda a, b, has: np.where(has, (span_hashes(values, np.where(has, a, low), np.where(has, b, low)) % np.uint64(255)).astype(np.uint16) + 1, 0)
    left = side(anchor - reach, anchor + k, low <= anchor - reach)
    right = side(anchor, anchor + k + reach, high + width >= anchor + k + reach)
    return grams[anchor], content, (left << 8 | right).astype(np.uint16), r, low - first[r], high - first[r]


def shared_side(group: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Whether another kind of the group has the same side; 0: has none."""
    _, back, count = np.unique(group * 256 + side, return_inverse=True, return_counts=True)
    return (count[back] > 1) & (side > 0)


def packets(docs: DataFrame, units, width: int, k: int, shards: int) -> DataFrame:
    """shard and columns of packed arrays: all pieces of all rows. units(batch) yields values and row starts and doc ids.

    If docs has the column of, units yields that too, and the packets hold it.
    """
    fields = FIELDS | (OF if "of" in docs.columns else {})

    def send(gathered):
        h, content, sides, doc, low, high, *of = (np.concatenate(x) for x in zip(*gathered, strict=True))
        shard = (h >> np.uint64(40)).astype(np.int64) % shards
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(shards + 1))
        full = np.flatnonzero(np.diff(ends))
        columns = [pa.array([x[order[ends[s] : ends[s + 1]]].tobytes() for s in full], pa.binary()) for x in (h.astype(np.uint32), content, sides, doc, low.astype(np.int32), (high - low).astype(np.uint8), *of)]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *columns], ["shard", *fields])

    def run(batches):
        gathered, n = [], 0
        for values, first, ids, *of in units(batches):
            h, content, sides, row, low, high = pieces(values, first, width, k)
            if len(h):
                gathered.append((h, content, sides, ids[row], low, high, *(x[row] for x in of)))
                n += len(h)
            if n >= PACKET_ANCHORS:
                yield send(gathered)
                gathered, n = [], 0
        if gathered:
            yield send(gathered)

    return map_batches(docs, run, "shard int, " + ", ".join(f"{x} binary" for x in fields))


def settle(sent: DataFrame, shards: int, decide, first: bool = False) -> DataFrame:
    """Rows doc, low, high, h and open: pieces that recur (open false) and pieces to compare by windows (open true).

    decide(doc, kind, kind_first, kind_count, group_kinds, group_docs) gives the masks of recurring and open pieces; all arrays
    are by piece, sorted by anchor, content, document and place. It is given the packets' ``of`` as doc, if they have that.
    With first, also first_doc and first_low: the first piece of the same content.
    """
    fields = FIELDS | (OF if "of" in sent.columns else {})
    schema = "doc long, low int, high int, h long, open boolean" + (", first_doc long, first_low int" if first else "")

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        h, content, sides, doc, low, more, *of = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for b in parts for x in b.column(name)]) for name, kind in fields.items())
        order = np.lexsort((low, doc, *of, content, h))
        h, content, sides, doc, low = h[order], content[order], sides[order], doc[order], low[order]
        high = low + more[order]
        of = of[0][order] if of else doc
        new_group = np.concatenate(([True], h[1:] != h[:-1]))
        new_kind = new_group | np.concatenate(([True], content[1:] != content[:-1]))
        kind = np.cumsum(new_kind) - 1
        at = np.flatnonzero(new_kind)
        count = np.diff(np.append(at, len(h)))
        group = np.cumsum(new_group) - 1
        kinds = np.bincount(group[at])
        begin = np.flatnonzero(new_group)
        several = np.minimum.reduceat(of, begin) != np.maximum.reduceat(of, begin)
        done, open_ = decide(of, kind, at, count, kinds[group], several[group])
        side = sides[at].astype(np.int64)
        open_ &= (shared_side(group[at], side >> 8) | shared_side(group[at], side & 255))[kind]
        for mask, flag in ((done, False), (open_, True)):
            some = np.flatnonzero(mask)
            for a in range(0, len(some), 50_000):
                i = some[a : a + 50_000]
                like = at[kind[i]]
                columns = {"doc": doc[i], "low": low[i], "high": high[i], "h": h[i].astype(np.int64), "open": np.full(len(i), flag)} | ({"first_doc": doc[like], "first_low": low[like]} if first else {})
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))

    return map_batches(sent.repartition(shards, "shard"), run, schema)


def by_document(spans: DataFrame, name: str) -> DataFrame:
    """One row a document: its spans, as structs."""
    return spans.groupBy("doc").agg(F.collect_list(F.struct("low", "high", "h")).alias(name))


def span_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """low, high and h of a column of by_document one after another, and each row's first; null: none."""
    count = column.value_lengths().fill_null(0).to_numpy()
    flat = column.flatten()
    low, high, h = (np.asarray(flat.field(name)) for name in ("low", "high", "h"))
    return low, high, h, np.concatenate((np.zeros(1, np.int64), np.cumsum(count)))

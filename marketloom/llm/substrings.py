"""Operator 5: repeated byte strings across documents, by suffix arrays of shards.

Anchors (``anchors.py``) leave the few places where a string could also stand in another document: pieces equal as a whole are
settled by their contents, one piece of each kind goes to the shard of its anchor. There suffixes are sorted by induction,
permuted common prefixes mark runs of suffixes that share the string length, and a start is hit if its run has a smaller
doc_id. All equal strings have one anchor, so they meet in one shard; nothing is compared across shards.

Defined cases: null text counts as empty; rows of one doc_id are one document for the comparison (none removes from the other)
and each is returned with its own spans, told apart by a number of its own; texts shorter than the string lose nothing;
rows of null doc_id count as one document after all others; very long texts are handled alone; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.anchors import SHARD_ANCHORS, by_document, packets, settle, span_arrays
from marketloom.llm.common import VALUES, join_spans, map_batches, numbered, raw, staged, steps, told_apart
from marketloom.llm.suffix_arrays import permuted_prefixes, suffix_array

LENGTH, GRAM = 50, 20
#: What null stands for in the order of doc_ids.
LAST = (1 << 63) - 1
#: Bytes of snippets that one suffix array holds.
SHARD_BYTES = 1 << 20


def byte_units(batches):
    for b in steps(batches):
        data, rows = raw(b.column("text"))
        yield VALUES[False][data], rows, b.column("row_id").to_numpy(), *(b.column(x).to_numpy() for x in ("of",) if x in b.schema.names)


def decide(doc, kind, at, count, kinds, several):
    """A piece recurs if a smaller document has it whole; those of the smallest are compared if the anchor has other kinds."""
    least = doc[at][kind]
    return doc > least, (doc == least) & (kinds > 1) & several


def snippets(rows: DataFrame, length: int) -> DataFrame:
    """h, doc (the row), of (its document), low and the bytes of every piece that is compared by windows."""

    def run(batches):
        for b in steps(batches):
            out = []
            low, high, h, at = span_arrays(b.column("open"))
            data, rows = raw(b.column("text"))
            for r, (doc, of, i, j) in enumerate(zip(b.column("row_id").to_pylist(), b.column("of").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True)):
                text = data[rows[r] : rows[r + 1]].tobytes()
                out += [(x, doc, of, a, text[a : z + length]) for x, a, z in zip(h[i:j].tolist(), low[i:j].tolist(), high[i:j].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["h", "doc", "of", "low", "bytes"])

    return map_batches(rows, run, "h long, doc long, of long, low int, bytes binary")


def shard_hits(length: int):
    """Starts in snippets whose string a smaller document has, as pieces (doc, low, high)."""

    def hits(doc: np.ndarray, of: np.ndarray, low: np.ndarray, parts: list[bytes]):
        size = np.array([len(x) for x in parts])
        flat = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int64) + 2
        ends = np.cumsum(size + 1) - 1
        flat[ends] = 1
        flat[-1] = 0
        order = suffix_array(flat)
        shared = permuted_prefixes(flat, order, length)[order] >= length  # with the suffix before
        which = np.repeat(np.arange(len(parts)), size + 1)
        inside = np.arange(len(flat)) - np.repeat(ends - size, size + 1)
        room = np.repeat(size, size + 1) - inside >= length  # no mark between snippets within the string
        run = np.cumsum(~(shared & room[order]))
        least = np.full(int(run[-1]) + 1, np.iinfo(np.int64).max)
        ok = room[order]
        np.minimum.at(least, run[ok], of[which[order[ok]]])
        hit = np.sort(order[ok][of[which[order[ok]]] > least[run[ok]]])
        first = np.flatnonzero(np.diff(hit, prepend=-2) > 1)  # runs of starts; a mark lies between snippets
        last = np.append(first[1:], len(hit)) - 1 if len(hit) else first
        part = which[hit[first]]
        return doc[part], low[part] + inside[hit[first]], low[part] + inside[hit[last]]

    def run(batches):
        gathered: dict[str, list] = {"h": [], "doc": [], "of": [], "low": [], "bytes": []}

        def flush(cut_group: bool):
            """Whole anchor groups go to one suffix array; the last group may go on in the next batch."""
            h = np.array(gathered["h"])
            to = len(h) if not cut_group else int(np.searchsorted(h, h[-1]))
            if to:
                doc, start, stop = hits(np.array(gathered["doc"][:to]), np.array(gathered["of"][:to]), np.array(gathered["low"][:to]), gathered["bytes"][:to])
                for x in gathered.values():
                    del x[:to]
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(np.zeros(len(doc), np.int64))], ["doc", "low", "high", "h"])

        held = 0
        for b in batches:
            for name, x in gathered.items():
                x.extend(b.column(name).to_pylist())
            held += sum(len(x) for x in b.column("bytes").to_pylist())
            if held >= SHARD_BYTES and gathered["h"]:
                yield from flush(True)
                held = sum(map(len, gathered["bytes"]))
        if gathered["h"]:
            yield from flush(False)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """row_id, doc_id, text, and spans: the byte ranges [start, end) that stand in a document of smaller doc_id. One row a row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    apart = told_apart(docs)
    docs = numbered(docs, apart).select("row_id", "doc.doc_id", "doc.text", F.coalesce("doc.doc_id", F.lit(LAST)).alias("of"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(8, int(2 * total / (length - gram + 2)) // SHARD_ANCHORS)
    sent = docs.select("row_id", "text") if apart else docs.select("row_id", "text", "of")
    found = staged(settle(packets(sent, byte_units, length, gram, shards), shards, decide), "pieces")
    texts = docs.repartition("row_id")
    compared = snippets(texts.join(by_document(found.where("open"), "open").withColumnRenamed("doc", "row_id"), "row_id").select("row_id", "of", "text", "open"), length)
    parts = max(8, shards // 4)
    hits = map_batches(compared.dropDuplicates(["h", "doc", "low"]).repartition(parts, "h").sortWithinPartitions("h"), shard_hits(length), "doc long, low int, high int, h long")
    spans = by_document(found.where("not open").select("doc", "low", "high", "h").unionByName(hits), "spans").withColumnRenamed("doc", "row_id")
    return texts.drop("of").join(spans, "row_id", "left")


def removed(text: bytes, low: np.ndarray, high: np.ndarray, length: int) -> tuple[bytes, np.ndarray]:
    """What is left, and the removed ranges."""
    start, end = join_spans(low.astype(np.int64), high.astype(np.int64) + length)
    keep, at = [], 0
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        keep.append(text[at:a])
        at = b
    return b"".join([*keep, text[at:]]), np.stack((start, end), axis=1)


def digest(rows: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for b in steps(batches):
            out = []
            low, high, _, at = span_arrays(b.column("spans"))
            flat, rows = raw(b.column("text"))
            for r, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                data = flat[rows[r] : rows[r + 1]].tobytes()
                left, ranges = removed(data, low[i:j], high[i:j], length)
                out.append((len(data), len(data) - len(left), len(ranges), hashlib.sha256(left).hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(),) * 3 + (pa.string(),)))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_batches(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")), LENGTH)

"""Operator 9: benchmark decontamination with an FM-index per training shard.

Every slice of a task's documents is a shard. Words outside the benchmark's vocabulary, and pairs of neighbouring words that
no test phrase holds, can't be part of an occurrence, so a shard indexes only the runs between them. All test phrases are
searched backward at once through wavelet-tree ranks; occurrences are located by sampled suffix positions and merged to
removal spans. Documents aren't shuffled. The benchmark is read in parts of at most ``part_bytes``; the table of one part is
what tasks get.

Defined cases: a null text has no words; items without words are never found; items of null id hit words like all others, but have no name to list; rows of
equal item_id are one item in the list; repeated documents and rows of null doc_id are handled each; very long texts are a shard of their own; with an empty
benchmark nothing is hit; an empty document table gives no rows; input columns with the names of new ones are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from marketloom.llm.common import ALNUM, join_spans, map_batches, raw, repeat_rows, staged, steps, words
from marketloom.llm.fm_index import FmIndex

WINDOW = 10
PART_BYTES = 8 << 20
NEW = ["n_words", "n_hit", "items", "hit_spans"]


class Phrases:
    """Distinct test phrases as rows of vocabulary numbers, and the items that hold each."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        blobs = [x.encode() for x in texts]
        rows = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(x) for x in blobs]))).astype(np.int64)
        h, _, _, first = words(np.frombuffer(b"".join(blobs), np.uint8), rows, ALNUM, lower=True)
        self.vocabulary, number = np.unique(h, return_inverse=True)
        size = np.diff(first)
        count = np.where(size > 0, np.maximum(1, size - window + 1), 0)
        item = np.repeat(np.arange(len(texts)), count)
        begin = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
        place = begin[:, None] + np.arange(window)
        inside = place < first[1:][item][:, None]
        rows = np.where(inside, number[np.minimum(place, max(0, len(h) - 1))] + 2 if len(h) else 0, 0).astype(np.int32)
        del place
        self.rows, of = np.unique(rows, axis=0, return_inverse=True)
        self.rows = self.rows.astype(np.int64)
        self.lengths = (self.rows > 0).sum(axis=1)
        holds = np.unique(np.stack((of.reshape(-1), item), axis=1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
        self.ids, self.items = ids, holds[:, 1]
        self.item_ends = np.searchsorted(holds[:, 0], np.arange(len(self.rows) + 1))
        self.least = int(self.lengths.min()) if len(self.rows) else 0
        size = len(self.vocabulary) + 2
        pair = self.rows[:, :-1] * size + self.rows[:, 1:]
        self.pairs = np.unique(pair[(self.rows[:, :-1] > 0) & (self.rows[:, 1:] > 0)])

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Each word's number, 0 outside the vocabulary."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 2, 0)

    def occurrences(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and phrase of every occurrence in the words h, which don't cross rows."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not self.least or not len(h):
            return none
        number = self.numbers(h)
        joined = np.zeros(len(h) + 1, bool)  # joined to the word before
        near = np.flatnonzero((number[1:] > 0) & (number[:-1] > 0) & (row[1:] == row[:-1]))
        if len(self.pairs):
            pair = number[near] * (len(self.vocabulary) + 2) + number[near + 1]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[near[self.pairs[at] == pair] + 1] = True
        begin = np.flatnonzero((number > 0) & ~joined[:-1])
        end = np.flatnonzero((number > 0) & ~joined[1:]) + 1
        long = end - begin >= self.least
        begin, end = begin[long], end[long]
        if not len(begin):
            return none
        size = end - begin + 1
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        text = number[np.minimum(place, len(number) - 1)]
        text[np.cumsum(size) - 1] = 1  # between runs
        index = FmIndex(text)
        low, high = index.search(self.rows, self.lengths)
        count = high - low
        suffix = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        return place[index.locate(suffix)], np.repeat(np.arange(len(count)), count)


def one_pass(docs: DataFrame, phrases: Phrases, first_pass: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(phrases)
    kept = [f for f in docs.schema.fields if f.name not in NEW]
    schema = StructType([*kept, StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("items", ArrayType(StringType())), StructField("hit_spans", BinaryType())])

    def run(batches):
        p = shared.value
        for b in steps(batches, limit=2 << 20):
            data, rows = raw(b.column("text"))
            h, start, end, first = words(data, rows, ALNUM, lower=True)
            row = repeat_rows(first)
            at, phrase = p.occurrences(h, row)
            begin, stop = join_spans(at, at + p.lengths[phrase])  # spans of different rows never touch: see below
            n_items = np.diff(p.item_ends)[phrase]
            of = np.repeat(row[at], n_items)
            item = p.items[np.repeat(p.item_ends[phrase], n_items) + np.arange(int(n_items.sum())) - np.repeat(np.cumsum(n_items) - n_items, n_items)]
            found: list[set[str]] = [set() for _ in range(b.num_rows)]
            for r, i in np.unique(np.stack((of, item), axis=1), axis=0).tolist():
                if p.ids[i] is not None:
                    found[r].add(p.ids[i])
            spans: list[list[tuple[int, int]]] = [[] for _ in range(b.num_rows)]
            for x, y in zip(begin.tolist(), stop.tolist(), strict=True):
                while x < y:  # a merged span may go on into the next row
                    r = row[x]
                    z = min(y, int(first[r + 1]))
                    spans[r].append((x - int(first[r]), z - int(first[r])))
                    x = z
            hit = []
            for r in range(b.num_rows):
                if not first_pass:
                    found[r] |= set(b.column("items")[r].as_py())
                    spans[r] += np.frombuffer(b.column("hit_spans")[r].as_py(), np.int64).reshape(-1, 2).tolist()
                if spans[r]:
                    x = np.array(spans[r], np.int64)
                    x = np.stack(join_spans(x[:, 0], x[:, 1]), axis=1)
                    hit.append((int((x[:, 1] - x[:, 0]).sum()), x.tobytes()))
                else:
                    hit.append((0, b""))
            new = [pa.array(np.diff(first)), pa.array([x[0] for x in hit], pa.int64()), pa.array([sorted(x) for x in found], pa.list_(pa.string())), pa.array([x[1] for x in hit], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *new], [f.name for f in schema.fields])

    return map_batches(docs, run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs with n_words, n_hit, items (ids found, sorted) and hit_spans (pairs of int64 word positions, end exclusive)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-2 * size // part_bytes)) if size > part_bytes else 1
    for k in range(parts):
        some = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        rows = some.collect()  # bounded by part_bytes
        docs = one_pass(docs, Phrases([r[0] for r in rows], [r[1] for r in rows], window), k == 0)
        docs = staged(docs, "decontaminated") if k < parts - 1 else docs
    return docs


def without_spans(docs: DataFrame) -> DataFrame:
    """docs with the words of hit_spans, and what lies between words of one span, cut from text."""

    def run(batches):
        for b in steps(batches):
            data, rows = raw(b.column("text"))
            _, start, end, first = words(data, rows, ALNUM, lower=True)
            texts = b.column("text").to_pylist()
            for r, spans in enumerate(b.column("hit_spans").to_pylist()):
                if spans:
                    text, at, parts = texts[r].encode(), 0, []
                    for x, y in np.frombuffer(spans, np.int64).reshape(-1, 2).tolist():
                        parts.append(text[at : start[first[r] + x] - rows[r]])
                        at = end[first[r] + y - 1] - rows[r]
                    texts[r] = b"".join([*parts, text[at:]]).decode()
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return map_batches(docs, run, docs.schema)


def op9_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))

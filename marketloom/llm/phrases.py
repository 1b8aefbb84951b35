"""Operator 8: recurring passages of words, confirmed by anchors and located with Aho-Corasick automata.

First phrases are confirmed: anchors (``anchors.py``) give pieces of consecutive windows; a piece that stands twice as a whole is a
phrase, one of each other kind is compared window by window, and its runs of recurring windows are phrases. Each
distinct phrase is kept once, with the bytes of one of its places. Then documents are dealt to slices of about 2 MB,
and each phrase to the slices that have a piece with its contents' hash. A slice's phrases are compiled to automata over numbers of words
(pyahocorasick), of a bounded number of words each, and all documents of the slice are streamed through all of them. The
occurrences found there, and nothing else, mark the words.

Defined cases: null text has no words; fewer words than a window lose nothing; of repeated rows, rows that share a doc_id, and rows of
null doc_id with the same text, all windows recur; very long texts are a slice's in one piece, while automata stay bounded; other
columns, also of clashing names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.anchors import SHARD_ANCHORS, packets, settle
from marketloom.llm.common import SPACED, map_batches, raw, release, repeat_rows, row_starts, signed, staged, steps, told_apart, window_hashes, words

WINDOW, GRAM = 35, 8
#: Bytes of documents in a slice, and words of phrases that one automaton holds.
SLICE_BYTES, AUTOMATON_WORDS = 2 << 20, 1 << 19
#: Bytes of documents in a partition of slices, up to so many partitions: beyond, they hold more slices, still one at a time.
PART_BYTES, MOST_PARTS = 12 << 20, 1 << 17


def word_units(batches):
    for b in steps(batches):
        h, _, _, first = words(*raw(b.column("text")), SPACED, lower=False)
        yield h, first, b.column("row_id").to_numpy()


def decide(doc, kind, at, count, kinds, several):
    """A piece recurs if it stands twice; one of each kind is compared if the anchor has other kinds."""
    twice = count[kind] > 1
    leader = np.zeros(len(doc), bool)
    leader[at] = True
    return twice, leader & (kinds > 1)


def cut(rows: DataFrame, window: int) -> DataFrame:
    """doc, low, sure, open and the bytes of each piece (low, high) of the rows' list ``pieces``."""

    def run(batches):
        for b in steps(batches):
            data, rows = raw(b.column("text"))
            _, start, end, first = words(data, rows, SPACED, lower=False)
            out = []
            for r, (i, own) in enumerate(zip(b.column("row_id").to_pylist(), b.column("pieces").to_pylist(), strict=True)):
                out += [(i, x["low"], x["sure"], x["open"], data[start[first[r] + x["low"]] : end[first[r] + x["high"] + window - 1]].tobytes()) for x in own]
            kinds = {"doc": pa.int64(), "low": pa.int32(), "sure": pa.bool_(), "open": pa.bool_(), "phrase": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds.values())], list(kinds))

    return map_batches(rows, run, "doc long, low int, sure boolean, open boolean, phrase binary")


def windows(pieces: DataFrame, window: int) -> DataFrame:
    """doc, low, at and h: place within its piece, and hash, of every window of the pieces."""

    def run(batches):
        for b in steps(batches, "phrase"):
            h, _, _, first = words(*raw(b.column("phrase")), SPACED, lower=False)
            start = row_starts(first, window)
            row = repeat_rows(first)[start]
            own = [b.column(x).to_numpy()[row] for x in ("doc", "low")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, own), pa.array((start - first[row]).astype(np.int32)), pa.array(signed(window_hashes(h, window)[start]))], ["doc", "low", "at", "h"])

    return map_batches(pieces, run, "doc long, low int, at int, h long")


def runs(pieces: DataFrame, window: int) -> DataFrame:
    """doc and phrase: the runs of consecutive windows that the list ``hits`` of a piece names."""

    def run(batches):
        for b in steps(batches, "phrase"):
            out = []
            for i, phrase, hits in zip(b.column("doc").to_pylist(), b.column("phrase").to_pylist(), b.column("hits").to_pylist(), strict=True):
                own, at = phrase.split(), np.sort(np.array(hits))
                new = np.flatnonzero(np.diff(at, prepend=-2) > 1)
                out += [(i, b" ".join(own[a : z + window])) for a, z in zip(at[new].tolist(), at[np.append(new[1:], len(at)) - 1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["doc", "phrase"])

    return map_batches(pieces, run, "doc long, phrase binary")


def automata(phrases: Iterable[list[int]], most: int = AUTOMATON_WORDS) -> Iterator:
    """Automata over numbers of words that together hold all phrases, each of at most ``most`` words or one phrase."""
    import ahocorasick

    made, held = None, 0
    for p in phrases:
        if made is not None and held + len(p) > most:
            made.make_automaton()
            yield made
            made = None
        if made is None:
            made, held = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), 0
        made.add_word(tuple(p), len(p))
        held += len(p)
    if made is not None:
        made.make_automaton()
        yield made


def located(texts: list[bytes], phrases: Iterable[bytes], most: int = AUTOMATON_WORDS) -> list[tuple[list[bytes], np.ndarray]]:
    """Each text's words, and which of them stand in an occurrence of a phrase."""
    number: dict[bytes, int] = {}
    coded = [[number.setdefault(w, len(number) + 1) for w in p.split()] for p in set(phrases)]
    pieces = [t.split() for t in texts]
    streams = [tuple([number.get(w, 0) for w in own]) if coded else () for own in pieces]
    change = [np.zeros(len(own) + 1, np.int64) for own in pieces]
    for automaton in automata(coded, most):
        for stream, c in zip(streams, change, strict=True):
            found = [(e + 1, n) for e, n in automaton.iter(stream)] if stream else []
            if found:
                end, size = np.array(found).T
                np.add.at(c, end - size, 1)
                np.subtract.at(c, end, 1)
    return [(own, np.cumsum(c)[:-1] > 0) for own, c in zip(pieces, change, strict=True)]


def phrase_table(docs: DataFrame, total: int, slice_of, window: int, gram: int) -> DataFrame:
    """slice and phrase: every distinct confirmed phrase of docs(row_id, text), for each slice that has a piece of its contents."""
    shards = max(8, int(total / 6 * 2 / (window - gram + 2)) // SHARD_ANCHORS)
    found = staged(settle(packets(docs, word_units, window, gram, shards), shards, decide, first=True), "pieces")
    # one place of each kind of piece: sure if the kind stands twice, open if it is to be compared with other kinds
    kinds = found.where("doc = first_doc and low = first_low").groupBy("doc", "low").agg(F.max("high").alias("high"), F.max(~F.col("open")).alias("sure"), F.max("open").alias("open"))
    own = kinds.groupBy(F.col("doc").alias("row_id")).agg(F.collect_list(F.struct("low", "high", "sure", "open")).alias("pieces"))
    pieces = staged(cut(docs.repartition(parts_of(total), "row_id").join(own, "row_id").select("row_id", "text", "pieces"), window), "phrases")
    compared = staged(windows(pieces.where("open").select("doc", "low", "phrase"), window), "windows")
    twice = compared.groupBy("h").count().where("count > 1").select("h")
    hits = compared.join(twice, "h").groupBy("doc", "low").agg(F.collect_list("at").alias("hits"))
    single = runs(pieces.where("open and not sure").join(hits, ["doc", "low"]).select("doc", "phrase", "hits"), window).select(slice_of("doc").alias("slice"), "phrase")
    places = found.where("not open").select(F.col("first_doc").alias("doc"), F.col("first_low").alias("low"), slice_of("doc").alias("slice")).distinct()
    return places.join(pieces.where("sure").select("doc", "low", "phrase"), ["doc", "low"]).select("slice", "phrase").unionByName(single)


def parts_of(total: int) -> int:
    return min(max(8, total // PART_BYTES), MOST_PARTS)


def remove_phrases(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept (words left, joined by one space). One row a row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if told_apart(docs):
        docs = docs.select(F.col("doc_id").alias("row_id"), "*")
    else:  # a number of its own for each row
        docs = staged(docs.select(F.monotonically_increasing_id().alias("row_id"), "*"), "numbered")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(8, total // SLICE_BYTES)

    def slice_of(row):
        return F.pmod(F.xxhash64(row), F.lit(slices))

    def run(own: pa.Table, phrases: pa.Table) -> pa.Table:
        out = []
        for pieces, hit in located([(x or "").encode() for x in own.column("text").to_pylist()], phrases.column("phrase").to_pylist()):
            left = [p for p, x in zip(pieces, hit.tolist(), strict=True) if not x] if hit.any() else pieces
            out.append((len(pieces), int(hit.sum()), b" ".join(left).decode()))
        made = pa.table([own.column("doc_id"), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_words", "n_removed", "kept"])
        release()
        return made

    phrases = phrase_table(docs.select("row_id", "text"), total, slice_of, window, gram)
    parts = parts_of(total)
    texts = docs.select(slice_of("row_id").alias("slice"), "doc_id", "text").repartition(parts, "slice").groupBy("slice")
    return texts.cogroup(phrases.repartition(parts, "slice").groupBy("slice")).applyInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op8_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

"""Operator 1: token ids of documents in files of frequency-ranked, byte-aligned variable-length codes.

A file holds one row a document, in ascending doc_id order over files and rows. An id is replaced by its rank by frequency
in the corpus, and a rank takes 1 to 4 bytes: the low bytes first, in ``data``, their number less one as 2 bits of
``control``, four to a byte. Reading back looks the lengths of four values up in a numpy table by their control byte.
The rank table, one row for each id of the vocabulary, lies beside the files.

Defined cases: null text counts as empty and gives the end id alone; repeated rows stay, each with its own place; rows of
equal doc_id are ordered by their ids; an empty table gives empty files; a null doc_id comes first.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import map_batches, offsets, raw, staged, steps, work_folder
from marketloom.llm.tokens import coder, vocabulary_path, vocabulary_size

END_ID = 1
#: Lengths of the four values of a control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def binary(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of the pieces of flat that end at ends."""
    size = flat.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((np.append(0, ends) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def encoded(docs: DataFrame, end_id: int, path: str, kind: str) -> DataFrame:
    """doc_id, ids (of the numpy type kind) of each whole text, end_id after them."""

    def run(batches):
        code = coder(path)
        for b in steps(batches):
            data, rows = raw(b.column("text"))
            ids, first = code.encode(data, rows)
            ids = np.insert(ids.astype(kind), first[1:], end_id)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), binary(ids, first[1:] + np.arange(1, len(first)))], ["doc_id", "ids"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids binary")


def id_counts(ids: DataFrame, kind: str) -> DataFrame:
    """id, n over all documents; each task adds up its own before the shuffle."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            now = np.bincount(raw_ids(b.column("ids"), kind)[0], minlength=len(total))
            now[: len(total)] += total
            total = now
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    return map_batches(ids.select("ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def raw_ids(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a binary column and each row's start in them."""
    at = offsets(column)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat.copy().view(kind), (at - at[0]) // np.dtype(kind).itemsize


def pack(ranks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes, their end for each row, data bytes, their end for each row."""
    extra = (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = -(-np.diff(first) // 4) * 4
    ends = np.cumsum(padded)
    codes = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    codes[np.arange(len(ranks)) + np.repeat(ends - padded - first[:-1], np.diff(first))] = extra
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    stop = np.concatenate((np.zeros(1, np.int64), np.cumsum(extra + 1)))
    data = np.zeros(int(stop[-1]), np.uint8)
    for k in range(4):
        has = extra >= k
        data[stop[:-1][has] + k] = ranks[has] >> np.uint32(8 * k) & np.uint32(0xFF)
    return control, ends // 4, data, stop[first[1:]]


def unpack(control: np.ndarray, data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The ranks of rows whose first values are at first; control bytes are whole for each row."""
    padded = -(-np.diff(first) // 4) * 4
    ends = np.cumsum(padded)
    length = LENGTHS[control].reshape(-1)[np.arange(int(first[-1])) + np.repeat(ends - padded - first[:-1], np.diff(first))]
    at = np.cumsum(length) - length
    out = np.zeros(len(length), np.uint32)
    for k in range(4):
        has = length > k
        out[has] |= data[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Write the ids of docs(doc_id, text) below folder: ``ranks`` and ``ids``."""
    spark = docs.sparkSession
    path = path or vocabulary_path()
    kind = "<u2" if max(vocabulary_size(path), end_id + 1) <= 1 << 16 else "<u4"
    ids = staged(encoded(docs, end_id, path, kind), "ids")
    counts = id_counts(ids, kind).toPandas().sort_values(["n", "id"], ascending=[False, True])  # a row for each id of the vocabulary at most
    by_rank = counts["id"].to_numpy()
    ranks = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    ranks[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    spark.createDataFrame([(k, int(i)) for k, i in enumerate(by_rank)], "rank long, id long").coalesce(1).write.parquet(f"{folder}/ranks")
    shared = spark.sparkContext.broadcast(ranks)

    def run(batches):
        shard, begin = TaskContext.get().partitionId(), 0
        for b in batches:
            if not b.num_rows:
                continue
            flat, first = raw_ids(b.column("ids"), kind)
            control, control_ends, data, data_ends = pack(shared.value[flat], first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(b.num_rows, shard, np.int32)), pa.array(begin + first[:-1]), b.column("doc_id"), pa.array(np.diff(first)), binary(control, control_ends), binary(data, data_ends)],
                ["shard", "shard_start", "doc_id", "n_values", "control", "data"],
            )
            begin += int(first[-1])

    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    map_batches(ordered, run, "shard int, shard_start long, doc_id long, n_values long, control binary, data binary").write.option("compression", "none").parquet(f"{folder}/ids")


def read_token_files(spark: SparkSession, folder: str, reduce_row=None, schema: str = "ids binary") -> DataFrame:
    """doc_id, start, n_tokens and the ids of every document; reduce_row turns a row's ids into the columns of schema."""
    files = spark.read.parquet(f"{folder}/ids")
    table = spark.read.parquet(f"{folder}/ranks").orderBy("rank").toPandas()["id"].to_numpy().astype("<u4")
    shared = spark.sparkContext.broadcast(table)
    names = [x.split()[0] for x in schema.split(",")]
    reduce_row = reduce_row or (lambda ids: (ids.tobytes(),))

    def run(batches):
        types = {"binary": pa.binary(), "long": pa.int64()}
        for b in batches:
            counts = b.column("n_values").to_numpy()
            first = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
            ids = shared.value[unpack(raw_bytes(b.column("control")), raw_bytes(b.column("data")), first)]
            out = [reduce_row(ids[x:y]) for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("shard"), b.column("shard_start"), b.column("doc_id"), b.column("n_values"), *(pa.array([x[k] for x in out], types[c.split()[1]]) for k, c in enumerate(schema.split(",")))],
                ["shard", "shard_start", "doc_id", "n_tokens", *names],
            )

    rows = map_batches(files, run, f"shard int, shard_start long, doc_id long, n_tokens long, {schema}")
    # a row a file: tokens in the files before it
    before = files.groupBy("shard").agg(F.sum("n_values").alias("n")).select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", *names)


def raw_bytes(column: pa.Array) -> np.ndarray:
    at = offsets(column)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_token_files(spark, folder, lambda ids: (zlib.crc32(ids.tobytes()),), "ids_crc32 long")

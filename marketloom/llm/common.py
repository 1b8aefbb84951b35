"""Helpers that the training-data operators share: work tables, Arrow batches, byte and word hashing.

Words and byte strings are hashed for a whole Arrow batch at once: prefix sums of ``value * r**position`` (mod 2**64)
give the hash of every substring with two array reads, so no Python loop runs per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step handles; a longer text is handled alone.
STEP_BYTES = 1 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
ASCII_SPACE = tuple(b"\x20\x09\x0a\x0b\x0c\x0d")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        base = tempfile.mkdtemp(prefix="spark-")  # tests on one machine; a cluster names a shared folder
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared work folder and read back: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def told_apart(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own."""
    return docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().where("count > 1 or doc_id is null").isEmpty()


def numbered(docs: DataFrame, apart: bool) -> DataFrame:
    """row_id and doc (all columns): the doc_id if it tells rows apart, else numbers in the order of doc_id, nulls last, and contents."""
    rows = docs.select(F.col("doc_id").cast("long").alias("row_id"), F.struct(*docs.columns).alias("doc"))
    if apart:
        return rows
    rows = rows.select("doc", F.col("row_id").alias("of"), F.xxhash64(F.to_json("doc")).alias("digest"), F.monotonically_increasing_id().alias("at"))
    return staged(rows.orderBy(F.col("of").asc_nulls_last(), "digest", "at").select(F.monotonically_increasing_id().alias("row_id"), "doc"), "numbered")


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with batches small enough for long texts, where the session leaves their bytes at Spark's default.

    What follows another such step at once runs in the same Python worker: a task then holds one worker, not two.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES) == "67108864b":
        conf.set(BATCH_BYTES, str(4 * STEP_BYTES))

    source, before = getattr(df, "_batches_of", (df, None))
    whole = function if before is None else lambda batches: function(before(batches))

    def run(batches):
        yield from whole(batches)
        release()

    out = source.mapInArrow(run, schema)
    out._batches_of = (source, whole)
    return out


def release() -> None:
    """Gives freed memory back to the system: a worker waits for its next task, maybe of another stage, with what it has kept."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do so themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def steps(batches, text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each, at least one row."""
    for batch in batches:
        ends = np.cumsum(offsets(batch.column(text))[1:] - offsets(batch.column(text))[:-1])
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's start in them; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    at = offsets(column)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_ROOT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ROOT, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), mod 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if size <= STEP_BYTES + 64:
            _powers[base] = have
    return have[:n]


def window_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive 64-bit values (also across rows; the caller drops those)."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_ROOT, len(values)), out=total[1:])
    return mix((total[n:] - total[:-n]) * powers(_INVERSE, len(values) - n + 1))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each values[start:end]."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_ROOT, len(values)), out=total[1:])
    inverse = powers(_INVERSE, len(values) + 1)
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if lower:
        values[65:91] = values[97:123]
    return values


VALUES = {False: byte_values(False), True: byte_values(True)}


def word_bytes(separators) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: `[^\x20\x09-\x0D]+`
SPACED = word_bytes(ASCII_SPACE)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z is lower-cased
ALNUM = word_bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def words(data: np.ndarray, rows: np.ndarray, table: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word, and each row's first word (one more entry than rows)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = table[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[rows] = False
    begin = inside & ~before
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside[1:]
    inner = rows[rows > 0]
    after[inner - 1] = False
    start, end = np.flatnonzero(begin), np.flatnonzero(inside & ~after) + 1
    return span_hashes(VALUES[lower][data], start, end), start, end, np.searchsorted(start, rows)


def repeat_rows(first: np.ndarray) -> np.ndarray:
    """The row of each item, from each row's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def row_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Positions of the windows of n items that stay within a row."""
    row = repeat_rows(first)
    at = np.arange(len(row))
    return at[at + n <= first[1:][row]]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def join_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans, sorted; touching spans merge."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    return start[new], np.concatenate((end[:-1][new[1:]], end[-1:]))

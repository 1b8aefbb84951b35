"""Operator 2: language by a byte convolutional network, written and trained in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, the maximum of each filter over a window goes
to a softmax. A text is cut into windows over its whole length (the last is padded); the log-probabilities of its windows,
weighted by their bytes, add up to the text's. The filters of all widths are one matrix, zero beyond their width, so a batch
of windows takes one product.

The network learns from a bounded sample: about ``SAMPLE`` documents of each language, chosen by a hash of their id, with one
slice of ``SLICE`` characters each, at a place that the hash chooses.

Defined cases: null text, or text without a letter (Unicode category L, so no digits or numerals), is ``und`` with score 0; repeated rows and rows of null
doc_id are handled each, the latter never learned from and never held out; ties go to the first language by name; very long texts are handled alone; with no
training rows every text is ``und``; with one language all texts with letters are that; an empty table gives no rows; clashing column names are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from marketloom.llm.common import map_batches, raw, steps

SAMPLE, SLICE = 1_200, 512
FOLDS = 3
WINDOW, DIM, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 12
NEW = ["lang_pred", "score"]
_LETTER = regex.compile(r"\p{L}")


class ByteNetwork:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embed = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.embed[0] = 0
        self.mask = np.concatenate([np.repeat(np.arange(max(WIDTHS)) < w, DIM)[:, None].repeat(FILTERS, 1) for w in WIDTHS], axis=1).astype(np.float32)
        self.filters = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(self.mask.shape[1], np.float32)
        self.out = rng.normal(0, 0.1, (self.mask.shape[1], len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """(windows * positions, width * DIM): the embedded bytes that each position's filters see."""
        e = self.embed[windows]
        wide = np.lib.stride_tricks.sliding_window_view(e, (max(WIDTHS), DIM), axis=(1, 2))
        return wide.reshape(-1, max(WIDTHS) * DIM)

    def pooled(self, patches: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        z = (patches @ self.filters).reshape(n, -1, self.mask.shape[1])
        return z, z.max(axis=1) + self.bias

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for at in range(0, len(windows), 128):
            some = windows[at : at + 128]
            _, top = self.pooled(self.patches(some), len(some))
            s = np.maximum(top, 0) @ self.out + self.out_bias
            out[at : at + 128] = s - s.max(axis=1, keepdims=True)
        return out - np.log(np.exp(out).sum(axis=1, keepdims=True))

    def fit(self, windows: np.ndarray, y: np.ndarray, rounds: int = 6, size: int = 64, seed: int = 7) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        names = ["embed", "filters", "bias", "out", "out_bias"]
        first, second, k = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
        for _ in range(rounds):
            order = rng.permutation(len(y))
            for at in range(0, len(y), size):
                w, label = windows[order[at : at + size]], y[order[at : at + size]]
                patches = self.patches(w)
                z, top = self.pooled(patches, len(w))
                hidden = np.maximum(top, 0)
                s = hidden @ self.out + self.out_bias
                p = np.exp(s - s.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(w)), label] -= 1
                p /= len(w)
                g_top = (p @ self.out.T) * (top > 0)
                best = z.argmax(axis=1) + np.arange(len(w))[:, None] * z.shape[1]  # the patch that each maximum came from
                seen = patches[best]  # (windows, filters, width * DIM)
                g_filters = np.einsum("bfd,bf->df", seen, g_top) * self.mask
                g_seen = (g_top[:, :, None] * (self.filters * self.mask).T[None]).reshape(-1, DIM)
                where = (best % z.shape[1])[:, :, None] + np.arange(max(WIDTHS))
                g_embed = np.zeros_like(self.embed)
                np.add.at(g_embed, w[np.arange(len(w))[:, None, None], where].reshape(-1), g_seen)
                g_embed[0] = 0
                k += 1
                for n, g in zip(names, (g_embed, g_filters, g_top.sum(axis=0), hidden.T @ p, p.sum(axis=0)), strict=True):
                    first[n] = 0.9 * first[n] + 0.1 * g
                    second[n] = 0.999 * second[n] + 0.001 * g * g
                    setattr(self, n, (getattr(self, n) - 0.01 * (first[n] / (1 - 0.9**k)) / (np.sqrt(second[n] / (1 - 0.999**k)) + 1e-8)).astype(np.float32))
        return self


def cut(data: np.ndarray, rows: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all rows (0 after the end), their row, and their bytes."""
    n = -(-np.diff(rows) // size)
    row = np.repeat(np.arange(len(n)), n)
    start = rows[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * size
    have = np.minimum(rows[1:][row] - start, size)
    padded = np.concatenate((data, np.zeros(size, np.uint8)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, size)[start]
    short = np.flatnonzero(have < size)
    windows[short] *= np.arange(size) < have[short][:, None]
    return windows, row, have


def train(docs: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> ByteNetwork | None:
    known = docs.where(F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % folds != 1))
    counts = known.groupBy("lang").count().toPandas()  # a row a language
    if not len(counts):
        return None
    part = docs.sparkSession.createDataFrame([(lang, max(1, int(n) // sample)) for lang, n in counts.itertuples(index=False)], "lang string, every long")
    h = F.xxhash64("doc_id")
    place = 1 + F.pmod(F.shiftright(h, 20), F.greatest(F.lit(1), F.length("text") - SLICE + 1))
    some = known.where("text is not null").join(F.broadcast(part), "lang").where(F.pmod(h, F.col("every")) == 0).select("lang", F.substring(F.col("text"), place.cast("int"), F.lit(SLICE)).alias("text"), h.alias("h"))
    rows = some.orderBy("h", "lang", "text").limit(2 * sample * len(part.columns) * max(2, len(counts))).collect()
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    parts = [r["text"].encode() for r in rows]
    windows, row, have = cut(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]))
    number = {x: k for k, x in enumerate(languages)}
    y = np.array([number[r["lang"]] for r in rows])[row]
    return ByteNetwork(languages).fit(windows, y)


def predict_language(docs: DataFrame, model: ByteNetwork | None) -> DataFrame:
    """docs with lang_pred and score, the probability of it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in NEW]
    schema = StructType([*kept, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        net = shared.value
        for b in steps(batches):
            lang, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            if net:
                windows, row, have = cut(*raw(b.column("text")))
                each = net.log_probabilities(windows) * (have / WINDOW)[:, None]
                total = np.stack([np.bincount(row, c, b.num_rows) for c in each.T], axis=1)
                p = np.exp(total - total.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                for r, text in enumerate(b.column("text").to_pylist()):
                    if text and _LETTER.search(text):
                        lang[r], score[r] = net.languages[best[r]], p[r, best[r]]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(lang, pa.string()), pa.array(score)], [f.name for f in schema.fields])

    return map_batches(docs, run, schema)


def op2_byte_network_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 1
    return predict_language(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")

"""Operator 3: toxic spans by a linear-chain conditional random field, documents by its marginals.

The chain has two tags (clean, toxic) over the letter words of a text. Only documents are labelled, so tokens get their
training tags from them: in toxic documents, words far more frequent there than in clean ones are toxic, all others clean.
Weights of words and of tag pairs are fitted in numpy by gradient on the exact likelihood (forward-backward). Marginals of a
whole text give its toxic spans and, by their sum, maximum and share, a logistic score fitted on the document labels.

The model learns from a bounded sample: ``SAMPLE`` labelled documents of each class, of at most ``SAMPLE_CHARS`` characters,
chosen by a hash of their id. Every text is scored whole.

Defined cases: null or empty text, or one without letters, gets the score of no evidence; repeated rows are scored each; a
sample without both classes gives the share of toxic labels (0 if there are none) to all; ties of the sample's order go by
doc_id; rows of null doc_id are never learned from and count as held out; very long texts are scored alone; an empty table gives no rows; input columns with the names of new ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from marketloom.llm.common import VALUES, map_batches, mix, raw, repeat_rows, span_hashes, steps, word_bytes, words

SAMPLE, SAMPLE_CHARS = 1_500, 20_000
FOLDS = 5
NEW = ["score", "predicted", "toxic_spans"]
LETTERS = word_bytes([x for x in range(128) if not chr(x).isalpha()])


#: Bytes of a word that a feature takes: from the front, or from the end where negative; 0: all.
CUTS = (0, 4, 5, 6, -5)


def token_features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A row of hashes for each cut."""
    values = VALUES[True][data]
    spans = [(start, end) if not c else (start, np.minimum(end, start + c)) if c > 0 else (np.maximum(start, end + c), end) for c in CUTS]
    return np.stack([span_hashes(values, x, y) ^ np.uint64(7919 * k) for k, (x, y) in enumerate(spans)])


class Batch:
    """Words of texts as numbers of their features (0: unknown), in order of falling length for the recursions."""

    def __init__(self, number: np.ndarray, first: np.ndarray):
        self.number, self.first, self.sizes = number, first, np.diff(first)
        order = np.argsort(-self.sizes, kind="stable")
        self.start, falling = first[:-1][order], self.sizes[order]
        top = int(falling[0]) if len(falling) else 0
        self.live = np.searchsorted(-falling, -np.arange(top), side="left")  # rows longer than t
        self.falling = falling

    def odds(self, d: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward odds (toxic to clean, up to each word) and backward odds (after it)."""
        e = np.exp(np.clip(d, -30, 30))
        (a, b), (c, f) = np.exp(pairs)
        ahead, back = np.empty(len(d)), np.ones(len(d))
        for t, n in enumerate(self.live.tolist()):
            at = self.start[:n] + t
            r = ahead[at - 1] if t else None
            ahead[at] = e[at] * ((b + f * r) / (a + c * r) if t else 1.0)
        for t in range(len(self.live) - 2, -1, -1):
            at = self.start[: self.live[t + 1]] + t
            x = e[at + 1] * back[at + 1]
            back[at] = (c + f * x) / (a + b * x)
        return ahead, back


class ToxicChain:
    def __init__(self) -> None:
        self.vocabulary = np.zeros(0, np.uint64)
        self.word = np.zeros(1)
        self.pairs = np.zeros((2, 2))
        self.weights = np.zeros(4)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(h.shape, np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0).astype(np.int32)

    def odds(self, batch: Batch) -> np.ndarray:
        """Logarithm of each word's own odds to be toxic."""
        d = self.word[batch.number[0]]
        for x in batch.number[1:]:
            d += self.word[x]
        return d

    def fit(self, h: np.ndarray, first: np.ndarray, toxic: np.ndarray, share: float, rounds: int = 60) -> ToxicChain:
        row = repeat_rows(first)
        before = np.append(np.zeros(1, np.uint64), h[0][:-1])
        before[first[:-1][np.diff(first) > 0]] = 0
        names, marks = [], []
        for own in h:
            _, at = np.unique(mix(own) + before, return_index=True)  # one of each feature and word before it
            name, number, n = np.unique(own[at], return_inverse=True, return_counts=True)
            bad = np.bincount(number, toxic[row[at]], len(n))
            rate, p = bad.sum() / max(1, n.sum()), bad / n
            gain = 2 * (bad * np.log(np.maximum(p, 1e-9) / max(rate, 1e-9)) + (n - bad) * np.log(np.maximum(1 - p, 1e-9) / max(1 - rate, 1e-9)))
            names.append(name[n >= 3])
            marks.append(((p > 0.9) & (gain >= 25))[n >= 3])
        order = np.argsort(np.concatenate(names))
        self.vocabulary, marked = np.concatenate(names)[order], np.append(False, np.concatenate(marks)[order])
        batch = Batch(np.stack([self.numbers(x) for x in h]), first)
        del h, own, before, at, name, number
        tag = marked[batch.number].any(axis=0) & (toxic[row] == 1)
        follows = np.flatnonzero(row[1:] == row[:-1])
        self.word = np.zeros(len(self.vocabulary) + 1)
        step_word, step_pairs = np.full_like(self.word, 1e-8), np.full((2, 2), 1e-8)
        seen_pairs = np.array([[np.sum(~tag[follows] & ~tag[follows + 1]), np.sum(~tag[follows] & tag[follows + 1])], [np.sum(tag[follows] & ~tag[follows + 1]), np.sum(tag[follows] & tag[follows + 1])]], float)
        for _ in range(rounds):
            d = self.odds(batch)
            ahead, back = batch.odds(d, self.pairs)
            p = ahead * back / (1 + ahead * back)
            g = -0.05 * self.word
            for x in batch.number:
                g += np.bincount(x, tag - p, len(self.word))
            g[0] = 0 if len(g) > 1 else g[0]
            r, x = ahead[follows], np.exp(np.clip(d[follows + 1], -30, 30)) * back[follows + 1]
            (a, b), (c, f) = np.exp(self.pairs)
            every = 1 / (a + b * x + c * r + f * r * x)
            gp = seen_pairs - np.array([[a * every.sum(), b * (x @ every)], [c * (r @ every), f * ((r * x) @ every)]]) - 0.05 * self.pairs
            step_word, step_pairs = step_word + g * g, step_pairs + gp * gp  # adaptive steps
            self.word += 0.7 * g / np.sqrt(step_word)
            self.pairs += 0.3 * gp / np.sqrt(step_pairs)
        x, w = self.evidence(batch, self.marginals(batch)), np.where(toxic == 1, share / max(toxic.mean(), 1e-9), (1 - share) / max(1 - toxic.mean(), 1e-9))
        for _ in range(60):  # Newton steps of a ridge logistic
            p = 1 / (1 + np.exp(-x @ self.weights))
            g = x.T @ (w * (p - toxic)) + 0.1 * self.weights
            self.weights -= np.linalg.solve((x.T * (w * p * (1 - p))) @ x + 0.1 * np.eye(4), g)
        return self

    def marginals(self, batch: Batch) -> np.ndarray:
        ahead, back = batch.odds(self.odds(batch), self.pairs)
        return ahead * back / (1 + ahead * back)

    @staticmethod
    def evidence(batch: Batch, p: np.ndarray) -> np.ndarray:
        total = np.concatenate((np.zeros(1), np.cumsum(p)))
        sums, most = total[batch.first[1:]] - total[batch.first[:-1]], np.zeros(len(batch.sizes))
        full = batch.sizes > 0
        if full.any():
            most[full] = np.maximum.reduceat(p, batch.first[:-1][full])
        return np.stack((np.ones(len(sums)), np.log1p(np.maximum(sums, 0)), most, sums / np.maximum(batch.sizes, 1)), axis=1)

    def score(self, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        p = self.marginals(batch)
        return 1 / (1 + np.exp(-self.evidence(batch, p) @ self.weights)), p


def blob(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [x.encode() for x in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS, folds: int = FOLDS) -> ToxicChain:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0)
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    model, share = ToxicChain(), counts.get(1, 0) / max(1, sum(counts.values()))
    some = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect() for k in (0, 1)]
    chosen = docs.sparkSession.createDataFrame([tuple(r) for rows in some for r in rows], "doc_id long, toxic int")  # 2 * sample rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= sample_chars).join(F.broadcast(chosen), "doc_id")
    rows = texts.select("text", "toxic").limit(4 * sample).collect()
    toxic = np.array([r[1] for r in rows], float)
    if len(rows) < 2 or toxic.min() == toxic.max():
        model.weights[0] = np.log((share + 1e-9) / (1 - share + 1e-9))
        return model
    h, sizes = [], [np.zeros(1, np.int64)]
    for k in range(0, len(rows), 100):
        data, at = blob([r[0] for r in rows[k : k + 100]])
        _, start, end, first = words(data, at, LETTERS, lower=True)
        h.append(token_features(data, start, end))
        sizes.append(np.diff(first))
    return model.fit(np.concatenate(h, axis=1), np.cumsum(np.concatenate(sizes)), toxic, share)


def score_toxicity(docs: DataFrame, model: ToxicChain, spans: bool = True) -> DataFrame:
    """docs with score, predicted (1 from 0.5 on) and toxic_spans (code points, end exclusive)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in NEW]
    span = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
    schema = StructType([*kept, StructField("score", DoubleType()), StructField("predicted", IntegerType())] + [StructField("toxic_spans", span)] * spans)
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        chain = shared.value
        for b in steps(batches):
            data, rows = raw(b.column("text"))
            _, start, end, first = words(data, rows, LETTERS, lower=True)
            score, p = chain.score(Batch(np.stack([chain.numbers(x) for x in token_features(data, start, end)]), first))
            new = [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            if spans:
                found: list[list[dict]] = [[] for _ in range(b.num_rows)]
                at = np.flatnonzero(p >= 0.5)
                chars = np.concatenate((np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80))) if len(at) else rows
                row = np.searchsorted(first, at, side="right") - 1
                for r, x, y in zip(row.tolist(), start[at].tolist(), end[at].tolist(), strict=True):
                    base = int(chars[rows[r]])
                    found[r].append({"start": int(chars[x]) - base, "end": int(chars[y]) - base})
                new.append(pa.array(found, arrow))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *new], [f.name for f in schema.fields])

    return map_batches(docs, run, schema)


def op3_toxic_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0
    return score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "toxic_spans")

"""Operator 12: collocations, phrases of two to four words that stand together more often than their parts make likely.

Counting goes by levels, and each level keeps only what the one before leaves possible. Words are counted first, then pairs of
frequent words. Suffix pointers remain: places whose two pairs at least are frequent, cut after the last frequent pair or at four
words. They are routed to shards by their two leading words; the few pairs with more than a set share of all places
are dealt over shards by their other words too, so that no pair fills a task. In a shard the pointers pass a multikey three-way quicksort
(``phrase_counts``): equal parts go on to the next word, their sizes are the counts, and parts too small for any
candidate are abandoned. What tasks know of the frequent words and pairs is a table of bits of bounded size; a false mark costs
time, no result. Scores, the lowest cut and containment are joins of the counted phrases, exact in decimal numbers.

Defined cases: null text has no words, null lang is ``und``; repeated rows count again; a very long text is handled alone; a
language without a candidate has no rows; ties are settled to the end by the phrase; an empty table gives no rows; other
columns are not read. Words are told apart by their text, within a task by 64 bits of hash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import ASCII_SPACE, VALUES, map_batches, mix, raw, repeat_rows, span_hashes, staged, steps, word_bytes, words

LEAST, MOST_WORDS, TOP = 30, 4, 2000
INSIDE = (80, 100)
SCALE = 2_000_000
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
WORD = word_bytes([*ASCII_SPACE, *PIECE_ENDS])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Text that one task combines at once; places a shard is meant to hold; rows below which a part is sorted at once.
COMBINE_BYTES, SHARD_PLACES, SMALL = 2 << 20, 1 << 20, 2048
#: Bits of a table of marks at most (16 MB), and for each marked phrase.
MOST_BITS, BITS_EACH = 1 << 27, 16
#: A pair with more than this share of all places is dealt by its other words too: so there are fewer than that many.
HOT_SHARE = 4096


def lang_keys(langs: pa.Array) -> tuple[np.ndarray, list[str]]:
    """The number of each row's language in the batch, and the languages."""
    coded = langs.dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary.to_pylist()


def seeds(names: list[str]) -> np.ndarray:
    data = [np.frombuffer(f"{x} ".encode(), np.uint8) for x in names]
    ends = np.cumsum([len(x) for x in data])
    joined = np.concatenate(data) if data else np.zeros(0, np.uint8)
    return span_hashes(VALUES[False][joined], ends - [len(x) for x in data], ends) if data else np.zeros(0, np.uint64)


def keys(seed: np.ndarray, *hashes: np.ndarray) -> np.ndarray:
    """One key for a language and its words in order."""
    out = seed
    for h in hashes:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h)
    return out


class Text:
    """Words of a batch of rows: hash h, span, row, language and whether the next word follows in the same piece."""

    def __init__(self, batch: pa.RecordBatch):
        data, rows = raw(batch.column("text"))
        self.data = LOWER[data]
        self.h, self.start, self.end, first = words(data, rows, WORD, True)
        row = repeat_rows(first)
        code, self.langs = lang_keys(batch.column("lang"))
        self.lang = code[row]
        self.seed = seeds(self.langs)[self.lang]
        ends = np.zeros(256, bool)
        ends[list(PIECE_ENDS)] = True
        piece = np.cumsum(ends[data], dtype=np.int32)[self.start] if len(data) else np.zeros(0, np.int64)
        self.joint = np.zeros(len(self.h), bool)
        self.joint[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])

    def words(self, at: np.ndarray) -> pa.Array:
        size = self.end[at] - self.start[at]
        ends = np.concatenate(([0], np.cumsum(size)))
        took = self.data[np.repeat(self.start[at] - ends[:-1], size) + np.arange(ends[-1])]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(took.tobytes()))

    def phrases(self, at: np.ndarray, size: np.ndarray) -> pa.Array:
        """The size[i] words from word at[i] on, joined by one space."""
        ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        each = np.repeat(at - ends[:-1], size) + np.arange(ends[-1])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), self.words(each)), " ")

    def counted(self, at: np.ndarray, size: np.ndarray, also: dict[str, np.ndarray] | None = None) -> pa.RecordBatch:
        """lang, phrase and n of the phrases of size[i] words at word at[i]; equal ones together."""
        most = int(size.max(initial=1))
        columns = [np.where(size > j, self.h[np.minimum(at + j, len(self.h) - 1)], 0) for j in range(most)]
        key = keys(self.seed[at], *columns)
        order = np.argsort(key, kind="stable")
        at, size = at[order], size[order]
        new = np.ones(len(at), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        for x in (self.lang[at], *(c[order] for c in columns)):
            new[1:] |= x[1:] != x[:-1]
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(at)))
        lang = pa.array(self.langs, pa.string()).take(pa.array(self.lang[at[begin]]))
        more = {k: pa.array(v[order][begin]) for k, v in (also or {}).items()}
        return pa.RecordBatch.from_arrays([lang, self.phrases(at[begin], size[begin]), pa.array(n.astype(np.int64)), *more.values()], ["lang", "phrase", "n", *more])


class Marks:
    """Bits at the keys of phrases. A marked phrase may be absent, an unmarked one is."""

    def __init__(self, bits: int, blocks: list):
        self.mask = np.uint64(bits - 1)
        self.bytes = np.zeros(bits // 8, np.uint8)
        for block, packed in blocks:
            part = np.frombuffer(zlib.decompress(packed), np.uint8)
            self.bytes[block * BLOCK : block * BLOCK + len(part)] = part

    def __call__(self, key: np.ndarray) -> np.ndarray:
        bit = key & self.mask
        return (self.bytes[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


BLOCK = 1 << 13


def phrase_keys(batch: pa.RecordBatch) -> np.ndarray:
    """Keys of a batch's (lang, phrase), all phrases of one number of words."""
    data, rows = raw(batch.column("phrase"))
    h, _, _, first = words(data, rows, WORD, False)
    code, langs = lang_keys(batch.column("lang"))
    size = int(np.diff(first).max(initial=0))
    return keys(seeds(langs)[code], *(h[first[:-1] + j] for j in range(size)))


def marks(phrases: DataFrame, n: int) -> Marks:
    """Marks of (lang, phrase), n of them. Tasks set the bits of a block each; the driver gets MOST_BITS bits at most."""
    bits = BLOCK * 8
    while bits < min(MOST_BITS, n * BITS_EACH):
        bits *= 2

    def places(batches):
        for batch in batches:
            if batch.num_rows:
                bit = (phrase_keys(batch) & np.uint64(bits - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bit // (BLOCK * 8)), pa.array(bit % (BLOCK * 8))], ["block", "bit"])

    def packed(batches):
        block = None
        for batch in batches:
            b, bit = np.asarray(batch.column("block")), np.asarray(batch.column("bit"))
            ends = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1), len(b)] if len(b) else [0]
            for low, high in zip(ends[:-1], ends[1:], strict=True):
                if b[low] != block:
                    if block is not None:
                        yield row(block, own)
                    block, own = b[low], np.zeros(BLOCK * 8, bool)
                own[bit[low:high]] = True
        if block is not None:
            yield row(block, own)

    def row(block, own):
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([zlib.compress(np.packbits(own, bitorder="little").tobytes(), 1)], pa.binary())], ["block", "packed"])

    at = map_batches(phrases.select("lang", "phrase"), places, "block long, bit long").distinct()
    return Marks(bits, map_batches(at.repartition("block").sortWithinPartitions("block"), packed, "block long, packed binary").collect())


def summed(counts: DataFrame, least: int) -> DataFrame:
    return counts.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase (a word; null: all words) and n, for each batch."""

    def run(batches):
        for batch in steps(batches, limit=COMBINE_BYTES):
            text = Text(batch)
            at = np.arange(len(text.h))
            yield text.counted(at, np.ones(len(at), np.int64))
            n = np.bincount(text.lang, minlength=len(text.langs))
            yield pa.RecordBatch.from_arrays([pa.array(text.langs, pa.string()), pa.nulls(len(n), pa.string()), pa.array(n.astype(np.int64))], ["lang", "phrase", "n"])

    return map_batches(docs, run, "lang string, phrase string, n long")


def pair_counts(docs: DataFrame, frequent) -> DataFrame:
    """lang, phrase and n of pairs of marked words."""

    def run(batches):
        for batch in steps(batches, limit=COMBINE_BYTES):
            text = Text(batch)
            good = frequent.value(keys(text.seed, text.h))
            at = np.flatnonzero(text.joint & good & np.roll(good, -1))
            if len(at):
                yield text.counted(at, np.full(len(at), 2))

    return map_batches(docs, run, "lang string, phrase string, n long")


def suffixes(docs: DataFrame, frequent, hot, shards: int) -> DataFrame:
    """lang, phrase (three words or four, all pairs marked), n and route: the shard of the two leading words, or below 0, of all words."""

    def run(batches):
        for batch in steps(batches, limit=COMBINE_BYTES):
            text = Text(batch)
            n = len(text.h)
            if n < 3:
                continue
            pair = np.zeros(n, np.uint64)
            pair[:-1] = keys(text.seed[:-1], text.h[:-1], text.h[1:])
            good = text.joint & frequent.value(pair)
            at = np.flatnonzero(good[:-1] & good[1:])
            if not len(at):
                continue
            size = 3 + np.append(good, False)[at + 2]
            whole = keys(pair[at], text.h[at + 2], np.where(size > 3, text.h[np.minimum(at + 3, n - 1)], 0))
            route = np.where(np.isin(pair[at], hot.value), -1 - (whole % np.uint64(shards)).astype(np.int64), (pair[at] % np.uint64(shards)).astype(np.int64))
            yield text.counted(at, size, {"route": route})

    return map_batches(docs, run, "lang string, phrase string, n long, route long")


def phrase_counts(columns: list[np.ndarray], weight: np.ndarray, least: list[int]) -> list[tuple[int, int, int]]:
    """(row, depth, count) of every prefix of columns[:depth] with a count of least[depth - 1] or more; row is one that has it.

    A multikey three-way quicksort of row pointers. A part that can't reach what all its depths ask is abandoned; small parts
    are sorted at once. Values below 0 end a row.
    """
    found, depths = [], len(columns)
    floor = [min(least[d:]) for d in range(depths)]
    stack = [(np.arange(len(weight)), 0)]
    while stack:
        part, depth = stack.pop()
        if not len(part) or weight[part].sum() < floor[depth]:
            continue
        if len(part) <= SMALL:
            found += small_counts(columns, weight, least, part, depth)
            continue
        value = columns[depth][part]
        pivot = np.partition(value[:: max(1, len(value) // 64)], 32)[32] if len(value) > 64 else value[len(value) // 2]
        equal = value == pivot
        stack += [(part[value < pivot], depth), (part[value > pivot], depth)]
        if pivot < 0:
            continue
        part = part[equal]
        n = int(weight[part].sum())
        if n >= least[depth]:
            found.append((int(part[0]), depth + 1, n))
        if depth + 1 < depths:
            stack.append((part, depth + 1))
    return found


def small_counts(columns, weight, least, part, depth) -> list[tuple[int, int, int]]:
    part = part[np.lexsort([c[part] for c in reversed(columns[depth:])])]
    new, found = np.zeros(len(part), bool), []
    new[0] = True
    for d in range(depth, len(columns)):
        value = columns[d][part]
        new[1:] |= value[1:] != value[:-1]
        begin = np.flatnonzero(new)
        n = np.add.reduceat(weight[part], begin)
        good = (n >= least[d]) & (value[begin] >= 0)
        found += zip(part[begin[good]].tolist(), [d + 1] * int(good.sum()), n[good].tolist(), strict=True)
    return found


def longer_counts(sent: DataFrame, parts: int, least: int) -> DataFrame:
    """lang, phrase and n of phrases of three and four words; where a pair was dealt by all its words, phrases of three come in parts."""

    def shard(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        split = pc.split_pattern(batch.column("phrase"), " ")
        size = np.asarray(split.value_lengths())
        all_ = split.flatten()
        coded = np.asarray(all_.dictionary_encode().indices)
        first = np.cumsum(size) - size
        columns = [np.asarray(batch.column("lang").dictionary_encode().indices)]
        columns += [np.where(size > j, coded[np.minimum(first + j, len(coded) - 1)], -1) for j in range(MOST_WORDS)]
        weight = np.asarray(batch.column("n"))
        dealt = batch.column("route")[0].as_py() < 0
        never = 1 << 62  # languages, words and pairs are counted already
        found = phrase_counts(columns, weight, [never, never, never, 1 if dealt else least, least])
        if not found:
            return None
        row, depth, n = (np.array(x) for x in zip(*found, strict=True))
        depth -= 1
        ends = np.concatenate(([0], np.cumsum(depth))).astype(np.int32)
        each = np.repeat(first[row] - ends[:-1], depth) + np.arange(ends[-1])
        phrase = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), all_.take(pa.array(each))), " ")
        return pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(row)), phrase, pa.array(n.astype(np.int64))], ["lang", "phrase", "n"])

    def run(batches):
        waiting, route = [], None

        def done():
            table = pa.Table.from_batches(waiting).combine_chunks().to_batches(max_chunksize=1 << 40)
            out = shard(table[0])
            return [out] if out is not None else []

        for batch in batches:
            r = np.asarray(batch.column("route"))
            ends = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1), len(r)] if len(r) else [0]
            for low, high in zip(ends[:-1], ends[1:], strict=True):
                if waiting and r[low] != route:
                    yield from done()
                    waiting = []
                route = r[low]
                waiting.append(batch.slice(low, high - low))
        if waiting:
            yield from done()

    dealt = sent.repartition(parts, "route").sortWithinPartitions("route")
    return map_batches(dealt, run, "lang string, phrase string, n long")


def counted_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of one to four words with f >= least, and (lang, n) of docs(lang, text)."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    singles = staged(summed(word_counts(docs), 1).where((F.col("f") >= least) | F.col("phrase").isNull()), "words")
    totals = singles.where("phrase is null").select("lang", F.col("f").alias("n"))
    singles = singles.where("phrase is not null")
    pairs = staged(summed(pair_counts(docs, sc.broadcast(marks(singles, singles.count()))), least), "pairs")
    n, places = pairs.agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first()
    shards = max(1, -(-places // SHARD_PLACES))
    hot = pairs.where(F.col("f") > max(SHARD_PLACES, places // HOT_SHARE)).select("lang", "phrase").toArrow().to_batches()
    hot = np.concatenate([phrase_keys(b) for b in hot if b.num_rows] or [np.zeros(0, np.uint64)])
    sent = suffixes(docs, sc.broadcast(marks(pairs, n)), sc.broadcast(hot), shards)
    parts = max(min(shards, 1 << 17), int(spark.conf.get("spark.sql.shuffle.partitions")))
    longer = summed(longer_counts(sent, parts, least), least)
    return staged(singles.unionByName(pairs).unionByName(longer), "phrases"), totals


def within(words_: Column, least: int) -> Column:
    """All runs of least or more words of an array, but the whole."""
    size = F.size(words_)
    runs = [F.when((size >= a + n) & (size > n), F.array_join(F.slice(words_, a + 1, n), " ")) for n in range(least, MOST_WORDS) for a in range(MOST_WORDS - n + 1)]
    return F.array_compact(F.array(*runs))


def exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def scored(counted: DataFrame, inside: tuple[int, int] = INSIDE) -> DataFrame:
    """lang, phrase, a, l, r and score (of the lowest cut) of all candidates that no longer one makes needless."""
    counted = counted.withColumn("words", F.split("phrase", " "))
    cands = counted.where(F.size("words") > 1).withColumnRenamed("f", "a")
    cuts = cands.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    both = F.array(F.struct(F.lit(True).alias("left"), F.slice("words", 1, F.col("k")).alias("part")), F.struct(F.lit(False).alias("left"), F.expr("slice(words, k + 1, size(words) - k)").alias("part")))
    parts = cuts.select("lang", "phrase", "a", "k", F.inline(both)).withColumn("part", F.array_join("part", " "))
    found = parts.join(counted.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    sides = found.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    sides = sides.withColumns({"by": exact("l") + exact("r"), "times": exact("a") * F.lit(SCALE).cast("decimal(8,0)")}).withColumn("score", F.expr("times div by"))
    best = sides.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    holds = cands.select("lang", F.col("a").alias("f"), F.explode(within(F.col("words"), 2)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    rows = best.join(holds, ["lang", "phrase"], "left").where(F.col("f").isNull() | (exact("f") * inside[1] < exact("a") * inside[0]))
    return rows.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def first_of_each(rows: DataFrame, top: int) -> DataFrame:
    """rows with rank, the first of each language: first those of each of its parts, so no language's rows meet in one task."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    some = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("part")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: tuple[int, int] = INSIDE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first collocations of each language of docs(lang, text)."""
    counted, totals = counted_phrases(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), least)
    return first_of_each(scored(counted, inside), top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
runs AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs_ AS (SELECT lang, w FROM runs WHERE len(w) > 0),
grams AS (
  SELECT lang, m, array_to_string(w[k : k + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM runs_, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang),
cands AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND f >= 30),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS x, array_to_string(w[k + 1 : m], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM cands)),
priced AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a // (l.f + r.f))::BIGINT AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.x JOIN counts r ON r.lang = c.lang AND r.phrase = c.y),
best AS (SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
subs AS (
  SELECT DISTINCT lang, a AS f, array_to_string(w[s : s + n - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, m - n + 2)) AS s FROM cands, (SELECT unnest([2, 3]) AS n) WHERE n < m)),
held AS (SELECT lang, phrase, max(f) AS f FROM subs GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase WHERE h.f IS NULL OR 100 * h.f < 80 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

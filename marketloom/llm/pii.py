"""Operator 10: personal data by rules and by boosted trees over candidate spans.

Rules (``RULES`` and their checks) give the base spans; those always stand. Generators of high recall propose more spans, which
may overlap: addresses with a spelled-out sign, numbers with other separators or without a plus, and secrets such as access
tokens. Boosted trees score each by its format and context. They are trained here on a bounded sample of documents: its own
candidates, and one passage planted in each (``planted``), which is personal data in a form that the rules miss, or only looks
like some. Own candidates that the rules miss count as negative, but for spelled-out addresses and assigned secrets, which
aren't used. Scores are calibrated on documents held out from the training, and a kind's threshold is the lowest that keeps
``PRECISION`` there. Candidates above it that touch no base span are added, the best of overlapping ones first.

Defined cases: null text counts as empty and has no spans; repeated rows are handled each; very long texts, and runs without
a break in them, take time in proportion to their length; of overlapping candidates with one score the first proposed stands;
without candidates of both labels in the sample, as in an empty table, no span is added to the base ones; input columns with
the names of new ones are replaced.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from marketloom.llm.boosting import BoostedTrees
from marketloom.llm.common import map_batches, steps

KINDS = ["email", "ip", "card", "phone"]
ALL = [*KINDS, "secret"]
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
RULES = {
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),  # a match can't begin within digits, or it would have begun before
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
AT = re.compile(r" ?(?:@|\(at\)|\[at\]) ?")
WIDE_HOST = re.compile(r"[A-Za-z0-9-]{1,64}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,64})+")
GENERATORS = {
    "ip": re.compile(r"[0-9]{1,4}(?:\.[0-9]{1,4}){2,5}"),
    "card": re.compile(r"[0-9](?:[ ./-]{0,2}[0-9]){10,20}"),
    "phone": re.compile(r"(?:\+|\(|00)?[0-9][0-9 ().\-]{5,18}[0-9]"),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"),
}
WORDS = {
    "email": re.compile(r"(?i)mail|contact|write"), "ip": re.compile(r"(?i)\bip\b|host|server|address"), "card": re.compile(r"(?i)card|visa|pay|account"),
    "phone": re.compile(r"(?i)call|phone|tel|mobile|fax|contact"), "secret": re.compile(r"(?i)token|key|secret|passw|pwd|auth|bearer"),
}
ASSIGNED = re.compile(r"(?i)(?:token|key|secret|password|passwd|pwd|auth|bearer)[\"']? ?[=: ] ?[\"']?$")
#: Documents of the training sample, candidates of it, and the precision that thresholds keep on held-out documents.
SAMPLE_DOCS, SAMPLE_CANDIDATES, PRECISION = 6_000, 30_000, 0.995
NEW = [*(f"n_{k}" for k in KINDS), "base_spans", "spans"]
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def stands(kind: str, found: str) -> bool:
    """Whether a match of a rule passes its check."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in found.split("."))
    n = sum(map(found.count, "0123456789"))
    return 9 <= n <= 15 if kind == "phone" else 13 <= n <= 19 and luhn(re.sub("[^0-9]", "", found))


def emails(text: str) -> list[tuple[int, int]]:
    """`[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, leftmost and non-overlapping. Each sign looks left no further than to
    the one before, so long runs take linear time."""
    out, begin = [], 0
    at = text.find("@")
    while at >= 0:
        before = text[begin:at]
        local = len(before) - len(before.rstrip(LOCAL))
        host = HOST.match(text, at + 1) if local else None
        begin = at + 1
        if host:
            out.append((at - local, host.end()))
            begin = host.end()
        at = text.find("@", begin)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    digit = _DIGIT.search(text)
    has = {"ip": digit and "." in text, "card": digit, "phone": digit and "+" in text}
    return {"email": emails(text)} | {k: [m.span() for m in RULES[k].finditer(text) if stands(k, m[0])] if has[k] else [] for k in KINDS[1:]}


def candidates(text: str) -> list[tuple[int, int, int]]:
    """kind, start, end of every proposal."""
    out, begin = [], 0
    if "@" in text or "(at)" in text or "[at]" in text:
        for m in AT.finditer(text):
            before = text[begin : m.start()]
            local = min(64, len(before) - len(before.rstrip(LOCAL)))
            host = WIDE_HOST.match(text, m.end()) if local else None
            if host:
                out.append((0, m.start() - local, host.end()))
            begin = m.end()
    if _DIGIT.search(text):
        out += [(k, *m.span()) for k, kind in enumerate(ALL) if k for m in GENERATORS[kind].finditer(text) if kind != "secret" or _DIGIT.search(m[0])]
    return out


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    found, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 2]
    all_digits = re.sub("[^0-9]", "", found)
    digits, letters = len(all_digits), sum(map(str.isalpha, found))
    runs = [len(x) for x in re.findall("[0-9]+", found)] or [0]
    side = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4
    return [
        *(float(kind == k) for k in range(len(ALL))), len(found), digits, len(runs), max(runs), min(runs), runs[0], runs[-1],
        found.count(" "), found.count("."), found.count("-"), found.count("("), found.count("@"), found.count("/"), float(found[0] == "+"), float(before[-1:] == "+"),
        side(before[-1:]), side(after[:1]), side(after[1:]), float(bool(WORDS[ALL[kind]].search(before))), float(digits and found[0] in "3456"),
        letters, len(set(found)), float("(at)" in found or "[at]" in found), float(bool(ASSIGNED.search(before))), float(13 <= digits <= 19 and luhn(all_digits)),
    ]


def planted(rng: random.Random) -> tuple[str, str, str, int, bool]:
    """Words before, the passage itself, words after, its kind, and whether it is personal data, all drawn at random."""
    some = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    digits = lambda n: some("0123456789", n)
    name, host, kind, real = some("abcdefghijklmnoprstuvwy", rng.randint(3, 9)), some("abcdefghiklmnoprstuw", rng.randint(3, 10)), rng.randrange(5), rng.random() < 0.5
    if kind == 0:
        sign, dot = rng.choice([" (at) ", "(at)", "[at]", " [at] "]), rng.choice([".", " (dot) ", "[dot]", "(dot)"])
        return ("write to ", f"{name}{sign}{host}{dot}example", " soon", kind, True) if real else ("meet ", f"{name} @ {digits(2)}.{digits(2)}", " today", kind, False)
    if kind == 1:
        return rng.choice(["version ", "build ", "section "]), ".".join(digits(rng.randint(1, 3)) for _ in range(rng.choice([3, 5, 6]))), " of", kind, False
    if kind == 2:
        mark, body = rng.choice([".", "/", "  ", "", "-"]), rng.choice("3456") + digits(14)
        body += next(c for c in "0123456789" if luhn(body + c) == real)
        return rng.choice(["card ", "paid with ", "", "order "]), mark.join(body[k : k + 4] for k in range(0, 16, 4)), " and", kind, real and mark not in ("", "-")
    if kind == 3:
        if real:
            return rng.choice(["call ", "phone ", "tel. ", "mobile "]), rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"00{digits(2)} {digits(3)} {digits(4)} {digits(2)}", f"{digits(3)}-{digits(3)}-{digits(4)}"]), " for", kind, True
        return rng.choice(["on ", "order ", "no. ", "in "]), rng.choice([f"20{digits(2)}-0{rng.randint(1, 9)}-1{digits(1)}", f"{digits(4)} {digits(4)}", digits(rng.randint(7, 11)), f"{digits(3)}.{digits(3)}.{digits(3)}"]), " and", kind, False
    letters = rng.choice(["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"])
    body = "7" + some(letters, rng.choice([23, 31, 39, 47]))
    if real:
        quote = rng.choice(['"', "'", ""])
        return rng.choice(["token", "api_key", "secret", "password", "Token", "access_token"]) + rng.choice([" = ", "=", ": "]) + quote, body, quote + " then", kind, True
    return rng.choice(["commit ", "sha256 ", "file ", "/x/", "id "]), rng.choice([body, f"{name}-{host}-{digits(4)}-{name}-{host}"]), " was", kind, False


def labelled(docs: DataFrame) -> DataFrame:
    """Features and label of candidates of each document and of the passage planted in it; half says which documents calibrate."""

    def run(batches):
        for b in steps(batches):
            x, y, half = [], [], []
            for text, part in zip(b.column("text").to_pylist(), b.column("half").to_pylist(), strict=True):
                base = base_spans(text)
                for k, s, e in candidates(text):
                    real = ALL[k] in base and (s, e) in base[ALL[k]]
                    if real or not (k == 0 or k == 4 and ASSIGNED.search(text[max(0, s - 24) : s])):
                        x.append(features(text, k, s, e))
                        y.append(real)
                        half.append(part)
                rng = random.Random(zlib.crc32(text.encode()))
                before, passage, after, kind, real = planted(rng)
                at = text.find(" ", rng.randrange(len(text) + 1))
                at = len(text) if at < 0 else at
                around = (text[max(0, at - 40) : at], text[at : at + 40])
                whole = f"{around[0]} {before}{passage}{after}{around[1]}"
                start, plain = len(around[0]) + 1 + len(before), base_spans(whole)
                for k, s, e in candidates(whole):
                    if s < start + len(passage) and start < e and (k == kind or not real):
                        x.append(features(whole, k, s, e))
                        y.append((real or (ALL[k] in KINDS and (s, e) in plain[ALL[k]])) and (s, e) == (start, start + len(passage)))
                        half.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.bool_()), pa.array(half, pa.int32())], ["x", "y", "half"])

    return map_batches(docs, run, "x array<double>, y boolean, half int")


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_candidates: int = SAMPLE_CANDIDATES) -> tuple[BoostedTrees, list[float]] | None:
    """Trees and each kind's threshold, from about sample_docs documents chosen by a hash of their text."""
    some = docs.where("text is not null").select("text", F.xxhash64("text").alias("h"))
    every = max(1, docs.count() // sample_docs)
    some = some.where(F.pmod("h", F.lit(every)) == 0).select("text", F.pmod(F.shiftright("h", 40), F.lit(2)).cast("int").alias("half"))
    rows = labelled(some).orderBy(F.xxhash64("x", "y"), "half").limit(sample_candidates).collect()
    x, y, half = np.array([r.x for r in rows], float), np.array([r.y for r in rows], float), np.array([r.half for r in rows])
    fit, test = half == 0, half == 1
    if not len(rows) or min(y[fit].sum(), (1 - y[fit]).sum(), y[test].sum(), (1 - y[test]).sum()) < 5:
        return None
    model = BoostedTrees().fit(x[fit], y[fit]).calibrate(x[test], y[test])
    p, limits = model.predict(x[test]), []
    for k in range(len(ALL)):
        own = x[test][:, k] == 1
        order = np.argsort(-p[own], kind="stable")
        precision = np.cumsum(y[test][own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(precision >= PRECISION)
        limits.append(max(0.9, float(p[own][order][good[-1]])) if len(good) else 2.0)
    return model, limits


def taken(spans) -> tuple[list[int], list[int]]:
    """Sorted starts and ends of the union of spans."""
    start: list[int] = []
    end: list[int] = []
    for s, e in sorted(spans):
        if start and s <= end[-1]:
            end[-1] = max(end[-1], e)
        else:
            start.append(s)
            end.append(e)
    return start, end


def touches(start: list[int], end: list[int], s: int, e: int) -> bool:
    """Whether s:e overlaps one of disjoint sorted spans."""
    at = bisect_left(end, s + 1)
    return at < len(start) and start[at] < e


def added(text: str, base: dict[str, list[tuple[int, int]]], model: BoostedTrees, limits: list[float]) -> list[tuple[int, int, int]]:
    """Candidates that the trees select, apart from base spans and from each other."""
    start, end = taken(s for spans in base.values() for s in spans)
    open_ = [c for c in candidates(text) if not touches(start, end, *c[1:])]
    if not open_:
        return []
    p = model.predict(np.array([features(text, *c) for c in open_], float))
    out: list[tuple[int, int, int]] = []
    start, end = [], []
    for i in np.argsort(-p, kind="stable").tolist():
        k, s, e = open_[i]
        if p[i] >= limits[k] and not touches(start, end, s, e):
            out.append((k, s, e))
            at = bisect_left(start, s)
            start.insert(at, s)
            end.insert(at, e)
    return sorted(out)


def find_pii(docs: DataFrame, model: tuple[BoostedTrees, list[float]] | None) -> DataFrame:
    """docs with counts of base spans by kind, base_spans and spans: `kind:start:end` in code points, comma-joined."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in NEW]
    schema = StructType([*kept, *(StructField(f"n_{k}", LongType()) for k in KINDS), StructField("base_spans", StringType()), StructField("spans", StringType())])

    def run(batches):
        chosen = shared.value
        for b in steps(batches):
            counts, base_text, all_text = [], [], []
            for text in b.column("text").to_pylist():
                base = base_spans(text or "")
                spans = [(k, *s) for k, kind in enumerate(KINDS) for s in base[kind]]
                counts.append([len(base[k]) for k in KINDS])
                base_text.append(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans))
                more = added(text or "", base, *chosen) if chosen else []
                all_text.append(",".join(f"{ALL[k]}:{s}:{e}" for k, s, e in sorted(spans + more)))
            new = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *new, pa.array(base_text, pa.string()), pa.array(all_text, pa.string())], [f.name for f in schema.fields])

    return map_batches(docs, run, schema)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each of its ``spans`` replaced by the kind in brackets; overlapping spans become one."""

    def run(batches):
        for b in steps(batches):
            texts = b.column("text").to_pylist()
            for r, spans in enumerate(b.column("spans").to_pylist()):
                if spans:
                    out, at = [], 0
                    for s, e, kind in sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(","))):
                        if s >= at:
                            out += [texts[r][at:s], f"[{kind.upper()}]"]
                        at = max(at, e)
                    texts[r] = "".join([*out, texts[r][at:]])
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return map_batches(docs, run, docs.schema)


def op10_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_pii(docs, train(docs)).select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans")

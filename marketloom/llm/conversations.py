"""Operator 11: conversations are brought to ``(s?(ua)+)?`` (role initials) by the cheapest edits, rebuilt in linear space.

Edits are Keep, Rerole, Delete and Insert; ``RULES`` states what they cost. The state before each row is one of four: at the start,
after a system row, after a user row, after an assistant row. Hirschberg's divide and conquer meets in the middle of a
conversation: costs of the four states from the left and from the right are added, and of the cheapest crossings the one whose
edits to the left are ASCII-least is taken (of two ways over the same rows to different states, neither spelling begins
with the other, so the left halves decide). Both halves are rebuilt alike. One byte a row is held, no table of states.

Texts take no part in that: rows are judged by Spark SQL functions (repeats by a window over role and hash of the text), a first pass
over (conversation, turn, initial, fault) makes the plan of each conversation, and a second one streams the rows behind their
conversation's plan, a row at a time. A conversation of any length passes both without being gathered.

Defined cases: null role and text are one space, null turn comes first, null conv_id is a conversation of its own; rows of equal turn
are taken in the order of role and a hash of text; repeated rows are duplicates; empty text is blank; very long texts are streamed;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marketloom.llm.common import STEP_BYTES, map_batches

# Fixed values of the rules.
RULES = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED_COST = 3
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = "sua"
LEGAL = {"su", "ua", "au"}
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state after an inserted or re-roled row, which the state before alone decides.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Cost and spelling of the inserts after the last row.
TAIL = {START: (0, ""), SYSTEM: (2 * RULES["I"], "II"), USER: (RULES["I"], "I"), ASSISTANT: (0, "")}
NO_WAY = 1 << 60


def code(initial: str, fault: int) -> int:
    """One byte for what matters of a row."""
    return (INITIALS.find(initial) if initial else -1) % 4 * 4 + fault


def ways(row: int) -> dict[tuple[int, int], tuple[int, str]]:
    """The cheapest, then ASCII-least, spelling of inserts and the row's edit between two states."""
    initial, fault = row // 4, row % 4
    extra = TRUNCATED_COST if fault == TRUNCATED else 0
    found: dict[tuple[int, int], tuple[int, str]] = {}
    for begin in STATES:
        state, spelt, cost = begin, "", 0
        for _ in range(3):  # after two inserts states come again
            ends = [(state, "D", RULES["D"])]
            if fault in (NONE, TRUNCATED):
                ends.append((NEXT[state], "R", RULES["R"] + extra))
                if initial < 3 and (state, INITIALS[initial]) in KEEPS:
                    ends.append((KEEPS[state, INITIALS[initial]], "K", extra))
            for end, edit, price in ends:
                found[begin, end] = min(found.get((begin, end), (NO_WAY, "")), (cost + price, spelt + edit))
            state, spelt, cost = NEXT[state], spelt + "I", cost + RULES["I"]
    return found


WAYS = [ways(row) for row in range(16)]
STEPS = [[(begin, end, *w) for (begin, end), w in table.items()] for table in WAYS]


def forward(rows: bytes, low: int, high: int, begin: int) -> tuple[list[int], list[int]]:
    """Cost of each state after rows[low:high], and the place of its least spelling among the four."""
    cost, rank = [NO_WAY] * 4, [0] * 4
    cost[begin] = 0
    for row in rows[low:high]:
        best = [(NO_WAY, 0, "")] * 4
        for a, b, price, spelt in STEPS[row]:
            if cost[a] < NO_WAY:
                best[b] = min(best[b], (cost[a] + price, rank[a], spelt))
        order = sorted(STATES, key=lambda q: best[q][1:])
        cost, rank = [b[0] for b in best], [order.index(q) for q in STATES]
    return cost, rank


def backward(rows: bytes, low: int, high: int, end: int) -> list[int]:
    """Cost from each state over rows[low:high] to end."""
    cost = [NO_WAY] * 4
    cost[end] = 0
    for row in reversed(rows[low:high]):
        before = [NO_WAY] * 4
        for a, b, price, _ in STEPS[row]:
            before[a] = min(before[a], price + cost[b])
        cost = before
    return cost


def rebuilt(rows: bytes, low: int, high: int, begin: int, end: int) -> str:
    if high - low == 1:
        return WAYS[rows[low]][begin, end][1]
    middle = (low + high) // 2
    left, rank = forward(rows, low, middle, begin)
    right = backward(rows, middle, high, end)
    cross = min(STATES, key=lambda q: (left[q] + right[q], rank[q]))
    return rebuilt(rows, low, middle, begin, cross) + rebuilt(rows, middle, high, cross, end)


def plan(rows: bytes) -> tuple[int, str]:
    """Cost and spelling of the cheapest, then ASCII-least, edits of a conversation's rows (see code())."""
    if not rows:
        return 0, ""
    cost, rank = forward(rows, 0, len(rows), START)
    last = min(STATES, key=lambda q: (cost[q] + TAIL[q][0], rank[q]))
    return cost[last] + TAIL[last][0], rebuilt(rows, 0, len(rows), START, last) + TAIL[last][1]


@lru_cache(1 << 16)
def short_plan(rows: bytes) -> tuple[int, str]:
    return plan(rows)


def judged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone, h, h2, again and fault of rows(conv_id, turn, role, text, gone); gone rows count for nothing."""
    text = F.col("text")
    rows = rows.withColumns({"h": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    rows = rows.withColumns({
        "blank": ~text.rlike(r"[^\x20\x09-\x0D]"), "cut": ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"),
    })
    narrow = Window.partitionBy("conv_id", "role", "h", "h2", "gone").orderBy(F.col("turn").asc_nulls_first())
    again = F.row_number().over(narrow) > 1
    fault = F.when(F.col("blank"), BLANK).when(F.col("again"), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(NONE)
    return rows.withColumn("again", again).withColumn("fault", fault.cast("byte"))


def in_order(first: str | None = None) -> list[Column]:
    """The order of a conversation's rows, the plan first; what ties here is equal in all that matters."""
    return [F.col("conv_id").asc_nulls_first(), *([F.col(first)] if first else []), F.col("turn").asc_nulls_first(), F.col("role"), F.col("h"), F.col("h2"), F.col("again")]


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def plans(rows: DataFrame) -> DataFrame:
    """A row for each conversation: COUNTS and audit, the initials of its edits."""
    kind = rows.schema["conv_id"].dataType
    arrow_type = to_arrow_type(kind)
    narrow = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "h", "h2", "again", F.substring("role", 1, 1).alias("initial"), "fault", "gone")

    def closed(conv, rows_, turns, counts):
        cost, audit = (short_plan if len(rows_) <= 64 else plan)(bytes(rows_))
        first, last, distinct = turns
        return conv, (last - first + 1 - distinct if distinct else 0), counts[BLANK], counts[DUPLICATE], counts[TRUNCATED], counts[0], cost, audit

    def run(batches):
        conv, open_ = None, False
        for batch in batches:
            out = []
            for c, turn, initial, fault, gone in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "initial", "fault", "gone")), strict=True):
                if not open_ or c != conv:
                    if open_:
                        out.append(closed(conv, codes, turns, counts))
                    conv, open_, codes, turns, counts, before = c, True, bytearray(), [0, 0, 0], [0] * 4, None
                if gone:
                    continue
                codes.append(code(initial, fault))
                counts[fault] += fault > 0
                counts[0] += before is not None and before + initial not in LEGAL
                before = initial
                if turn is not None and (not turns[2] or turn != turns[1]):
                    turns = [turns[0] if turns[2] else turn, turn, turns[2] + 1]
            if out:
                yield as_batch(out)
        if open_:
            yield as_batch([closed(conv, codes, turns, counts)])

    names = ["conv_id", *COUNTS, "audit"]

    def as_batch(out):
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], arrow_type), *(pa.array(x, pa.int64()) for x in columns[1:-1]), pa.array(columns[-1], pa.string())], names)

    dealt = narrow.repartition("conv_id").sortWithinPartitions(*in_order())
    return map_batches(dealt.select("conv_id", "turn", "initial", "fault", "gone"), run, f"conv_id {kind.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, audit string")


def behind_plans(rows: DataFrame) -> DataFrame:
    """Each conversation's plan, then its rows in order, in one task."""
    made = plans(rows)
    texts = rows.where("not gone").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "h", "h2", "again", "text", F.lit(1).alias("kind"))
    return made.withColumn("kind", F.lit(0)).unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(*in_order("kind"))


def walk(batches) -> Iterator[tuple]:
    """(conv_id and plan) as a conversation begins, then (edit, role, text) of each of its edits, then None as it ends."""
    waiting, at, state, open_ = "", 0, START, False

    def inserts():
        nonlocal at, state
        while at < len(waiting) and waiting[at] == "I":
            at, state = at + 1, NEXT[state]
            yield "I", ROLE[state], ""

    for batch in batches:
        for kind, role, text, *of in zip(*(batch.column(x).to_pylist() for x in ("kind", "role", "text", "conv_id", *COUNTS, "audit")), strict=True):
            if not kind:
                if open_:
                    yield from inserts()
                    yield None
                waiting, at, state, open_ = of[-1], 0, START, True
                yield tuple(of)
                continue
            yield from inserts()
            edit = waiting[at]
            at += 1
            if edit == "D":
                yield edit, role, text
                continue
            state = NEXT[state] if edit == "R" else KEEPS[state, role[:1]]
            yield edit, ROLE[state] if edit == "R" else role, text
    if open_:
        yield from inserts()
        yield None


def repair_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, role and text of every edit; rows as of judged(). Without the edits D these are the repaired conversations."""
    kind = rows.schema["conv_id"].dataType
    arrow_type = to_arrow_type(kind)

    def run(batches):
        out, size, place, conv = [], 0, 0, None
        for x in walk(batches):
            if x is None:
                continue
            if len(x) > 3:
                conv, place = x[0], 0
                continue
            out.append((conv, place, *x))
            place, size = place + 1, size + len(x[2])
            if size > STEP_BYTES or len(out) >= 10_000:
                yield made(out)
                out, size = [], 0
        if out:
            yield made(out)

    def made(out):
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], arrow_type), pa.array(columns[1], pa.int64()), *(pa.array(x, pa.string()) for x in columns[2:])], ["conv_id", "place", "edit", "role", "text"])

    return map_batches(behind_plans(rows), run, f"conv_id {kind.simpleString()}, place long, edit string, role string, text string")


def repair_digests(rows: DataFrame) -> DataFrame:
    """conv_id, COUNTS, audit and repaired_sha256 (of the repaired ``role:text``, joined by newlines) of every conversation; rows as of judged()."""
    kind = rows.schema["conv_id"].dataType
    arrow_type = to_arrow_type(kind)

    def run(batches):
        out, row = [], ()
        for x in walk(batches):
            if x is None:
                out.append((*row, digest.hexdigest()))
                if len(out) >= 1000:
                    yield made(out)
                    out = []
            elif len(x) > 3:
                row, digest, joint = x, hashlib.sha256(), b""
            elif x[0] != "D":
                digest.update(joint + f"{x[1]}:{x[2]}".encode())
                joint = b"\n"
        if out:
            yield made(out)

    def made(out):
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], arrow_type), *(pa.array(x, pa.int64()) for x in columns[1:-2]), *(pa.array(x, pa.string()) for x in columns[-2:])], ["conv_id", *COUNTS, "audit", "repaired_sha256"])

    return map_batches(behind_plans(rows), run, f"conv_id {kind.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone of rows, damaged by the contract's rule; null role and text are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    hurt = F.when(harm == 1, "").when(harm == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    twice = F.explode(F.array_repeat(F.lit(1), F.when(harm == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(harm == 4, "user").otherwise(text("role")).alias("role"), hurt.alias("text"), (harm == 0).alias("gone"), twice.alias("copy")).drop("copy")


def op11_hirschberg_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair_digests(judged(damaged(rows)))

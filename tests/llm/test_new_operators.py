"""Line dedup, conversation repair and collocations: plain versions, edges and empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import numpy as np
from marketloom.llm import collocations, conversations, line_dedup


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- lines


def plain_lines(docs, min_chars=40, min_docs=5):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    held = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    stays = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(k) >= min_chars and len(ids) >= min_docs}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in stays or stays[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


def line_docs():
    rng = random.Random(4)
    common = ["A line of forty code points and some mor", "Ünë lìgne dë plus de quarante caractères ÀÉ", "short line", "x" * 40, "y" * 39]
    docs = []
    for i in range(60):
        lines = [rng.choice([" \t", "", "\r"]) + (x.upper() if rng.random() < 0.1 and x.isascii() else x) + rng.choice(["", "\x0b ", "\r"]) for x in rng.choices([*common, "", *(f"own line {i} {k} of more than forty letters ..." for k in range(3))], k=rng.randint(0, 9))]
        docs.append((i // 2 if i < 20 else i, "\n".join(lines)))
    return [*docs, (None, common[0] + "\n" + common[3]), (None, None), (700, None), (701, ""), (702, "\n" * 3), (703, "é" * 20000 + "\n" + common[0]), (703, "é" * 20000 + "\n" + common[0])]


def test_lines_equal_a_plain_version_and_sql(spark, tmp_path):
    docs = line_docs()
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, row_id int, kept string").write.parquet(path)
    own = sorted(map(tuple, line_dedup.op13_line_dedup(spark, str(tmp_path)).collect()), key=repr)
    assert own == plain_lines(docs)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert own == sorted(con.sql(line_dedup.OP13_SQL).fetchall(), key=repr)
    kept = line_dedup.drop_common_lines(spark.read.parquet(path), min_docs=3)
    assert sorted(((r.doc.doc_id, r.n_lines, r.n_dropped, sha(r.kept or "")) for r in kept.collect()), key=repr) == plain_lines(docs, min_docs=3)


def test_no_lines(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert line_dedup.op13_line_dedup(spark, str(tmp_path)).collect() == []


# ---- conversations

AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
FOLLOWS = {"": "u", "s": "u", "u": "a", "a": "u"}


def every_plan(rows):
    """The cheapest, ASCII-least edits of (initial, fault) rows, by trying all spellings with few inserts."""
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            spelt = "".join("I" * n + e for n, e in zip(inserts, [*edits, ""]))
            state, cost, left = "", 0, list(rows)
            for e in spelt:
                if e == "I":
                    state, cost = FOLLOWS[state], cost + 3
                    continue
                initial, fault = left.pop(0)
                if e == "D":
                    cost += 4
                    continue
                to = FOLLOWS[state] if e == "R" else AFTER.get((state, initial))
                if to is None or fault in (1, 2):
                    break
                state, cost = to, cost + (3 if e == "R" else 0) + (3 if fault == 3 else 0)
            else:
                if state in ("", "a"):
                    best = min(best or (cost, spelt), (cost, spelt))
    return best


def in_one_table(rows):
    """The same by full spellings for each state, row after row."""
    best = {"": (0, "")}
    for initial, fault in rows:
        nxt = {}
        for state, (cost, spelt) in best.items():
            for n in range(3):
                options = [(state, "D", 4)]
                if fault not in (1, 2):
                    options.append((FOLLOWS[state], "R", 3 + 3 * (fault == 3)))
                    if (state, initial) in AFTER:
                        options.append((AFTER[state, initial], "K", 3 * (fault == 3)))
                for to, e, price in options:
                    new = (cost + 3 * n + price, spelt + "I" * n + e)
                    nxt[to] = min(nxt.get(to, new), new)
                state = FOLLOWS[state]
        best = nxt
    return min((c + {"": 0, "s": 6, "u": 3, "a": 0}[q], s + {"": "", "s": "II", "u": "I", "a": ""}[q]) for q, (c, s) in best.items())


def coded(rows):
    return bytes(conversations.code(*r) for r in rows)


def test_plans_are_the_least_of_all():
    kinds = [(i, f) for i in ("s", "u", "a", "x") for f in range(4)]
    for n in range(3):
        for rows in itertools.product(kinds, repeat=n):
            assert conversations.plan(coded(rows)) == every_plan(rows)
    rng = random.Random(1)
    for _ in range(120):
        rows = rng.choices(kinds, k=3)
        assert conversations.plan(coded(rows)) == every_plan(rows)
    for _ in range(2000):
        rows = rng.choices(kinds, k=rng.randint(0, 40))
        assert conversations.plan(coded(rows)) == in_one_table(rows)


def plain_repair(rows):
    """The contract for all rows (conv_id, turn, role, text)."""
    one = lambda x: " " if x is None else x
    after, ids = defaultdict(list), {r[0] for r in rows}
    for conv, turn, role, text in rows:
        role, text = one(role), one(text)
        d = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        if d == 0:
            continue
        if d == 1:
            text = ""
        if d == 2:
            text = re.sub("[.!?]", "", text)
        if d == 4:
            role = "user"
        after[conv] += [(turn, role, text)] * (2 if d == 3 else 1)
    out = {}
    for conv in ids:
        mine = sorted(after[conv], key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults = set(), []
        for _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
            seen.add((role, text))
        turns = [t for t, _, _ in mine if t is not None]
        initials = [r[:1] for _, r, _ in mine]
        cost, audit = in_one_table(list(zip(initials, faults)))
        state, left, kept = "", list(mine), []
        for e in audit:
            if e == "I":
                state = FOLLOWS[state]
                kept.append({"u": "user", "a": "assistant"}[state] + ":")
                continue
            _, role, text = left.pop(0)
            if e != "D":
                state = FOLLOWS[state] if e == "R" else AFTER[state, role[:1]]
                kept.append(f"{ {'u': 'user', 'a': 'assistant'}[state] if e == 'R' else role}:{text}")
        count = Counter(faults)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, count[1], count[2], count[3], illegal, cost, audit, sha("\n".join(kept)))
    return out


def talk():
    rng = random.Random(9)
    rows = []
    for conv in [None, *range(150)]:
        for turn in [*([None] if rng.random() < 0.1 else []), *range(rng.randint(1, 9) if conv != 7 else 700)]:
            if rng.random() < 0.9:
                rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(["Yes.", "No", "é?\n", " \t", "", None, f"text {rng.random()}!", "x. y", "long word " * 500 + "."])))
    return rows


def test_repair_equals_a_plain_version(spark, tmp_path):
    rows = talk()
    spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, kind int").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    want = plain_repair(rows)
    own = conversations.op11_hirschberg_repair(spark, str(tmp_path)).collect()
    assert {tuple(r)[0]: tuple(r)[1:] for r in own} == want and len(own) == len(want)
    edits = conversations.repair_conversations(conversations.judged(conversations.damaged(spark.read.parquet(f"{tmp_path}/conversations.parquet")))).collect()
    spelt = defaultdict(list)
    for r in sorted(edits, key=lambda r: r.place):
        spelt[r.conv_id].append(r)
    for conv, mine in spelt.items():
        assert "".join(r.edit for r in mine) == want[conv][6]
        assert sha("\n".join(f"{r.role}:{r.text}" for r in mine if r.edit != "D")) == want[conv][7]
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in mine if r.edit != "D"))


def test_repair_on_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r)[1:] for r in conversations.op11_hirschberg_repair(spark, sf).collect()} == plain_repair(rows)


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert conversations.op11_hirschberg_repair(spark, str(tmp_path)).collect() == []


# ---- collocations


def plain_collocations(docs, least, top=2000):
    counts, words = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for n in range(1, 5):
                counts[lang].update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cands.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(100 * b >= 80 * a and any(q[s : s + len(p)] == p for s in range(len(q) - len(p) + 1)) for q, b in cands.items() if len(q) > len(p))
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, words[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def mixed_docs(seed, n=120):
    rng = random.Random(seed)
    words = ["Of", "the", "of", "red", "fox", "é", "ÉCOLE", "42", "a-b", "x"]
    docs = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
        docs.append((rng.choice(["en", "en", "fr", None, "und"]), text))
    return [*docs, ("en", None), (None, ""), ("xx", " \t.\n"), ("zz", "rare words only"), ("en", "the red fox " * 3000)]


@pytest.mark.parametrize("least, places", [(30, None), (5, 500), (7, 60)])
def test_collocations_equal_a_plain_version(spark, monkeypatch, least, places):
    """Also with small shards and with pairs that are dealt by all their words."""
    docs = mixed_docs(least)
    if places:
        monkeypatch.setattr(collocations, "SHARD_PLACES", places)
        monkeypatch.setattr(collocations, "HOT_SHARE", 1 << 40)
    table = spark.createDataFrame([(*d, 1, "q") for d in docs], "lang string, text string, n int, phrase string").repartition(4)
    assert sorted(map(tuple, collocations.collocations(table, least=least).collect())) == plain_collocations(docs, least)
    if not places:
        assert sorted(map(tuple, collocations.collocations(table, least=least, top=3).collect())) == plain_collocations(docs, least, 3)


def test_quicksort_counts_every_prefix(monkeypatch):
    rng = random.Random(3)
    for small in (0, 5, 2048):
        monkeypatch.setattr(collocations, "SMALL", small)
        for least in (1, 3, 9):
            rows = [tuple(rng.randint(0, 3) if k < 3 else rng.choice([-1, 0, 1]) for k in range(4)) for _ in range(200)]
            weight = [rng.randint(1, 4) for _ in rows]
            found = collocations.phrase_counts([np.array(c) for c in zip(*rows)], np.array(weight), [least] * 4)
            want = Counter()
            for row, w in zip(rows, weight):
                for d in range(1, 5):
                    if row[d - 1] >= 0:
                        want[row[:d]] += w
            got = {rows[i][:d]: n for i, d, n in found}
            assert got == {p: n for p, n in want.items() if n >= least} and len(got) == len(found)


def test_scores_beyond_64_bits(spark):
    big = 5_000_000_000_000_000_000
    counted = spark.createDataFrame([("en", "a", big), ("en", "b", big), ("en", "a b", big - 1)], "lang string, phrase string, f long")
    (r,) = collocations.scored(counted).collect()
    assert r.score == 2_000_000 * (big - 1) // (2 * big)


def test_no_collocations(spark, tmp_path):
    spark.createDataFrame([], "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert collocations.op12_collocations(spark, str(tmp_path)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).collect() == []

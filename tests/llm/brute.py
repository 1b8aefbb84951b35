"""Plain versions of the operators' contracts."""

import hashlib
import re
from collections import Counter


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def near(docs, n, num, den):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return {i: (len(sets[i]), comp[i]) for i in sets}


def substrings(docs, length):
    first, out = {}, {}
    for i, t in docs:
        x = (t or "").encode()
        for k in range(len(x) - length + 1):
            first[x[k : k + length]] = min(first.get(x[k : k + length], i), i)
    for i, t in docs:
        x = (t or "").encode()
        m = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if first[x[k : k + length]] < i:
                m[k : k + length] = b"\1" * length
        out[i] = (len(x), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(bytes(c for c, z in zip(x, m) if not z)).hexdigest())
    return out


def phrases(docs, window):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    count = Counter(tuple(w[k : k + window]) for w in words.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        m = [0] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                m[k : k + window] = [1] * window
        out[i] = (len(w), sum(m), hashlib.sha256(" ".join(x for x, z in zip(w, m) if not z).encode()).hexdigest())
    return out


def contamination(docs, items, n):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    found = {}
    for i, t in items:
        w = word.findall(lower(t))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            found.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for i, t in docs:
        w, hit, ids = word.findall(lower(t)), set(), set()
        for size in {len(p) for p in found}:
            for k in range(len(w) - size + 1):
                if p := found.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    ids |= p
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out

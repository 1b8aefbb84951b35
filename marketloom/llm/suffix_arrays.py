"""Suffix arrays by induced sorting, with the permuted common-prefix table.

Suffixes are S or L by the order of their neighbour; the leftmost S suffixes (LMS) are sorted by their substrings, recursively
where names repeat, and all others follow from them in two linear passes. A pass over a small alphabet goes bucket by bucket
in numpy: what stands in a bucket sends its left neighbours to the ends of later buckets, in order. Names of a recursion
are many, so there the passes run over plain lists.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """text: small non-negative integers, the last of them 0 and nowhere else."""
    n = len(text)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    differs = text[:-1] != text[1:]
    nearest = np.minimum.accumulate(np.where(np.append(differs, True), np.arange(n), n)[::-1])[::-1]  # the next place where the text changes
    small = np.append(text[nearest[:-1]] < text[np.minimum(nearest[:-1] + 1, n - 1)], True)  # S type
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induce = _induce_buckets if int(text.max()) < 1024 else _induce_lists
    first = induce(text, small, lms)
    name = np.zeros(n, np.int64)
    name[lms] = np.minimum(np.append(lms[1:], n - 1) + 1, n) - lms  # lengths of LMS substrings, for now
    order = first[name[first] > 0]
    size = name[order]
    differ = np.ones(len(order), bool)
    same_size = np.flatnonzero(size[1:] == size[:-1]) + 1
    raw = text.astype(np.int32)
    for w in np.unique(size[same_size]):
        pair = same_size[size[same_size] == w]
        for a in range(0, len(pair), max(1, (1 << 22) // int(w))):
            p = pair[a : a + max(1, (1 << 22) // int(w))]
            k = np.arange(int(w))
            differ[p] = (raw[order[p][:, None] + k] != raw[order[p - 1][:, None] + k]).any(axis=1)
    name[order] = np.cumsum(differ) - 1
    if int(differ.sum()) < len(lms):
        lms_order = lms[suffix_array(name[lms])]
    else:
        lms_order = order
    return induce(text, small, lms_order)


def _induce_buckets(text: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    n, sigma = len(text), int(text.max()) + 1
    bounds = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
    seeds = lms[np.argsort(text[lms], kind="stable")]
    seed_ends = np.searchsorted(text[seeds], np.arange(sigma + 1))

    def one_pass(left_to_right: bool, start: dict[int, np.ndarray]) -> list[np.ndarray]:
        """Per bucket, in the pass's direction, its suffixes of the wanted type."""
        waiting: list[list[np.ndarray]] = [[] for _ in range(sigma)]
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * sigma
        for c in range(sigma) if left_to_right else range(sigma - 1, -1, -1):
            own: list[np.ndarray] = []
            # what came from earlier buckets stands first, then what the bucket sends to itself, then the given ones
            now, given = (np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)), start.get(c)
            while len(now):
                own.append(now)
                now = spread(now, c, waiting)
            out[c] = np.concatenate(own) if own else np.zeros(0, np.int64)
            if given is not None and len(given):
                spread(given, c, waiting)
        return out

    def spread_to(wanted: bool):
        def spread(of: np.ndarray, c: int, waiting: list[list[np.ndarray]]) -> np.ndarray:
            before = of[of > 0] - 1
            before = before[small[before] == wanted]
            letters = text[before]
            again = before[letters == c]
            others = letters != c
            before, letters = before[others], letters[others]
            order = np.argsort(letters, kind="stable")
            before, letters = before[order], letters[order]
            cuts = [0, *(np.flatnonzero(letters[1:] != letters[:-1]) + 1).tolist(), len(letters)] if len(letters) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                waiting[int(letters[a])].append(before[a:b])
            return again

        return spread

    spread = spread_to(False)
    large = one_pass(True, {c: seeds[seed_ends[c] : seed_ends[c + 1]] for c in range(sigma)})
    spread = spread_to(True)
    little = one_pass(False, {c: large[c][::-1] for c in range(sigma)})
    out = np.empty(n, np.int64)
    for c in range(sigma):
        a, b = bounds[c], bounds[c + 1]
        out[a : a + len(large[c])] = large[c]
        out[b - len(little[c]) : b] = little[c][::-1]
    out[0] = n - 1
    return out


def _induce_lists(text: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    n, sigma = len(text), int(text.max()) + 1
    ends = np.cumsum(np.bincount(text, minlength=sigma))
    heads, tails = np.concatenate(([0], ends[:-1])).tolist(), ends.tolist()
    out = np.full(n, -1, np.int64)
    letters = text[lms]
    order = np.argsort(letters, kind="stable")
    sizes = np.bincount(letters, minlength=sigma)
    stop = np.cumsum(sizes)
    out[ends[letters[order]] - stop[letters[order]] + np.arange(len(lms))] = lms[order]
    sa, t, s = out.tolist(), text.tolist(), small.tolist()
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not s[j]:
            sa[heads[t[j]]] = j
            heads[t[j]] += 1
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and s[j]:
            tails[t[j]] -= 1
            sa[tails[t[j]]] = j
    return np.array(sa, np.int64)


def permuted_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place, the common prefix (up to most) of its suffix and the one before it in order."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out, at = np.zeros(n, np.int64), np.flatnonzero(before >= 0)
    padded = np.concatenate((text.astype(np.int32), np.full(most + 8, -1, np.int32)))
    eight = np.zeros(n + most + 1, np.uint64)  # eight symbols in one number, by a hash
    for k in range(8):
        eight = eight * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + len(eight)].astype(np.uint64)
    long = at
    for _ in range(most // 8):
        long = long[eight[long + out[long]] == eight[before[long] + out[long]]]
        out[long] += 8
    for _ in range(min(8, most)):
        at = at[out[at] < most]
        at = at[padded[at + out[at]] == padded[before[at] + out[at]]]
        out[at] += 1
    return out

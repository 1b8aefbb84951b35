"""Token ids of whole texts with a public vocabulary, as the library gives them, at several times its speed.

White space never stands inside a pre-token of this vocabulary, and runs of Latin letters and runs of signs are pre-tokens
of their own. numpy cuts a batch of texts into such units and looks them up by hash in a bounded table that each Python
worker keeps; the library encodes only units that it has not met. A piece between white space that holds anything else
(digits, apostrophes, other scripts, special tokens) is one unit, encoded whole and looked up as it is written: special
tokens and composed marks depend on case.
"""

from __future__ import annotations

import os
import re

import numpy as np

from marketloom.llm.common import SPACED, VALUES, span_hashes

VOCABULARY = "word_bpe_49k.json"
#: Slots of a worker's table, filled up to two fifths, and the ids that it keeps.
SLOTS_LOG2, KEPT_IDS = 21, 1 << 22
_PLAIN = re.compile(r"[a-zß-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+")
_LETTER, _SIGN, _OTHER = 1, 2, 0
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), 0xC3]] = _LETTER
_KIND[[x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in "'<"]] = _SIGN
_AFTER_C3 = np.zeros(256, bool)
_AFTER_C3[[x for x in range(0x9F, 0xC0) if x != 0xB7]] = True
_coders: dict[str, Coder] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def coder(path: str) -> Coder:
    """One per Python worker and vocabulary."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def units(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of every unit, whether it is letters or signs alone, and each row's first unit."""
    n = len(data)
    kind = _KIND[data]
    if n:
        follows = np.zeros(n, bool)
        follows[1:] = data[:-1] == 0xC3
        good = follows & _AFTER_C3[data]
        kind[good] = _LETTER
        kind[follows & ~good] = _OTHER
    space = ~SPACED[data]
    edge = np.zeros(n + 1, bool)
    edge[rows] = True
    edge[n] = True
    edge[:-1] |= space
    edge[1:] |= space
    piece = np.flatnonzero(edge[:-1])  # starts of pieces, spaces too
    other = np.concatenate((np.zeros(1, np.int64), np.cumsum(kind == _OTHER)))
    ends = np.append(piece[1:], n)
    plain = np.repeat(other[ends] == other[piece], ends - piece)
    edge[1:-1] |= (kind[1:] != kind[:-1]) & plain[1:]
    start = np.flatnonzero(edge[:-1])
    end = np.append(start[1:], n)
    keep = ~space[start]
    start, end = start[keep], end[keep]
    return start, end, plain[start], np.searchsorted(start, rows)


class Coder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        size = self.whole.get_vocab_size()
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.ends = np.zeros(size, bool)
        for token, i in self.whole.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.split = Tokenizer(self.whole.model)  # for lower-case letters or signs alone: nothing is left to normalize
        self.split.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.keys = np.zeros(1 << SLOTS_LOG2, np.uint64)
        self.entry = np.zeros(1 << SLOTS_LOG2, np.int32)
        self.begin = np.zeros((1 << SLOTS_LOG2) * 2 // 5, np.int32)
        self.length = np.zeros(len(self.begin), np.int32)
        self.flat = np.zeros(KEPT_IDS, self.kind)
        self.entries = self.ids = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each hash's entry, -1 where there is none."""
        out = np.full(len(h), -1, np.int64)
        slot = (h >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)
        open_ = np.arange(len(h))
        while len(open_):
            key = self.keys[slot]
            hit = key == h[open_]
            out[open_[hit]] = self.entry[slot[hit]]
            more = ~hit & (key != 0)
            open_, slot = open_[more], (slot[more] + 1) & ((1 << SLOTS_LOG2) - 1)
        return out

    def add(self, h: np.ndarray, length: np.ndarray, ids: np.ndarray) -> None:
        """Keep the ids of new hashes, as far as there is room."""
        ends = np.cumsum(length)
        n = min(len(h), len(self.begin) - self.entries, int(np.searchsorted(ends, len(self.flat) - self.ids, side="right")))
        if n <= 0:
            return
        total = int(ends[n - 1])
        self.flat[self.ids : self.ids + total] = ids[:total]
        new = np.arange(self.entries, self.entries + n)
        self.begin[new], self.length[new] = self.ids + ends[:n] - length[:n], length[:n]
        self.entries, self.ids = self.entries + n, self.ids + total
        h, slot = h[:n], (h[:n] >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            mine = free & (self.keys[slot] == h)
            self.entry[slot[mine]] = new[mine]
            h, new, slot = h[~mine], new[~mine], (slot[~mine] + 1) & ((1 << SLOTS_LOG2) - 1)

    def encode(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts data[rows[i]:rows[i + 1]] one after another, and where each text's ids start."""
        start, end, plain, first = units(data, rows)
        if not len(start):
            return np.zeros(0, self.kind), np.zeros(len(rows), np.int64)
        values = VALUES[True][data]
        upper = np.flatnonzero((data >= 65) & (data <= 90))
        upper = upper[~plain[np.searchsorted(start, upper, side="right") - 1]]
        values[upper] = VALUES[False][data[upper]]  # case counts in units that the library encodes whole
        h = span_hashes(values, start, end)
        entry = self.find(h)
        lost = np.flatnonzero(entry < 0)
        begin, length, source = self.begin[entry].astype(np.int64), self.length[entry].astype(np.int64), self.flat
        if len(lost):
            new, at, back = np.unique(h[lost], return_index=True, return_inverse=True)
            at = lost[at]
            text = data.tobytes()
            got_length, got = self._ask([text[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)], plain[at])
            source = np.concatenate((self.flat[: self.ids], got))
            begin[lost], length[lost] = (self.ids + np.cumsum(got_length) - got_length)[back], got_length[back]
            self.add(new, got_length, got)
        ends = np.cumsum(length)
        where = np.arange(int(ends[-1])) + np.repeat(begin - (ends - length), length)
        return source[where], np.concatenate((np.zeros(1, np.int64), ends))[first]

    def _ask(self, texts: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of each unit: how many, and all of them in order."""
        found: list[np.ndarray] = [np.zeros(0, self.kind)] * len(texts)
        lower = [x.decode().lower() for x in texts]
        easy = [i for i in np.flatnonzero(plain).tolist() if _PLAIN.fullmatch(lower[i])]
        for at in range(0, len(easy), 500):
            some = easy[at : at + 500]
            ids = np.array(self.split.encode_batch_fast([" ".join([lower[i] for i in some])], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("a pre-token has no end in this vocabulary")
            begin = 0
            for i, stop in zip(some, ends.tolist(), strict=True):
                found[i] = ids[begin:stop]
                begin = stop
        hard = sorted(set(range(len(texts))) - set(easy))
        for i, e in zip(hard, self.whole.encode_batch_fast([texts[i].decode() for i in hard], add_special_tokens=False), strict=True):
            found[i] = np.array(e.ids, self.kind)
        return np.array([len(x) for x in found], np.int64), np.concatenate(found)

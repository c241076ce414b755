"""Substring dedup by relative Lempel-Ziv parsing.

Blocks of one hash (see segments) are parsed in order of document id: each is factored greedily against the index of all
blocks of smaller ids, taking the longest match at each place. A factor of a whole window or more is a duplicate span.
A repeated window that no single factor holds starts inside a factor and crosses its end, so matches around the ends of
factors are extended to both sides; no other windows are looked at. Matches are compared word by word.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import GRAM_ROLLER, SPAN_ROLLER, free_name, mix
from partloom.llm.segments import Units, remove_spans, repeated_spans

WINDOW, SEED = 50, 8
#: So many units are compared at once, in all places of a seed.
MOST = 256
#: Places that are compared at once.
PLACES = 1 << 15


class Index:
    """The blocks of whole groups as one text, and the places of every seed gram, by group and in order.

    Blocks of a group come in order of document id, so those of smaller ids are the places before a limit. A mark of its
    own ends each block, so no match leaves its block.
    """

    def __init__(self, codes: np.ndarray, first: np.ndarray, h: np.ndarray, doc: np.ndarray, u: Units):
        self.u, m, self.hashes = u, len(doc), None
        block = np.repeat(np.arange(m), np.diff(first))
        pad = MOST + u.k + 1  # so that comparing never leaves the text
        self.begin, self.end = first[:-1] + np.arange(m) + pad, first[1:] + np.arange(m) + pad
        self.text = -1 - np.arange(len(codes) + m + 2 * pad)  # marks, all different
        self.place = np.arange(len(codes)) + block + pad
        self.text[self.place] = codes
        group = np.cumsum(np.append(0, h[1:] != h[:-1])) if m else np.zeros(0, np.int64)
        grams = GRAM_ROLLER.grams(GRAM_ROLLER.prefix(mix(self.text.view(np.uint64))), u.k)
        at = self.place[: max(len(codes) - u.k + 1, 0)]
        own = block[: len(at)]
        at, own = at[at + u.k <= self.end[own]], own[at + u.k <= self.end[own]]
        key = grams[at] ^ mix(group[own].astype(np.uint64))
        order = np.argsort(key, kind="stable")
        self.at = at[order]
        head = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(at) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(at)))
        self.low, self.high = np.zeros(len(self.text), np.int64), np.zeros(len(self.text), np.int64)
        self.low[self.at] = np.repeat(head, size)
        # documents before that of each block: the places before the first block of the same document
        fresh = np.append(True, (doc[1:] != doc[:-1]) | (group[1:] != group[:-1])) if m else np.zeros(0, bool)
        self.limit = self.begin[np.maximum.accumulate(np.where(fresh, np.arange(m), 0))] if m else self.begin
        # how many places of each seed lie before the limit: places of one seed are in order
        run = np.repeat(np.arange(len(head)), size)
        wide = len(self.text) + 1
        before = np.searchsorted(run * wide + self.at, run * wide + self.limit[own[order]])
        self.high[self.at] = before
        known = np.flatnonzero(self.high > self.low)
        self.next = np.append(known, len(self.text))[np.searchsorted(known, np.arange(len(self.text)))]

    def places(self, p: int) -> np.ndarray:
        """Where blocks of smaller documents in the group have the seed of place p."""
        return self.at[self.low[p] : self.high[p]]

    def longest(self, p: int) -> int:
        """Length of the longest match of the text at place p with blocks of smaller documents."""
        places, best, tries = self.places(p), 0, 0
        while len(places):
            if tries == 24:  # many: all at once
                return max(best, self._longest_of_many(p, places))
            near, places, tries = int(places[-1]), places[:-1], tries + 1
            done, step = 0, 32
            while (same := self.text[near + done : near + done + step] == self.text[p + done : p + done + step]).all():
                done, step = done + step, MOST
            best = max(best, done + int(same.argmin()))
            places = places[self.text[places + best] == self.text[p + best]]  # others can't be longer
        return best

    def _longest_of_many(self, p: int, places: np.ndarray) -> int:
        """The same for many places: lengths by halving over hashes of spans, which are never too short, and the longest
        compared unit by unit. However long matches are, a place costs a logarithm of that."""
        if self.hashes is None:
            self.hashes = SPAN_ROLLER.prefix(mix(self.text.view(np.uint64)))
        low, high = np.zeros(len(places), np.int64), np.minimum(len(self.text) - places, len(self.text) - p)
        while (open_ := np.flatnonzero(low < high)).size:
            half = (low[open_] + high[open_] + 1) // 2
            same = SPAN_ROLLER.spans(self.hashes, places[open_], places[open_] + half) == SPAN_ROLLER.spans(self.hashes, p + half * 0, p + half)
            low[open_], high[open_] = np.where(same, half, low[open_]), np.where(same, high[open_], half - 1)
        for k in np.argsort(-low, kind="stable"):
            n, at = int(low[k]), int(places[k])
            if (self.text[at : at + n] == self.text[p : p + n]).all():
                return n
            low[k] = int(self.match(p, places[k : k + 1], 1)[0])  # two spans of one hash
            if low[k] >= low.max():
                return int(low[k])
        return int(low.max())

    def match(self, p: int, places: np.ndarray, way: int, most: int | None = None) -> np.ndarray:
        """As _match, for a bounded number of places at once."""
        return np.concatenate([self._match(p, places[i : i + PLACES], way, most) for i in range(0, max(len(places), 1), PLACES)])

    def _match(self, p: int, places: np.ndarray, way: int, most: int | None = None) -> np.ndarray:
        """How many units from p and from each of the places on are the same, to the right (way 1) or the left (-1). Where
        most is given and as many are, there may be more."""
        out, live, done, step = np.zeros(len(places), np.int64), np.arange(len(places)), 0, 16
        while len(live) and (most is None or done < most):
            by = way * np.arange(done, done + step)
            same = self.text[places[live][:, None] + by] == self.text[p + by]
            n = np.where(same.all(1), step, same.argmin(1))
            out[live] = done + n
            live, done, step = live[n == step], done + step, min(2 * step, MOST)
        return out

    def parse(self, b: int) -> list[tuple[int, int]]:
        """Greedy factors (place, length) of block b against the blocks of smaller documents; what they leave out is literal."""
        out, p, stop = [], int(self.next[self.begin[b]]), int(self.end[b])
        while p + self.u.k <= stop:
            length = self.longest(p)
            if length >= self.u.k:
                out.append((p, length))
            p = int(self.next[p + max(length, 1)])
        return out

    def around(self, p: int) -> list[tuple[int, int]]:
        """Matches (start, end) of a window or more that hold the seed at place p."""
        places, w = self.places(p), self.u.window
        if not len(places):
            return []
        right = self.match(p, places, 1, w)
        left = self.match(p - 1, places - 1, -1, w)
        good = (right >= self.u.k) & (left + right >= w)
        pairs = np.unique(left[good] << 32 | right[good]).tolist()
        return [(p - (x >> 32), p + (x & 0xFFFFFFFF)) for x in pairs]


def search(u: Units):
    def run(codes: np.ndarray, first: np.ndarray, h: np.ndarray, doc: np.ndarray, copies: np.ndarray) -> np.ndarray:
        index = Index(codes, first, h, doc, u)
        hits = np.zeros(len(index.text), bool)
        for b in range(len(doc)):
            for p, length in index.parse(b):
                hits[p : p + max(length - u.window + 1, 0)] = True
                # a window that starts in the factor and goes on beyond its end holds the seed before the end or the one after
                for q in (p + length - u.k, p + length):
                    for start, end in index.around(q):
                        hits[start : end - u.window + 1] = True
        return np.flatnonzero(hits[index.place])

    return run


def rest_of(u: Units):
    def rest(data: bytes, s: np.ndarray, e: np.ndarray) -> tuple[int, bytes]:
        parts = data.split() if u.words else data
        if not len(s):
            return len(parts), b" ".join(parts) if u.words else data
        cuts, at = [], 0
        for a, b in zip(s.tolist(), e.tolist()):
            cuts.append(parts[at:a])
            at = b
        cuts.append(parts[at:])
        return len(parts), b" ".join(w for c in cuts for w in c) if u.words else b"".join(cuts)

    return rest


def substring_dedup(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of docs (its other columns as they are) with _n, _n_removed, _n_spans, _kept_sha256 and _kept.

    A word goes where a window over it also starts in a document with a smaller id. Null text: no words. Null id: later
    than every id; such rows do not remove from each other. Rows with one id do not remove from each other. Fewer words
    than a window: nothing goes. An empty table gives no rows.
    """
    u = Units(words=True, window=window, k=min(SEED, window))
    spans = repeated_spans(docs, u, search(u), True, doc_id, text)
    return remove_spans(docs, spans, u, doc_id, text, rest_of(u))


def without_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated words taken out of the text; texts that lose nothing stay as they are, n_chars follows the text."""
    done = substring_dedup(docs, window, doc_id, text)
    kept = F.col(free_name("_kept", docs.columns))
    chars = {"n_chars": F.char_length(kept).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    new = {text: kept} | chars
    return done.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))

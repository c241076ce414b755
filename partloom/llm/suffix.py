"""Suffix-array dedup: repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Whole hash groups of blocks (see segments) are joined to one text. Its suffixes are sorted as far as the threshold asks,
which gives the transform. Common prefixes then come by increasing length: a boundary between suffixes with l bytes in
common leads, by one backward step with each byte c before it, to the boundary between the suffixes c+... with l+1 bytes
in common. The breadth-first search stops at the threshold; boundaries it has not met join suffixes that share at least
that many bytes, so both begin a repeated window.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from partloom.llm.segments import Units, remove_spans, repeated_spans
from partloom.llm.substring import rest_of

WINDOW, SEED = 400, 32
#: Runs of an interval that are looked at before ranks over the whole alphabet take over.
WALK = 24


def bounded_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first depth symbols at least; text has codes of 9 bits and ends with the only 0."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = (key << np.uint64(9)) | padded[i : i + n]
    order = np.argsort(key).astype(np.int32)
    ordered = key[order]
    head = np.ones(n, bool)
    head[1:] = ordered[1:] != ordered[:-1]
    del key, ordered
    place = np.arange(n, dtype=np.int32)
    group = np.maximum.accumulate(np.where(head, place, 0))
    rank = np.zeros(n + 1, np.int32)  # after the end: 0, which only the suffix at the end has otherwise
    rank[order] = group
    length = 7
    while length < depth:
        tied = np.ones(n, bool)
        tied[:-1] = ~(head[:-1] & head[1:])
        tied[-1] = not head[-1]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        suffix = order[at]
        # suffixes that are still tied are longer than length, as the 0 at the end comes once
        key = (rank[suffix].astype(np.int64) << 32) | rank[suffix + length]
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[at] = suffix
        head[at[1:]] = key[1:] != key[:-1]
        head[at[0]] = True
        own = np.maximum.accumulate(np.where(head[at], at, 0))
        rank[suffix] = own
        length *= 2
    return order


def unmet_boundaries(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Places i > 0 where suffixes i-1 and i share at least depth symbols, by expansion over common prefixes 0, 1, ...

    An interval is held by its ends. Its left end is a boundary just met; a step backward with each symbol that occurs in
    it gives the intervals of the next length. Symbols are found at the runs of the transform, which are few where the
    text repeats.
    """
    n = len(text)
    bwt = text[order - 1].astype(np.uint16)  # the suffix at 0 is preceded by the last symbol
    by = np.argsort(bwt, kind="stable").astype(np.int32)  # psi: place in the transform of the j-th smallest symbol
    symbols = bwt[by]
    step = np.empty(n, np.int32)
    step[by] = np.arange(n, dtype=np.int32)  # last-to-first mapping
    before = np.full(n, -1, np.int32)  # psi of the place before, in the same symbol's part
    same = np.flatnonzero(symbols[1:] == symbols[:-1]) + 1
    before[same] = by[same - 1]
    ranked = symbols.astype(np.int64) * (n + 1) + by  # in order, so a search is a rank
    run = np.full(n + 1, n, np.int32)
    fresh = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
    run[fresh] = fresh
    run = np.minimum.accumulate(run[::-1])[::-1][1:]  # the next place with another symbol than the one before it
    begin = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
    stop = np.append(begin[1:], n)
    met = np.zeros(n, bool)
    met[begin] = True
    left, right = begin[1:].astype(np.int32), stop[1:].astype(np.int32)
    for _ in range(depth - 1):
        if not len(left):
            break
        at, lefts, rights = left, [], []
        for _ in range(WALK):
            j = step[at]
            good = ~met[j] & (before[j] < left)  # the symbol's first place in the interval
            after = run[at]
            on = after < right
            ends = np.flatnonzero(good & ~on)  # in the last run, the symbol's last place is that before the end
            lefts.append(j[ends])
            rights.append(step[right[ends] - 1] + 1)
            inner = np.flatnonzero(good & on)
            if len(inner):
                lefts.append(j[inner])
                rights.append(np.searchsorted(ranked, bwt[at[inner]].astype(np.int64) * (n + 1) + right[inner]).astype(np.int32))
            at, left, right = after[on], left[on], right[on]
            if not len(at):
                break
        met[np.concatenate(lefts)] = True
        if len(at):  # many runs: one rank for every symbol
            for b, e in zip(begin, stop):
                j = b + np.searchsorted(by[b:e], left)
                good = np.flatnonzero((j > b) & (j < e))
                good = good[(by[j[good]] < right[good]) & ~met[j[good]]]
                lefts.append(j[good].astype(np.int32))
                rights.append((b + np.searchsorted(by[b:e], right[good])).astype(np.int32))
                met[lefts[-1]] = True
        left, right = np.concatenate(lefts), np.concatenate(rights)
    return np.flatnonzero(~met)


def search(u: Units):
    def run(raw: np.ndarray, first: np.ndarray, h: np.ndarray, doc: np.ndarray, copies: np.ndarray) -> np.ndarray:
        block = np.repeat(np.arange(len(doc)), np.diff(first))
        text = np.ones(len(raw) + len(doc) + 1, np.uint64)  # 1 parts the blocks, 0 ends the text
        place = np.arange(len(raw)) + block
        text[place] = raw.astype(np.uint64) + np.uint64(2)
        text[-1] = 0
        order = bounded_suffixes(text, u.window)
        hit = unmet_boundaries(text, order, u.window)
        unit = np.full(len(text), -1, np.int64)
        unit[place] = np.arange(len(raw))
        shared = np.zeros(len(text), bool)
        shared[order[hit]] = shared[order[hit - 1]] = True
        windows = unit[shared]
        windows = windows[windows >= 0]
        # all copies of a block met more than once go whole, and are not asked again
        return windows[(windows + u.window <= first[1:][block[windows]]) & (copies[block[windows]] == 1)]

    return run


def suffix_dedup(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of docs (its other columns as they are) with _n, _n_removed, _n_spans, _kept_sha256 and _kept.

    A byte goes where a window over it also starts anywhere else, in the same text or another. Null text: empty. Null
    ids: the rows take part like any other; rows that repeat both id and text are copies of each other and lose their
    windows. Texts shorter than a window lose nothing. An empty table gives no rows. _kept may hold broken characters
    where a span cuts one; _kept_sha256 is over the exact bytes.
    """
    u = Units(words=False, window=window, k=min(SEED, window))
    spans = repeated_spans(docs, u, search(u), False, doc_id, text)
    return remove_spans(docs, spans, u, doc_id, text, rest_of(u))

"""Token counts under a byte-pair vocabulary with word ends, without building the tokens.

Texts are normalised and cut into pre-tokens as arrays of code points. The different pre-tokens of a chunk are held as one
ragged array of symbols. In each round every sequence looks up the ranks of its neighbouring pairs, and applies its own
lowest pair wherever it stands, left before right; all sequences do so at once. A sequence without a pair left is done,
and its symbols are counted. A merge makes a symbol of its own, so pairs with it rank after it: applying one rank at a
time gives what the library's queue gives. Pre-tokens of many symbols keep a linked list and their places by rank
instead, so that a round costs what it changes and not the whole length; the rounds and results are the same.

What is a letter, a number or a space, and how a character is lower-cased, is asked of the library once for each character
met. Rows with characters that can combine with others are normalised by the library as a whole.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import chunks, small_batches

MODEL = "/opt/tokenizers/word_bpe_49k.json"
MAX_TOKENS = 2048
BYTES_AT_ONCE = 4 << 20
#: Pre-tokens of more symbols than this keep their places by rank.
LONG = 1024
NONE = np.int32(2**31 - 1)
SPACE, LETTER, NUMBER, OTHER = 1, 2, 3, 4

# fixed values: the kinds of file that are understood
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next one from U+0100."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(prints) else chr(next(rest)) for b in range(256)]


class Merges:
    """Ranks of pairs in a hash table of arrays, and the symbol that each rank makes."""

    def __init__(self, ids: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        pairs = np.array([(ids[a], ids[b]) for a, b in merges], np.int64).reshape(-1, 2)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        of = byte_characters()
        self.inner = np.array([ids[c] for c in of], np.int32)
        self.last = np.array([ids[c + suffix] for c in of], np.int32)
        first = np.full(max(ids.values()) + 1, -1)
        first[self.made] = np.arange(len(self.made))
        if len(set(self.made.tolist())) < len(merges) or (first[pairs] >= np.arange(len(pairs))[:, None]).any():
            raise ValueError("each merge must make a symbol of its own out of earlier ones")
        self.bits = max(4, int(np.ceil(np.log2(4 * len(pairs) + 1))))
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):  # each free slot takes one key, the others go on to the next
            free = self.keys[at[left]] == -1
            slots, who = np.unique(at[left[free]], return_index=True)
            taken = left[free][who]
            self.keys[slots], self.ranks[slots] = keys[taken], taken
            left = np.setdiff1d(left, taken)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE for no merge."""
        keys = a.astype(np.int64) << 32 | b
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


def _alternate(chosen: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Of chosen places in a row that overlap (each follows the one before), every second from the left is left out."""
    n = np.arange(len(chosen))
    start = np.maximum.accumulate(np.where(follows, -1, n))
    return chosen[(n - start) % 2 == 0]


def survivors(symbols: np.ndarray, offsets: np.ndarray, merges: Merges) -> np.ndarray:
    """How many symbols each sequence symbols[offsets[i]:offsets[i + 1]] has left after all merges."""
    out = np.diff(offsets)
    for i in np.flatnonzero(out > LONG):
        out[i] = _survivors_of_one(symbols[offsets[i] : offsets[i + 1]], merges)
    size = np.diff(offsets)
    who = np.flatnonzero((size > 1) & (size <= LONG))
    take = np.repeat((size > 1) & (size <= LONG), size)
    ids, size = symbols[take].astype(np.int32), size[who]
    while len(who):
        start = np.cumsum(size) - size
        rank = np.full(len(ids), NONE, np.int32)
        inner = np.ones(len(ids), bool)
        inner[start + size - 1] = False
        at = np.flatnonzero(inner)
        rank[at] = merges.rank(ids[at], ids[at + 1])
        least = np.minimum.reduceat(rank, start)
        going = least < NONE
        out[who[~going]] = size[~going]
        chosen = np.flatnonzero((rank == np.repeat(least, size)) & np.repeat(going, size))
        chosen = _alternate(chosen, np.append(False, chosen[1:] == chosen[:-1] + 1))
        ids[chosen] = merges.made[rank[chosen]]
        keep = np.repeat(going, size)
        keep[chosen + 1] = False
        before = np.zeros(len(keep) + 1, np.int64)
        np.cumsum(keep, out=before[1:])
        size = (before[start + size] - before[start])[going]
        ids, who = ids[keep], who[going]
        done = size == 1
        if done.any():
            out[who[done]] = 1
            ids, who, size = ids[np.repeat(~done, size)], who[~done], size[~done]
    return out


def _survivors_of_one(symbols: np.ndarray, merges: Merges) -> int:
    """As above for one long sequence: links between symbols, and the places of each rank that is still to come."""
    n = len(symbols)
    ids = np.append(symbols, -1).astype(np.int32)
    after, before = np.arange(1, n + 2, dtype=np.int64), np.arange(-1, n, dtype=np.int64)
    rank = np.full(n + 1, NONE, np.int32)  # of the pair that starts here
    rank[: n - 1] = merges.rank(ids[: n - 1], ids[1:n])
    waiting: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def wait(places: np.ndarray) -> None:
        places = places[rank[places] < NONE]
        places = places[np.argsort(rank[places], kind="stable")]
        ranks, first = np.unique(rank[places], return_index=True)
        for r, some in zip(ranks.tolist(), np.split(places, first[1:])):
            if r not in waiting:
                heapq.heappush(heap, r)
            waiting.setdefault(r, []).append(some)

    wait(np.arange(n - 1))
    left = n
    while heap:
        r = heapq.heappop(heap)
        at = np.unique(np.concatenate(waiting.pop(r)))
        at = at[rank[at] == r]
        if not len(at):
            continue
        at = _alternate(at, np.append(False, after[at[:-1]] == at[1:]))
        gone = after[at]
        ids[at] = merges.made[r]
        after[at] = after[gone]
        before[after[at]] = at
        rank[gone] = NONE
        left -= len(at)
        touched = np.unique(np.concatenate([at, before[at][before[at] >= 0]]))
        rank[touched] = NONE
        inside = touched[after[touched] < n]
        rank[inside] = merges.rank(ids[inside], ids[after[inside]])
        wait(touched)
    return left


class Counter:
    """Normaliser, pre-tokeniser and merges of one vocabulary file."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        spec = json.loads(spec)
        model, (split, level) = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != NORMALIZERS or split["pattern"]["Regex"] != PATTERN or level["type"] != "ByteLevel" or model["type"] != "BPE" or level["add_prefix_space"]:
            raise ValueError("not a byte-pair vocabulary with word ends of the kind that is understood")
        self.merges = Merges(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
        self.special = re.compile(b"|".join(re.escape(t["content"].encode()) for t in spec["added_tokens"]))
        self.kind = np.zeros(0x110000, np.uint8)  # of a character after normalisation; 0: not met yet
        self.lower = np.zeros(0x110000, np.uint32)
        self.alone = np.zeros(0x110000, bool)  # normalised by itself, whatever stands beside it
        self.met = np.zeros(0x110000, bool)

    def _meet(self, points: np.ndarray) -> None:
        """Ask the library about characters of raw texts that are new."""
        if self.met[points].all():
            return
        for c in np.unique(points[~self.met[points]]).tolist():
            low = self.library.normalizer.normalize_str(chr(c))
            category = unicodedata.category(chr(c))
            self.alone[c] = len(low) == 1 and (category[0] in "LNPSZ" or category in ("Cc", "Cf")) and not 0x1160 <= c <= 0x11FF
            self.lower[c] = ord(low) if len(low) == 1 else c
            self.met[c] = True

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        out = self.kind[points]
        if (new := out == 0).any():
            cut = self.library.pre_tokenizer.pre_tokenize_str
            for c in np.unique(points[new]).tolist():
                x = chr(c)
                self.kind[c] = SPACE if not cut(x) else LETTER if len(cut("a" + x)) == 1 else OTHER if len(cut("!" + x)) == 1 else NUMBER
            out = self.kind[points]
        return out

    def _normalised(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all rows after normalisation, and where each row starts."""
        try:
            points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
            at = np.zeros(len(data) + 1, np.int64)
            np.cumsum(data & 0xC0 != 0x80, out=at[1:])
            offsets = at[offsets]
        except UnicodeDecodeError:
            rows = [np.frombuffer(data[i:j].tobytes().decode(errors="replace").encode("utf-32-le"), np.uint32) for i, j in zip(offsets[:-1], offsets[1:])]
            points, offsets = np.concatenate(rows), np.append(0, np.cumsum([len(x) for x in rows]))
        self._meet(points)
        odd = np.flatnonzero(~self.alone[points])
        if not len(odd):
            return self.lower[points], offsets
        rows = [self.lower[points[i:j]] for i, j in zip(offsets[:-1], offsets[1:])]
        for r in np.unique(np.searchsorted(offsets, odd, side="right") - 1):
            raw = points[offsets[r] : offsets[r + 1]].tobytes().decode("utf-32-le")
            rows[r] = np.frombuffer(self.library.normalizer.normalize_str(raw).encode("utf-32-le"), np.uint32)
        return np.concatenate(rows), np.append(0, np.cumsum([len(x) for x in rows]))

    def _pieces(self, points: np.ndarray, kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens."""
        n = len(points)
        cut = np.ones(n + 1, bool)
        cut[1:n] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
        cut[offsets] = True
        at = np.flatnonzero(cut)
        start, end = at[:-1], at[1:].copy()
        solid = kinds[start] != SPACE
        start, end = start[solid], end[solid]
        # an apostrophe by itself takes the ending that follows it
        row_start = np.zeros(n + 1, bool)
        row_start[offsets] = True
        lone = np.flatnonzero((end - start == 1) & (points[start] == ord("'")))
        lone = lone[lone + 1 < len(start)]
        lone = lone[(start[lone + 1] == end[lone]) & ~row_start[end[lone]] & (kinds[end[lone]] == LETTER)]
        if len(lone):
            size = end[lone + 1] - start[lone + 1]
            a = points[end[lone]]
            b = np.where(size > 1, points[np.minimum(end[lone] + 1, n - 1)], 0)
            short = np.isin(a, [ord(x) for x in "stmd"])
            double = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            taken = np.where(short, 1, np.where(double, 2, 0))
            end[lone] += taken
            start[lone + 1] += taken
            some = start < end
            start, end = start[some], end[some]
        return start, end

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of each row."""
        n_special = np.zeros(len(offsets) - 1, np.int64)
        if b"<|" in (raw := data.tobytes()):
            data = data.copy()
            for m in self.special.finditer(raw):
                row = int(np.searchsorted(offsets, m.start(), side="right")) - 1
                if m.end() <= offsets[row + 1]:
                    n_special[row] += 1
                    data[m.start() : m.end()] = 32  # nothing combines across a space
        if not len(data):
            return n_special
        points, offsets = self._normalised(data, offsets)
        if not len(points):
            return n_special
        kinds = self._kinds(points)
        start, end = self._pieces(points, kinds, offsets)
        if not len(start):
            return n_special
        solid = kinds != SPACE
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        size = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width * solid, out=size[1:])
        packed = points[solid].tobytes().decode("utf-32-le").encode()
        bounds = np.append(size[start], size[end[-1]])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(packed)]).dictionary_encode()
        each = words.dictionary
        edges = np.frombuffer(each.buffers()[1], np.int64)[: len(each) + 1]
        flat = np.frombuffer(each.buffers()[2], np.uint8)[: edges[-1]]
        symbols = self.merges.inner[flat]
        symbols[edges[1:] - 1] = self.merges.last[flat[edges[1:] - 1]]
        total = np.zeros(len(start) + 1, np.int64)
        np.cumsum(survivors(symbols, edges, self.merges)[words.indices.to_numpy()], out=total[1:])
        first = np.searchsorted(start, offsets)
        return total[first[1:]] - total[first[:-1]] + n_special


@lru_cache(maxsize=2)
def counter(spec: str) -> Counter:
    """One in each Python worker."""
    return Counter(spec)


def _cut_long(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, row of each part): rows of more than size bytes are cut at spaces, across which nothing combines."""
    out, rows = [], []
    for r, (i, j) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        while True:
            out.append(i)
            rows.append(r)
            if j - i <= size:
                break
            gap = data[i + size : j] == 32
            k = int(gap.argmax())
            if not len(gap) or not gap[k]:
                break
            i += size + k
    return np.array([*out, offsets[-1]], np.int64), np.array(rows, np.int64)


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row.

    Counts are those of the library without added special tokens; special strings inside a text count as one token each.
    A null text is empty and has no tokens; a null doc_id stays null; repeated rows are counted each by itself; an empty
    table gives no rows; other columns are ignored, whatever their names. Bytes that are no UTF-8 read as U+FFFD.
    """
    small_batches(docs.sparkSession)
    with open(model, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file
    kind = dict((f.name, f.dataType.simpleString()) for f in docs.schema)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1), BYTES_AT_ONCE):
                n = np.zeros(j - i, np.int64)
                parts, rows = _cut_long(data, offsets, 2 * BYTES_AT_ONCE)
                if len(rows) == j - i:
                    n += counter(spec.value).count(data, offsets)
                else:
                    for p, r in enumerate(rows):
                        n[r] += counter(spec.value).count(data[parts[p] : parts[p + 1]], np.array([0, parts[p + 1] - parts[p]]))[0]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > max_tokens)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("doc_id", doc_id)

"""SentencePiece encoding by Gumbel top-k without replacement, and exact decoding.

The lattice of a text has a node at each byte and an edge for each piece of the model found there; characters without a
piece fall back to byte pieces. Pieces never hold an inner space, so the lattice is a chain of units (a space and what
follows it), and each different unit of a chunk is built once. Backward sums turn the weights into a distribution over
the edges of each node. A unit of over 4,096 bytes counts as several, cut at characters: no piece crosses such a cut, and
decoding still gives the text exactly. A long text is sampled range by range of units, so memory beyond the text and its
ids stays the same however long it is; where ranges are cut has no effect on the samples.

Top-k is an A-star search over sets of paths. The whole set has a Gumbel value; its best path is drawn from the model and
takes that value. The rest of the set is split by the first edge at which a path leaves the drawn one; each part gets a
Gumbel value for its mass, truncated at the value above it. The part with the largest value is drawn from next. Values are
exact, not bounds, so k parts give the k best distinct paths. All randomness is a hash of the row's key.

A BPE model ranks its pieces but has no probabilities: a piece of rank r weighs (r + 2) ** -alpha (Zipf's law).
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import BYTE_CODES, CHUNK_BYTES, WORD_ROLLER, chunks, lean, mix, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, ALPHA, SEED = 2, 0.5, 1
#: A lattice is built over so many bytes at most (and one unit). No piece of the models given is as long as a unit may be.
RANGE_BYTES, UNIT_BYTES = CHUNK_BYTES, 4096
#: Bytes of different units whose edges a task holds, some 100 bytes for each.
MET_BYTES = 1 << 20
#: Edges of a path whose sets are valued at once.
EDGES_AT_ONCE = 1 << 18
NEVER = -1e8  # longer pieces of this score or less are not for use
MASK = (1 << 64) - 1


@dataclass
class Pieces:
    """All pieces as bytes (the space mark is a space), and a trie of them as rows laid over each other: the child of a node by
    a byte is in place base[node] + byte of child, if parent has the node there. 0 is the root."""

    data: np.ndarray
    start: np.ndarray
    weight: np.ndarray
    byte_ids: np.ndarray
    base: np.ndarray
    child: np.ndarray
    parent: np.ndarray  # -1 where no child is
    piece_at: np.ndarray  # by node; -1 where no piece ends

    def __post_init__(self) -> None:
        self.size = np.diff(self.start)
        self.size_type = np.min_scalar_type(int(self.size.max(initial=1)))

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Children of nodes by a byte each; -1 is no node."""
        place = self.base.take(node) + byte
        return np.where(self.parent.take(place) == node, self.child.take(place), np.int32(-1))

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, one after the other."""
        out = []
        for a in range(0, len(ids), EDGES_AT_ONCE):
            part = ids[a : a + EDGES_AT_ONCE]
            n = self.size[part]
            ends = np.cumsum(n)
            out.append(self.data[np.repeat(self.start[part] - (ends - n), n) + np.arange(ends[-1])].tobytes())
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, without the space that encoding puts first."""
        return self.joined(ids)[1:]


def load_pieces(path: str = MODEL, alpha: float = ALPHA) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts, byte_ids, weight, known = [], np.zeros(256, np.int64), [], {}
    for i in range(model.get_piece_size()):
        text, rank = model.id_to_piece(i), -model.get_score(i)
        usable = not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) or (rank >= -NEVER and len(text) > 1))
        raw = text.replace("▁", " ").encode()
        if model.is_byte(i):
            raw = bytes([int(text[3:5], 16)])
            byte_ids[raw[0]] = i
        texts.append(raw if usable or model.is_byte(i) else b"")
        weight.append(-alpha * np.log(min(rank, model.get_piece_size()) + 2) if usable else 0.0)
        if usable and b" " not in raw[1:]:
            known[raw] = i
    weight = np.array(weight)
    weight[byte_ids] = -alpha * np.log(len(texts) + 2)
    number = {raw: i for i, raw in enumerate(sorted({b""} | {raw[:n] for raw in known for n in range(1, len(raw) + 1)}, key=lambda x: (len(x), x)))}
    piece_at = np.array([known.get(raw, -1) for raw in number], np.int32)
    trie = laid_over(number)
    return Pieces(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), weight, byte_ids, *trie, piece_at)


def laid_over(number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, child and parent of a trie's nodes. Rows of many children look for room first, one child fits anywhere."""
    rows: list[list[tuple[int, int]]] = [[] for _ in number]
    for raw, node in number.items():
        if raw:
            rows[number[raw[:-1]]].append((raw[-1], node))
    base = np.zeros(len(number), np.int32)
    places = len(number) + 512  # rows that find no room go behind
    child, parent = np.zeros(places, np.int32), np.full(places, -1, np.int32)
    low = 256  # no place of a row is before 0; about all places before low are taken
    for node in sorted(range(len(rows)), key=lambda x: -len(rows[x])):
        row = sorted(rows[node])
        if not row:
            break
        nodes, at = np.array([n for _, n in row], np.int32), np.array([c for c, _ in row])
        while True:
            if low + 2048 > len(parent):
                child, parent = np.append(child, np.zeros(4096, np.int32)), np.append(parent, np.full(4096, -1, np.int32))
            free = np.flatnonzero(parent[low : low + 1024] < 0) + low - at[0]
            fits = free[(parent[free[:, None] + at] < 0).all(1)] if len(row) > 1 else free
            if len(fits):
                break
            low += 256
        base[node] = fits[0]
        child[fits[0] + at], parent[fits[0] + at] = nodes, node
    end = int(base.max(initial=0)) + 256
    return base, child[:end].copy(), parent[:end].copy()


class Lattice:
    """Edges of many units by node (byte place in the joined units), with their probabilities."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, pieces: Pieces):
        n = len(data)
        self.end = np.repeat(offsets[1:].astype(np.int32), np.diff(offsets))
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead).astype(np.int32)
        found, length = [], 0
        width = np.where(data < 0xC0, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4))).astype(np.uint8)
        whole = np.zeros(n, bool)
        node = pieces.step(np.zeros(len(at), np.int32), data.take(at))
        while len(at):
            length += 1
            good = np.flatnonzero(node >= 0)
            at, node = at.take(good), node.take(good)
            i = pieces.piece_at.take(node)
            real = np.flatnonzero(i >= 0)
            ends_here = at.take(real)
            found.append((ends_here, length, i.take(real)))
            if length <= 4:
                whole[ends_here[width.take(ends_here) == length]] = True
            on = np.flatnonzero(at + length < self.end.take(at))
            at = at.take(on)
            node = pieces.step(node.take(on), data.take(at + length))
        alone = np.flatnonzero(lead & ~whole)
        for extra in range(4):
            more = alone[width[alone] > extra] + extra
            more = more[more < self.end[alone[width[alone] > extra]]]
            found.append((more, 1, pieces.byte_ids[data[more]]))
        # nodes by their distance to the unit's end; the edges of a node together, long ones first: they are likely, and
        # draws try edges in order
        count = np.zeros(n, np.int16)  # a piece is shorter than a unit
        for at, _, _ in found:
            count[at] += 1  # a place is there once
        left = self.end - np.arange(n, dtype=np.int32)
        order = np.argsort(left.astype(np.uint16) if n and left.max() < 1 << 16 else left, kind="stable")
        order = order[count[order] > 0].astype(np.int32)
        count = count[order]
        stop = np.cumsum(count)
        first = stop - count
        self.first, self.count = np.zeros(n, np.int32), np.zeros(n, np.int16)  # of the edges of each node
        self.first[order], self.count[order] = first, count
        self.node = np.repeat(order, count)
        self.size, self.ids = np.empty(len(self.node), pieces.size_type), np.empty(len(self.node), np.int32)
        free = self.first.copy()
        for at, size, ids in reversed(found):
            to = free.take(at)
            self.size[to], self.ids[to] = size, ids
            free[at] = to + 1
        weight = pieces.weight.take(self.ids)
        # backward sums, from the unit ends on: nodes with the same distance to the end at once
        beta = np.zeros(n + 1)
        cuts = np.append(np.flatnonzero(np.append(True, left[order[1:]] != left[order[:-1]])), len(order)) if len(order) else np.zeros(1, np.int64)
        after = self.node + self.size
        after[after >= self.end.take(self.node)] = n  # where beta stays 0
        total = np.empty(len(self.node))
        for a, b in zip(cuts[:-1], cuts[1:]):
            lo, hi = first[a], stop[b - 1]
            total[lo:hi] = weight[lo:hi] + beta.take(after[lo:hi])
            beta[order[a:b]] = np.logaddexp.reduceat(total[lo:hi], first[a:b] - lo)
        self.logp = total - beta.take(self.node)
        # sums within each node alone, so that they don't depend on what else is in the lattice
        self.within = np.exp(self.logp)
        more, k = first[count > 1], 1
        while len(more):
            self.within[more + k] += self.within[more + k - 1]
            k += 1
            more = first[count > k]
        self.within[stop - 1] = 1.0
        self.nodes, self.edges = n, len(self.node)

    def append(self, other: Lattice) -> None:
        """Put the units of another lattice behind those here, whose places stay."""
        nodes, edges = self.nodes, self.edges
        self.nodes, self.edges = nodes + other.nodes, edges + other.edges
        for name, shift in (("end", nodes), ("first", edges), ("count", 0)):
            setattr(self, name, appended(getattr(self, name), nodes, getattr(other, name), shift))
        for name, shift in (("node", nodes), ("size", 0), ("ids", 0), ("logp", 0), ("within", 0)):
            setattr(self, name, appended(getattr(self, name), edges, getattr(other, name), shift))

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """One edge for each node."""
        e = self.first.take(node)
        more = np.flatnonzero(u > self.within.take(e))
        while len(more):
            e[more] += 1
            more = more[u.take(more) > self.within.take(e.take(more))]
        return e

    def paths(self, node: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw a path from each node to its unit's end: edges in order, and how many of each."""
        count = np.zeros(len(node), np.int64)
        live, at, steps = np.arange(len(node)), node.copy(), []
        step = 0
        while len(live):
            e = self.draw(at, uniform(seed.take(live) + np.uint64(step * 0x9E3779B97F4A7C15 & MASK)))
            steps.append((live, e))
            count[live] += 1
            goal = self.end.take(at)
            at = at + self.size.take(e)
            on = np.flatnonzero(at < goal)
            live, at = live.take(on), at.take(on)
            step += 1
        begin = np.cumsum(count) - count
        out = np.empty(count.sum(), np.int64)
        for k, (live, e) in enumerate(steps):
            out[begin.take(live) + k] = e
        return out, count


def appended(a: np.ndarray, used: int, more: np.ndarray, shift: int) -> np.ndarray:
    """a with more + shift from place used on, in place where there is room."""
    need = used + len(more)
    if need > len(a):
        a, old = np.empty(max(need, len(a) * 5 // 4), a.dtype), a
        a[:used] = old[:used]
    np.add(more, a.dtype.type(shift), out=a[used:need])
    return a


class Met:
    """Units that a task has met, each built once and held with its edges, as chunks of text share most of their words.

    About most bytes of them are held; then it begins anew. What is held has no effect on samples.
    """

    def __init__(self, pieces: Pieces, most: int = MET_BYTES):
        self.pieces, self.most, self.data = pieces, most, np.zeros(0, np.uint8)
        self.lattice = Lattice(self.data, np.zeros(1, np.int64), pieces)
        self.clear()

    def clear(self) -> None:
        self.lattice.nodes = self.lattice.edges = 0  # arrays stay, to be filled again
        self.keys, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def places(self, data: np.ndarray, bounds: np.ndarray, keys: np.ndarray, one: np.ndarray, which: np.ndarray) -> np.ndarray | None:
        """First nodes of units, those not met before built on the way. keys: the hashes of different units, in order; one and
        which as np.unique gives them. None where a hash stands for different units."""
        length = bounds[one + 1] - bounds[one]
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inner = at < len(self.keys)
        new[inner] = self.keys[at[inner]] != keys[inner]
        held = self.lattice.nodes
        if held and held + length[new].sum() > self.most:
            self.clear()
            return self.places(data, bounds, keys, one, which)
        if new.any():
            to = np.concatenate([[0], np.cumsum(length[new])])
            raw = data[np.repeat(bounds[one[new]] - to[:-1], length[new]) + np.arange(to[-1])]
            self.data = appended(self.data, held, raw, 0)
            self.lattice.append(Lattice(raw, to, self.pieces))
            self.keys, self.begin, self.size = (np.insert(a, at[new], x) for a, x in ((self.keys, keys[new]), (self.begin, held + to[:-1]), (self.size, length[new])))
            at = np.searchsorted(self.keys, keys)
        first = self.begin[at][which]
        if (self.size[at][which] != np.diff(bounds)).any() or not np.array_equal(self.data[np.repeat(first - bounds[:-1], np.diff(bounds)) + np.arange(bounds[-1])], data):
            return None
        return first


def uniform(x: np.ndarray) -> np.ndarray:
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gumbel(x: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(uniform(x)))


def units_of(data: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with a space put first (none for an empty text), unit starts, and the first unit of each text."""
    n = np.diff(offsets)
    some = np.flatnonzero(n)
    out = np.insert(data, offsets[:-1][some], 32)
    moved = np.concatenate([[0], np.cumsum(n + (n > 0))])
    control = (out < 32) | (out == 127)
    begin = control | (out == 32)
    begin[1:] |= control[:-1]
    begin[moved[:-1][some]] = True
    starts = np.flatnonzero(begin)
    size = np.diff(np.append(starts, len(out)))
    long = np.flatnonzero(size > most)
    if len(long):  # cut before the character at each multiple of most
        cuts = np.concatenate([np.arange(most, size[i], most) + starts[i] for i in long])
        for _ in range(3):
            cuts = cuts - ((out[cuts] & 0xC0) == 0x80)
        starts = np.union1d(starts, cuts)
    return out, starts, np.searchsorted(starts, moved)


class Ranges:
    """The units of a chunk in ranges of a bounded number of bytes. Lattices are built when asked for; one is held."""

    def __init__(self, texts: np.ndarray, starts: np.ndarray, pieces: Pieces, size: int, met: Met | None = None):
        self.met = met
        self.texts, self.pieces, self.bounds = texts, pieces, np.append(starts, len(texts))
        self.cuts = [0]
        while self.cuts[-1] < len(starts):
            a = self.cuts[-1]
            self.cuts.append(max(a + 1, int(np.searchsorted(self.bounds, self.bounds[a] + size, side="right")) - 1))
        self.now = -1

    def __len__(self) -> int:
        return len(self.cuts) - 1

    def of(self, unit: int) -> int:
        return bisect.bisect_right(self.cuts, unit) - 1

    def at(self, g: int) -> tuple[Lattice, np.ndarray, int, int]:
        """Lattice of range g, the first node of each of its units, its first unit and the one after its last."""
        a, b = self.cuts[g], self.cuts[g + 1]
        if g != self.now:
            bounds = self.bounds[a : b + 1] - self.bounds[a]
            data = self.texts[self.bounds[a] : self.bounds[b]]
            h = WORD_ROLLER.spans(WORD_ROLLER.prefix(BYTE_CODES[data]), bounds[:-1], bounds[1:])
            keys, one, which = np.unique(h, return_index=True, return_inverse=True)  # each different unit is built once
            if self.met is not None and len(self) == 1:
                known = self.met.places(data, bounds, keys, one, which)
                if known is not None:
                    self.lattice, self.first, self.now = self.met.lattice, known, g
                    return self.lattice, self.first, a, b
            length = bounds[one + 1] - bounds[one]
            to = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
            pick = np.repeat(bounds[one] - to[:-1], length) + np.arange(to[-1])
            same = np.repeat(to[which] - bounds[:-1], np.diff(bounds)) + np.arange(bounds[-1])  # of each byte, the place in pick
            if (np.diff(bounds) != length[which]).any() or not np.array_equal(data[pick][same], data):
                to, which, pick = bounds, np.arange(len(bounds) - 1), np.arange(len(data))  # two units share a hash: build them all
            self.lattice = None
            self.lattice, self.first, self.now = Lattice(data[pick], to, self.pieces), to[which], g
        return self.lattice, self.first, a, b


@dataclass
class Sample:
    """A path: for each edge its place in its range's lattice, its unit in the text, its piece and log probability."""

    edge: np.ndarray
    unit: np.ndarray
    ids: np.ndarray
    logp: np.ndarray
    value: float


NOTHING = (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))


def _joined(parts: list[tuple[np.ndarray, ...]], value: float, last: bool = False) -> Sample:
    """One path of parts, which are emptied column by column on the way. No path leaves a last one: its edges and units go."""
    columns = [list(x) for x in zip(*parts)] or [[x] for x in NOTHING]
    parts.clear()
    out = []
    for i, column in enumerate(columns):
        out.append(NOTHING[i] if last and i < 2 else np.concatenate(column))
        column.clear()
    return Sample(*out, value)


def encode_chunk(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, pieces: Pieces, k: int = SAMPLES, seed: int = SEED, range_bytes: int = RANGE_BYTES, unit_bytes: int = UNIT_BYTES, met: Met | None = None) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k segmentations: (ids, log probability, Gumbel value, log of the inclusion probability).

    range_bytes bounds the lattice that is held at a time and has no effect on the result; nor has met, which holds what other
    chunks had to build.
    """
    texts, starts, first = units_of(data, offsets, unit_bytes)
    ranges = Ranges(texts, starts, pieces, range_bytes, met)
    rows = len(offsets) - 1
    row_seed = mix(keys.view(np.uint64) ^ mix(np.full(rows, seed, np.uint64)))
    sampled: list[list[Sample]] = [[] for _ in range(rows)]
    heaps: list[list] = [[] for _ in range(rows)]

    def draw(lattice: Lattice, row: np.ndarray, node: np.ndarray, unit: np.ndarray, turn: int) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
        """Paths from nodes to their units' ends, as the arrays of a Sample, and the place after each path's last edge."""
        noise = mix(row_seed[row] + np.uint64((turn + 1) * 0xD1B54A32D192ED03 & MASK)) + unit.astype(np.uint64) * np.uint64(0xABC98388FB8FAC03)
        edge, count = lattice.paths(node, noise)
        return (edge.astype(np.int32), np.repeat(unit.astype(np.int32), count), lattice.ids.take(edge), lattice.logp.take(edge)), np.concatenate([[0], np.cumsum(count)])

    def expand(drawn: list[tuple[int, Sample, int, tuple[int, ...], float]], turn: int) -> None:
        """Put the best parts of what remains of drawn sets (row, path, first edge, edges barred there, their mass) on the rows'
        heaps. The edges of many paths are valued at once, those of a long one in parts."""
        seeds = mix(row_seed + np.uint64(turn + 1))
        before, top = [float(s.logp[:t].sum()) for _, s, t, _, _ in drawn], [[] for _ in drawn]
        parts, held = [], 0
        for x, (_, s, from_edge, _, _) in enumerate(drawn):
            for a in range(from_edge, len(s.logp), EDGES_AT_ONCE):
                n = min(EDGES_AT_ONCE, len(s.logp) - a)
                if held + n > EDGES_AT_ONCE:
                    value(drawn, parts, seeds, before, top)
                    parts, held = [], 0
                parts.append((x, a, n))
                held += n
        value(drawn, parts, seeds, before, top)
        for x, (r, _, from_edge, barred, _) in enumerate(drawn):
            for v, t in heapq.nsmallest(k, top[x]):
                heapq.heappush(heaps[r], (v, len(sampled[r]) - 1, t, barred if t == from_edge else ()))

    def value(drawn: list[tuple[int, Sample, int, tuple[int, ...], float]], parts: list[tuple[int, int, int]], seeds: np.ndarray, before: list[float], top: list[list]) -> None:
        if not parts:
            return
        x, first_edge, n = np.array(parts).T
        bounds = np.concatenate([[0], np.cumsum(n)])
        all_logp = np.concatenate([drawn[i][1].logp[a : a + m] for i, a, m in parts])
        mass = -np.expm1(np.minimum(all_logp, 0.0))
        for (i, a, _), lo in zip(parts, bounds.tolist()):
            if a == drawn[i][2]:
                mass[lo] -= drawn[i][4]
        can = np.flatnonzero(mass >= 1e-12)
        t = can + np.repeat(first_edge - bounds[:-1], n).take(can)
        noise = uniform(np.repeat(seeds[[d[0] for d in drawn]][x], n).take(can) + t.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
        gain = np.log(mass.take(can) / -np.log(noise))  # log mass and Gumbel noise; truncating keeps their order
        cuts = np.searchsorted(can, bounds).tolist()
        for (i, _, _), lo, hi, c, d in zip(parts, bounds[:-1].tolist(), bounds[1:].tolist(), cuts[:-1], cuts[1:]):
            logp = all_logp[lo:hi]
            ahead = before[i] + np.cumsum(logp) - logp
            before[i] += float(logp.sum())
            v = ahead.take(can[c:d] - lo) + gain[c:d]
            best = np.argpartition(-v, k)[:k] if len(v) > 4 * k else np.arange(len(v))
            top[i].extend(zip(np.logaddexp(-drawn[i][1].value, -v[best]).tolist(), t[c:d][best].tolist()))

    root = gumbel(row_seed)
    parts: list[list] = [[] for _ in range(rows)]
    for g in range(len(ranges)):
        lattice, node, a, b = ranges.at(g)
        row = np.searchsorted(first, np.arange(a, b), side="right") - 1
        cols, ends = draw(lattice, row, node, np.arange(a, b) - first[row], 0)
        for r in range(int(row[0]), int(row[-1]) + 1):
            cut = slice(ends[max(first[r], a) - a], ends[max(min(first[r + 1], b), a) - a])
            parts[r].append(tuple(c[cut] for c in cols))
        cols = ()
    for r in range(rows):
        sampled[r].append(_joined(parts[r], float(root[r]), k == 1))
    expand([(r, sampled[r][0], 0, (), 0.0) for r in range(rows)], 1)
    for turn in range(1, k):
        last = turn == k - 1
        todo, chance = [], uniform(mix(row_seed) + np.uint64(turn))
        for r in range(rows):
            if not heaps[r]:
                continue
            best, parent, t, barred = heapq.heappop(heaps[r])
            old = sampled[r][parent]
            unit = int(old.unit[t])
            lattice, node, a, _ = ranges.at(ranges.of(int(first[r]) + unit))
            at = lattice.node[old.edge[t]]
            choices = np.arange(lattice.first[at], lattice.first[at] + lattice.count[at])
            not_ = (*barred, int(old.edge[t]))
            for x in not_:
                choices = choices[choices != x]
            p = np.cumsum(np.exp(lattice.logp[choices]))
            e = int(choices[min(np.searchsorted(p, chance[r] * p[-1], side="right"), len(choices) - 1)])
            lost = float(np.exp(lattice.logp[list(not_)]).sum())
            head = (np.array([e], np.int32), np.array([unit], np.int32), lattice.ids[e : e + 1], lattice.logp[e : e + 1])
            after = int(lattice.node[e] + lattice.size[e])
            rest = after if after < lattice.end[lattice.node[e]] else -1  # where its unit goes on
            todo.append((r, -best, old, t, not_, lost, unit, rest, [tuple(x[:t] for x in (old.edge, old.unit, old.ids, old.logp)), head]))
        # what follows the new edges, range by range and for all rows at once
        for g in sorted({x for r, *_, unit, _, _ in todo for x in range(ranges.of(int(first[r]) + unit), ranges.of(max(int(first[r + 1]) - 1, 0)) + 1)}):
            lattice, node, a, b = ranges.at(g)
            nodes, rows_of, units, mine = [], [], [], []
            for x in todo:
                r, unit, rest = x[0], x[6], x[7]
                lo, hi = max(int(first[r]) + unit + 1, a), min(int(first[r + 1]), b)
                new, no = node[lo - a : max(hi, lo) - a], np.arange(lo, max(hi, lo)) - first[r]
                if rest >= 0 and a <= first[r] + unit < b:
                    new, no = np.append(rest, new), np.append(unit, no)
                if len(new):
                    nodes.append(new), units.append(no), rows_of.append(np.full(len(new), r)), mine.append(x)
            if not mine:
                continue
            cols, ends = draw(lattice, np.concatenate(rows_of), np.concatenate(nodes), np.concatenate(units), turn)
            if last:
                cols = (*NOTHING[:2], *cols[2:])
            cuts = ends[np.concatenate([[0], np.cumsum([len(x) for x in nodes])])]
            for x, lo, hi in zip(mine, cuts[:-1], cuts[1:]):
                x[-1].append(tuple(c[lo:hi] for c in cols))
            cols = ()
        new = []
        for r, best, old, t, barred, lost, _, _, pieces_of in todo:
            s = _joined(pieces_of, best, last)
            sampled[r].append(s)
            new.append((r, s, t, barred, lost))
        # paths that share the part up to t and leave at t by yet another edge, or later
        expand(new, turn + 1)
    out = []
    for r in range(rows):
        limit = -heaps[r][0][0] if heaps[r] else -np.inf
        mine = []
        for s in sampled[r]:
            logp = float(s.logp.sum())
            x = logp - limit
            mine.append((s.ids, logp, s.value, 0.0 if x == np.inf else float(x if x < -30 else np.log(-np.expm1(-np.exp(min(x, 700.0)))))))
        sampled[r] = []
        out.append(mine)
    return out


RESULT = "doc_id bigint, sample int, n_pieces bigint, log_prob double, value double, log_inclusion double, ids_sha256 string, decoded_ok boolean"


def sample_segmentations(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED, model: str = MODEL, with_ids: bool = False) -> DataFrame:
    """Up to k rows for each input row: sample (from 1, best value first), pieces, scores, digest of the ids, and whether
    decoding the ids gives the text again; with_ids adds the ids themselves.

    Null and empty texts have one segmentation, of no pieces. Texts with fewer than k segmentations give them all, each
    with inclusion probability 1. A null doc_id is kept and seeds as -1. Repeated rows get the same samples. An empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(load_pieces(model, alpha))  # a few MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        met = Met(pieces)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, data, offsets in chunks(batch.column(1), CHUNK_BYTES // 4):
                keys = np.array([-1 if x is None else x for x in ids[i:j]], np.int64)
                found = encode_chunk(data, offsets, keys, pieces, k, seed, met=met)
                rows = np.repeat(np.arange(j - i), [len(x) for x in found])
                samples = [s for x in found for s in x]
                codes = np.concatenate([s[0] for s in samples])
                ends = np.cumsum([len(s[0]) for s in samples])
                decoded, raw = pieces.joined(codes), codes.astype("<i4", copy=False).data
                n = np.concatenate([[0], np.cumsum(pieces.size[codes])])[ends]
                text, good, digest, at, byte_at = data.tobytes(), [], [], 0, 0
                for r, end, byte_end in zip(rows.tolist(), ends.tolist(), n.tolist()):
                    good.append(decoded[byte_at + 1 : byte_end] == text[offsets[r] : offsets[r + 1]])
                    digest.append(hashlib.sha256(raw[at:end]).hexdigest())
                    at, byte_at = end, byte_end
                no = np.concatenate([np.arange(1, len(x) + 1) for x in found])
                cols = {
                    "doc_id": pa.array([ids[i + r] for r in rows.tolist()], pa.int64()), "sample": pa.array(no.astype(np.int32)), "n_pieces": pa.array(np.diff(ends, prepend=0)),
                    "log_prob": pa.array([s[1] for s in samples]), "value": pa.array([s[2] for s in samples]), "log_inclusion": pa.array([s[3] for s in samples]),
                    "ids_sha256": pa.array(digest, pa.string()), "decoded_ok": pa.array(good),
                }
                if with_ids:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(codes))
                yield pa.RecordBatch.from_pydict(cols)

    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return slim.mapInArrow(lean(run), RESULT + (", ids array<int>" if with_ids else "")).withColumnRenamed("doc_id", doc_id)

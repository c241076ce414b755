"""N-gram Jaccard join with signature trees.

Two shingle sets with Jaccard similarity of at least 9/10 differ in at most (|x|+|y|)/19 shingles. So when shingles are
dealt by hash to one part more than that, some part is the same in both (pigeonhole); equal parts make a bucket. Buckets
with one smallest member (the pivot) are joined to one group, so that documents which share many parts meet once. Inside a
group a signature tree is built: a node holds the OR of its members' token bitmaps and the range of their sizes. Two trees
are walked together, and a pair of nodes goes on only if the largest overlap that bitmaps and sizes allow is enough. Pairs
of documents left over are compared exactly; documents already linked need no second proof.

At first each document visits one group only, which links most copies. A second round takes the groups whose members are
still in different components, and compares all but the largest component with the whole group: first by trees of the
signatures alone, then by the sets of those members which the trees leave a partner in another component. Groups beyond BLOCK
documents are cut into blocks and compared pair by pair of blocks, so no task holds an unbounded group and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import ARROW_ROWS, GRAM_ROLLER, by_place, chunks, discard, keyed_words, lean, materialise, mix, rows_for_broadcast, small_batches, word_bounds

SHINGLE, PERCENT = 3, 90
#: Most documents of one group that one task compares with each other.
BLOCK = 1024
#: Size classes grow by this factor; a set near the upper end of its class also visits the next.
CLASS_GROWTH = 1.5
BITS = 2048
#: Ids to drop are broadcast up to this number (8 bytes each), and joined by a shuffle beyond.
BROADCAST_IDS = 2_000_000
FANOUT = 8


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and where each text's begin."""
    starts, ends, first = word_bounds(data, offsets)
    words = keyed_words(data, starts, ends)
    grams = GRAM_ROLLER.grams(GRAM_ROLLER.prefix(words), size)
    prefix = GRAM_ROLLER.prefix(words)
    out, n = [], np.zeros(len(offsets), np.int64)
    for r, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b - a >= size:
            g = np.sort(grams[a : b - size + 1])
            keep = np.ones(len(g), bool)
            np.not_equal(g[1:], g[:-1], out=keep[1:])
            g = g[keep]
        elif b > a:
            g = GRAM_ROLLER.spans(prefix, np.array([a]), np.array([b]))
        else:
            g = np.zeros(0, np.uint64)
        out.append(g)
        n[r + 1] = len(g)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(n)


def _upper(c: np.ndarray) -> np.ndarray:
    """Largest set size of a class."""
    return np.ceil(CLASS_GROWTH ** (c + 1)).astype(np.int64) - 1


def class_of(n: np.ndarray) -> np.ndarray:
    c = np.floor(np.log(np.maximum(n, 1)) / np.log(CLASS_GROWTH)).astype(np.int64)
    c += n > _upper(c)
    return c - ((c > 0) & (n <= _upper(c - 1)))


def _parts(c: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(parts, spare) of a size class. Sets of the class differ in at most parts - 1 - spare shingles, so more than spare
    parts are the same; a set with no more than spare empty parts then shares one that is not empty."""
    upper = _upper(c)
    least = upper / CLASS_GROWTH * percent / 100
    needed = 2 * upper * (100 - percent) // (100 + percent) + 1
    spare = np.zeros_like(needed)
    for _ in range(4):
        empty = (needed + spare) * np.exp(-least / (needed + spare))
        spare = np.ceil(empty + 3 * np.sqrt(empty)).astype(np.int64)
    spare[needed == 1] = 0
    return needed + spare, spare


def _visits(n: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(takes part, number of parts, spare ones, class) of every set, for its own class and for the next one."""
    own = class_of(n)
    # a partner has at most n * 100 / percent shingles
    return [(takes, *_parts(c, percent), c) for takes, c in ((n > 0, own), ((n > 0) & (n * 100 // percent > _upper(own)), own + 1))]


def part_keys(sets: np.ndarray, first: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the parts of every set, in its own size class and, near the upper end, in the next one too.

    Empty parts would join sets that have nothing in common. They have keys only in sets with more of them than spare.
    """
    n = np.diff(first)
    rows, keys = [], []
    for takes, count, spare, c in _visits(n, percent):
        parts = np.where(takes, count, 0)
        base = np.cumsum(parts) - parts
        total = int(parts.sum())
        row_of = np.repeat(np.arange(len(n)), n)
        use = takes[row_of]
        x, r = sets[use], row_of[use]
        slot = base[r] + (x % parts[r].astype(np.uint64)).astype(np.int64)
        sums = np.zeros(total, np.uint64)
        np.add.at(sums, slot, mix(x))
        row = np.repeat(np.arange(len(n)), parts)
        part = np.arange(total) - base[row]
        full = np.bincount(slot, minlength=total) > 0
        wide = np.bincount(row[~full], minlength=len(n)) > spare
        give = full | wide[row]
        key = mix(sums ^ mix((c[row] * (1 << 32) + part).astype(np.uint64)))
        rows.append(row[give]), keys.append(key[give])
    return np.concatenate(rows), np.concatenate(keys)


def signature(s: np.ndarray) -> np.ndarray:
    """Bitmap of a set."""
    bits = np.zeros(BITS, np.uint8)
    bits[(s % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


class Members:
    """Members of a group: sizes and bitmaps, and the sets where they are there."""

    def __init__(self, size: list[int], bitmap: list[np.ndarray], sets: list[np.ndarray] | None = None):
        self.sets, self.size = sets or [], np.array(size, np.int64)
        self.bitmap = np.array(bitmap, np.uint64).reshape(len(size), BITS // 64)
        # shingles beyond the first of each bit: an overlap can exceed the common bits by no more than these
        self.excess = self.size - np.bitwise_count(self.bitmap).sum(1).astype(np.int64)

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Members:
        return cls([len(s) for s in sets], [signature(s) for s in sets], sets)


class Tree:
    """Levels from the leaves up: OR of bitmaps, size ranges and largest excess; node i of a level holds 8i..8i+7 below."""

    def __init__(self, m: Members, order: np.ndarray):
        self.order = order
        self.levels = [(m.bitmap[order], m.size[order], m.size[order], m.excess[order])]
        while len(self.levels[-1][0]) > 1:
            b, low, high, extra = self.levels[-1]
            cut = np.arange(0, len(b), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(extra, cut)))


def _possible(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether some pair below the nodes can still reach the threshold."""
    common = np.bitwise_count(x[0][i] & y[0][j]).sum(1).astype(np.int64)
    overlap = np.minimum(common + np.minimum(x[3][i], y[3][j]), np.minimum(x[2][i], y[2][j]))
    need = -(-percent * (x[1][i] + y[1][j]) // (100 + percent))
    return (overlap >= need) & (100 * x[2][i] >= percent * y[1][j]) & (100 * y[2][j] >= percent * x[1][i])


def candidate_pairs(m: Members, a: np.ndarray, b: np.ndarray | None, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dual traversal: pairs of members of a and b (or within a) that the tree can't rule out, a node pair's at a time."""
    left = Tree(m, a)
    right = left if b is None else Tree(m, b)
    stack = [(len(left.levels) - 1, len(right.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        p, q, i, j = stack.pop()
        ok = _possible(left.levels[p], i, right.levels[q], j, percent)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if p == 0 and q == 0:
            if b is None:
                i, j = i[i < j], j[i < j]
            yield left.order[i], right.order[j]
            continue
        if p >= q:
            n = len(left.levels[p - 1][0])
            kids = (i[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            i, j, p = kids[kids < n], np.repeat(j, FANOUT)[kids < n], p - 1
        else:
            n = len(right.levels[q - 1][0])
            kids = (j[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            i, j, q = np.repeat(i, FANOUT)[kids < n], kids[kids < n], q - 1
        if b is None and p == q:
            i, j = i[i <= j], j[i <= j]
        for at in range(0, len(i), 4096):
            stack.append((p, q, i[at : at + 4096], j[at : at + 4096]))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exact test on sorted distinct shingles."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = int((y[at] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def links(m: Members, names: list[int], a: np.ndarray, b: np.ndarray | None, known: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Proved links that join all members which any links join; known: labels of members linked before."""
    parent = list(range(len(names)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if known is not None:
        seen: dict[int, int] = {}
        for i, k in enumerate(known.tolist()):
            parent[i] = root(seen.setdefault(k, i))
    out = []
    for left, right in candidate_pairs(m, a, b, percent):
        for i, j in zip(left.tolist(), right.tolist()):
            p, q = root(i), root(j)
            if p != q and linked(m.sets[i], m.sets[j], percent):
                parent[max(p, q)] = min(p, q)
                out.append((names[i], names[j]))
    return out


EDGES = "a bigint, b bigint"


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])


def _each_set(column: pa.Array, size: int | None) -> Iterator[np.ndarray]:
    """The values of a list column, or the shingle set of each text."""
    if size is None:
        at, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield values[a:b].copy()
        return
    for _, _, data, offsets in chunks(column):
        sets, first = shingle_sets(data, offsets, size)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            yield sets[a:b].copy()


def _groups(batches: Iterator[pa.RecordBatch], keys: int, size: int | None = None) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of equal leading columns of sorted batches; with a size the last column has texts, and rows get their sets."""
    held: list[tuple] = []
    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in range(batch.num_columns - 1)]
        for row, own in zip(zip(*cols), _each_set(batch.column(batch.num_columns - 1), size)):
            if held and held[-1][:keys] != row[:keys]:
                yield held[-1][:keys], held
                held = []
            held.append((*row, own))
    if held:
        yield held[-1][:keys], held


def _within(percent: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for _, rows in _groups(batches, 2, size):
            sets = {r[2]: r[3] for r in rows}
            names = sorted(sets)
            if len(names) > 1:
                m = Members.of([sets[x] for x in names])
                edges += links(m, names, np.lexsort((np.arange(len(names)), m.size)), None, None, percent)
            if len(edges) > 5000:
                yield _edge_batch(edges)
                edges = []
        yield _edge_batch(edges)

    return run


MEET = ["pivot", "_slot", "block", "side", "component"]
MEETING = "pivot bigint, _slot int, block int, side boolean, component bigint, id bigint"


def _promising(percent: int):
    """Of each block of pairs the members which, by their signatures, may be linked with one of another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64())
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [*MEET, "id"])
            out.clear()
            return done

        for _, rows in _groups(batches, 3):
            rows.sort(key=lambda r: not r[3])
            n = sum(r[3] for r in rows)
            m = Members([r[6] for r in rows], [r[7] for r in rows])
            label, hope = np.array([r[4] for r in rows]), np.zeros(len(rows), bool)
            order = np.argsort(m.size, kind="stable")
            a, b = order[order < n], order[order >= n]
            for left, right in [(a, None), (a, b)]:
                if len(left) and (right is None or len(right)):
                    for i, j in candidate_pairs(m, left, right, percent):
                        apart = label[i] != label[j]
                        hope[i[apart]] = hope[j[apart]] = True
            out.extend(r[:6] for r, good in zip(rows, hope.tolist()) if good)
            if len(out) > 5000:
                yield flush()
        yield flush()

    return run


def _across(percent: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for _, rows in _groups(batches, 3, size):
            side = {r[5]: r for r in rows if r[3]}
            rest = {r[5]: r for r in rows if not r[3] and r[5] not in side}
            names = [*sorted(side), *sorted(rest)]
            if not side:
                continue
            m = Members.of([(side.get(x) or rest[x])[6] for x in names])
            label = np.array([(side.get(x) or rest[x])[4] for x in names])
            a, b = np.arange(len(side)), np.arange(len(side), len(names))
            a, b = a[np.argsort(m.size[a], kind="stable")], b[np.argsort(m.size[b], kind="stable")]
            edges += links(m, names, a, None, label, percent)
            if len(b):
                edges += links(m, names, a, b, label, percent)
        yield _edge_batch(edges)

    return run


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component): smallest id reachable. Small-star and large-star by turns; each round is written and read again."""
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours of u go to the smallest one
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.union(low.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        # small star: smaller neighbours of u, and u, go to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        old, edges = edges, materialise(small, "edges")
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(edges.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


SETS = "doc bigint, th bigint, n int, d1 bigint, d2 bigint, parts bigint"
#: About so many part keys meet in one bucket.
BUCKET_KEYS = 2_000_000
KEY_BITS = 48


def _facts(percent: int, size: int):
    """Size, digest (two sums of mixed hashes) and number of part keys of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(2)):
                sets, first = shingle_sets(data, offsets, size)
                n = np.diff(first)
                sums = []
                for salt in (0, 0x5851F42D4C957F2D):
                    total = np.zeros(len(sets) + 1, np.uint64)
                    np.cumsum(mix(sets ^ np.uint64(salt)), out=total[1:])
                    sums.append(pa.array((total[first[1:]] - total[first[:-1]]).view(np.int64)))
                parts = sum(np.where(takes, m, 0) for takes, m, _, _ in _visits(n, percent))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n.astype(np.int32)), *sums, pa.array(parts)], ["doc", "th", "n", "d1", "d2", "parts"])

    return run


PACKED = "bucket int, keys binary, places binary, docs binary, key bigint, doc bigint"


def _packed_keys(percent: int, size: int, buckets: int):
    """Part keys by bucket in packed rows, 8 bytes a key. Keys that come twice in a batch go out as (key, doc) rows, and
    only one of them into the bucket, so a key that many documents share adds little to its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, ARROW_ROWS) for b in batches for a in range(0, b.num_rows, ARROW_ROWS)):  # so places have 16 bits
            ids = batch.column(0).to_numpy()
            found = []
            for i, _, data, offsets in chunks(batch.column(1)):
                row, key = part_keys(*shingle_sets(data, offsets, size), percent)
                found.append((i + row, key))
            if not found:
                continue
            row, key = (np.concatenate(x) for x in zip(*found))
            bucket, key = mix(key) % np.uint64(buckets), key & np.uint64((1 << KEY_BITS) - 1)
            order = np.lexsort((key, bucket))
            row, key, bucket = row[order], key[order], bucket[order]
            lead = np.ones(len(key), bool)
            lead[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
            many = ~lead
            many[:-1] |= ~lead[1:]
            one_key, one_row, one_bucket = key[lead], row[lead], bucket[lead]
            cut = np.flatnonzero(np.append(True, one_bucket[1:] != one_bucket[:-1])) if len(one_bucket) else np.zeros(0, np.int64)
            out = []
            for b, lo, hi in zip(one_bucket[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(one_bucket)]):
                k, r = one_key[lo:hi], one_row[lo:hi]
                who, place = np.unique(r, return_inverse=True)
                low = np.concatenate([(k & np.uint64(0xFFFFFFFF)).astype("<u4").view(np.uint8), (k >> np.uint64(32)).astype("<u2").view(np.uint8)])
                out.append((int(b), low.tobytes(), place.astype("<u2").tobytes(), ids[who].astype("<i8").tobytes()))
            n, m = len(out), int(many.sum())
            cols = list(zip(*out)) if out else [()] * 4
            blank = [None] * m
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*cols[0], *blank], pa.int32()), *(pa.array([*c, *blank], pa.binary()) for c in cols[1:]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(_whole_key(key[many], bucket[many]))]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(ids[row[many]])]),
                ],
                ["bucket", "keys", "places", "docs", "key", "doc"],
            )

    return run


def _whole_key(key: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """A key and its bucket in 64 bits; keys only propose, so that two of them may fall together does no harm."""
    return mix(key ^ mix(bucket + np.uint64(1))).view(np.int64)


def _met_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc) of keys that come twice or more in a bucket."""

    def settle(bucket: int, keys: list[np.ndarray], docs: list[np.ndarray]) -> pa.RecordBatch:
        k, d = np.concatenate(keys), np.concatenate(docs)
        order = np.argsort(k, kind="stable")
        k, d = k[order], d[order]
        same = np.zeros(len(k), bool)
        same[1:] = k[1:] == k[:-1]
        same[:-1] |= same[1:]
        return pa.RecordBatch.from_arrays([pa.array(_whole_key(k[same], np.full(same.sum(), bucket, np.uint64))), pa.array(d[same])], ["key", "doc"])

    now, keys, docs = -1, [], []
    for batch in batches:
        for bucket, low, place, who in zip(*(c.to_pylist() for c in batch.columns[:4])):
            if bucket != now and keys:
                yield settle(now, keys, docs)
                keys, docs = [], []
            now, n = bucket, len(place) // 2
            keys.append(np.frombuffer(low, "<u4", n).astype(np.uint64) | (np.frombuffer(low, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)))
            docs.append(np.frombuffer(who, "<i8")[np.frombuffer(place, "<u2")])
    if keys:
        yield settle(now, keys, docs)


def fetch_texts(rows: DataFrame, wanted: DataFrame, fields: list[str]) -> DataFrame:
    """wanted (id, id_th and fields) with the text of each id. Texts are moved, and sets made of them where they meet: eight
    bytes a shingle, which don't compress, are more than the words that they stand for."""
    return rows.join(wanted, (F.col("_doc") == F.col("id")) & (F.col("_th") == F.col("id_th"))).select(*fields, "id", "_text")


def fetch_signatures(rows: DataFrame, wanted: DataFrame, fields: list[str], size: int) -> DataFrame:
    """wanted (id, id_th and fields) with the size and bitmap of the shingle set of each id: texts are read once, however
    often an id is wanted."""
    lists = wanted.groupBy("id", "id_th").agg(F.collect_list(F.struct(*fields)).alias("_list"))  # at most one for each part
    kinds = {f.name: f.dataType for f in wanted.schema.fields}
    joined = rows.join(lists, (F.col("_doc") == F.col("id")) & (F.col("_th") == F.col("id_th"))).select("_text", "id", "_list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            at, items = lists.offsets.to_numpy(), lists.values
            for i, j, data, offsets in chunks(batch.column(0)):
                sets, first = shingle_sets(data, offsets, size)
                for r in range(i, j):
                    mine = sets[first[r - i] : first[r - i + 1]]
                    many = len(mine)
                    mine = pa.array(signature(mine).view(np.int64))
                    m = int(at[r + 1] - at[r])
                    each = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * len(mine)), pa.concat_arrays([mine] * m))
                    part = items.slice(at[r], m)
                    yield pa.RecordBatch.from_arrays([*(part.field(k) for k in range(len(fields))), pa.array(np.full(m, batch.column(1)[r].as_py())), pa.array(np.full(m, many, np.int32)), each], [*fields, "id", "n", "sets"])

    schema = ", ".join(f"{f} {kinds[f].simpleString()}" for f in fields)
    return joined.mapInArrow(lean(run), f"{schema}, id bigint, n int, sets array<bigint>")


def _placed(member: DataFrame, block: int) -> DataFrame:
    """(pivot, id, pieces, block) of groups of two or more; the least member of a cut group sits in every block."""
    sizes = member.groupBy("pivot").agg(F.count("*").alias("size")).where("size > 1")
    pieces = F.ceil(F.col("size") / block).cast("int")
    placed = member.join(sizes, "pivot").select("pivot", "id", pieces.alias("pieces"), F.when(pieces > 1, F.pmod(F.xxhash64("id"), pieces)).otherwise(F.lit(0)).cast("int").alias("block"))
    lead = placed.where("pieces > 1").groupBy("pivot", "pieces").agg(F.min("id").alias("id")).select("pivot", "id", "pieces", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("block"))
    return placed.union(lead).distinct()


def jaccard_components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id.

    Texts without words (null, empty, white space) have no shingles and are linked with nothing; their component is their
    own id. Texts of fewer words than a shingle have one. Equal sets are linked whatever their ids; rows of one id share
    its component, and of different texts under one id only that with the smallest hash is compared. A null doc_id takes
    no part: n_shingles is given, component_id is null. Empty tables give no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("_doc"), F.xxhash64(t).alias("_th"), t.alias("_text"))
    small = materialise(rows.mapInArrow(lean(_facts(percent, size)), SETS), "facts")
    # one text speaks for an id, and one id (the smallest) for equal sets
    present = small.where("doc is not null and n > 0").groupBy("doc").agg(F.min(F.struct("th", "n", "d1", "d2")).alias("s")).select("doc", "s.*")
    reps = present.groupBy("d1", "d2", "n").agg(F.min(F.struct("doc", "th")).alias("r")).select("d1", "d2", "n", F.col("r.doc").alias("id"), F.col("r.th").alias("id_th"))
    total = small.where("doc is not null").agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0]
    buckets = max(32, total // BUCKET_KEYS)
    packed = rows.where("_doc is not null").select("_doc", "_text").mapInArrow(lean(_packed_keys(percent, size, buckets)), PACKED)
    gathered = packed.where("bucket is not null").select("bucket", "keys", "places", "docs").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_met_again), "key bigint, doc bigint")
    parts = materialise(packed.where("key is not null").select("key", "doc").union(gathered), "parts")
    shared = parts.groupBy("key").agg(F.min("doc").alias("pivot"), F.max("doc").alias("_last")).where("_last > pivot").select("key", "pivot")
    # members of each pivot's group, representatives only
    member = parts.join(shared, "key").select("pivot", F.col("doc").alias("id")).distinct()
    one = present.join(reps, ["d1", "d2", "n"]).select("doc", "id").distinct()
    same = one.where("doc <> id").select(F.col("doc").alias("a"), F.col("id").alias("b"))
    member = materialise(member.join(reps.select("id"), "id", "left_semi"), "members")
    discard(parts)
    named = reps.select("id", "id_th")
    # first every document goes to one group only, that of its smallest pivot
    first = member.groupBy("id").agg(F.min("pivot").alias("pivot"))
    once = first.select("pivot", "id").union(first.select("pivot", F.col("pivot").alias("id"))).distinct()
    placed = materialise(_placed(once, block), "placed")
    texts = fetch_texts(rows, placed.select("pivot", "block", "id").join(named, "id"), ["pivot", "block"])
    edges = materialise(texts.repartition("pivot", "block").sortWithinPartitions("pivot", "block").mapInArrow(lean(_within(percent, size)), EDGES), "links")
    discard(placed)
    # then whole groups, but only where they still fall apart: the largest component needs no look at itself
    seen = member.join(components(member.select("id").distinct(), edges), "id")
    apart = seen.groupBy("pivot").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.count("*").alias("_n")).where("_a < _b").select("pivot", F.ceil(F.col("_n") / block).cast("int").alias("pieces"))
    seen = materialise(seen.join(apart, "pivot").withColumn("block", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")), "apart")
    most = seen.groupBy("pivot", "component").agg(F.count("*").alias("_c")).groupBy("pivot").agg(F.max_by("component", F.struct("_c", "component")).alias("_main"))
    left = seen.join(most, "pivot").where("component <> _main").withColumn("_slot", F.pmod(F.xxhash64("id", F.lit(1)), F.col("pieces")).cast("int"))
    others = seen.join(left.select("pivot", "_slot").distinct(), "pivot").select("pivot", "_slot", "block", F.lit(False).alias("side"), "component", "id")
    ask = left.select("pivot", "_slot", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("block"), F.lit(True).alias("side"), "component", "id")
    pairs = materialise(others.union(ask), "pairs")
    if pairs.limit(1).count():
        # documents that only share a passage are told apart by their signatures, before any set is moved
        marks = fetch_signatures(rows, pairs.join(named, "id"), MEET, size)
        hope = materialise(marks.repartition("pivot", "_slot", "block").sortWithinPartitions("pivot", "_slot", "block").mapInArrow(lean(_promising(percent)), MEETING), "promising")
        again = fetch_texts(rows, hope.join(named, "id"), MEET)
        more = again.repartition("pivot", "_slot", "block").sortWithinPartitions("pivot", "_slot", "block").mapInArrow(lean(_across(percent, size)), EDGES)
        edges = edges.union(materialise(more, "links"))
    found = components(present.select(F.col("doc").alias("id")).distinct(), edges.union(same))
    out = small.join(found, F.col("doc") == F.col("id"), "left")
    return out.select(F.col("doc").alias(doc_id), F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but the smallest id of each component; rows that repeat an id are kept once. Null ids stay."""
    found = jaccard_components(docs, percent, size, doc_id, text)
    found = found.toDF("doc_id", "n_shingles", "component_id")
    gone = materialise(found.where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    if rows_for_broadcast(gone, BROADCAST_IDS):
        gone = F.broadcast(gone)
    rows, names = by_place(docs)
    own = F.col(rows.columns[names.index(doc_id)])
    kept = rows.join(gone, own.cast("bigint") == F.col("_gone"), "left_anti")
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.where(own.isNotNull()).dropDuplicates([rows.columns[names.index(doc_id)]]).unionByName(kept.where(own.isNull()))
    return kept.toDF(*names)

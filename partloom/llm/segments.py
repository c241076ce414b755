"""Repeated windows across a corpus: the parts that substring dedup and suffix-array dedup share.

A text is a sequence of units (words or bytes). Every window of W units has a smallest k-gram hash; a block is a longest
run of windows of one text with the same smallest hash. Equal windows have equal smallest hashes, so a window can only
repeat between blocks of one hash, and blocks of different hashes never need to meet. Blocks are first counted by
(hash, digest), which collapses exact copies before any shuffle by hash; only hashes with different blocks go on to a
search inside blocks. Nothing is dropped: a block that is alone under its hash holds no repeated window. Rolling hashes
only propose: a digest is BLAKE2b over the units themselves, and the searches compare units.

Before the search, blocks are trimmed: some grams of each block are chosen by their content, and a chosen gram that comes
once under its hash can't be in a repeated window, so the block is cut there. What differs around a shared passage goes
away with that, and equal pieces collapse once more. This keeps the groups to search small however often a passage comes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import BYTE_CODES, GRAM_ROLLER, SPAN_ROLLER, by_place, chunks, discard, free_name, lean, materialise, mix, sliding_min, small_batches, word_bounds, word_hashes

#: A hash with more different pieces, or units in them, than this is settled window by window, so that no task gets an
#: unbounded group. Windows are equal there if two independent 64-bit hashes are.
HOT_BLOCKS, HOT_UNITS = 2048, 1 << 21
#: Rows without a document id count as later than all others.
NO_ID = (1 << 63) - 1
BLOCK = "h bigint, d bigint, doc bigint, th bigint, start int, n int, multi boolean"


@dataclass(frozen=True)
class Units:
    """words: W counts words split at ASCII white space; bytes: W counts UTF-8 bytes."""

    words: bool
    window: int
    k: int

    @property
    def spread(self) -> int:
        """One gram of so many is chosen for trimming: about six in a window."""
        return max(1, (self.window - self.k) // 6)

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the units, their starts and ends in bytes, and the first unit of each row."""
        if self.words:
            starts, ends, first = word_bounds(data, offsets)
            return word_hashes(data, starts, ends), starts, ends, first
        at = np.arange(len(data) + 1)
        return BYTE_CODES[data], at[:-1], at[1:], offsets

    def plain(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Bytes in which equal sequences of units are equal slices (words with one space between), and the units' places."""
        if not self.words:
            return data.tobytes(), starts, ends
        size = ends - starts
        to = np.cumsum(size + 1) - 1
        out = np.full(to[-1] + 1 if len(to) else 0, 32, np.uint8)
        gone = np.repeat(starts - (to - size), size)
        at = np.arange(len(out)) if not len(to) else np.delete(np.arange(len(out)), to)
        out[at] = data[at + gone]
        return out.tobytes(), to - size, to


def digests(plain: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of BLAKE2b of each slice."""
    view = memoryview(plain)
    found = b"".join([hashlib.blake2b(view[a:b], digest_size=8).digest() for a, b in zip(starts.tolist(), ends.tolist())])
    return np.frombuffer(found, np.int64)


def runs(codes: np.ndarray, first: np.ndarray, u: Units) -> tuple[np.ndarray, ...]:
    """Blocks of a chunk: row, first window (unit index), units, hash, and whether the smallest gram comes twice."""
    n = len(codes) - u.window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = row[:n] == row[u.window - 1 :]
    grams = GRAM_ROLLER.grams(GRAM_ROLLER.prefix(codes), u.k)
    low = sliding_min(grams, u.window - u.k + 1)
    fresh = whole.copy()
    fresh[1:] &= (low[1:] != low[:-1]) | ~whole[:-1] | (row[1:n] != row[: n - 1])
    begin = np.flatnonzero(fresh)
    stop = whole.copy()
    stop[:-1] &= fresh[1:] | ~whole[1:]
    last = np.flatnonzero(stop)
    end = last + u.window
    h = low[begin]
    # does the smallest gram come twice in a block? only grams that are smallest in some window can count
    w = u.window - u.k + 1
    around = np.zeros(len(low) + 2 * (w - 1), np.uint64)
    around[w - 1 : w - 1 + len(low)] = np.where(whole, low, np.uint64(0))
    chosen = np.flatnonzero(~sliding_min(~around, w) == grams)
    left, right = np.searchsorted(chosen, begin), np.searchsorted(chosen, end - u.k, side="right")
    owner = np.repeat(np.arange(len(h)), right - left)
    member = np.arange(len(owner)) - np.repeat(np.cumsum(right - left) - (right - left), right - left) + left[owner]
    times = np.bincount(owner[grams[chosen[member]] == h[owner]], minlength=len(h))
    return row[begin], begin, end - begin, h, times > 1


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """_doc (id, or NO_ID for null), _th (hash of the text) and _text: the key by which spans find their rows again.

    Rows that repeat both id and text share their spans, as they must.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("_doc"), F.xxhash64(t).alias("_th"), t.alias("_text"))


def blocks(rows: DataFrame, u: Units) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, _, data, offsets in chunks(batch.column(2)):
                codes, starts, ends, first = u.split(data, offsets)
                row, begin, n, h, multi = runs(codes, first, u)
                plain, starts, ends = u.plain(data, starts, ends)
                d = digests(plain, starts[begin], ends[begin + n - 1])
                start = begin - first[row]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(d), pa.array(doc[i + row]), pa.array(th[i + row]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(multi)], ["h", "d", "doc", "th", "start", "n", "multi"])

    return rows.mapInArrow(lean(run), BLOCK)


PICK = ("h", "d", "doc", "th", "start", "n", "copies", "multi")
LIVE = "h bigint, d bigint, doc bigint, th bigint, start int, n int, copies bigint, multi boolean, seg binary"


def fetch(rows: DataFrame, wanted: DataFrame, u: Units) -> DataFrame:
    """Add the text of wanted blocks (words joined by one space, or bytes): one join of documents and their block lists."""
    lists = wanted.groupBy("doc", "th").agg(F.collect_list(F.struct("h", "d", "start", "n", "copies", "multi")).alias("_list"))  # of one document
    joined = rows.join(lists, (F.col("_doc") == F.col("doc")) & (F.col("_th") == F.col("th"))).select("_text", "doc", "th", "_list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(0), batch.column(3)
            at, items = lists.offsets.to_numpy(), lists.values
            cols = [items.field(k).to_numpy(zero_copy_only=False) for k in range(6)]
            for i in range(len(texts)):
                data = texts[i].as_py().encode()
                buffer, own = np.frombuffer(data, np.uint8), slice(at[i], at[i + 1])
                if u.words:
                    words = data.split()
                    segs = [b" ".join(words[s : s + n]) for s, n in zip(cols[2][own], cols[3][own])]
                else:
                    segs = [buffer[s : s + n].tobytes() for s, n in zip(cols[2][own], cols[3][own])]
                m = len(segs)
                yield pa.RecordBatch.from_arrays([*(pa.array(c[own]) for c in cols[:2]), pa.array(np.full(m, batch.column(1)[i].as_py())), pa.array(np.full(m, batch.column(2)[i].as_py())), *(pa.array(c[own]) for c in cols[2:]), pa.array(segs, pa.binary())], ["h", "d", "doc", "th", "start", "n", "copies", "multi", "seg"])

    return joined.mapInArrow(lean(run), LIVE)


def seg_codes(segs: list[bytes], u: Units) -> tuple[np.ndarray, np.ndarray]:
    """Unit codes of many segments, and the first unit of each."""
    data = np.frombuffer(b"".join(segs), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in segs])]).astype(np.int64)
    codes, _, _, first = u.split(data, offsets)
    return codes, first


def exact_codes(segs: list[bytes], u: Units) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the units of many segments, the same for the same unit and no other, and the first unit of each."""
    if not u.words:
        return np.frombuffer(b"".join(segs), np.uint8).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in segs])]).astype(np.int64)
    words = [x.split() for x in segs]
    every = pa.array([w for x in words for w in x], pa.binary()).dictionary_encode()
    return every.indices.to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in words])]).astype(np.int64)


def _chosen(codes: np.ndarray, first: np.ndarray, u: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams chosen by their hash alone, so in all their places or in none: block, place, hash."""
    block = np.repeat(np.arange(len(first) - 1), np.diff(first))
    grams = GRAM_ROLLER.grams(GRAM_ROLLER.prefix(codes), u.k)
    at = np.flatnonzero((grams >> np.uint64(20)) % np.uint64(u.spread) == 0)
    at = at[block[at] == block[at + u.k - 1]]
    return block[at], at, grams[at]


def trim(live: DataFrame, u: Units) -> DataFrame:
    """Pieces of blocks (same columns) between chosen grams that come once under their hash."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            codes, first = seg_codes(batch.column(2).to_pylist(), u)
            block, at, gram = _chosen(codes, first, u)
            key = mix(h[block].view(np.uint64) ^ mix(gram))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(h[block]), pa.array(d[block]), pa.array((at - first[block]).astype(np.int32))], ["x", "h", "d", "at"])

    marks = live.select("h", "d", "seg").mapInArrow(lean(mark), "x bigint, h bigint, d bigint, at int")
    alone = marks.groupBy("x").agg(F.count("*").alias("c"), F.min("h").alias("h"), F.min("d").alias("d"), F.min("at").alias("at")).where("c = 1")
    cuts = alone.groupBy("h", "d").agg(F.sort_array(F.collect_list("at")).alias("_cuts"))  # of one block

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {f: batch.column(f).to_pylist() for f in batch.schema.names}
            out: list[tuple] = []
            for i, seg in enumerate(rows["seg"]):
                edges, n = rows["_cuts"][i] or [], rows["n"][i]
                units = seg.split() if u.words and edges else seg
                for a, b in zip([-1, *edges], [*edges, n - u.k + 1]):
                    # a piece holds no whole cut gram
                    lo, hi = a + 1, b + u.k - 1
                    if hi - lo >= u.window:
                        piece = seg if not edges else b" ".join(units[lo:hi]) if u.words else units[lo:hi]
                        out.append((rows["h"][i], rows["doc"][i], rows["th"][i], rows["start"][i] + lo, hi - lo, rows["copies"][i], rows["multi"][i], piece))
            cols = list(zip(*out)) if out else [()] * 8
            ends = np.cumsum([len(x) for x in cols[7]], dtype=np.int64)
            d = digests(b"".join(cols[7]), np.append(0, ends)[:-1], ends)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([arrays[0], pa.array(d), *arrays[1:]], ["h", "d", "doc", "th", "start", "n", "copies", "multi", "seg"])

    return live.join(cuts, ["h", "d"], "left").mapInArrow(lean(cut), LIVE)


SPAN = "doc bigint, th bigint, s int, e int"


def _span_batch(doc: np.ndarray, th: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(th), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["doc", "th", "s", "e"])


def window_spans(first: np.ndarray, hit: np.ndarray, block: np.ndarray, start: np.ndarray, u: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge hit windows (unit indexes, ascending) of blocks to (block, s, e) in units of the document."""
    if not len(hit):
        return hit, hit, hit
    cut = np.ones(len(hit), bool)
    cut[1:] = (block[1:] != block[:-1]) | (hit[1:] > hit[:-1] + u.window)
    begin, last = np.flatnonzero(cut), np.append(np.flatnonzero(cut)[1:], len(hit)) - 1
    b = block[begin]
    base = start[b] - first[b]
    return b, hit[begin] + base, hit[last] + base + u.window


Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def search_blocks(live: DataFrame, u: Units, search: Search, batch_bytes: int = 1 << 20) -> DataFrame:
    """Run search on whole hash groups, many at a time; it gets codes, first, h, doc, copies and returns the hit windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def settle() -> pa.RecordBatch:
            h, doc, th, start, copies = (np.array([x[k] for x in held], np.int64) for k in range(5))
            codes, first = exact_codes([x[5] for x in held], u)
            hit = search(codes, first, h, doc, copies)
            block = np.searchsorted(first, hit, side="right") - 1
            b, s, e = window_spans(first, hit, block, start, u)
            return _span_batch(doc[b], th[b], s, e)

        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("h", "doc", "th", "start", "copies", "seg"))):
                if size > batch_bytes and held[-1][0] != x[0]:
                    yield settle()
                    held, size = [], 0
                held.append(x)
                size += len(x[5])
        if held:
            yield settle()

    return live.select("h", "doc", "th", "start", "copies", "seg").repartition("h").sortWithinPartitions("h", "doc", "start").mapInArrow(lean(run), SPAN)


def hot_windows(live: DataFrame, u: Units, earlier: bool) -> DataFrame:
    """Blocks of hot hashes: count their windows by two 64-bit hashes, summed up before the shuffle, and keep repeated ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th, start, copies = (batch.column(c).to_numpy() for c in ("doc", "th", "start", "copies"))
            codes, first = seg_codes(batch.column("seg").to_pylist(), u)
            block = np.repeat(np.arange(len(doc)), np.diff(first))
            n = max(len(codes) - u.window + 1, 0)
            at = np.flatnonzero(block[:n] == block[u.window - 1 :]) if n else np.zeros(0, np.int64)
            b = block[at]
            one = GRAM_ROLLER.grams(GRAM_ROLLER.prefix(codes), u.window)[at]
            two = SPAN_ROLLER.grams(SPAN_ROLLER.prefix(codes), u.window)[at]
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(doc[b]), pa.array(th[b]), pa.array((start[b] + at - first[b]).astype(np.int32)), pa.array(copies[b])], ["w1", "w2", "doc", "th", "s", "copies"])

    windows = live.select("doc", "th", "start", "copies", "seg").mapInArrow(lean(run), "w1 bigint, w2 bigint, doc bigint, th bigint, s int, copies bigint")
    if earlier:
        known = windows.groupBy("w1", "w2").agg(F.min("doc").alias("_low"), F.max("doc").alias("_high")).where("_high > _low")
        found = windows.join(known, ["w1", "w2"]).where("doc > _low")
    else:
        known = windows.groupBy("w1", "w2").agg(F.sum("copies").alias("_c")).where("_c > 1").select("w1", "w2")
        found = windows.join(known, ["w1", "w2"])
    return found.select("doc", "th", "s", (F.col("s") + u.window).alias("e"))


def _known(found: DataFrame, earlier: bool) -> DataFrame:
    """For every (h, d) of hashes that may hold repeated windows: first document, copies and number of different blocks."""
    kinds = found.groupBy("h", "d").agg(F.min("doc").alias("_first"), F.max("doc").alias("_last"), F.sum("copies").alias("_copies"), F.max("multi").alias("_multi"), F.min("n").alias("_n"))
    groups = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.sum("_n").alias("units"), F.sum("_copies").alias("_all"), F.max("_multi").alias("_any"), F.min("_first").alias("_low"), F.max("_last").alias("_high"))
    return kinds.select("h", "d", "_first", "_copies").join(groups.where("_high > _low" if earlier else "_all > 1 or _any").select("h", "kinds", "units", "_any"), "h")


def _settled(met: DataFrame, earlier: bool) -> DataFrame:
    """Spans of blocks that are repeated as a whole."""
    whole = F.col("doc") > F.col("_first") if earlier else F.col("_copies") > 1
    return met.where(whole).select("doc", "th", F.col("start").alias("s"), (F.col("start") + F.col("n")).alias("e"))


def repeated_spans(docs: DataFrame, u: Units, search: Search, earlier: bool, doc_id: str, text: str, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """Spans (doc, th, s, e) of repeated windows. earlier: only where a smaller document id has the window too."""
    small_batches(docs.sparkSession)
    rows = keyed(docs, doc_id, text)
    found = materialise(blocks(rows, u).withColumn("copies", F.lit(1).cast("bigint")), "blocks")
    met = materialise(found.join(_known(found, earlier), ["h", "d"]), "met")  # hashes met once are gone from here on
    discard(found)
    open_ = (F.col("kinds") > 1) | F.lit(False if earlier else True) & F.col("_any")
    if earlier:  # every place of a block in its first document; later ones go whole
        pick = met.where(open_ & (F.col("doc") == F.col("_first"))).select(*PICK)
    else:  # one place stands for all copies
        pick = met.where(open_).groupBy("h", "d", "n", F.col("_copies").alias("copies")).agg(F.max("multi").alias("multi"), F.min(F.struct("doc", "th", "start")).alias("_at")).select("h", "d", "_at.*", "n", "copies", "multi")
    live = materialise(fetch(rows, pick, u), "live")
    pieces = materialise(trim(live, u), "pieces")
    discard(live)
    left = pieces.join(_known(pieces, earlier), ["h", "d"])
    spans = _settled(met, earlier).unionByName(_settled(left, earlier))
    if earlier:
        ask = left.where(open_ & (F.col("doc") == F.col("_first")))
    else:
        one = pieces.groupBy("h", "d").agg(F.min(F.struct("doc", "th", "start")).alias("_one"))
        ask = left.where(open_).join(one, ["h", "d"]).where(F.struct("doc", "th", "start") == F.col("_one")).withColumn("copies", F.col("_copies"))
    few = (F.col("kinds") <= hot_blocks) & (F.col("units") <= HOT_UNITS)
    ask = ask.select("h", "doc", "th", "start", "copies", "kinds", "units", "seg")
    return spans.unionByName(search_blocks(ask.where(few), u, search)).unionByName(hot_windows(ask.where(~few), u, earlier))


RESULT = "n bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _merge(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    cut = np.ones(len(s), bool)
    cut[1:] = s[1:] > e[:-1]
    begin = np.flatnonzero(cut)
    return s[begin], e[np.append(begin[1:], len(s)) - 1]


def remove_spans(docs: DataFrame, spans: DataFrame, u: Units, doc_id: str, text: str, rest: Callable[[bytes, np.ndarray, np.ndarray], tuple[int, bytes]]) -> DataFrame:
    """Every row of docs: its columns but the text, then _n, _n_removed, _n_spans, _kept_sha256 and _kept (the text that is
    left). Where docs has a column of such a name, the new one gets one more underscore in front."""
    lists = spans.distinct().groupBy("doc", "th").agg(F.collect_list(F.struct("s", "e")).alias("_list"))  # of one document
    slim, original = by_place(docs)
    names, body = slim.columns, slim.columns[docs.columns.index(text)]
    slim = slim.withColumn("_text", F.coalesce(F.col(body).cast("string"), F.lit("")))
    slim = slim.withColumns({"_doc": F.coalesce(F.col(names[docs.columns.index(doc_id)]).cast("bigint"), F.lit(NO_ID)), "_th": F.xxhash64("_text")}).drop(body)
    others = [n for n in names if n != body]
    joined = slim.join(lists, (F.col("_doc") == F.col("doc")) & (F.col("_th") == F.col("th")), "left").select(*others, "_text", "_list")
    m = len(others)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*others).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(m + 1)
            at, items, has = lists.offsets.to_numpy(), lists.values, lists.is_valid().to_numpy(zero_copy_only=False)
            s_all, e_all = (items.field(k).to_numpy().astype(np.int64) for k in range(2))
            out = []
            for i, value in enumerate(batch.column(m).to_pylist()):
                s, e = _merge(s_all[at[i] : at[i + 1]], e_all[at[i] : at[i + 1]]) if has[i] and at[i + 1] > at[i] else (np.zeros(0, np.int64),) * 2
                n, kept = rest(value.encode(), s, e)
                out.append((n, int((e - s).sum()), len(s), hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace") if len(s) else value))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(m)), *(pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())))], [*others, "n", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = joined.mapInArrow(lean(run), f"{fields}, {RESULT}, kept string")
    back = dict(zip(names, original))
    return done.select(*(F.col(c).alias(back[c]) for c in others), *(F.col(c).alias(free_name(f"_{c}", original)) for c in ("n", "n_removed", "n_spans", "kept_sha256", "kept")))


"""How far the sources of a language differ in their words: an audit of every pair of sources, and each source's own terms.

Each task counts the terms of its texts by (lang, source), with Arrow's dictionaries for the different words of a stretch,
and one shuffle by (lang, term) adds the counts up. Kept terms go to blocks of a bounded number of terms. In a block the
terms are a sorted array, so that an id found by binary search is also the term's place in UTF-8 order; counts are added by
id into one dense vector for each group, and shares, differences and the first terms are array operations on those.
All arithmetic is in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from partloom.llm.common import chunks, materialise, small_batches

MIN_DOCS, TOP_TERMS = 10, 10
UNIT = 1_000_000_000
BYTES_AT_ONCE = 4 << 20
#: Counts held by a task before they are handed on.
ROWS_HELD = 1 << 20
EMITTED = 1 << 16
#: Kept terms of a block, about.
BLOCK_TERMS = 4096
#: Cells (groups times terms) that are compared at once.
CELLS_AT_ONCE = 1 << 22

# fixed values: bytes of terms (letters, and all of any character beyond ASCII), and A-Z to a-z
IS_TERM = np.zeros(256, bool)
IS_TERM[65:91] = IS_TERM[97:123] = IS_TERM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

COUNTED = "lang string, source string, term string, n bigint, df bigint"


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of all rows in order, and for each row its first."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = IS_TERM[data]
    begin, end = solid[1:] & ~solid[:-1], solid[:-1] & ~solid[1:]
    inner = offsets[1:-1]
    both = inner[(inner > 0) & (inner < len(data))]
    both = both[solid[both] & solid[both + 1]]
    begin[both] = end[both] = True
    start, stop = np.flatnonzero(begin), np.flatnonzero(end)
    bounds = np.zeros(len(start) + 1, np.int64)
    np.cumsum(stop - start, out=bounds[1:])
    packed = LOWER[data[solid[1:-1]]]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(packed.tobytes())])
    return words.dictionary_encode(), np.searchsorted(start, offsets)


Counts = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]  # group, term's id, n, df; the terms by id


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts in sorted keys."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def _count(group: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> Counts:
    """Of the rows of a chunk; group: the group of each row."""
    words, first = terms(data, offsets)
    size = np.diff(first)
    ids, wide = words.indices.to_numpy().astype(np.int64), max(len(words.dictionary), 1)
    row = np.repeat(np.arange(len(size)), size)
    seen = np.sort(row * wide + ids)
    seen = seen[_runs(seen)]  # one for each (row, term)
    cells, docs = np.sort(group[row] * wide + ids), np.sort(group[seen // wide] * wide + seen % wide)
    at = _runs(cells)
    n, df = np.diff(np.append(at, len(cells))), np.diff(np.append(_runs(docs), len(docs)))
    cells = cells[at]
    return cells // wide, cells % wide, n, df, words.dictionary


def _sum(parts: list[Counts]) -> Counts:
    words = pa.concat_arrays([p[4] for p in parts]).dictionary_encode()
    base = np.cumsum([0] + [len(p[4]) for p in parts])
    ids = words.indices.to_numpy().astype(np.int64)[np.concatenate([p[1] + b for p, b in zip(parts, base)])]
    group, n, df = (np.concatenate([p[k] for p in parts]) for k in (0, 2, 3))
    wide = max(len(words.dictionary), 1)
    cells = group * wide + ids
    order = np.argsort(cells)
    cells = cells[order]
    at = _runs(cells)
    n, df = (np.add.reduceat(x[order], at) if len(at) else x for x in (n, df))
    return cells[at] // wide, cells[at] % wide, n, df, words.dictionary


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences, and documents with the term; docs has lang, source and text without nulls."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counts] = []
        groups: dict[tuple[str, str], int] = {}

        def emit(counts: Counts) -> Iterator[pa.RecordBatch]:
            group, ids, n, df, words = counts
            names, words = list(groups), words.cast(pa.string())
            langs, sources = (pa.array([g[k] for g in names], pa.string()) for k in (0, 1))
            for i in range(0, len(ids), EMITTED):
                part = slice(i, i + EMITTED)
                which = pa.array(group[part])
                yield pa.RecordBatch.from_arrays([langs.take(which), sources.take(which), words.take(pa.array(ids[part])), pa.array(n[part], pa.int64()), pa.array(df[part], pa.int64())], ["lang", "source", "term", "n", "df"])

        for batch in batches:
            group = np.array([groups.setdefault(g, len(groups)) for g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], np.int64)
            for i, j, data, offsets in chunks(batch.column(2), BYTES_AT_ONCE):
                held.append(_count(group[i:j], data, offsets))
                if sum(len(h[0]) for h in held) > ROWS_HELD:
                    held = [_sum(held)]
                    if len(held[0][0]) > ROWS_HELD // 2:
                        yield from emit(held.pop())
        if held:
            yield from emit(_sum(held))

    return docs.select("lang", "source", "text").mapInArrow(run, COUNTED)


def shares(n: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)) exactly: three digits of the quotient at a time. Totals up to 9 * 10^15."""
    over = np.broadcast_to(np.asarray(total, np.int64) + 2 * kept, n.shape)
    out, rest = np.divmod(n + 2, over)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, over)
        out = out * 1000 + digit
    return out + 1


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _dense(t: pa.Table, sources: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The block's terms in UTF-8 order, and the counts of each source (in order) of each of them."""
    words = pc.cast(t.column("term").combine_chunks(), pa.binary())
    each = pc.unique(words)
    each = each.take(pc.sort_indices(each))
    # ids by binary search: bytes in order, so an id is also the place in that order
    ids = np.searchsorted(np.array(each.to_pylist(), object), np.array(words.to_pylist(), object))
    own = pc.index_in(t.column("source").combine_chunks(), value_set=sources).to_numpy(zero_copy_only=False).astype(np.int64)
    n = t.column("n").to_numpy()
    wide = len(each)
    cells = own * wide + ids
    # two halves, so that each sum of doubles is exact
    low, high = (np.bincount(cells, weights=x, minlength=len(sources) * wide).astype(np.int64) for x in (n & 0xFFFFFF, n >> 24))
    return each, (low + (high << 24)).reshape(len(sources), wide)


BLOCK_SCHEMA = "lang string, part string, source string, item string, value bigint"


def _compare(counts: pa.Table, groups: pa.Table) -> pa.Table:
    """Of one block of kept terms: the sums of every pair of sources, and each source's first terms."""
    out = pa.schema([("lang", pa.string()), ("part", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    if not len(counts):
        return out.empty_table()
    groups = groups.sort_by("source")
    sources = groups.column("source").combine_chunks()
    total, kept = groups.column("total").to_numpy(), groups.column("kept")[0].as_py()
    each, dense = _dense(counts, sources)
    p = shares(dense, total[:, None], kept)
    q = shares(dense.sum(0), int(total.sum()), kept)
    rows: list[tuple[str, np.ndarray, pa.Array, np.ndarray]] = []
    step = max(1, CELLS_AT_ONCE // max(p.size, 1))
    for i in range(0, len(p), step):
        some = p[i : i + step]
        value = difference(some[:, None, :], p[None, :, :]).sum(2)
        a, b = np.divmod(np.arange(value.size), len(p))
        a += i
        other = a != b
        rows.append(("pair", a[other], sources.take(pa.array(b[other])), value.ravel()[other]))
    for k in range(len(p)):
        at = np.flatnonzero((dense[k] > 0) & (p[k] > q))
        f = difference(p[k, at], q[at])
        best = np.lexsort((at, -f))[:TOP_TERMS]
        rows.append(("term", np.full(len(best), k), each.take(pa.array(at[best])).cast(pa.string()), f[best]))
    lang = groups.column("lang")[0].as_py()
    return pa.concat_tables([pa.table([pa.array([lang] * len(v), pa.string()), pa.array([part] * len(v), pa.string()), sources.take(pa.array(k)), item, pa.array(v, pa.int64())], schema=out) for part, k, item, v in rows])


def divergence_audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language, and the first ten own terms.

    A language keeps the V terms that at least min_docs of its documents hold. A group (lang, source), and a language, gives
    each of them p = 1 + floor(10^9 (count + 2) / (N + 2 V)), where N is the sum of its counts. The difference of two is
    floor((p - q)^2 / (p + q)). Part 'pair' sums that over all kept terms for each other source (0 without kept terms), all
    ranks; part 'term' has a group's terms with a larger share than the language's, by their difference, ten ranks.

    Null text, lang and source read as ''. Ties go by the UTF-8 order of the item. Repeated rows are documents of their own;
    a group without terms counts 0 everywhere; a language of one source has no pairs; an empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    slim = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    # each task has added up its own; rows of a term meet in one task, some for each task and group
    each = count_terms(slim).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    by_term = each.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("counts"))
    kept = materialise(by_term.where(F.col("df") >= min_docs).select("lang", "term", "counts"), "kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    n_sources = slim.groupBy("lang").agg(F.count_distinct("source").alias("sources"))
    # a block has so many terms at most on average, and so many cells
    n_blocks = F.ceil(F.greatest(F.col("kept") / block_terms, F.col("kept") * F.col("sources") / CELLS_AT_ONCE)).cast("int")
    flat = kept.select("lang", "term", F.explode("counts").alias("c")).select("lang", "term", "c.source", "c.n")
    totals = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = materialise(slim.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes.join(n_sources, "lang"), "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce(n_blocks, F.lit(0)).alias("blocks")), "groups")
    # blocks by hash: the number of blocks of a language is known to each group's row, and joins by (lang, block) are even
    most = groups.agg(F.max("blocks")).first()[0] or 1
    in_block = lambda n: F.pmod(F.xxhash64("term"), n).cast("int")
    counts = kept.withColumn("block", in_block(F.lit(int(most)))).select("lang", "block", "term", F.explode("counts").alias("c")).select("lang", "block", "term", "c.source", "c.n")
    heads = groups.where("kept > 0").select("lang", "source", "total", "kept", F.explode(F.sequence(F.lit(0), F.lit(int(most) - 1))).alias("block"))
    done = materialise(counts.groupBy("lang", "block").cogroup(heads.groupBy("lang", "block")).applyInArrow(_compare, BLOCK_SCHEMA), "blocks")
    sums = done.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(others, "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))
    both = pairs.unionByName(done.where("part = 'term'").select("lang", "source", "part", "item", "value"))
    ranked = both.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS))

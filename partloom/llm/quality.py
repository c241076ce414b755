"""Quality rules: base statistics of every text and a hashed n-gram log-likelihood ratio of target against raw corpus.

The ratio compares two multinomials over hashed byte trigrams: one from trusted documents, one from all documents. Its
mean over the trigrams of a text is held against one fixed threshold; nothing is drawn at random.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import IS_SPACE, chunks, lean, rows_for_broadcast, small_batches, word_bounds

BUCKETS = 1 << 16
#: A text is kept when its mean log-likelihood ratio (nats a trigram) is at least this.
MIN_RATIO = -0.25
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
SMOOTHING = 0.5
#: Trusted ids are broadcast up to this number (8 bytes each), and joined by a shuffle beyond.
BROADCAST_IDS = 2_000_000


def _byte_classes() -> np.ndarray:
    c = np.full(256, 11, np.uint8)  # other punctuation
    c[:32] = 14
    c[list(b" \t\x0b\x0c\r")] = 1
    c[10] = 2
    c[97:123] = 3
    c[65:91] = 4
    c[48:58] = 5
    c[list(b"#*$%&<>")] = 6
    c[list(b"|")] = 7
    c[list(b"!")] = 8
    c[list(b".")] = 9
    c[list(b",")] = 10
    c[128:192] = 13  # continuation bytes
    c[192:] = 12  # first bytes of longer characters
    return c


CLASSES = _byte_classes()


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def stats(data: np.ndarray, offsets: np.ndarray, distinct: bool = False) -> dict[str, np.ndarray]:
    """Integer statistics of each row of a chunk; equal lines, words and windows are told by their bytes. distinct: the
    number of different words too."""
    n = len(offsets) - 1
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(row_of * 16 + CLASSES[data], minlength=16 * n).reshape(n, 16)
    starts, ends, first = word_bounds(data, offsets)
    out = {"kinds": kinds, "n_words": np.diff(first), "n_symbols": kinds[:, 6] + kinds[:, 7], "n_bytes": np.diff(offsets)}
    out["word_chars"] = kinds.sum(1) - kinds[:, 1] - kinds[:, 2] - kinds[:, 13]

    # lines: the k-th start and the k-th end belong together, as both go up from line to line
    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_end = np.sort(np.concatenate([breaks, offsets[1:]]))
    line_row = np.repeat(np.arange(n), kinds[:, 2] + 1)
    has_word = np.searchsorted(starts, line_start) < np.searchsorted(starts, line_end)
    key = numbered(data[data != 10], line_end - line_start)[has_word]
    rows = line_row[has_word]
    order = np.lexsort((key, rows))
    key, rows = key[order], rows[order]
    again = np.flatnonzero((key[1:] == key[:-1]) & (rows[1:] == rows[:-1])) + 1
    out["n_lines"] = np.bincount(line_row[has_word], minlength=n)
    out["n_dup_lines"] = np.bincount(rows[again], minlength=n)

    # words in windows that come twice or more in one text
    solid = np.ones(len(data), bool)
    solid[IS_SPACE[data]] = False
    words = numbered(data[solid], ends - starts)
    word_row = np.repeat(np.arange(n), out["n_words"])
    repeated = np.zeros(len(words) + 1, np.int64)
    if len(words) >= REPEAT_WINDOW:
        grams = windows(words, REPEAT_WINDOW)
        whole = np.flatnonzero(word_row[: len(grams)] == word_row[REPEAT_WINDOW - 1 :])
        key = word_row[whole] * (int(grams.max()) + 1) + grams[whole]
        ordered = np.sort(key)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
            hit = whole[twice[at] == key]
            np.add.at(repeated, hit, 1)
            np.add.at(repeated, hit + REPEAT_WINDOW, -1)
    covered = np.cumsum(repeated)[:-1] > 0
    out["n_repeat_words"] = _per_row(covered, first)
    if distinct:
        pairs = np.sort(word_row * (len(words) + 1) + words)
        out["n_distinct_words"] = np.bincount(pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]] // (len(words) + 1), minlength=n)
    return out


def numbered(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each of the byte strings that make up data, the same for equal strings and for no others."""
    bounds = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())])
    return strings.dictionary_encode().indices.to_numpy().astype(np.int64)


def windows(numbers: np.ndarray, k: int) -> np.ndarray:
    """A number for every k consecutive numbers, the same for equal windows and for no others: pairs are numbered anew."""

    def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * (int(b.max()) + 1) + b
        order = np.argsort(key)
        new = np.append(False, key[order][1:] != key[order][:-1])
        out = np.empty(len(key), np.int64)
        out[order] = np.cumsum(new)
        return out

    have, size = numbers, 1
    while size < k:  # windows may overlap: two of the size so far, the second moved by what is missing
        step = min(size, k - size)
        have, size = pairs(have[: len(have) - step], have[step:]), size + step
    return have


def trigram_buckets(data: np.ndarray) -> np.ndarray:
    if len(data) < 3:
        return np.zeros(0, np.uint32)
    wide = data.astype(np.uint32)
    return ((wide[:-2] | (wide[1:-1] << np.uint32(8)) | (wide[2:] << np.uint32(16))) * np.uint32(2654435761)) >> np.uint32(16)


def corpus_counts(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Trigram counts (all documents, trusted documents) by bucket; each task adds up its own before the shuffle."""
    small_batches(docs.sparkSession)
    ids = trusted.select(F.col(doc_id).alias("_id")).distinct().withColumn("_yes", F.lit(True))
    if rows_for_broadcast(ids, BROADCAST_IDS):
        ids = F.broadcast(ids)
    slim = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(ids, "_id", "left").select(F.coalesce("_yes", F.lit(False)).alias("_yes"), "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            yes = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), bool)
            for i, j, data, offsets in chunks(batch.column(1)):
                buckets = trigram_buckets(data)
                row = np.repeat(np.arange(i, j), np.diff(offsets))
                inside = row[: len(buckets)] == row[2:] if len(buckets) else np.zeros(0, bool)
                total[0] += np.bincount(buckets[inside], minlength=BUCKETS)
                total[1] += np.bincount(buckets[inside & yes[row[: len(buckets)]]], minlength=BUCKETS)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[0][some]), pa.array(total[1][some])], ["bucket", "raw", "target"])

    sums = slim.mapInArrow(lean(count), "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, r, t in sums.collect():  # at most BUCKETS rows
        raw[b], target[b] = r, t
    return raw, target


def ratio_table(raw: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """Log-likelihood ratio by bucket; None without a trusted corpus."""
    if not target.sum():
        return None
    log = lambda c: np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * len(c)))
    return log(target) - log(raw)


def judge(data: np.ndarray, offsets: np.ndarray, table: np.ndarray | None, min_ratio: float) -> dict[str, np.ndarray]:
    """Statistics, base_failed, ratio and kept of each row of a chunk."""
    out = stats(data, offsets)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    grams = np.maximum(np.diff(offsets) - 2, 0)
    ratio = np.zeros(len(grams))
    if table is not None:
        total = np.zeros(max(len(data) - 2, 0) + 1)
        np.cumsum(table[trigram_buckets(data)], out=total[1:])
        some = np.flatnonzero(grams)
        ratio[some] = (total[offsets[1:][some] - 2] - total[offsets[:-1][some]]) / grams[some]
    out["ratio"] = ratio
    out["kept"] = ~out["base_failed"] & (ratio >= min_ratio)
    return out


def trusted_ids(labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """Documents labelled good at least once; null ids and labels count for nothing."""
    return labels.where((F.col(quality) == 1) & F.col(doc_id).isNotNull()).select(doc_id).distinct()


COLUMNS = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, ratio double"


def quality_rules(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """One row for each input row, with the statistics and the verdict.

    Null and empty texts have no words and fail the base rule. Without trusted documents the ratio is 0 and only the base
    rule rejects. Repeated rows are judged each by itself, a null doc_id stays null, an empty table gives no rows, and
    other columns are ignored. Texts under three bytes have ratio 0.
    """
    table = ratio_table(*corpus_counts(docs, trusted, doc_id, text))
    shared = docs.sparkSession.sparkContext.broadcast(table)  # BUCKETS doubles, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1)):
                got = judge(data, offsets, shared.value, min_ratio)
                numbers = [pa.array(got[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *numbers, pa.array(got["base_failed"]), pa.array(got["kept"]), pa.array(got["ratio"])], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), COLUMNS).withColumnRenamed("doc_id", doc_id)


def keep_good(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """The rows of docs, all columns as they are, that quality_rules keeps."""
    table = ratio_table(*corpus_counts(docs, trusted, doc_id, text))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [judge(data, offsets, shared.value, min_ratio)["kept"] for _, _, data, offsets in chunks(batch.column(at))]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts)))

    return docs.mapInArrow(lean(run), docs.schema)

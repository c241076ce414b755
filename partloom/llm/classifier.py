"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are complete binary trees kept in flat arrays, so a batch of documents walks all of them with numpy indexing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import chunks, small_batches
from partloom.llm.quality import stats

#: The model is fitted on at most so many labelled rows, those with the smallest hash of their id.
TRAIN_ROWS = 20_000
FOLDS, HELD_OUT_FOLD, CUT = 5, 0, 0.3


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers for each text: sizes, shares of byte classes, repetition. An empty text gives zeros."""
    s = stats(data, offsets, distinct=True)
    words, size, lines = np.maximum(s["n_words"], 1), np.maximum(s["n_bytes"], 1), np.maximum(s["n_lines"], 1)
    shares = s["kinds"] / size[:, None]
    letters = np.maximum(s["kinds"][:, 3] + s["kinds"][:, 4], 1)
    more = [np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["kinds"][:, 4] / letters, s["kinds"][:, 8] / words, s["kinds"][:, 7] / words, s["kinds"][:, 9] / words, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["n_words"] / lines, s["n_distinct_words"] / words, np.log1p(s["n_lines"])]
    return np.column_stack([shares, *more]).astype(np.float64)


@dataclass
class Trees:
    """feature and threshold by (tree, inner node), value by (tree, leaf); node i has children 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        trees, inner = self.feature.shape
        rows, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), np.int64)
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.threshold[tree, node])
        return 1 / (1 + np.exp(-(self.base + self.value[tree, node - inner].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Second-order boosting of the logistic loss on quantile bins; ties go to the first feature and bin."""
    n, m = x.shape
    inner = 2**depth - 1
    if n == 0 or y.min() == y.max():  # nothing to tell apart: a constant
        p = np.clip(y.mean() if n else 0.5, 0.01, 0.99)
        return Trees(np.zeros((1, inner), np.int64), np.full((1, inner), np.inf), np.zeros((1, inner + 1)), float(np.log(p / (1 - p))))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    code = np.column_stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(m)])
    p = y.mean()
    base = float(np.log(p / (1 - p)))
    score = np.full(n, base)
    out_f, out_t, out_v = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-score))
        g, h = prob - y, prob * (1 - prob)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            low, wide = 2**level - 1, 2**level
            at = node - low
            best = np.full(wide, 1e-9)
            sum_g, sum_h = np.bincount(at, g, wide), np.bincount(at, h, wide)
            choice = np.full((wide, 2), -1)
            for f in range(m):
                key = at * bins + code[:, f]
                left_g = np.bincount(key, g, wide * bins).reshape(wide, bins).cumsum(1)
                left_h = np.bincount(key, h, wide * bins).reshape(wide, bins).cumsum(1)
                right_g, right_h = sum_g[:, None] - left_g, sum_h[:, None] - left_h
                gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - (sum_g**2 / (sum_h + l2))[:, None]
                gain[(left_h < least / 4) | (right_h < least / 4)] = 0
                gain[:, len(edges[f]) :] = 0
                b = gain.argmax(1)
                better = gain[np.arange(wide), b] > best
                best[better], choice[better, 0], choice[better, 1] = gain[np.arange(wide), b][better], f, b[better]
            for k in np.flatnonzero(choice[:, 0] >= 0):
                feature[low + k], threshold[low + k] = choice[k, 0], edges[choice[k, 0]][choice[k, 1]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        score += value[leaf]
        out_f.append(feature), out_t.append(threshold), out_v.append(value)
    return Trees(np.array(out_f), np.array(out_t), np.array(out_v), base)


def _fold(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = TRAIN_ROWS) -> Trees:
    """Fit on labelled rows outside the held-out fold. Ids labelled both ways count once, with the smaller label."""
    small_batches(docs.sparkSession)
    usable = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (_fold(doc_id) != HELD_OUT_FOLD))
    sample = usable.groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample), "_id").select("_id", "_y", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(2)):
                x = features(data, offsets)
                wide = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), wide], ["id", "y", "x"])

    # at most `most` rows of a few dozen numbers, unless ids repeat in docs: then the same bound holds again
    got = rows.mapInArrow(run, "id bigint, y int, x array<double>").orderBy(F.xxhash64("id"), "id", "x").limit(most).collect()
    if not got:
        return fit(np.zeros((0, 28)), np.zeros(0))
    return fit(np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", cut: float = CUT) -> DataFrame:
    """One row for each input row: doc_id, held_out, score (0 to 1) and predicted.

    Only the text is scored. Null and empty texts have all features 0 and get a score like any other; a null doc_id is not
    held out. Without usable labels every score is 0.5. Repeated rows get equal scores; other columns are ignored.
    """
    model = train(docs, labels, doc_id, text, label)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(2)):
                score = shared.value.score(features(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(score), pa.array((score >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(_fold(doc_id) == HELD_OUT_FOLD, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int").withColumnRenamed("doc_id", doc_id)

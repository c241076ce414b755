"""Hard negatives: for each anchor and each of its positives, the best rows of other labels inside a band of scores.

All rows are dealt into blocks, and all anchors too; a task holds one block of each. Scores are exact integer inner products.
First each block gives an anchor's best rows of its own label, and the best of those over all blocks are its positives.
Then each block sorts, for each anchor, the scores of the rows of other labels by (score, id), finds every positive's upper
limit by binary search and reads on from there down to the lower limit; the best over all blocks are the negatives. The
work is anchors times rows, which is what the definition asks for; no task holds more than one pair of blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from partloom.llm.common import materialise

POSITIVES, NEGATIVES = 5, 3
LOW_PERCENT, HIGH_PERCENT = 50, 95
SCALE = 256
#: Rows and anchors of a block; results don't depend on it.
BLOCK_ROWS = 16384
#: Scores of so many (anchor, row) pairs are held at once.
SCORES_AT_ONCE = 1 << 21
LONG = (1 << 63) - 1


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of floor(256 x) as exact doubles; missing components at the end count as 0. Python integers where doubles can't."""
    column = column.combine_chunks()
    n = len(column)
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(offsets)
    width = int(size.max()) if n else 0
    out = np.zeros((n, width))
    inside = np.arange(width) < size[:, None]
    out[inside] = flat[offsets[0] : offsets[-1]]
    with np.errstate(over="ignore"):
        scaled = np.floor(out * SCALE)
    if np.isfinite(scaled).all():
        return scaled
    exact = np.empty(out.shape, object)
    exact[...] = [[math.floor(SCALE * x) if abs(x) < 2.0**52 else SCALE * int(x) for x in row] for row in out.tolist()]
    return exact


def _bound(m: np.ndarray) -> int:
    return int(np.abs(m).max()) if m.size else 0


class Scores:
    """Integer inner products of anchors with rows, and the order of rows by score down and id up."""

    def __init__(self, anchors: np.ndarray, rows: np.ndarray, ids: np.ndarray):
        width = max(anchors.shape[1], rows.shape[1])
        pad = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
        self.anchors, self.rows = pad(anchors), pad(rows)
        self.by_id = np.argsort(ids, kind="stable")
        self.shift = max(1, int(len(ids)).bit_length())
        most = max(width, 1) * _bound(anchors) * _bound(rows)
        self.narrow = most < 1 << min(53, 62 - self.shift)
        self.rows = self.rows[self.by_id]
        if self.narrow:
            self.anchors, self.rows = self.anchors.astype(np.float64), self.rows.astype(np.float64)
        else:  # beyond exact doubles: Python integers
            whole = np.vectorize(int, otypes=[object])
            self.anchors, self.rows = (whole(m) if m.size else m.astype(object) for m in (self.anchors, self.rows))

    def ordered(self, who: np.ndarray, among: np.ndarray):
        """(anchor, its scores from high to low, places of the rows) for the anchors who; among: places in order of id."""
        step = max(1, SCORES_AT_ONCE // max(len(among), 1))
        rows = self.rows[among]
        for i in range(0, len(who), step):
            block = who[i : i + step]
            if self.narrow:
                scores = (self.anchors[block] @ rows.T).astype(np.int64)
                keys = np.sort((-scores << self.shift) | np.arange(len(among)), axis=1)  # by score down, then by id
                for a, key in zip(block, keys):
                    yield a, -(key >> self.shift), among[key & ((1 << self.shift) - 1)]
            else:
                for a in block:
                    scores = [sum(x * y for x, y in zip(self.anchors[a], row)) for row in rows]
                    order = sorted(range(len(among)), key=lambda k: (-scores[k], k))
                    yield a, np.array([max(-LONG, min(LONG, scores[k])) for k in order], np.int64), among[order]


def _best_alike(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """Of one pair of blocks: each anchor's first rows of its own label, itself left out."""
    out: list[list[np.ndarray]] = [[], [], []]
    ids, places, own = rows.column("id").to_numpy(), rows.column("place").to_numpy(), anchors.column("place").to_numpy()
    label, wanted = rows.column("label").to_numpy(), anchors.column("label").to_numpy()
    s = Scores(_matrix(anchors.column("vector")), _matrix(rows.column("vector")), ids)
    ids, places, label = ids[s.by_id], places[s.by_id], label[s.by_id]
    for value in np.unique(wanted):
        for a, score, at in s.ordered(np.flatnonzero(wanted == value), np.flatnonzero(label == value)):
            first = np.flatnonzero(places[at[: POSITIVES + 1]] != own[a])[:POSITIVES]
            for x, y in zip(out, (np.full(len(first), own[a]), score[first], ids[at[first]])):
                x.append(y)
    return pa.table({n: np.concatenate([*x, np.zeros(0, np.int64)]) for n, x in zip(("anchor", "score", "id"), out)})


def _best_unlike(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """Of one pair of blocks: for each positive of each anchor the first rows of other labels inside its band."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    ids, own = rows.column("id").to_numpy(), anchors.column("place").to_numpy()
    label, wanted = rows.column("label").to_numpy(), anchors.column("label").to_numpy()
    positives = anchors.column("positives").combine_chunks()
    edges, best = positives.offsets.to_numpy(), positives.values.to_numpy(zero_copy_only=False)
    s = Scores(_matrix(anchors.column("vector")), _matrix(rows.column("vector")), ids)
    ids, label = ids[s.by_id], label[s.by_id]
    for value in np.unique(wanted):
        for a, score, at in s.ordered(np.flatnonzero(wanted == value), np.flatnonzero(label != value)):
            for k, p in enumerate(best[edges[a] : edges[a + 1]].tolist()):
                high, low = HIGH_PERCENT * p // 100, -(-LOW_PERCENT * p // 100)
                begin = int(np.searchsorted(-score, -high))
                got = score[begin : begin + NEGATIVES]
                got = got[got >= low]
                for x, y in zip(out, (np.full(len(got), own[a]), np.full(len(got), k), got, ids[at[begin : begin + len(got)]])):
                    x.append(y)
    return pa.table({n: np.concatenate([*x, np.zeros(0, np.int64)]) for n, x in zip(("anchor", "positive", "score", "id"), out)})


def hard_negatives(rows: DataFrame, anchor: str = "vec_id % 50 = 0", vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", relabel: str | None = "vec_id % 7 = 0", n_labels: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors, an SQL condition on rows.

    Components x count as floor(256 x), scores are their integer inner products, and a higher score comes first, ties by the
    smaller id. An anchor's positives are its first five other rows of the same label. For each, the first three rows of
    other labels whose score is 50 % to 95 % of the positive's are returned. Where relabel holds (None: nowhere), the label
    is first changed to (label + 1) mod n_labels.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Repeated rows are rows of their
    own: a copy of an anchor is another row of its label. Vectors of different lengths count as ended by zeros; an empty one
    scores 0. Scores beyond 64 bits are ordered exactly inside a block and held at the ends of long. An empty table, or one
    without anchors, gives no rows; other columns are ignored, whatever their names.
    """
    spark = rows.sparkSession
    label_of = F.col(label).cast("long")
    if relabel:
        label_of = F.when(F.expr(relabel), F.pmod(label_of + 1, F.lit(n_labels))).otherwise(label_of)
    bad = F.exists(F.col("vector"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    part = rows.select(F.col(vec_id).cast("long").alias("id"), label_of.alias("label"), F.col(vector).alias("vector"), F.coalesce(F.expr(anchor), F.lit(False)).alias("is_anchor"))
    part = part.where("id is not null and label is not null and vector is not null").where(~bad)
    # the place of a row is fixed by writing it, so that a task that runs again deals it to the same block
    all_rows = materialise(part.withColumn("place", F.monotonically_increasing_id()), "vectors")
    n, n_anchors = all_rows.agg(F.count("*"), F.count_if("is_anchor")).first()
    n_blocks = max(1, math.ceil(n / block_rows), min(spark.sparkContext.defaultParallelism, math.ceil(n / 1024)))
    n_anchor_blocks = max(1, math.ceil(n_anchors / block_rows))
    block = lambda k: F.pmod(F.xxhash64("place"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    slim = all_rows.select("id", "label", "vector", "place", block(n_blocks).alias("b"), every(n_anchor_blocks).alias("a"))
    anchors = all_rows.where("is_anchor").select("place", "id", "label", "vector", block(n_anchor_blocks).alias("a"))

    def over_blocks(who: DataFrame, f, schema: str) -> DataFrame:
        dealt = who.withColumn("b", every(n_blocks))
        return slim.groupBy("b", "a").cogroup(dealt.groupBy("b", "a")).applyInArrow(f, schema)

    def first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)

    alike = first(over_blocks(anchors.drop("id"), _best_alike, "anchor bigint, score bigint, id bigint"), ["anchor"], POSITIVES)
    positives = alike.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("best"))  # five at most
    mined = materialise(anchors.join(positives, anchors["place"] == positives["anchor"]).select("place", anchors["id"].alias("anchor_id"), "label", "vector", "a", "best"), "positives")
    ask = mined.select("place", "label", "vector", "a", F.col("best.score").alias("positives"))
    unlike = first(over_blocks(ask, _best_unlike, "anchor bigint, positive bigint, score bigint, id bigint"), ["anchor", "positive"], NEGATIVES)
    named = mined.select(F.col("place").alias("anchor"), "anchor_id", F.posexplode("best").alias("positive", "p"))
    return named.join(unlike, ["anchor", "positive"]).select("anchor_id", F.col("p.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))

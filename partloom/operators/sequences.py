"""Sequence search and clustering, gram sets and distances, and sequence statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from partloom.functions.text import closed_bucket, kgrams, normalise_sequence, percent
from partloom.operators import alignment
from partloom.operators.alignment import WORD
from partloom.operators.blocks import near_pairs
from partloom.operators.graph import checkpointed, connected_components
from partloom.operators.linkage import centroids, single_link
from partloom.operators.seeds import RUN, distinct_sequences, identities, members, seed_edges
from partloom.session import spread

# fixed values: defaults of the global search
MAX_ACCEPTS, IDENTITY, MIN_LENGTH, MAX_LENGTH = 50, 0.8, 20, 5000
#: Share of minimizers from which two sequences are aligned for clusters.
SHARE = 0.1


def normalise(sequences: DataFrame, bases: str = "gatc") -> DataFrame:
    return sequences.withColumn("sequence", normalise_sequence(F.col("sequence"), bases))


def exact_search(sequences: DataFrame, query: str) -> DataFrame:
    return sequences.where(F.upper("sequence") == query.upper()).select("subject")


def align(a: str, b: str) -> tuple[float, str]:
    """Identity (matches by inner columns) and CIGAR of one best global alignment."""
    if not a or not b:
        return 0.0, ""
    ops = alignment.align(a, b)
    return alignment.identity_of(ops, a, b), alignment.cigar(ops)


def global_search(
    sequences: DataFrame, query: str, identity: float = IDENTITY, most: int = MAX_ACCEPTS, shortest: int = MIN_LENGTH, longest: int = MAX_LENGTH, definition: int = 2, rejects: int = 0
) -> DataFrame:
    """subject, pct_id and cigar of the matches of one query, found by shared words and then aligned.

    Without a limit of rejects the best matches of all candidates, at most `most` (0: all). With one, candidates come by
    the number of shared words, shorter ones and then smaller subjects first, and the search ends at `most` accepted or
    so many rejected; no more than both together are read, so that is what is aligned.
    """
    q = query.lower()
    if len(q) < WORD or not shortest <= len(q) <= longest:
        return sequences.limit(0).select("subject", F.lit(0.0).alias("pct_id"), F.lit("").alias("cigar"))
    near = spread(sequences.where(F.length("sequence").between(shortest, longest)).select("subject", "sequence"))
    run = lambda prune: lambda batches: alignment.matches(q, batches, identity, definition, 1, prune)
    if not rejects:
        good = near.mapInArrow(run(True), alignment.MATCHES).where(F.col("pct_id") >= 100 * identity).select("subject", "pct_id", "cigar")
        return good.orderBy(F.desc("pct_id"), "subject").limit(most) if most else good
    own = alignment.words(q.encode())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = alignment.shared_words(own, [s.lower().encode() for s in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n)], ["subject", "sequence", "words"])

    by_words = [F.desc("words"), "length", "subject"]
    counted = near.mapInArrow(count, "subject string, sequence string, words bigint").where("words > 0").withColumn("length", F.length("sequence"))
    if most:
        counted = counted.orderBy(*by_words).limit(most + rejects - 1)
    done = counted.select("subject", "sequence").mapInArrow(run(False), alignment.MATCHES).withColumn("good", F.col("pct_id") >= 100 * identity)
    # the candidates are few: as many as both limits allow
    w = W.orderBy(*by_words).rowsBetween(W.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.count_if(c).over(w), F.lit(0))
    met = done.withColumns({"_yes": before(F.col("good")), "_no": before(~F.col("good"))}).where(F.col("_no") < rejects)
    met = met.where(F.col("_yes") < most) if most else met
    return met.where("good").orderBy(F.desc("pct_id"), "subject").select("subject", "pct_id", "cigar")


def substring_semi(parts: DataFrame, hits: DataFrame) -> DataFrame:
    """Parts whose subject contains any hit. Hits of a search are few (its accept limit), so they meet every part."""
    return parts.join(hits.select(F.col("subject").alias("_hit")).distinct(), F.contains(F.col("subject"), F.col("_hit")), "left_semi")


def hit_attributes(parts: DataFrame, uc: DataFrame, ranks: DataFrame) -> DataFrame:
    """Identity, strand and CIGAR of the first table row naming the subject as target, and the score rank * identity."""
    first = uc.where("rec = 'H'").groupBy("target_label").agg(F.min_by(F.struct("pct_id", "strand", "cigar"), "line").alias("u"))
    rows = parts.join(first, F.col("subject") == F.col("target_label"), "left").join(ranks, "subject", "left")
    score = F.coalesce("pagerank", F.lit(1.0)) * percent(F.col("u.pct_id"))
    return rows.select(*parts.columns, F.when(F.contains(F.coalesce("type", F.lit("")), F.lit("Sequence")), score / 10).otherwise(score).alias("order_by"), percent(F.col("u.pct_id")).alias("percentMatch"), F.col("u.strand").alias("strandAlignment"), F.col("u.cigar").alias("CIGAR"))


def uc_clusters(uc: DataFrame) -> DataFrame:
    """(cluster_id, subject); a subject listed twice belongs to its last cluster."""
    rows = uc.where(F.col("rec").isin("S", "H"))
    return rows.groupBy(F.col("query_label").alias("subject")).agg(F.max("cluster_no").alias("cluster_id")).select("cluster_id", "subject")


def cluster_neighbours(clusters: DataFrame) -> DataFrame:
    """(subject, others): the other members of each subject's cluster."""
    sets = clusters.groupBy("cluster_id").agg(F.sort_array(F.collect_set("subject")).alias("all"))
    return clusters.join(sets, "cluster_id").select("subject", F.array_except("all", F.array("subject")).alias("others"))


def neighbour_counts(clusters: DataFrame) -> DataFrame:
    """(subject, others): how many other members each subject's cluster has. A cluster is counted once and is not spread over
    its members, so the work grows with the rows and not with the squares of the clusters."""
    rows = clusters.select("cluster_id", "subject").distinct()
    sizes = rows.groupBy("cluster_id").agg(F.count("*").alias("size"))
    return rows.join(sizes, "cluster_id").select("subject", (F.col("size") - 1).alias("others"))


def uc_targets(uc: DataFrame) -> DataFrame:
    return uc.where("rec = 'H'").select(F.col("target_label").alias("subject")).distinct()


def uc_summary(uc: DataFrame) -> DataFrame:
    hit = F.col("rec") == "H"
    return uc.agg(F.count_if(hit | (F.col("rec") == "S")).alias("parts"), F.count_if(hit).alias("hits"), F.coalesce(F.round(F.avg(F.when(hit, F.col("pct_id").try_cast("double"))), 6), F.lit(0.0)).alias("mean_identity"))


def gram_pairs(sequences: DataFrame, k: int = WORD, within: float = 0.5, distance: Distance | None = None) -> DataFrame:
    """(a, b, dist), a < b: all pairs of different sequences, under their smallest subjects, whose sets of grams have a
    Jaccard distance of at most `within` (below 1). Exact.

    Blocks of sequences meet in pairs, and common grams are counted there, so what is moved and held doesn't depend on how
    frequent grams are. distance, a function of two sets, takes the place of the Jaccard distance in the result; pairs are
    still chosen by the latter.
    """
    if not 0 <= within < 1:
        raise ValueError("within must be at least 0 and below 1")
    distinct = checkpointed(distinct_sequences(sequences))
    near = near_pairs(distinct, k, within)
    if distance is None:
        return near.select("a", "b", (1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("dist"))
    sets = distinct.select("subject", kgrams(F.col("sequence"), k).alias("grams"))
    both = near.join(sets.toDF("a", "ga"), "a").join(sets.toDF("b", "gb"), "b")
    return pair_scores(both.select("a", "ga", "b", "gb"), distance)


def greedy_clusters(sequences: DataFrame, identity: float = IDENTITY, run: int = RUN, share: float = SHARE) -> DataFrame:
    """(cluster_id, subject, centroid, identity) of greedy centroid clustering.

    Longer sequences come first, then smaller subjects. A sequence joins the earlier centroid with the highest identity, if
    that is high enough (ties: the earliest), and is a centroid of its own if not. Sequences are held against each other
    where they share enough of the minimizers of the one that has fewer; equal ones are always in one cluster. Null
    sequences are in none.

    All pairs with enough identity are found first; who is a centroid then follows from the order in rounds.
    """
    distinct = checkpointed(distinct_sequences(sequences))
    near = checkpointed(identities(distinct, identity, run, share=share))
    heads = centroids(near)
    lost = heads.where("not is_centroid").select(F.col("id").alias("later"))
    to = near.join(lost, "later").join(heads.where("not is_centroid").select(F.col("id").alias("earlier")), "earlier", "left_anti")
    length = distinct.select(F.col("subject").alias("earlier"), F.length("sequence").alias("length"))
    # the highest identity, then the earliest in the order
    joined = to.join(length, "earlier").groupBy("later").agg(F.min_by(F.struct("earlier", "identity"), F.struct(-F.col("identity"), -F.col("length"), "earlier")).alias("x"))
    own = distinct.select("subject").join(joined, F.col("subject") == F.col("later"), "left").select(F.col("subject").alias("representative"), F.coalesce("x.earlier", "subject").alias("centroid"), F.coalesce("x.identity", F.lit(1.0)).alias("identity"))
    done = members(sequences, distinct).join(own, "representative")
    return done.select(F.xxhash64("centroid").alias("cluster_id"), "subject", "centroid", "identity")


def threshold_clusters(sequences: DataFrame, above: int = 500, run: int = RUN) -> DataFrame:
    """(subject, component): sequences linked by scores above the threshold, and equal ones; the smallest subject's name."""
    distinct = checkpointed(distinct_sequences(sequences))
    edges = seed_edges(distinct, above, run).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = connected_components(distinct.select(F.col("subject").alias("id")), edges)
    return members(sequences, distinct).join(found, F.col("representative") == F.col("id")).select("subject", "component")


Distance = Callable[[frozenset, frozenset], float]


def hierarchical_clusters(sequences: DataFrame, clusters: int, k: int = WORD, within: float = 0.5, distance: Distance | None = None) -> DataFrame:
    """(cluster, subject): single link merged until so many clusters of different sequences are left, or no two clusters
    have sequences within the bound; ids are the smallest subject. Equal sequences are one for the count."""
    distinct = checkpointed(distinct_sequences(sequences))
    found = single_link(distinct.select(F.col("subject").alias("id")), gram_pairs(distinct, k, within, distance), clusters)
    return members(sequences, distinct).join(found, F.col("representative") == F.col("id")).select("cluster", "subject")


def base_frequencies(sequences: DataFrame) -> DataFrame:
    return sequences.select(F.explode(F.split("sequence", "")).alias("base")).where("base <> ''").groupBy("base").agg(F.count("*").alias("n"))


def length_histogram(sequences: DataFrame, bins: int = 500, cutoff: int | None = None, include_empty: bool = True) -> DataFrame:
    rows = sequences.select(F.length("sequence").cast("double").alias("len"))
    if cutoff is not None:
        rows = rows.where(F.col("len") < cutoff)
    if not include_empty:
        rows = rows.where("len > 0")
    return histogram(rows, "len", bins)


def histogram(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n) with bins from 1 between the smallest and the largest value, the last one closed."""
    ends = rows.agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    x = rows.join(F.broadcast(ends))  # one row
    same = F.col("_a") == F.col("_b")
    b = F.when(same, F.lit(1).cast("bigint")).otherwise(closed_bucket(F.col(column), F.col("_a"), F.when(same, F.col("_b") + 1).otherwise(F.col("_b")), bins))
    return x.where(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def length_cumulative(sequences: DataFrame, most: int = 100) -> DataFrame:
    """(len, n): how many sequences have at most len characters, for 0 to most - 1."""
    spark = sequences.sparkSession
    counts = sequences.select(F.length("sequence").alias("len")).where(F.col("len") < most).groupBy("len").count()
    all_ = spark.range(most).select(F.col("id").cast("int").alias("len")).join(counts, "len", "left")  # `most` rows
    return all_.select("len", F.sum(F.coalesce("count", F.lit(0))).over(W.orderBy("len").rowsBetween(W.unboundedPreceding, 0)).alias("n"))


def ecdf(rows: DataFrame, column: str) -> DataFrame:
    """(value, y): share of values at or below each distinct value; counted by value first, so the window is short."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("c"))
    w = W.orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    return counts.select("value", (F.sum("c").over(w) / F.sum("c").over(W.partitionBy())).alias("y"))


def rank_histogram(ranks: DataFrame, bins: int = 10_000, rank: str = "pagerank", key: str = "subject") -> DataFrame:
    """(bin, n) of all ranks but the highest one, which would leave the others in one bin; of equal ones the first key goes."""
    top = ranks.orderBy(F.desc(rank), key).limit(1).select(key)
    return histogram(ranks.join(F.broadcast(top), key, "left_anti"), rank, bins)  # one row


def cluster_sizes(clusters: DataFrame, outliers: int = 0, least: int = 1) -> DataFrame:
    """(size, clusters) of clusters of at least so many members, after dropping the largest clusters."""
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    if outliers:
        drop = sizes.orderBy(F.desc("size"), "cluster_id").limit(outliers).select("cluster_id")
        sizes = sizes.join(F.broadcast(drop), "cluster_id", "left_anti")  # `outliers` rows
    return sizes.groupBy("size").agg(F.count("*").alias("clusters"))


def pair_scores(pairs: DataFrame, distance: Distance) -> DataFrame:
    """dist of pairs (a, ga, b, gb) by a Python function of two sets, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "dist": [distance(frozenset(x), frozenset(y)) for x, y in zip(pdf["ga"], pdf["gb"])]})

    return pairs.mapInPandas(run, T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("dist", T.DoubleType())]))

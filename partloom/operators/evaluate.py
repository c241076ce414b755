"""Ranking quality: where expected items stand in result lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def rank_of_expected(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, child, position): place from 0 in the query's result list, -1 where absent.

    results: query_id, subject, order_by; expected: query_id, child.
    """
    w = W.partitionBy("query_id").orderBy(F.desc("order_by"), "subject")
    placed = results.withColumn("position", F.row_number().over(w) - 1).select("query_id", F.col("subject").alias("child"), "position")
    first = placed.groupBy("query_id", "child").agg(F.min("position").alias("position"))
    return expected.join(first, ["query_id", "child"], "left").select("query_id", "child", F.coalesce("position", F.lit(-1)).alias("position"))


def summary(positions: DataFrame) -> DataFrame:
    """total, found, average and upper median (element n div 2 of the sorted list) of found positions."""
    found = positions.where("position >= 0")
    n = F.count("*")
    counts = found.groupBy("position").agg(n.alias("c"))
    run = counts.select("position", F.sum("c").over(W.orderBy("position").rowsBetween(W.unboundedPreceding, 0)).alias("upto"))
    facts = positions.agg(n.alias("total"), F.count_if(F.col("position") >= 0).alias("found"), F.coalesce(F.round(F.avg(F.when(F.col("position") >= 0, F.col("position"))), 6), F.lit(0.0)).alias("average"))
    middle = run.join(F.broadcast(facts.select("found"))).where(F.col("upto") > F.floor(F.col("found") / 2)).agg(F.min("position").alias("upper_median"))
    return facts.join(middle)  # one row each


def top_slices(ranks: DataFrame, id_column: str = "id", rank: str = "rank") -> DataFrame:
    """The top item and the next ten, with their place from 1."""
    best = ranks.orderBy(F.desc(rank), id_column).limit(11)
    return best.withColumn("place", F.row_number().over(W.orderBy(F.desc(rank), id_column)))


def popular(ranks: DataFrame, least: float = 0.002, not_containing: str = "sequence", id_column: str = "id", rank: str = "rank") -> DataFrame:
    return ranks.where((F.col(rank) > least) & ~F.contains(F.col(id_column), F.lit(not_containing)))


def evaluation_set(parts: DataFrame, components: DataFrame, role: str, collection: DataFrame, kind: str, most: int = 5000) -> DataFrame:
    """Parts of a role and type in a collection that have a component, at most so many."""
    hit = parts.where((F.col("role") == role) & (F.col("type") == kind)).join(collection, "subject", "left_semi")
    return hit.join(components.select(F.col("parent").alias("subject")), "subject", "left_semi").select("subject", "description").distinct().orderBy("subject").limit(most)

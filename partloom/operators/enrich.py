"""Index documents: rank, keywords, ontology synonyms and type words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.functions.text import clean_synonym, display_keywords, term_id, type_suffix


def add_rank(parts: DataFrame, ranks: DataFrame) -> DataFrame:
    """pagerank, 1.0 where a part has none."""
    return parts.join(ranks.select("subject", "pagerank"), "subject", "left").withColumn("pagerank", F.coalesce("pagerank", F.lit(1.0)))


def add_keywords(parts: DataFrame) -> DataFrame:
    return parts.withColumn("keywords", display_keywords(F.col("displayId")))


def role_words(parts: DataFrame, terms: DataFrame) -> DataFrame:
    """(role, words): labels and synonyms of every term whose id contains the role's term id, in term order.

    Only the distinct roles meet the terms, so the comparison by substring stays small.
    """
    roles = parts.select("role").where(term_id(F.col("role")).isNotNull()).distinct().withColumn("_term", term_id(F.col("role")))
    ordered = terms.withColumn("_no", F.monotonically_increasing_id())
    hits = roles.join(ordered, F.contains(F.col("id"), F.col("_term")))
    words = F.array_union(F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), clean_synonym), F.array("lbl"))
    grouped = hits.select("role", F.struct("_no", F.array_distinct(words).alias("w")).alias("x")).groupBy("role").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return roles.select("role").join(grouped, "role", "left").select("role", F.coalesce(F.array_distinct(F.flatten(F.col("x.w"))), F.array().cast("array<string>")).alias("words"))


def add_roles(parts: DataFrame, terms: DataFrame) -> DataFrame:
    out = parts.join(role_words(parts, terms), "role", "left")
    return out.withColumn("keywords", F.when(F.col("words").isNull(), F.col("keywords")).otherwise(F.concat("keywords", F.lit(" "), F.array_join("words", " ")))).drop("words")


def add_type(parts: DataFrame) -> DataFrame:
    return parts.withColumn("keywords", F.when(F.col("sboltype").isNull(), F.col("keywords")).otherwise(F.concat("keywords", F.lit(" "), type_suffix(F.col("sboltype")))))


def index_documents(parts: DataFrame, ranks: DataFrame, terms: DataFrame) -> DataFrame:
    return add_type(add_roles(add_keywords(add_rank(parts, ranks)), terms))

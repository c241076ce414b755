"""Ranked text search over fields, filters, demotion of duplicates, and paging."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from partloom.functions.text import tokens
from partloom.operators.postings import EXPANSIONS, FIELDS, K1, B, edits_allowed, nearest

CAP = 10_000
SEQUENCE = "Sequence"


def fuzzy_terms(docs: DataFrame, terms: list[str], fields: list[str], most: int = EXPANSIONS) -> dict[str, list[tuple[str, float]]]:
    """For each term the nearest words of the vocabulary of docs, without an index: one reading of the fields for all terms.

    Only words within the length difference are compared.
    """
    given = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(len(t)).alias("length"), F.lit(edits_allowed(t)).alias("allowed")) for t in dict.fromkeys(terms)))
    spans = [F.length("word").between(len(t) - edits_allowed(t), len(t) + edits_allowed(t)) for t in terms]
    words = docs.select(F.explode(F.concat(*(tokens(F.col(f)) for f in fields))).alias("word")).where(reduce(lambda a, b: a | b, spans, F.lit(False))).distinct()
    fits = F.filter(given, lambda x: F.abs(F.length("word") - x["length"]) <= x["allowed"])
    return nearest(words.select(F.explode(fits).alias("x"), "word").select("x.term", "word"), terms, most) if terms else {}


Scorer = Callable[[DataFrame, Any, dict[str, float] | None], DataFrame]


def bm25(docs: DataFrame, terms: list[str] | dict[str, list[tuple[str, float]]], fields: dict[str, float] | None = None, subject: str | None = "subject") -> DataFrame:
    """docs with column q: the largest over fields of boost * BM25, only rows that any term matches.

    Statistics of all fields and terms come from one aggregation to one row; scoring is a map, without a shuffle. Counts
    are one array a field, so the plan stays small for many words.
    """
    fields = fields or FIELDS
    weighted = terms if isinstance(terms, dict) else {t: [(t, 1.0)] for t in terms}
    words = sorted({w for alts in weighted.values() for w, _ in alts})
    names = list(fields)
    tok = docs.withColumns({f"_t_{f}": tokens(F.col(f)) for f in names})
    tok = tok.withColumns({f"_l_{f}": F.size(f"_t_{f}") for f in names} | {f"_k_{f}": F.filter(F.col(f"_t_{f}"), lambda x: x.isin(words)) for f in names}).drop(*(f"_t_{f}" for f in names))
    listed = F.lit(words) if words else F.array().cast("array<string>")
    # an array of one binds the kept words, else the optimizer puts the split of the text into the loop over words
    count = lambda f: F.transform(F.array(F.col(f"_k_{f}")), lambda kept: F.transform(listed, lambda w: F.size(F.filter(kept, lambda x: x == w))))[0]
    table = tok.withColumns({f"_n_{f}": count(f) for f in names}).drop(*(f"_k_{f}" for f in names))
    stats = [F.count_if(F.col(f"_l_{f}") > 0).alias(f"_docs_{f}") for f in names] + [F.sum(f"_l_{f}").alias(f"_total_{f}") for f in names]
    stats += [F.array(*(F.count_if(F.col(f"_n_{f}")[i] > 0) for i in range(len(words)))).cast("array<bigint>").alias(f"_df_{f}") for f in names]
    scored = table.crossJoin(F.broadcast(table.agg(*stats)))  # one row of statistics
    flat = [(words.index(w), float(weight)) for alts in weighted.values() for w, weight in alts]
    alternatives = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(weight).alias("weight")) for i, weight in flat)).cast("array<struct<i:int,weight:double>>")

    def field_score(f: str) -> Column:
        length = 1 - B + B * F.col(f"_l_{f}") / (F.col(f"_total_{f}") / F.col(f"_docs_{f}"))

        def add(total: Column, x: Column) -> Column:
            tf, df = F.col(f"_n_{f}")[x["i"]], F.col(f"_df_{f}")[x["i"]]
            idf = F.log(1 + (F.col(f"_docs_{f}") - df + 0.5) / (df + 0.5))
            return total + F.when(tf > 0, x["weight"] * idf * tf * (K1 + 1) / (tf + K1 * length)).otherwise(0.0)

        return fields[f] * F.aggregate(alternatives, F.lit(0.0), add)

    each = [field_score(f) for f in names]
    if subject:  # keyword field: a whole value matches or not
        each.append(F.when(F.col(subject).isin(list(weighted)), F.lit(1.0)).otherwise(0.0))
    best = F.greatest(*each) if len(each) > 1 else each[0]
    return scored.select(*(F.col(c) for c in docs.columns), best.alias("q")).where("q > 0")


def blend(docs: DataFrame, score: Column, mode: str = "multiply", plus: float = 0.0) -> DataFrame:
    """score: q * ln(1 + pagerank), once more times q where the script's value multiplies the query's own."""
    q = score + plus
    value = q * F.log1p("pagerank")
    return docs.withColumn("score", F.round(q * value if mode == "multiply" else value, 6))


def top(docs: DataFrame, cap: int = CAP) -> DataFrame:
    return docs.orderBy(F.desc("score"), "subject").limit(cap)


def search_text(docs: DataFrame, terms, mode: str = "multiply", cap: int = CAP, fields: dict[str, float] | None = None, scorer: Scorer = bm25) -> DataFrame:
    """scorer: bm25 over the documents themselves, or that of a stored index."""
    return top(blend(scorer(docs, terms, fields), F.col("q"), mode), cap)


def search_allowed(docs: DataFrame, terms, allowed: DataFrame, mode: str = "multiply", cap: int = CAP, scorer: Scorer = bm25) -> DataFrame:
    """Text search within an allow-list; a list match adds 1 to the text score. Statistics are those of all documents."""
    return top(blend(scorer(docs, terms, None).join(allowed.select("subject").distinct(), "subject", "left_semi"), F.col("q"), mode, 1.0), cap)


def allowed_only(docs: DataFrame, allowed: DataFrame, cap: int = CAP) -> DataFrame:
    return top(docs.join(allowed.select("subject").distinct(), "subject", "left_semi").withColumn("score", F.round(F.log1p("pagerank"), 6)), cap)


def all_in_graphs(docs: DataFrame, graphs: list[str], offset: int, limit: int) -> DataFrame:
    """Every document of the graphs by rank; paged here, before any demotion."""
    ranked = docs.where(F.col("graph").isin(graphs)).withColumn("score", F.round(F.log1p("pagerank"), 6))
    return ranked.orderBy(F.desc("score"), "subject").offset(offset).limit(limit)


def plain_search(docs: DataFrame, terms: list[str], cap: int = CAP) -> DataFrame:
    """The prototype's search: no boosts, no rank."""
    hits = bm25(docs, terms, dict.fromkeys(FIELDS, 1.0))
    return top(hits.withColumn("score", F.round("q", 6)), cap)


def acl(hits: DataFrame, graphs: list[str]) -> DataFrame:
    return hits.where(F.col("graph").isin(graphs))


def role_gate(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows without a role, or with one that contains the prefix."""
    return rows.where(F.col("role").isNull() | F.contains(F.col("role"), F.lit(prefix)))


def graph_in_uri(uris: DataFrame, graphs: list[str], column: str = "subject") -> DataFrame:
    return uris.where(reduce(lambda a, b: a | b, [F.contains(F.col(column), F.lit(g)) for g in graphs], F.lit(False)))


def demote(hits: DataFrame, clusters: DataFrame, score: str = "score") -> DataFrame:
    """order_by: the first hit of a cluster keeps its score, later ones get half; sequences get a tenth of that."""
    w = W.partitionBy("cluster_id").orderBy(F.desc(score), "subject")
    placed = hits.join(clusters.select("subject", "cluster_id").dropDuplicates(["subject"]), "subject", "left")
    # hits are at most the retrieval cap, so the window is small; rows without a cluster never meet
    ranked = placed.where("cluster_id is not null").withColumn("_k", F.row_number().over(w)).unionByName(placed.where("cluster_id is null").withColumn("_k", F.lit(1)))
    halved = F.when(F.col("_k") > 1, F.col(score) / 2).otherwise(F.col(score))
    tenth = F.when(F.contains(F.coalesce("type", F.lit("")), F.lit(SEQUENCE)), halved / 10).otherwise(halved)
    return ranked.withColumn("order_by", tenth).drop("_k")


def page(results: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    return results.orderBy(F.desc("order_by"), "subject").offset(offset).limit(limit)


def similar(clusters: DataFrame, subject: str) -> DataFrame:
    """Other members of the subject's clusters; nothing for one without."""
    mine = clusters.where(F.col("subject") == subject).select("cluster_id").distinct()
    return clusters.join(mine, "cluster_id", "left_semi").where(F.col("subject") != subject).select("subject").distinct()


def criteria_rows(parts: DataFrame, ranks: DataFrame, prefix: str | None = None) -> DataFrame:
    """Rows of a criteria search: rank (1 by default), a tenth for sequences."""
    rows = parts.join(ranks, "subject", "left")
    rows = role_gate(rows, prefix) if prefix else rows
    r = F.coalesce("pagerank", F.lit(1.0))
    return rows.withColumn("order_by", F.when(F.contains(F.coalesce("type", F.lit("")), F.lit(SEQUENCE)), r / 10).otherwise(r)).drop("pagerank")

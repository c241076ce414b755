"""Sinks: FASTA, cluster files, and typed query responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partloom.sources.readers import xsd

MAX_SUBJECT_BYTES = 512
URI_FIELDS = ("subject", "type", "role", "sboltype")


def write_fasta(sequences: DataFrame, path: str) -> None:
    sequences.select(F.concat(F.lit(">"), "subject", F.lit("\n"), F.coalesce("sequence", F.lit(""))).alias("value")).write.mode("overwrite").text(path)


def write_clusters(clusters: DataFrame, path: str) -> None:
    """Lines `subject cluster`."""
    clusters.select("subject", "cluster_id").write.mode("overwrite").csv(path, sep=" ")


def uc_assignments(uc: DataFrame) -> DataFrame:
    """The cluster of every sequence record (seeds and hits) of a UC table."""
    return uc.where(F.col("rec").isin("H", "S")).select(F.col("query_label").alias("subject"), F.col("cluster_no").alias("cluster_id"))


def write_grams(grams: DataFrame, path: str) -> None:
    grams.select(F.concat("subject", F.lit(" "), F.array_join("grams", " ")).alias("value")).write.mode("overwrite").text(path)


def split_by_size(parts: DataFrame, most: int = MAX_SUBJECT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows to index, rows skipped because their subject has more UTF-8 bytes than allowed)."""
    fits = F.octet_length("subject") <= most
    return parts.where(fits), parts.where(~fits)


def cell(name: str, value: Column) -> Column:
    """A typed binding cell; null, -1 and N/A give no cell."""
    text = value.cast("string")
    gone = text.isNull() | text.isin("-1", "-1.0", "N/A")
    kind = F.lit("uri" if name in URI_FIELDS else "literal")
    return F.when(~gone, F.struct(kind.alias("type"), text.alias("value"), (xsd("uri") if name in URI_FIELDS else xsd("string")).alias("datatype")))


def response(results: DataFrame) -> DataFrame:
    """results as one JSON text for each binding."""
    fields = [cell(c, F.col(c)).alias(c) for c in results.columns if c != "order_by"]
    order = [F.col("order_by")] if "order_by" in results.columns else []
    return results.select(F.to_json(F.struct(*fields, *order)).alias("binding"))


def envelope(page: DataFrame) -> DataFrame:
    """A page of results as one JSON text: the names of its columns, and its bindings in the order of order_by and subject.

    A page is as long as its limit, so it fits in one row.
    """
    names = [c for c in page.columns if c != "order_by"]
    order = F.desc("order_by") if "order_by" in page.columns else F.lit(0)
    placed = page.withColumn("_no", F.row_number().over(W.orderBy(order, names[0])))
    cells = F.struct(*(cell(c, F.col(c)).alias(c) for c in names))
    bindings = F.transform(F.array_sort(F.collect_list(F.struct("_no", cells.alias("b")))), lambda x: x["b"])
    head = F.struct(F.array(*map(F.lit, names)).alias("vars"))
    return placed.agg(F.to_json(F.struct(head.alias("head"), F.struct(bindings.alias("bindings")).alias("results"))).alias("response"))


def count_response(results: DataFrame) -> DataFrame:
    return results.agg(F.to_json(F.struct(F.lit("typed-literal").alias("type"), F.count("*").cast("string").alias("value"), xsd("integer").alias("datatype"))).alias("binding"))

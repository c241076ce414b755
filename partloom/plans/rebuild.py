"""Full rebuild: clusters (may be skipped), ranks, index; published as one commit."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from partloom.operators import enrich, graph, sequences
from partloom.session import Options
from partloom.sources.store import IndexStore
from partloom.sources.writers import MAX_SUBJECT_BYTES


def rebuild(quads: DataFrame, optional: dict[str, str], terms: DataFrame, store: IndexStore, options: Options = Options(), skip_clustering: bool = True, seqs: DataFrame | None = None) -> dict[str, int | None]:
    """Read the statements of a repository and publish its index, with the tables `ranks`, `stamps` (step, at) and, unless
    skipped, `clusters` (cluster_id, subject) beside it. Sequences are those of the definitions, if none are given.

    Returns the number of parts, of parts left out for the length of their subject, of edges and of edges with unknown
    ends, all counted while the tables are made, and the number of the commit. Whoever keeps results by the number of the
    last commit (Memo) forgets them with it.
    """
    spark, stamps = quads.sparkSession, []
    stamp = lambda step: stamps.append((step, datetime.now(timezone.utc)))
    tables: dict[str, DataFrame] = {}
    top = graph.top_levels(quads)
    if not skip_clustering:
        own = graph.sequence_chain(quads) if seqs is None else seqs
        tables["clusters"] = graph.checkpointed(sequences.greedy_clusters(own, options.cluster_identity).select("cluster_id", "subject"))
        stamp("clusters")
    edges, parts = Observation("edges"), Observation("parts")
    links = graph.links(quads, top).select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    ranked = graph.pagerank(top.select(F.col("s").alias("id")), links, options.damping, options.pagerank_tolerance, dropped=edges)
    tables["ranks"] = graph.checkpointed(ranked.select(F.col("id").alias("subject"), F.col("rank").alias("pagerank")))
    stamp("ranks")
    rows = enrich.index_documents(graph.one_row_each(graph.parts(quads, optional, indexing=True)), tables["ranks"], terms)
    fits = F.octet_length("subject") <= MAX_SUBJECT_BYTES
    stamp("index")
    tables["stamps"] = spark.createDataFrame(stamps, "step string, at timestamp")
    counted = rows.observe(parts, F.count(F.lit(1)).alias("parts"), F.count_if(~fits).alias("skipped"))
    commit = store.publish(counted.where(fits), **tables)
    has_edges = top.limit(1).count() > 0
    return parts.get | (edges.get if has_edges else {"edges": 0, "dropped": 0}) | {"commit": commit}

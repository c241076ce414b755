"""Incremental changes of the index: latest state of each subject, collection removal, refresh, and streams of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from partloom.operators.enrich import add_keywords, add_rank
from partloom.sources.store import IndexStore


def latest(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last change of each key; one aggregation with partial results before the shuffle."""
    return changes.groupBy(key).agg(F.max_by(F.struct(*changes.columns), F.struct(*order)).alias("r")).select("r.*")


def apply_changes(index: DataFrame, changes: DataFrame, ranks: DataFrame) -> DataFrame:
    """index after a batch of (op, subject, seq, part): removals first, so a subject removed and added is there.

    Added parts get rank and keywords, but no role or type words.
    """
    adds = latest(changes.where("op = 'add'"), "subject", ["seq"]).select("part.*")
    added = add_keywords(add_rank(adds, ranks)).select(*index.columns)
    return index.join(changes.select("subject").distinct(), "subject", "left_anti").unionByName(added)


def remove_collection(index: DataFrame, members: DataFrame, collection: str, prefix: str) -> DataFrame:
    """index without the collection and those of its members whose subject starts with prefix."""
    gone = members.where((F.col("collection") == collection) & F.startswith(F.col("member"), F.lit(prefix))).select(F.col("member").alias("subject"))
    gone = gone.union(index.where(F.col("subject") == collection).select("subject")).distinct()
    return index.join(gone, "subject", "left_anti")


def refresh(index: DataFrame, parts: DataFrame, subject: str, ranks: DataFrame, strict: bool = True) -> DataFrame:
    """Replace one subject by its rows in parts; strict: only if there is exactly one, else it is gone."""
    found = parts.where(F.col("subject") == subject)
    rest = index.where(F.col("subject") != subject)
    if strict:
        found = found.join(found.groupBy("subject").count().where("count = 1").select("subject"), "subject", "left_semi")
    return rest.unionByName(add_keywords(add_rank(found, ranks)).select(*index.columns))


def change_store(store: IndexStore, changes: DataFrame, ranks: DataFrame) -> int:
    """apply_changes() as one commit of the store: writes the rows and keys of the batch and nothing else. The same batch
    twice leaves the same state."""
    adds = latest(changes.where("op = 'add'"), "subject", ["seq"]).select("part.*")
    return store.change(add=add_keywords(add_rank(adds, ranks)).select(*store.current().columns), remove=changes)


def stream_changes(changes: DataFrame, store: IndexStore, ranks: DataFrame, checkpoint: str, compact_after: int = 16) -> DataStreamWriter:
    """A stream of changes into the store; each batch is one commit, readers never see half of one. After so many changes
    they are put together with the base."""

    def batch(rows: DataFrame, _: int) -> None:
        change_store(store, rows, ranks)
        store.compact(compact_after)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)

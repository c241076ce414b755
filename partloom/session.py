"""Session builder and options."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    b = SparkSession.builder.master(master).appName("partloom")
    defaults = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession, name: str = "") -> str:
    """A fresh path in the folder named by spark.checkpoint.dir; only a local session gets one of its own where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="partloom-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *by: Column | str) -> DataFrame:
    """df dealt to all cores before a step that costs far more than moving its rows; a few bytes can be hours of work, so
    the number of partitions is not left to their size."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *by)


def partitions_for(df: DataFrame, rows: int = 500_000) -> int:
    """How many partitions hold about so many rows of df each, the session's number at least: tasks over them don't grow
    with the input. Counts df, so it is meant for a table that is read."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


@dataclass(frozen=True)
class Options:
    """Validated settings of the engine; numbers may come as strings."""

    pagerank_tolerance: float = 0.0001
    damping: float = 0.85
    cluster_identity: float = 0.8
    retrieval_cap: int = 10_000
    page_size: int = 50
    role_prefix: str | None = None
    boost_mode: str = "multiply"
    fuzzy: bool = True

    @classmethod
    def load(cls, values: dict | None = None) -> Options:
        return cls().updated(values or {})

    def updated(self, values: dict) -> Options:
        """A copy with values merged in. Raises ValueError for text that is no number and for numbers out of range."""
        kinds = {"pagerank_tolerance": float, "damping": float, "cluster_identity": float, "retrieval_cap": int, "page_size": int}
        new = replace(self, **{k: kinds[k](v) if k in kinds else v for k, v in values.items() if k in self.__dataclass_fields__})
        if not 0 < new.pagerank_tolerance <= 0.1:
            raise ValueError("pagerank_tolerance must be above 0 and at most 0.1")
        if not 0 < new.cluster_identity <= 1.0:
            raise ValueError("cluster_identity must be above 0 and at most 1")
        if new.boost_mode not in ("multiply", "replace"):
            raise ValueError("boost_mode is multiply or replace")
        return new

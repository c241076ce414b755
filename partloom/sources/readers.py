"""Sources: query results in JSON and XML, FASTA, cluster tables, ontology terms, graphs, and paged endpoints."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from partloom.session import shared_folder

log = logging.getLogger(__name__)

QUADS = "g string, s string, p string, o string, o_kind string"
PARTS = "subject string, displayId string, version string, name string, description string, type string, graph string, role string, sboltype string"
UC = "rec string, cluster_no long, len_or_size long, pct_id string, strand string, c5 string, c6 string, cigar string, query_label string, target_label string"
TERMS = "id string, lbl string, synonyms array<string>"


def read_bindings_json(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    """One row for each binding of a SPARQL JSON result; variables that are not bound are null."""
    cell = "struct<type:string,value:string>"
    schema = f"results struct<bindings:array<struct<{','.join(f'`{v}`:{cell}' for v in variables)}>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("results.bindings").alias("b"))
    return rows.select(*(F.col(f"b.`{v}`.value").alias(v) for v in variables))


def read_bindings_xml(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    """The same for the XML form."""
    schema = "binding array<struct<_name:string,uri:string,literal:string>>"
    rows = spark.read.format("xml").option("rowTag", "result").schema(schema).load(path)
    named = rows.select(F.map_from_entries(F.transform("binding", lambda b: F.struct(b["_name"], F.coalesce(b["uri"], b["literal"])))).alias("m"))
    return named.select(*(F.col("m")[v].alias(v) for v in variables))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """subject (the whole header) and sequence; sequences may be wrapped, and a header may hold any sign, but marks at its start go. Equal headers stay rows of their own."""
    # a record ends where a line begins with the mark, so only a file's first record still has its own
    rows = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    parts = F.split(F.regexp_replace("value", r"^\s*>+", ""), "\n", 2)
    return rows.select(F.trim(F.regexp_replace(parts[0], "\r", "")).alias("subject"), F.regexp_replace(F.coalesce(F.get(parts, 1), F.lit("")), r"\s", "").alias("sequence"))


def read_uc(spark: SparkSession, path: str) -> DataFrame:
    """A UC cluster table, its columns apart by any white space, with a line number: in file order within a split, and
    splits in their order. Raises for lines with fewer columns than the format has; blank lines are none."""
    names = T.StructType.fromDDL(UC)
    fields = F.split(F.trim("value"), r"\s+")
    whole = F.when(F.size(fields) >= len(names), fields).otherwise(F.raise_error(F.concat(F.lit("not a line of a UC table: "), "value")))
    rows = spark.read.text(path).where(F.trim("value") != "").select(whole.alias("f"), F.monotonically_increasing_id().alias("line"))
    return rows.select(*(F.col("f")[k].try_cast(c.dataType).alias(c.name) for k, c in enumerate(names)), "line")


def read_cluster_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines `part cluster` to one row for each cluster with the set of its parts."""
    rows = spark.read.csv(path, sep=" ", schema="part string, cluster string")
    return rows.groupBy("cluster").agg(F.sort_array(F.collect_set("part")).alias("parts"))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TERMS).json(path, multiLine=True)


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, group) and (links: source, target, value) of a force-graph file."""
    whole = spark.read.schema("nodes array<struct<id:string,`group`:int>>, links array<struct<source:string,target:string,value:double>>").json(path, multiLine=True)
    return whole.select(F.inline("nodes")), whole.select(F.inline("links"))


def read_hit_report(spark: SparkSession, path: str) -> DataFrame:
    """uri and score of an aligner's text report: the block after the significance heading, first score of each uri."""
    text = spark.read.text(path, wholetext=True)
    block = F.regexp_extract("value", r"(?s)Sequences producing significant alignments:[^\n]*\n[^\n]*\n(.*?)(?:\n\s*\n|$)", 1)
    rows = text.select(F.posexplode(F.split(block, "\n")).alias("line", "value")).where(F.trim("value") != "")
    fields = F.split(F.trim("value"), r"\s+")
    return rows.select("line", fields[0].alias("uri"), F.element_at(fields, -2).cast("double").alias("score")).groupBy("uri").agg(F.min_by("score", "line").alias("score"))


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or an empty one with the schema where nothing is stored."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _kept(source: Callable[[], DataFrame], path: str) -> DataFrame:
    df = source()
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def federate(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], at_once: int = 4) -> tuple[DataFrame, DataFrame]:
    """(union of all sources without equal rows, failures: source and error).

    Each source is read and stored by itself in the shared folder, several at once, so one that fails while it runs is
    left out as a whole and recorded, and no source is read twice. ValueError if none could be read.
    """
    folder = shared_folder(spark, "sources")

    def read(k: int, source: Callable[[], DataFrame]) -> DataFrame | str:
        try:
            return _kept(source, f"{folder}/{k}")
        except Exception as e:  # noqa: BLE001  one source must not stop the others
            log.warning("source skipped: %s", str(e)[:300])
            return str(e)[:300]

    with ThreadPoolExecutor(at_once) as pool:
        done = dict(zip(sources, pool.map(read, range(len(sources)), sources.values())))
    frames = [df for df in done.values() if isinstance(df, DataFrame)]
    if not frames:
        raise ValueError(f"no source could be read: {done}")
    failures = spark.createDataFrame([(name, x) for name, x in done.items() if isinstance(x, str)], "source string, error string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).dropDuplicates(), failures


def federated(sources: Iterable[Callable[[], DataFrame]]) -> DataFrame:
    """The union of federate() alone; sources are numbered."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("a federated read needs an active session")
    return federate(spark, {str(k): s for k, s in enumerate(sources)})[0]


def endpoint(spark: SparkSession, url: str, query: str, variables: list[str], **options: str) -> DataFrame:
    """All rows of a paged endpoint."""
    spark.dataSource.register(PagedEndpoint)
    return spark.read.format("paged_endpoint").options(url=url, query=query, variables=",".join(variables), **options).load()


def federated_endpoints(spark: SparkSession, local: Callable[[], DataFrame], registry: str, query: str, variables: list[str], **options: str) -> tuple[DataFrame, DataFrame]:
    """The local rows and those of every registered instance, as federate() gives them. A registry that can't be read has
    no instances. Other endpoints have graphs of their own, so FROM lines go."""
    try:
        urls = [r["instanceUrl"] for r in instances(spark, registry).where("instanceUrl is not null").distinct().orderBy("instanceUrl").collect()]  # a registry has tens
    except Exception as e:  # noqa: BLE001
        log.warning("registry not read: %s", str(e)[:300])
        urls = []
    far = {u: (lambda u=u: endpoint(spark, f"{u.rstrip('/')}/sparql", query, variables, graphs="drop", **options)) for u in urls}
    return federate(spark, {"local": local} | far)


def allowed_graphs(asked: Iterable[str], default: str, urls: Iterable[str] = ()) -> list[str]:
    """The graphs of a request: those asked for, or the default one, and the public graph of every federated instance."""
    return list(dict.fromkeys([*(list(asked) or [default]), *(f"{u.rstrip('/')}/public" for u in urls)]))


class _Page(InputPartition):
    def __init__(self, offset: int, rows: int):
        self.offset, self.rows = offset, rows


class PagedEndpoint(DataSource):
    """A query endpoint read page by page, one partition for each page, each fetched where it is processed.

    Reads of one row find how many rows there are, by doubling and then halving, so a read ends with the first page that
    is short. As a stream the offset is the number of rows read; each batch has the pages that have come since.

    Options: url, query, variables (comma-separated), page (10000), rows (at most so many), graphs=drop to remove FROM lines,
    retries of a page (2), timeout in seconds (60).
    """

    @classmethod
    def name(cls) -> str:
        return "paged_endpoint"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(v.strip(), T.StringType()) for v in self.options["variables"].split(",")])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader(schema, dict(self.options))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _PagedStream(schema, dict(self.options))


class _Endpoint:
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.names, self.options = schema.names, options
        self.page = int(options.get("page", 10_000))
        if self.page < 1:
            raise ValueError("a page has one row at least")

    def fetch(self, offset: int, rows: int) -> list[dict]:
        import re
        import time
        import urllib.parse
        import urllib.request

        query = self.options["query"]
        if self.options.get("graphs") == "drop":
            query = re.sub(r"FROM .*\n", "", query)
        at = f"{self.options['url']}?{urllib.parse.urlencode({'query': f'{query} OFFSET {offset} LIMIT {rows}'})}"
        for left in range(int(self.options.get("retries", 2)), -1, -1):
            try:
                with urllib.request.urlopen(urllib.request.Request(at, headers={"Accept": "application/json"}), timeout=float(self.options.get("timeout", 60))) as reply:
                    return json.load(reply)["results"]["bindings"]
            except Exception as e:
                if not left:
                    raise RuntimeError(f"rows {offset} to {offset + rows} of {self.options['url']}: {e}") from e
                time.sleep(0.2)
        return []

    def available(self, known: int = 0) -> int:
        """How many rows there are, if there are `known` at least."""
        most = int(self.options["rows"]) if "rows" in self.options else None
        if most is not None and most <= known:
            return known
        step, low = self.page, known  # rows before low are there
        while self.fetch(low + step - 1, 1):
            low, step = low + step, 2 * step
            if most is not None and low >= most:
                return most
        high = low + step - 1  # no row there
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.fetch(middle, 1) else (low, middle)
        return low if most is None else min(low, most)

    def pages(self, start: int, end: int) -> list[InputPartition]:
        return [_Page(k, min(self.page, end - k)) for k in range(start, end, self.page)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for binding in self.fetch(partition.offset, partition.rows):  # type: ignore[attr-defined]
            yield tuple(binding[n]["value"] if n in binding else None for n in self.names)


class _PagedReader(_Endpoint, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.pages(0, self.available()) or [_Page(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return super().read(partition) if partition.rows else iter(())  # type: ignore[attr-defined]


class _PagedStream(_Endpoint, DataSourceStreamReader):
    _known = 0

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        self._known = self.available(self._known)
        return {"row": self._known}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.pages(start["row"], end["row"])

    def commit(self, end: dict) -> None:
        pass


def instances(spark: SparkSession, path: str) -> DataFrame:
    """The registry of other endpoints: a JSON list with instanceUrl."""
    return read_snapshot_json(spark, path, "instanceUrl string")


def read_snapshot_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def xsd(kind: str) -> Column:
    return F.lit(f"http://www.w3.org/2001/XMLSchema#{kind}")

"""Query text to a request, and a request to a DataFrame. Query text is small, so it is parsed in Python."""

from __future__ import annotations

import logging
import re
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.operators import search as S
from partloom.operators import sequences as Q
from partloom.operators.postings import TextIndex
from partloom.plans.criteria import Criteria, parse_criteria, with_criteria
from partloom.session import Options
from partloom.sources.readers import read_fasta

_FROM = re.compile(r"FROM\s*<([^>]*)>")
#: A keyword, asked for in the display id or another text of a part; it becomes a term of the text search.
_KEYWORD = re.compile(r"CONTAINS\(\s*lcase\(\s*\?(?:displayId|name|description)\s*\)\s*,\s*lcase\(\s*'([^']*)'\s*\)\s*\)", re.I)
# fixed values: how a hub writes flags, and the settings of a search that it may change
_FLAG = re.compile(r"# flag_([\w.]*): (\S*)")
SEARCH_FLAGS = {"maxaccepts": "50", "id": "0.8", "iddef": "2", "maxrejects": "0", "maxseqlength": "5000", "minseqlength": "20"}
ROUTE_FLAGS = ("file_search", "search_exact")
_SEQUENCE = re.compile(r"\?seq\w*\s+\S*elements\s+\"([A-Za-z*.-]+)\"\s*\.?")
_SEQUENCE_OF = re.compile(r"\?subject\s+\S*sequence>?\s+\?seq\w*\s*\.?")


@dataclass(frozen=True)
class SearchFlags:
    """Settings of one sequence search. Each request has its own; nothing stays for the next."""

    identity: float
    accepts: int
    shortest: int
    longest: int
    definition: int = 2
    rejects: int = 0

    @classmethod
    def of(cls, flags: dict[str, str]) -> SearchFlags:
        """The defaults with the known ones of flags; others are not accepted. ValueError for values out of range."""
        values = SEARCH_FLAGS | {k: v for k, v in flags.items() if k in SEARCH_FLAGS}
        if unknown := sorted(k for k in flags if k not in SEARCH_FLAGS and k not in ROUTE_FLAGS):
            logging.getLogger(__name__).warning("flags not accepted: %s", ", ".join(unknown))
        out = cls(float(values["id"]), *(int(values[k]) for k in ("maxaccepts", "minseqlength", "maxseqlength", "iddef", "maxrejects")))
        if not 0 < out.identity <= 1 or out.accepts < 0 or out.rejects < 0 or out.definition not in range(5) or not 0 < out.shortest <= out.longest:
            raise ValueError(f"flags out of range: {values}")
        return out


@dataclass(frozen=True)
class Request:
    keywords: str = ""
    graphs: tuple[str, ...] = ()
    criteria: Criteria = Criteria()
    offset: int = 0
    limit: int = 50
    sequence: str | None = None
    flags: dict[str, str] = field(default_factory=dict)
    similar_to: str | None = None
    uses: str | None = None
    twins: str | None = None
    count: bool = False

    @property
    def path(self) -> str:
        """The first way of answering that fits."""
        if "file_search" in self.flags:
            return "file"
        if self.sequence:
            return "sequence"
        if self.similar_to:
            return "similar"
        if self.uses or self.twins:
            return "related"
        if not self.keywords and not self.criteria:
            return "empty"
        return "criteria" if self.criteria else "keywords"


def parse(text: str, default_graph: str = "public", limit: int = 50) -> Request:
    """Read what a hub sends. Without LIMIT the default page, without OFFSET 0; keywords are joined by a space. ValueError for
    criteria that are not understood."""
    body = text[text.find("{") + 1 : text.rfind("}")] if "{" in text else text
    related = re.compile(r"\b(?:SIMILAR|USES|TWINS)\b\s*\(?\s*<[^>]+>\s*\)?\s*\.?")
    sequence = _SEQUENCE.search(body)
    asked = related.sub(" ", body)
    for form in (_SEQUENCE, _SEQUENCE_OF):
        asked = form.sub(" ", asked)
    prefixes = dict(re.findall(r"PREFIX\s+([\w-]*):\s*<([^>]*)>", text, re.I))
    number = lambda word, default: int(m[1]) if (m := re.search(rf"\b{word}\s+(\d+)", text)) else default
    one = lambda word: m[1] if (m := re.search(rf"\b{word}\b\s*\(?\s*<([^>]+)>", body)) else None
    return Request(
        keywords=" ".join(dict.fromkeys(_KEYWORD.findall(body))).strip(),
        graphs=tuple(dict.fromkeys(_FROM.findall(text))) or (default_graph,),
        criteria=parse_criteria(asked, prefixes, _KEYWORD),
        offset=number("OFFSET", 0),
        limit=number("LIMIT", limit),
        sequence=sequence[1] if sequence else None,
        flags={k: v for k, v in _FLAG.findall(text)},
        similar_to=one("SIMILAR"),
        uses=one("USES"),
        twins=one("TWINS"),
        count=bool(re.search(r"select\s*\(\s*count\(distinct\s*\?subject\)", text, re.I)),
    )


@dataclass(frozen=True)
class Engine:
    """Tables of one repository: index documents, parts, quads, ranks, clusters, sequences and links."""

    documents: DataFrame
    parts: DataFrame
    quads: DataFrame
    ranks: DataFrame
    clusters: DataFrame
    sequences: DataFrame
    links: DataFrame
    options: Options = Options()
    index: TextIndex | None = None  # of the documents; without one they are read for each search

    def _page(self, rows: DataFrame, r: Request) -> DataFrame:
        return rows.agg(F.count("*").alias("n")) if r.count else S.page(rows, r.offset, r.limit)

    def _by_hits(self, hits: DataFrame, r: Request) -> DataFrame:
        rows = S.acl(Q.substring_semi(self.parts, hits), list(r.graphs))
        scored = rows.join(hits.select("subject", F.col("pct_id").alias("_p"), F.col("cigar").alias("CIGAR")), "subject", "left").join(self.ranks, "subject", "left")
        score = F.coalesce("pagerank", F.lit(1.0)) * F.col("_p") / 100
        return self._page(scored.withColumn("order_by", F.when(F.contains(F.coalesce("type", F.lit("")), F.lit(S.SEQUENCE)), score / 10).otherwise(score)).withColumn("percentMatch", F.col("_p") / 100).drop("_p", "pagerank"), r)

    def _criteria(self, subjects: DataFrame, r: Request) -> DataFrame:
        rows = S.acl(self.parts.join(subjects, "subject", "left_semi"), list(r.graphs))
        return self._page(S.criteria_rows(rows, self.ranks, self.options.role_prefix), r)

    def _sequence_hits(self, query: str, flags: dict[str, str]) -> DataFrame:
        if "search_exact" in flags:
            return Q.exact_search(self.sequences, query).select("subject", F.lit(100.0).alias("pct_id"), F.lit(None).cast("string").alias("cigar"))
        f = SearchFlags.of(flags)
        return Q.global_search(self.sequences, query, f.identity, f.accepts, f.shortest, f.longest, f.definition, f.rejects)

    def _terms(self, words: list[str]) -> list[str] | dict[str, list[tuple[str, float]]]:
        """Words as they are, or with their neighbours in the vocabulary."""
        if not self.options.fuzzy or not words:
            return words
        return self.index.near(words) if self.index else S.fuzzy_terms(self.documents, words, list(S.FIELDS))

    @property
    def _scorer(self) -> S.Scorer:
        return self.index.bm25 if self.index else S.bm25

    def search(self, r: Request) -> DataFrame:
        graphs, cap, mode = list(r.graphs), self.options.retrieval_cap, self.options.boost_mode
        words = r.keywords.lower().split()
        if r.path in ("file", "sequence"):
            # a file names its queries, a few sequences; a subject that several of them find counts with the best match
            queries = [r.sequence or ""] if r.path == "sequence" else [x["sequence"] for x in read_fasta(self.sequences.sparkSession, r.flags["file_search"]).collect()]
            found = [self._sequence_hits(q, r.flags) for q in queries if q] or [self._sequence_hits("", r.flags)]
            every = reduce(lambda a, b: a.unionByName(b), found)
            return self._by_hits(every.groupBy("subject").agg(F.max(F.struct("pct_id", "cigar")).alias("m")).select("subject", "m.*"), r)
        if r.path == "similar":
            return self._criteria(S.similar(self.clusters, r.similar_to or ""), r)
        if r.path == "related":
            if r.uses:
                return self._criteria(self.links.where((F.col("child") == r.uses) & (F.col("parent") != r.uses)).select(F.col("parent").alias("subject")), r)
            own = self.sequences.where(F.col("subject") == r.twins).select("sequence")
            return self._criteria(self.sequences.join(own, "sequence", "left_semi").where(F.col("subject") != r.twins).select("subject"), r)
        if r.path == "empty":
            if r.count:
                return self.documents.where(F.col("graph").isin(graphs)).agg(F.count("*").alias("n"))
            return S.demote(S.all_in_graphs(self.documents, graphs, r.offset, r.limit), self.clusters).orderBy(F.desc("order_by"), "subject")
        if r.path == "keywords":
            hits = S.search_text(self.documents, self._terms(words), mode, cap, scorer=self._scorer)
        else:
            allowed = with_criteria(self.documents.select("subject"), self.quads, r.criteria)
            hits = S.search_allowed(self.documents, self._terms(words), allowed, mode, cap, self._scorer) if words else S.allowed_only(self.documents, allowed, cap)
        return self._page(S.demote(S.acl(hits, graphs), self.clusters), r)

    def search_raw(self, words: str) -> DataFrame:
        """Text search as it is: no graphs, no demotion."""
        return S.search_text(self.documents, self._terms(words.lower().split()), self.options.boost_mode, self.options.retrieval_cap, scorer=self._scorer)


class Memo:
    """The last results by query text, kept in memory by Spark.

    With a version (such as the number of a store's last commit) engine is a function that makes an engine; when the version
    is another one, all results go and a new engine is made.
    """

    def __init__(self, engine: Engine | Callable[[], Engine], most: int = 32, version: Callable[[], int] | None = None):
        self.most, self._kept, self._version, self._seen = most, OrderedDict(), version, None
        self._make = engine if version else lambda: engine
        self.engine = None if version else engine

    def search(self, text: str) -> DataFrame:
        if self._version and (now := self._version()) != self._seen:
            self.clear()
            self.engine, self._seen = self._make(), now
        if text not in self._kept:
            self._kept[text] = self.engine.search(parse(text)).cache()
        self._kept.move_to_end(text)
        while len(self._kept) > self.most:
            self._kept.popitem(last=False)[1].unpersist()
        return self._kept[text]

    def clear(self) -> None:
        for df in self._kept.values():
            df.unpersist()
        self._kept.clear()

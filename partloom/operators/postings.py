"""Stored inverted index of text fields: postings, word counts, field totals, and the vocabulary in pieces for fuzzy words.

A posting list is cut by the tasks that read the rows, so a word that every row holds has many short lists and no long one.
Lists are in folders by hash of the word; a search reads the folders of its words. Near words are found by pieces: a word
cut into k + 1 pieces has one that k edits leave whole, so probing a query word's substrings at each piece's place, k either
way, meets every word within k edits; the distance is then computed for those only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from partloom.functions.text import WORDS

# fixed values: boosts of the searched fields, BM25's constants
FIELDS = {"displayId": 3.0, "version": 1.0, "name": 1.0, "description": 1.0, "type": 1.0, "keywords": 1.0}
K1, B = 1.2, 0.75
#: A list of near words has so many at most.
EXPANSIONS = 50
#: Bytes of text that are cut into words at once: some fifteen times as much is held for them.
BYTES_AT_ONCE = 8 << 20

#: A list has three integers for each row: its number less base, the count of the word, and the length of the field. Most
#: words are rare, so a list is as narrow as it can be. Without a term: documents and words of a stretch.
POSTINGS = "term string, field tinyint, base bigint, data array<int>"


def edits_allowed(term: str) -> int:
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def word_characters(spark: SparkSession) -> np.ndarray:
    """For each code point whether Spark's word pattern takes it: asked of Spark, so that both agree on every character."""
    character = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    known = spark.range(0x110000).where("id not between 55296 and 57343").where(F.regexp_like(character, F.lit(f"^{WORDS}$")))
    out = np.zeros(0x110000, bool)
    for first, last in known.select("id", (F.col("id") - F.row_number().over(W.orderBy("id"))).alias("run")).groupBy("run").agg(F.min("id"), F.max("id")).drop("run").collect():
        out[first : last + 1] = True  # some 700 runs
    return out


def words_of(column: pa.Array, word: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of lower-case texts in order, and for each row its first."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if len(data) and data.max() >= 128:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        solid_bytes = np.repeat(word[points], width)
    else:
        solid_bytes = word[data]
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = solid_bytes
    begin, end = solid[1:] & ~solid[:-1], solid[:-1] & ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    both = inner[solid[inner] & solid[inner + 1]]  # a word at the end of one row and one at the start of the next
    begin[both] = end[both] = True
    start, stop = np.flatnonzero(begin), np.flatnonzero(end)
    bounds = np.zeros(len(start) + 1, np.int64)
    np.cumsum(stop - start, out=bounds[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data[solid_bytes].tobytes())])
    return words.dictionary_encode(), np.searchsorted(start, offsets)


def _lists(field: int, rows: np.ndarray, column: pa.Array, word: np.ndarray) -> list[pa.Array]:
    """Posting lists of one field of a stretch of rows, and last its totals, without a term."""
    words, first = words_of(column, word)
    size = np.diff(first)
    n_terms, n_rows = len(words.dictionary), max(len(size), 1)
    cells = np.sort(words.indices.to_numpy().astype(np.int64) * n_rows + np.repeat(np.arange(len(size)), size))
    at = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else np.zeros(0, np.int64)
    counts, cells = np.diff(np.append(at, len(cells))), cells[at]
    row = cells % n_rows
    base = rows.min() if len(rows) else 0
    data = np.append(np.stack([rows[row] - base, counts, size[row]], 1).ravel(), [(size > 0).sum(), size.sum()]).astype(np.int32)
    edges = np.append(3 * np.searchsorted(cells // n_rows, np.arange(n_terms + 1)), len(data)).astype(np.int32)
    names = pa.concat_arrays([words.dictionary.cast(pa.string()), pa.nulls(1, pa.string())])
    return [names, pa.array([field] * (n_terms + 1), pa.int8()), pa.array([base] * (n_terms + 1), pa.int64()), pa.ListArray.from_arrays(pa.array(edges), pa.array(data))]


def stretches(sizes: np.ndarray, numbers: np.ndarray) -> list[tuple[int, int]]:
    """Rows that are cut into words at once, by their bytes; of one file at most, whose numbers differ by less than 32 bits."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // BYTES_AT_ONCE) | np.diff(numbers >> 31)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]))


def bucket_of(column: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(column.cast("binary")), F.lit(buckets)).cast("int")


def piece_bounds(length: int, k: int) -> list[tuple[int, int]]:
    """(place, size) of the k + 1 pieces of a word: as even as can be, longer ones last."""
    m = k + 1
    sizes = [length // m + (i >= m - length % m) for i in range(m)]
    return [(sum(sizes[:i]), sizes[i]) for i in range(m)]


def pieces(words: DataFrame) -> DataFrame:
    """(k, length, no, piece, word) for the edits that a query may need: one for words near 3 to 5 letters, two from 4 on."""
    length = F.length("word")

    def cut(k: int) -> Column:
        m, base, rest = k + 1, F.floor(length / (k + 1)).cast("int"), length % (k + 1)
        place = lambda i: F.lit(i) * base + F.greatest(F.lit(0), F.lit(i - m) + rest)
        size = lambda i: base + (F.lit(i) >= F.lit(m) - rest).cast("int")
        return F.array(*(F.struct(F.lit(k).alias("k"), F.lit(i).alias("no"), F.substring(F.col("word"), place(i) + 1, size(i)).alias("piece")) for i in range(m)))

    none = F.array().cast("array<struct<k:int,no:int,piece:string>>")
    every = F.concat(F.when(length.between(2, 6), cut(1)).otherwise(none), F.when(length >= 4, cut(2)).otherwise(none))
    return words.select("word", F.explode(every).alias("x")).select("x.k", length.alias("length"), "x.no", "x.piece", "word")


def _piece_key() -> Column:
    return F.concat_ws(" ", "k", "length", "no", "piece")


def probes(term: str) -> list[tuple[str, int, int, int, str]]:
    """(term, k, length, no, piece) of every piece that a word within the allowed edits can share with the term."""
    k, out = edits_allowed(term), set()
    for length in range(max(k + 1, len(term) - k), len(term) + k + 1) if k else ():
        for no, (place, size) in enumerate(piece_bounds(length, k)):
            for at in range(max(0, place - k), min(len(term) - size, place + k) + 1):
                out.add((term, k, length, no, term[at : at + size]))
    return sorted(out)


def swaps(term: str) -> list[str]:
    """The term with two neighbours in each other's place."""
    return sorted({s for i in range(len(term) - 1) if (s := term[:i] + term[i + 1] + term[i] + term[i + 2 :]) != term})


def nearest(candidates: DataFrame, terms: list[str], most: int = EXPANSIONS) -> dict[str, list[tuple[str, float]]]:
    """For each term the nearest of its candidate words (term, word) with weight 1 - d / shorter length.

    One neighbouring swap counts as one edit; ties go by the word. One job for all terms; at most `most` words for each
    term come to the driver, as the definition asks.
    """
    wanted = [(t, edits_allowed(t), swaps(t) if edits_allowed(t) else []) for t in dict.fromkeys(terms)]
    given = F.broadcast(candidates.sparkSession.createDataFrame(wanted, "term string, allowed int, swaps array<string>"))
    d = F.when(F.array_contains("swaps", F.col("word")), 1).otherwise(F.levenshtein("word", "term"))
    near = candidates.join(given, "term").select("term", "word", d.alias("d"), "allowed").where("d <= allowed")
    best = near.withColumn("k", F.row_number().over(W.partitionBy("term").orderBy("d", "word"))).where(F.col("k") <= most)
    out: dict[str, list[tuple[str, float]]] = {t: [] for t in dict.fromkeys(terms)}
    for t, w, e in best.orderBy("term", "k").select("term", "word", "d").collect():
        out[t].append((w, 1 - e / min(len(w), len(t))))
    return out


@dataclass(frozen=True)
class TextTables:
    """How the text tables of a store are made."""

    fields: tuple[str, ...] = tuple(FIELDS)
    buckets: int = 64

    def postings(self, rows: DataFrame) -> DataFrame:
        """Posting lists of rows (with their numbers in _row), and for each stretch and field a row of totals."""
        shared = rows.sparkSession.sparkContext.broadcast(np.packbits(word_characters(rows.sparkSession)))  # 140 KB
        fields = self.fields

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            word = np.unpackbits(shared.value).astype(bool)
            for batch in batches:
                sizes = np.maximum(1, sum(np.asarray(pc.binary_length(batch.column(i + 1)).fill_null(0)).astype(np.int64) for i in range(len(fields))))
                for i, j in stretches(sizes, batch.column(0).to_numpy()):
                    if i < j:
                        part = batch.slice(i, j - i)
                        numbers = part.column(0).to_numpy()
                        for k in range(len(fields)):
                            yield from pa.Table.from_arrays(_lists(k, numbers, part.column(k + 1), word), ["term", "field", "base", "data"]).to_batches(max_chunksize=1 << 16)

        lower = [F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f"_f{i}") for i, f in enumerate(fields)]
        return rows.select("_row", *lower).mapInArrow(run, POSTINGS)

    def lists(self, rows: DataFrame) -> DataFrame:
        """Posting lists of new rows as they are stored; a common word's lists are dealt to several tasks."""
        lists = self.postings(rows).withColumn("bucket", bucket_of(F.coalesce("term", F.lit("")), self.buckets))
        return lists.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")

    def counts(self, lists: DataFrame | None, old: DataFrame | None) -> dict[str, tuple[DataFrame, str | None]]:
        """The other tables, and the column of their folders, for stored lists of rows that come and rows that go."""

        def signed(df: DataFrame, sign: int) -> DataFrame:
            n, total = F.when(F.col("term").isNull(), F.col("data")[0]).otherwise(F.size("data") / 3), F.when(F.col("term").isNull(), F.col("data")[1]).otherwise(0)
            return df.select("term", "field", (sign * n.cast("bigint")).alias("n"), (sign * total.cast("bigint")).alias("total"))

        both = reduce(lambda a, b: a.union(b), [signed(df, sign) for df, sign in ((lists, 1), (None if old is None else self.postings(old), -1)) if df is not None])
        terms = both.where("term is not null").groupBy("term", "field").agg(F.sum("n").alias("n")).where("n <> 0").withColumn("bucket", bucket_of(F.col("term"), self.buckets))
        out = {"terms": (terms.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term"), "bucket")}
        out["totals"] = (both.where("term is null").groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), None)
        if lists is not None:
            words = lists.where("term is not null").select(F.col("term").alias("word")).distinct()
            cut = pieces(words).withColumn("bucket", bucket_of(_piece_key(), self.buckets))
            out["pieces"] = (cut.hint("rebalance", "bucket").sortWithinPartitions("bucket", "k", "length", "no", "piece"), "bucket")
        return out


@dataclass(frozen=True)
class TextIndex:
    """The text tables of one commit: reads of them touch the folders of the words asked for."""

    tables: TextTables
    rows: DataFrame
    key: str
    postings: DataFrame
    terms: DataFrame
    totals: DataFrame
    pieces: DataFrame
    changed: bool = False

    def _of(self, table: DataFrame, words: list[str]) -> DataFrame:
        return table.where(F.col("bucket").isin(sorted({zlib.crc32(w.encode()) % self.tables.buckets for w in words})) & F.col("term").isin(words))

    def near(self, terms: list[str], most: int = EXPANSIONS) -> dict[str, list[tuple[str, float]]]:
        """The nearest words of the vocabulary to each term, from the pieces that they can share."""
        spark = self.rows.sparkSession
        asked = [p for t in dict.fromkeys(terms) for p in probes(t)]
        exact = [(t, w) for t in dict.fromkeys(terms) for w in ([t, *swaps(t)] if edits_allowed(t) else [t])]
        found = self._of(self.terms, [w for _, w in exact]).select(F.col("term").alias("word")).join(F.broadcast(spark.createDataFrame(exact, "term string, word string")), "word").select("term", "word")
        if asked:
            folders = sorted({zlib.crc32(f"{k} {length} {no} {piece}".encode()) % self.tables.buckets for _, k, length, no, piece in asked})
            probe = F.broadcast(spark.createDataFrame(asked, "term string, k int, length int, no int, piece string"))  # some 75 a term
            found = found.union(self.pieces.where(F.col("bucket").isin(folders)).join(probe, ["k", "length", "no", "piece"]).select("term", "word"))
        found = found.distinct()
        if self.changed:  # words whose last row has gone
            alive = self.terms.groupBy("term", "field").agg(F.sum("n").alias("n")).where("n > 0").select(F.col("term").alias("word"))
            found = found.join(alive, "word", "left_semi").select("term", "word")
        return nearest(found, terms, most)

    def scores(self, terms: list[str] | dict[str, list[tuple[str, float]]], fields: dict[str, float] | None = None) -> DataFrame:
        """(_commit, _row, q) of rows that any term matches, those of replaced rows included: the largest over fields of
        boost * BM25, and 1 for a key that is a term."""
        fields = fields or FIELDS
        weighted = terms if isinstance(terms, dict) else {t: [(t, 1.0)] for t in terms}
        weight: dict[str, float] = {}
        for alternatives in weighted.values():
            for w, x in alternatives:
                weight[w] = weight.get(w, 0.0) + x
        words, spark = sorted(weight), self.rows.sparkSession
        known = self._of(self.terms, words).groupBy("term", "field").agg(F.sum("n").alias("df")).where("df > 0")
        totals = self.totals.groupBy("field").agg(F.sum("n").alias("docs"), F.sum("total").alias("total"))
        given = spark.createDataFrame(list(weight.items()), "term string, weight double")
        idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        # at most words times fields rows
        facts = known.join(F.broadcast(totals), "field").join(F.broadcast(given), "term").select("term", "field", (F.col("weight") * idf).alias("worth"), (F.col("total") / F.col("docs")).alias("mean"))
        places = [self.tables.fields.index(f) for f in fields]
        hits = self._of(self.postings, words).where(F.col("field").isin(places)).join(F.broadcast(facts), ["term", "field"])
        each = hits.select("_commit", "field", "worth", "mean", "base", "data", F.explode(F.sequence(F.lit(0), F.size("data") - 3, F.lit(3))).alias("i"))
        tf, length = F.col("data")[F.col("i") + 1], F.col("data")[F.col("i") + 2]
        score = F.col("worth") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("mean")))
        each = each.select("_commit", (F.col("base") + F.col("data")[F.col("i")]).alias("_row"), "field", score.alias("s"))
        sums = each.groupBy("_commit", "_row").agg(*(F.sum(F.when(F.col("field") == f, F.col("s"))).alias(f"_{i}") for i, f in enumerate(places)))
        best = [boost * F.col(f"_{i}") for i, boost in enumerate(fields.values())]
        scored = sums.select("_commit", "_row", (F.greatest(*best) if len(best) > 1 else best[0]).alias("q"))
        named = self.rows.where(F.col(self.key).isin(list(weighted))).select("_commit", "_row", F.lit(1.0).alias("q"))
        return scored.unionByName(named).groupBy("_commit", "_row").agg(F.max("q").alias("q")).where("q > 0")

    def bm25(self, docs: DataFrame | None, terms: list[str] | dict[str, list[tuple[str, float]]], fields: dict[str, float] | None = None) -> DataFrame:
        """Live rows that any term matches, with column q; docs is not read, as the index has its own."""
        return self.rows.join(self.scores(terms, fields), ["_commit", "_row"]).drop("_bucket", "_commit", "_row")

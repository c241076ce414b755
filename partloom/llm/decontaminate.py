"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every window of ``window`` words selects the smallest hash of the k-grams in it (k = half the window), so two equal
windows select the same gram at the same place. The selected grams of the documents are joined with those of the
benchmark's windows; each hit is then extended to the whole window and compared word by word, so hashes only propose.
Items shorter than a window are one window of their own length, handled the same way with their own k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import ascii_lower, by_place, materialise, rows_for_broadcast

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Low bits of a packed fingerprint hold the position.
PLACE_BITS = 26
#: Benchmarks of more windows than this (of ten words each, so tens of MB) are joined by a shuffle, not a broadcast.
BROADCAST_WINDOWS = 200_000


def _words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _packed(hashes: Column, size: Column, length: int) -> tuple[Column, Column]:
    """(windows, grams): for every window the smallest gram, hash in the high bits, place in the low ones (so ties go to the left)."""
    k = (length + 1) // 2
    w = length - k + 1
    none = F.expr("cast(array() as array<bigint>)")
    grams = F.transform(
        F.sequence(F.lit(0), size - k),
        lambda i: F.shiftleft(F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]), PLACE_BITS).bitwiseOR(i.cast("bigint")),
    )
    return F.when(size < length, none).otherwise(
        F.transform(F.sequence(F.lit(0), size - length), lambda i: F.least(*[F.get(F.col("_g"), i + j) for j in range(w)]) if w > 1 else F.get(F.col("_g"), i))
    ), F.when(size < length, none).otherwise(grams)


def _with_packed(df: DataFrame, length: int, out: str) -> DataFrame:
    windows, grams = _packed(F.col("_h"), F.col("_n"), length)
    return df.withColumn("_g", grams).withColumn(out, windows).drop("_g")


def _hashed(df: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    return df.select(*keep, _words(F.col(text)).alias("_w")).withColumn("_n", F.size("_w")).withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))


def benchmark_windows(benchmark: DataFrame, window: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row for each different window: length, fp, off (place of the gram in the window), ws (its words), items."""
    items = _hashed(benchmark, text, [F.col(item_id).cast("string").alias("_item")]).where("_n > 0")
    lengths = [r[0] for r in items.select(F.least("_n", F.lit(window)).alias("l")).distinct().collect()]  # at most `window` rows
    parts = []
    for length in sorted(lengths):
        mine = items.where(F.col("_n") >= window) if length == window else items.where(F.col("_n") == length)
        rows = _with_packed(mine, length, "_p").select("_item", "_w", F.posexplode_outer("_p").alias("_t", "_v"))
        place = F.col("_v").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
        parts.append(
            rows.select(
                F.lit(length).alias("length"), F.shiftright("_v", PLACE_BITS).alias("fp"), (place - F.col("_t")).alias("off"), F.slice("_w", F.col("_t") + 1, length).alias("ws"), "_item"
            )
        )
    if not parts:
        spark = benchmark.sparkSession
        return spark.createDataFrame([], "length int, fp bigint, off int, ws array<string>, items array<string>")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("length", "fp", "off", "ws").agg(F.collect_set("_item").alias("items"))


def hits(docs: DataFrame, windows: DataFrame, lengths: list[int], keep: list[Column], text: str = "text", broadcast: bool = True) -> DataFrame:
    """keep columns, _n words and, for each hit window, s, length and items; a row without a hit stands for the document."""
    base = _hashed(docs, text, keep)
    packed = base
    for length in lengths:
        packed = _with_packed(packed, length, f"_p{length}")

    def tagged(length: int) -> Column:
        return F.transform(F.array_distinct(f"_p{length}"), lambda v: F.struct(F.lit(length).alias("length"), v.alias("v")))

    per_length = [tagged(n) for n in lengths]
    marker = F.array(F.struct(F.lit(None).cast("int").alias("length"), F.lit(None).cast("bigint").alias("v")))
    names = [c for c in base.columns if c not in ("_w", "_n", "_h")]
    # explode_outer, as the filter that the optimizer infers for explode would compute the array again for every element;
    # the array is made before it: with a plain column there, explode, join and comparison are one generated loop
    # that passes the words on by reference instead of copying them for every fingerprint
    rows = packed.withColumn("_e", F.concat(marker, *per_length)).select(*names, "_n", "_w", F.explode_outer("_e").alias("_x")).select(
        *names, "_n", "_w", F.col("_x.length").alias("_l"), F.shiftright("_x.v", PLACE_BITS).alias("_fp"), F.col("_x.v").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int").alias("_at")
    )
    start = F.col("_at") - F.col("off")
    same = (start >= 0) & (start + F.col("length") <= F.col("_n")) & (F.slice("_w", F.greatest(start, F.lit(0)) + 1, F.col("length")) == F.col("ws"))
    found = [*names, "_n", start.alias("s"), "length", "items"]
    if broadcast:
        joined = rows.join(F.broadcast(windows), (F.col("_fp") == F.col("fp")) & (F.col("_l") == F.col("length")) & same, "left")
        return joined.where(F.col("_l").isNull() | F.col("items").isNotNull()).select(*found)
    # without a broadcast the words stay behind: only proposals meet them again, by row
    key = [c for c in names if c == "_row"]
    slim = rows.drop("_w").join(windows, (F.col("_fp") == F.col("fp")) & (F.col("_l") == F.col("length"))).select(*key, "_at", "off", "length", "ws", "items")
    checked = base.drop("_h").join(slim, key).where(same).select(*found)
    none = F.lit(None)
    return checked.unionByName(base.select(*names, "_n", none.cast("int").alias("s"), none.cast("int").alias("length"), none.cast("array<string>").alias("items")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row for each input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (the hit word ranges) and text_hash.

    Nulls: a null text has no words; a null doc_id stays null and is a document of its own. Empty text: zero words, no
    hit. Empty benchmark: nothing is hit. Repeated rows: each is answered by itself. Repeated items with one id count
    once. Very long texts: up to 2**26 words a text. Other columns of docs are ignored, whatever their names.
    """
    windows = benchmark_windows(benchmark, window, item_id, text)
    # the benchmark is read once more for each use; it is small beside the corpus
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())
    small = rows_for_broadcast(windows, broadcast_windows)
    # rows are told apart by a number where one job does all, and by their content where they are read again
    row = F.monotonically_increasing_id() if small else F.xxhash64(F.col(doc_id).cast("string"), F.lit(0), F.col(text))
    keep = [row.alias("_row"), F.col(doc_id).alias("_doc"), F.col(text).alias("_text")]
    rows = hits(docs.select(*keep), windows, lengths, [F.col("_row"), F.col("_doc"), F.xxhash64("_text").alias("_th")], "_text", small)
    span = F.when(F.col("s").isNotNull(), F.struct("s", (F.col("s") + F.col("length")).alias("e")))
    grouped = rows.groupBy("_row", "_doc").agg(
        F.first("_n").cast("bigint").alias("n_words"), F.first("_th").alias("text_hash"), F.array_sort(F.collect_set(span)).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_items")
    )
    merged = F.aggregate(
        "_spans",
        F.expr("cast(array() as array<struct<s:int,e:int>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["s"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e"))))).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))),
    )
    out = grouped.withColumn("spans", merged)
    if not small:  # rows that repeat id and text were one so far
        out = docs.select(row.alias("_again")).join(out, F.col("_again") == F.col("_row")).drop("_again")
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + (x["e"] - x["s"]))
    return out.select(
        F.col("_doc").alias(doc_id), "n_words", hit.alias("n_hit"), F.size("_items").cast("bigint").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"), "spans", "text_hash"
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of docs, all columns as they are, that no benchmark window hits."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    bad = decontaminate(slim, benchmark).where("contaminated").select(F.col("doc_id").alias("_bad"), F.col("text_hash").alias("_hash")).distinct()
    bad = materialise(bad, "contaminated")
    if rows_for_broadcast(bad, broadcast_rows):
        bad = F.broadcast(bad)
    rows, names = by_place(docs)
    own, body = (F.col(rows.columns[names.index(c)]) for c in (doc_id, text))
    return rows.join(bad, own.eqNullSafe(F.col("_bad")) & (F.xxhash64(body) == F.col("_hash")), "left_anti").toDF(*names)

"""The stored index: same results as without it, changes in buckets, and writers that meet."""

import random
import re
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from partloom.operators import postings, search
from partloom.operators.postings import FIELDS, TextTables
from partloom.plans import domain as D
from partloom.sources.store import CommitConflict, IndexStore

DOC = ", ".join(f"{f} string" for f in ("subject", *FIELDS)) + ", pagerank double, graph string"


def documents(spark, rows):
    """(subject, name, description) as index documents."""
    return spark.createDataFrame([(s, s.replace("/", "_"), "1", n, d, "T", None, 1.0 + i, "g") for i, (s, n, d) in enumerate(rows)], DOC)


def scored(hits):
    return {r["subject"]: round(r["q"], 9) for r in hits.select("subject", "q").collect()}


def store_of(spark, path, rows, **more):
    store = IndexStore(spark, str(path), text=TextTables(buckets=4), buckets=4, **more)
    store.publish(rows)
    return store


AWKWARD = [("a/1", "Promoter gfp", "GFP gfp_x Ünïcode ΣΑΣ wörds"), ("a/2", None, None), ("a/3", "", "  "), ("a/4", "gfp", "the " * 3000), ("a/5", "İstanbul ２３ 漢字", "one\ttwo—three"), ("a/6", "gpf", "gfps promoters")]


@pytest.mark.parametrize("terms", [["gfp"], ["gfp", "promoter", "nothing"], ["a/4", "two"], ["ünïcode", "漢字", "２３", "σας"], ["a_1"]])
def test_same_scores_as_without_an_index(spark, tmp_path, terms):
    docs = documents(spark, AWKWARD)
    index = store_of(spark, tmp_path / "i", docs).index()
    assert scored(index.bm25(docs, terms)) == scored(search.bm25(docs, terms))
    some = dict.fromkeys(["name", "description"], 1.0)
    assert scored(index.bm25(docs, terms, some)) == scored(search.bm25(docs, terms, some))


def test_rows_of_many_files_in_one_batch(spark, tmp_path):
    docs = documents(spark, [(f"s/{i}", f"name{i % 5}", "gfp " * (i % 3)) for i in range(200)]).repartition(40).withColumn("_row", F.monotonically_increasing_id())
    docs.write.parquet(str(tmp_path / "rows"))
    one = spark.read.parquet(str(tmp_path / "rows")).coalesce(1)
    lists = TextTables().postings(one).where("term is not null").collect()
    numbers = {r["_row"] for r in one.collect()}
    assert {r["base"] + r["data"][i] for r in lists for i in range(0, len(r["data"]), 3)} == numbers and len({n >> 33 for n in numbers}) > 1


def test_same_results_on_the_whole_table(spark, data, tmp_path):
    docs = D.documents(spark, data)
    index = store_of(spark, tmp_path / "i", docs).index()
    words = ["onenth", "reerea", "the", "qu"]
    assert index.near(words) == search.fuzzy_terms(docs, words, list(FIELDS))
    fuzzy = index.near(words)
    assert any(w != t for t, near in fuzzy.items() for w, _ in near)
    want = search.search_text(docs, fuzzy).select("subject", "score").collect()
    got = search.search_text(None, fuzzy, scorer=index.bm25).select("subject", "score").collect()
    assert want == got and len(got) > 50


def test_words_are_those_of_the_pattern(spark):
    word = postings.word_characters(spark)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab_1 é漢ß-٣²\ń\U0001F600\U00010400") for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", "x", "y"]
    given = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = [r[0] for r in given.orderBy("i").select(F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).collect()]
    words, first = postings.words_of(pa.array(texts, pa.string()), word)
    flat = [w.decode() for w in words.to_pylist()]
    assert [flat[a:b] for a, b in zip(first[:-1], first[1:])] == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_pieces_meet_every_near_word(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(1500)})
    table = spark.createDataFrame([(w,) for w in words], "word string")
    cut = {}
    for r in postings.pieces(table).collect():
        cut.setdefault((r["k"], r["length"], r["no"], r["piece"]), set()).add(r["word"])
    for w in words:  # the pieces of a word make it up
        for k in (1, 2):
            own = sorted((key[2], key[3]) for key, who in cut.items() if key[0] == k and key[1] == len(w) and w in who)
            assert not own or "".join(p for _, p in own) == w
    for t in rng.sample(words, 60) + ["abcabcabcab"]:
        k = postings.edits_allowed(t)
        found = {t, *postings.swaps(t)}.union(*(cut.get(p[1:], set()) for p in postings.probes(t)))
        assert {w for w in words if distance(w, t) <= k} <= found


def test_search_reads_the_folders_of_its_words(spark, tmp_path):
    index = store_of(spark, tmp_path / "i", documents(spark, AWKWARD)).index()
    plan = index.scores(["gfp"])._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in re.findall(r"FileScan parquet [^\n]*", plan) if "term" in x]
    assert len(scans) >= 2 and all("PartitionFilters: [bucket" in x or "bucket#" in x.split("PartitionFilters:")[1].split("PushedFilters")[0] for x in scans)


def test_changes_change_the_index(spark, tmp_path):
    store = store_of(spark, tmp_path / "i", documents(spark, AWKWARD))
    store.upsert(documents(spark, [("a/4", "gfp", "now short"), ("b/1", "gfq", "a new part")]))
    store.delete(spark.createDataFrame([("a/1",)], "subject string"))
    store.change(add=documents(spark, [("a/5", "rfp", "again")]), remove=spark.createDataFrame([("a/5",), ("none",)], "subject string"))
    now = store.current()
    assert {r["subject"] for r in now.collect()} == {"a/2", "a/3", "a/4", "a/5", "a/6", "b/1"}
    index = store.index()
    for terms in (["gfp"], ["gfq", "the", "again"], ["promoter"]):
        assert scored(index.bm25(None, terms)) == scored(search.bm25(now, terms))
    words = ["gfp", "promoter", "again", "wörds"]
    assert index.near(words) == search.fuzzy_terms(now, words, list(FIELDS))
    assert store.lookup(["a/4", "none"]).select("name").collect()[0][0] == "gfp"
    store.compact()
    assert len(store.head()[1]) == 1
    assert scored(store.index().bm25(None, ["gfp"])) == scored(search.bm25(now, ["gfp"])) and store.compact() == store.head()[0]


def files(path):
    return {p for p in path.rglob("part-*.parquet")}


def test_one_row_writes_one_bucket(spark, tmp_path):
    rows = spark.range(500).select(F.concat(F.lit("s"), "id").alias("subject"), F.lit("x").alias("name"))
    store = IndexStore(spark, str(tmp_path / "i"))
    store.publish(rows)
    before = files(tmp_path)
    store.upsert(rows.where("subject = 's7'").withColumn("name", F.lit("y")))
    new = files(tmp_path) - before
    assert len([p for p in new if "/rows/" in str(p)]) == 1 and len({p.parent for p in new if "/rows/" in str(p)}) == 1
    assert store.current().count() == 500 and store.lookup(["s7"]).first()["name"] == "y"


def test_two_writers_that_meet(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "i"))
    rows = spark.createDataFrame([("a", "1"), ("b", "1")], "subject string, name string")
    store.publish(rows)
    number, segments = store.head()
    store.upsert(rows.where("subject = 'a'").withColumn("name", F.lit("2")))
    with pytest.raises(CommitConflict):  # started from the same state as the one before
        store._commit(number + 1, segments)
    assert {tuple(r) for r in store.current().collect()} == {("a", "2"), ("b", "1")}
    done, failed, gate = [], [], threading.Barrier(3)

    def write(k):
        own = IndexStore(spark, str(tmp_path / "i"))
        head = own.head()
        own.head = lambda: head  # all start from one state
        gate.wait()
        try:
            done.append((k, own.upsert(spark.createDataFrame([("a", f"w{k}")], "subject string, name string"))))
        except CommitConflict:
            failed.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(done) == 1 and len(failed) == 2
    assert store.lookup(["a"]).first()["name"] == f"w{done[0][0]}" and store.current().count() == 2


def test_empty_index(spark, tmp_path):
    store = store_of(spark, tmp_path / "i", documents(spark, AWKWARD).limit(0))
    assert store.index().bm25(None, ["gfp"]).count() == 0 and store.index().near(["gfp"]) == {"gfp": []}
    store.upsert(documents(spark, AWKWARD))
    assert scored(store.index().bm25(None, ["gfp"])) == scored(search.bm25(documents(spark, AWKWARD), ["gfp"]))
    with pytest.raises(ValueError):
        IndexStore(spark, str(tmp_path / "none")).current()


def test_words_are_cut_in_small_stretches():
    """A batch of 10,000 rows of 2,500 bytes was one stretch, and a worker held some 700 MB for it."""
    import numpy as np

    from partloom.operators.postings import stretches

    sizes = np.full(10_000, 2500)
    got = stretches(sizes, np.arange(10_000))
    assert [i for i, _ in got] == [0, *(j for _, j in got[:-1])] and got[-1][1] == 10_000
    assert max(sizes[i:j].sum() for i, j in got) <= (8 << 20) + 2500
    assert stretches(np.full(3, 9 << 20), np.arange(3)) == [(0, 1), (1, 2), (2, 3)]
    assert stretches(np.ones(4, int), np.array([0, 1, 1 << 33, (1 << 33) + 1])) == [(0, 2), (2, 4)]

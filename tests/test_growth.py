"""Work that must grow with the rows: large clusters, few shuffles, pairs by blocks."""

from pyspark.sql import functions as F

from partloom.operators import sequences
from partloom.queries import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_neighbours_are_counted_once_for_a_cluster(spark, data):
    rows = spark.range(30_000).select(F.lit(7).alias("cluster_id"), F.col("id").cast("string").alias("subject")).union(spark.createDataFrame([(8, "x")], "cluster_id int, subject string"))
    got = {r[0]: r[1] for r in sequences.neighbour_counts(rows).groupBy("others").count().collect()}
    assert got == {29_999: 30_000, 0: 1}
    assert "collect_set" not in plan_of(QUERIES["uc_cluster_neighbours"](spark, data))


def test_block_pairs_don_t_depend_on_blocks(spark):
    """Frequent words in every sequence: nothing is joined by word, and any size of blocks gives the same pairs."""
    from partloom.operators.blocks import near_pairs

    rows = [(f"s{i:03d}", "gattaca" * 6 + "".join("gatc"[(i // 3 * j * j + j // 5) % 4] for j in range(90)) + "acgt"[i % 3]) for i in range(90)]
    table = spark.createDataFrame(rows, "subject string, sequence string")
    grams = {s: {x[i : i + 8] for i in range(len(x) - 7)} for s, x in rows}
    want = {(a, b, len(grams[a] & grams[b]), len(grams[a]), len(grams[b])) for a in grams for b in grams if a < b and 1 - len(grams[a] & grams[b]) / len(grams[a] | grams[b]) <= 0.5}
    assert len(want) > 80
    for letters in (700, 10_000_000):
        got = near_pairs(table, 8, 0.5, letters)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
        assert "Join" not in plan_of(got)


def test_pagerank_passes_over_lists_of_bounded_length(spark, monkeypatch):
    """A node with many targets, and repeated edges, whatever the length of lists."""
    from partloom.operators import graph

    nodes = spark.range(40).select(F.concat(F.lit("n"), "id").alias("id"))
    rows = [("n0", f"n{i}") for i in range(1, 40)] + [(f"n{i}", "n0") for i in range(1, 30)] + [("n1", "n2")] * 25 + [("n1", "unknown")]
    edges = spark.createDataFrame(rows, "src string, dst string")

    def ranks(multi):
        return {r[0]: r[1] for r in graph.pagerank(nodes, edges, iterations=3, multi=multi).collect()}

    def plain(multi):
        e = [x for x in (rows if multi else dict.fromkeys(rows)) if x[1] != "unknown"]
        out = {x: sum(a == x for a, _ in e) for x in (f"n{i}" for i in range(40))}
        r = dict.fromkeys(out, 1 / 40)
        for _ in range(3):
            new = {x: 0.15 / 40 + 0.85 * sum(r[y] for y in out if not out[y]) / 40 for x in out}
            for a, b in e:
                new[b] += 0.85 * r[a] / out[a]
            r = {x: v / sum(new.values()) for x, v in new.items()}
        return r

    for size in (3, 1024):
        monkeypatch.setattr(graph, "LIST", size)
        for multi in (False, True):
            got, want = ranks(multi), plain(multi)
            assert got.keys() == want.keys() and max(abs(got[x] - want[x]) for x in want) < 1e-12


def test_either_end_reads_the_pairs_once(spark):
    from partloom.operators import graph

    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "d"), (None, "a"), ("d", "e")], "parent string, child string")
    quads = spark.createDataFrame([("a", "role", "x"), ("a", "role", "x"), ("c", "role", "x"), ("d", "role", "y")], "s string, p string, o string")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = graph.either_end(pairs.mapInArrow(count, "parent string, child string"), quads, [("role", "x")])
    assert sorted((r[0] or "", r[1]) for r in got.collect()) == [("", "a"), ("a", "b"), ("b", "c"), ("c", "d")] and seen.value == 6


def test_edges_are_dealt_into_partitions_that_grow_with_the_lines(spark, data, monkeypatch):
    from partloom import session
    from partloom.plans import domain

    assert session.partitions_for(spark.range(4_100), 100) == 41 and session.partitions_for(spark.range(3), 100) == 4
    few = sorted(map(tuple, QUERIES["outdegree_dangling"](spark, data).collect()))
    monkeypatch.setattr(domain, "partitions_for", lambda df: session.partitions_for(df, 400))
    df, n = QUERIES["outdegree_dangling"](spark, data), -(-domain.table(spark, data, "lineitem").count() // 400)
    plan = plan_of(df)
    assert n > 4 and all(f"{n}" in line for line in plan.splitlines() if "RepartitionByExpression" in line) and plan.count("RepartitionByExpression") == 4
    assert sorted(map(tuple, df.collect())) == few and any(k == 0 for _, k in few)


def test_containment_moves_steps_a_bounded_number_of_times(spark, data):
    """Against the plain definition, with loops, repeated and broken statements; shuffles are counted without broadcasts."""
    from partloom.operators import graph

    def plain(rows, ends=None):
        a = set(rows)
        join = lambda x: {(p, d) for p, c in x for c2, d in a if c == c2 and c is not None}
        out = a | join(a) | join(join(a))
        return {(p, c) for p, c in out if ends is None or (p in ends and c in ends)}

    rows = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g"), ("g", "g"), ("h", None), ("b", "h"), (None, "a"), (None, None)]
    steps, ends = spark.createDataFrame(rows, "parent string, child string"), {"a", "c", "d", "f", "g"}
    as_set = lambda df: [tuple(r) for r in df.collect()]
    got = as_set(graph.containment(steps))
    assert len(got) == len(set(got)) and set(got) == plain(rows)
    quads = [(p, "component", f"{p}>{c}") for p, c in rows if p and c] + [(f"{p}>{c}", "definition", c) for p, c in rows if p and c] + [(x, "type", "ComponentDefinition") for x in ends] + [("a", "component", None), (None, "definition", "a")]
    got = as_set(graph.component_pairs(spark.createDataFrame(quads * 2, "s string, p string, o string")))
    assert len(got) == len(set(got)) and set(got) == plain(rows, ends)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        df = QUERIES["component_containment"](spark, data)
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set(key, before)
    moved = [line for line in final.splitlines() if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]
    assert len(moved) <= 12, final

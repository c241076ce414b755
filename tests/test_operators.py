import json

import pytest
from pyspark.sql import functions as F

from partloom.functions import text as X
from partloom.operators import enrich, evaluate, graph, search, sequences
from partloom.plans.query import Engine, Memo, SearchFlags, parse
from partloom.plans.rebuild import rebuild
from partloom.session import Options
from partloom.sources import readers, writers
from partloom.sources.store import IndexStore
from partloom.streaming import updates


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


def ranks(spark, edges, **kw):
    nodes = spark.createDataFrame([(x,) for x in "ABCD"], "id string")
    return {r["id"]: round(r["rank"], 6) for r in graph.pagerank(nodes, spark.createDataFrame(edges, "src string, dst string"), **kw).collect()}


EDGES = [("A", "B"), ("A", "C"), ("B", "C"), ("C", "A")]


def test_pagerank_golden(spark):
    assert ranks(spark, EDGES) == {"A": 0.369311, "B": 0.20458, "C": 0.37849, "D": 0.047619}


def test_pagerank_with_loops_and_unknown_ends(spark):
    got = ranks(spark, EDGES + [(x, x) for x in "ABCD"] + [("A", "nowhere"), ("ghost", "B")])
    assert got == {"A": 0.243159, "B": 0.185042, "C": 0.3218, "D": 0.25}


def test_pagerank_empty(spark):
    assert graph.pagerank(spark.createDataFrame([], "id string"), spark.createDataFrame([], "src string, dst string")).count() == 0


def test_demotion_golden(spark):
    hits = spark.createDataFrame([("a", 10.0, "x"), ("b", 8.0, "x"), ("c", 6.0, "#Sequence"), ("d", 5.0, "x")], "subject string, score double, type string")
    clusters = spark.createDataFrame([("a", 1), ("b", 1), ("d", 1), ("c", 2)], "subject string, cluster_id long")
    got = lambda h: {r["subject"]: r["order_by"] for r in search.demote(h, clusters).collect()}
    assert got(hits) == {"a": 10.0, "b": 4.0, "c": 0.6, "d": 2.5}
    assert got(hits.where("subject <> 'a'")) == {"b": 8.0, "c": 0.6, "d": 2.5}


def test_scalar_functions(spark):
    assert one(spark, X.display_keywords(F.lit("BBa_K_1"))) == "BBa K 1"
    assert one(spark, X.display_keywords(F.lit(None).cast("string"))) == ""
    assert one(spark, X.term_id(F.lit("http://identifiers.org/so/SO:0000167"))) == "SO_0000167"
    assert one(spark, X.term_id(F.lit("http://else"))) is None
    assert one(spark, X.type_suffix(F.lit("x" * 48 + "DnaRegion"))) == "DnaRegion"
    assert one(spark, X.type_suffix(F.lit("x" * 48 + "DnaregionRegion"))) == "Dnaregion"
    assert one(spark, X.normalise_sequence(F.lit("GATnC-t"))) == "gatct"
    assert one(spark, X.kgrams(F.lit("abcabc"))) == ["abc", "bca", "cab"]
    empty = F.array().cast("array<string>")
    assert one(spark, X.jaccard_distance(empty, empty)) == 1.0
    assert one(spark, X.clean_query(F.lit(" a&b'c "))) == "a bc"


def test_role_gate(spark):
    rows = spark.createDataFrame([("a", None), ("b", "http://own.example.org/x"), ("c", "http://identifiers.org/so/SO:1")], "subject string, role string")
    assert {r[0] for r in search.role_gate(rows, "own.example.org").collect()} == {"a", "b"}


def test_rank_defaults_to_one(spark):
    got = enrich.add_rank(spark.createDataFrame([("a",), ("b",)], "subject string"), spark.createDataFrame([("a", 0.2)], "subject string, pagerank double"))
    assert {tuple(r) for r in got.collect()} == {("a", 0.2), ("b", 1.0)}


def test_optional_fan_out_and_winner(spark):
    q = spark.createDataFrame([("g", "s", p, o, "uri") for p, o in (("type", "T"), ("topLevel", "s"), ("role", "r1"), ("role", "r2"))] + [("g", "t", "type", "T", "uri"), ("g", "t", "topLevel", "t", "uri")], readers.QUADS)
    p = graph.parts(q, {"role": "role", "name": "title", "description": "d", "version": "v", "sboltype": "b"}, indexing=True)
    assert {(r["subject"], r["role"]) for r in p.collect()} == {("s", "r1"), ("s", "r2"), ("t", None)}
    assert {(r["subject"], r["role"]) for r in graph.one_row_each(p).collect()} == {("s", "r1"), ("t", None)}


def test_upper_median(spark):
    got = evaluate.summary(spark.createDataFrame([(1, "a", x) for x in (0, 1, 2, 3, -1)], "query_id int, child string, position long")).first()
    assert (got["total"], got["found"], got["average"], got["upper_median"]) == (5, 4, 1.5, 2)


def test_uc_golden(spark, tmp_path):
    (tmp_path / "x.uc").write_text("S\t0\t9\t*\t*\t*\t*\t*\tp1\t*\nH\t0\t9\t98.5\t+\t0\t0\t10M\tp2\tp1\nS\t1\t9\t*\t*\t*\t*\t*\tp3\t*\n")
    uc = readers.read_uc(spark, str(tmp_path / "x.uc"))
    assert tuple(sequences.uc_summary(uc).first()) == (3, 1, 98.5)
    assert {r["subject"]: r["others"] for r in sequences.cluster_neighbours(sequences.uc_clusters(uc)).collect()} == {"p1": ["p2"], "p2": ["p1"], "p3": []}
    assert [r[0] for r in sequences.uc_targets(uc).collect()] == ["p1"]
    assert {tuple(r) for r in writers.uc_assignments(uc).collect()} == {("p1", 0), ("p2", 0), ("p3", 1)}


def test_fasta_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "gatc"), ("b x", "tt")], "subject string, sequence string")
    writers.write_fasta(rows, str(tmp_path / "f"))
    assert {tuple(r) for r in readers.read_fasta(spark, str(tmp_path / "f")).collect()} == {("a", "gatc"), ("b x", "tt")}
    (tmp_path / "w.fsa").write_text(">one\nGAT\nTACA\n>two\nC\n")
    assert {tuple(r) for r in readers.read_fasta(spark, str(tmp_path / "w.fsa")).collect()} == {("one", "GATTACA"), ("two", "C")}


def test_bindings(spark, tmp_path):
    doc = {"results": {"bindings": [{"subject": {"type": "uri", "value": "s"}, "role": {"type": "uri", "value": "r"}}, {"subject": {"type": "uri", "value": "t"}}]}}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    assert [tuple(r) for r in readers.read_bindings_json(spark, str(tmp_path / "r.json"), ["subject", "role"]).collect()] == [("s", "r"), ("t", None)]
    (tmp_path / "r.xml").write_text('<sparql><results><result><binding name="subject"><uri>s</uri></binding><binding name="name"><literal>n</literal></binding></result></results></sparql>')
    assert [tuple(r) for r in readers.read_bindings_xml(spark, str(tmp_path / "r.xml"), ["subject", "name", "role"]).collect()] == [("s", "n", None)]


def test_hit_report_and_graph(spark, tmp_path):
    (tmp_path / "r.txt").write_text("head\nSequences producing significant alignments:  (Bits)  Value\n\nuri1  some text  700  0.0\nuri2  30.1  2.0\nuri1  9  1.0\n\nrest\n")
    assert {tuple(r) for r in readers.read_hit_report(spark, str(tmp_path / "r.txt")).collect()} == {("uri1", 700.0), ("uri2", 30.1)}
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a", "group": 1}], "links": [{"source": "a", "target": "a", "value": 2}]}))
    nodes, links = readers.read_graph_json(spark, str(tmp_path / "g.json"))
    assert nodes.count() == links.count() == 1


def test_index_store(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    assert not store.exists()
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "subject string, v int")
    store.publish(rows)
    store.upsert(spark.createDataFrame([("b", 3), ("c", 4)], "subject string, v int"))
    store.delete(spark.createDataFrame([("a",)], "subject string"))
    assert {tuple(r) for r in store.current().collect()} == {("b", 3), ("c", 4)}


def test_subject_bytes(spark):
    rows = spark.createDataFrame([("x" * 512,), ("ä" * 256 + "y",)], "subject string")
    fits, skipped = writers.split_by_size(rows)
    assert fits.count() == 1 and skipped.count() == 1


def test_response_cells(spark):
    row = spark.createDataFrame([("s", "n", -1.0, 2.5)], "subject string, name string, percentMatch double, order_by double")
    got = json.loads(writers.response(row).first()[0])
    assert got["subject"]["type"] == "uri" and got["name"]["type"] == "literal" and "percentMatch" not in got and got["order_by"] == 2.5
    assert json.loads(writers.count_response(row).first()[0])["value"] == "1"


def test_updates(spark):
    index = spark.createDataFrame([("a", "old", 1.0, "k"), ("b", "old", 1.0, "k")], "subject string, displayId string, pagerank double, keywords string")
    none = spark.createDataFrame([], "subject string, pagerank double")
    part = "struct<subject:string,displayId:string>"
    changes = spark.createDataFrame([("remove", "a", 1, None), ("add", "a", 2, ("a", "new_1")), ("add", "c", 1, ("c", "x"))], f"op string, subject string, seq int, part {part}")
    got = {r["subject"]: (r["displayId"], r["keywords"]) for r in updates.apply_changes(index, changes, none).collect()}
    assert got == {"a": ("new_1", "new 1"), "b": ("old", "k"), "c": ("x", "x")}
    twice = spark.createDataFrame([("a", "r1"), ("a", "r2")], "subject string, displayId string")
    assert {r[0] for r in updates.refresh(index, twice, "a", none).select("subject").collect()} == {"b"}
    assert updates.refresh(index, twice, "a", none, strict=False).count() == 3


def test_stream_of_changes(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    store.publish(spark.createDataFrame([("a", "d", 1.0, "k")], "subject string, displayId string, pagerank double, keywords string"))
    schema = "op string, subject string, seq int, part struct<subject:string,displayId:string>"
    spark.createDataFrame([("add", "b", 1, ("b", "y_z")), ("remove", "a", 1, None)], schema).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).json(str(tmp_path / "in"))
    updates.stream_changes(stream, store, spark.createDataFrame([], "subject string, pagerank double"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert [(r["subject"], r["keywords"]) for r in store.current().collect()] == [("b", "y z")]


def test_options():
    assert Options.load({"pagerank_tolerance": "0.1"}).pagerank_tolerance == 0.1
    for bad in ({"pagerank_tolerance": "0"}, {"pagerank_tolerance": "0.2"}, {"cluster_identity": "1.8"}, {"cluster_identity": "x"}):
        with pytest.raises(ValueError):
            Options.load(bad)


@pytest.mark.parametrize(
    ("text", "path"),
    [
        ("select ?subject where { }", "empty"),
        ("where { FILTER (CONTAINS(lcase(?displayId), lcase('gfp'))) }", "keywords"),
        ("where { ?subject role <http://r> . }", "criteria"),
        ("where { SIMILAR <http://s> }", "similar"),
        ("where { USES <http://s> }", "related"),
        ('where { ?seq sbol:elements "gatc" }', "sequence"),
        ("# flag_file_search: /tmp/x.fsa\nwhere { }", "file"),
        ("# file_search: /tmp/x.fsa\nwhere { }", "empty"),
    ],
)
def test_routes(text, path):
    assert parse(text).path == path


HUB = """SELECT DISTINCT ?subject ?displayId ?version ?name ?description ?type
FROM <http://hub/public> FROM <http://hub/user/a>
WHERE { %s ?subject a ?type . ?subject sbh:topLevel ?subject . }
LIMIT 50 OFFSET 0"""


def engine(spark, **options):
    parts = [("s/a", "alpha", "1", "Alpha", "green protein", "Component", "http://hub/public", None, None), ("s/b", "beta", "1", "Beta", "red protien", "Component", "http://hub/public", None, None), ("s/c", "gamma", "1", "Gamma", "green light", "Component", "http://hub/user/b", None, None)]
    columns = "subject string, displayId string, version string, name string, description string, type string, graph string, role string, sboltype string"
    p = spark.createDataFrame(parts, columns)
    docs = p.selectExpr("*", "0.5D as pagerank", "displayId as keywords")
    sequences_ = spark.createDataFrame([("s/a", "gattacagattacagattacagattaca"), ("s/b", "gattacagattacagattacagattacc"), ("s/c", "ccccccccccccccccccccccccccccc")], "subject string, sequence string")
    empty = lambda ddl: spark.createDataFrame([], ddl)
    return Engine(docs, p, empty(readers.QUADS), empty("subject string, pagerank double"), empty("subject string, cluster_id long"), sequences_, empty("parent string, child string"), Options(**options))


def test_flags_of_a_hub():
    r = parse("# flag_file_search: /tmp/q.fsa\n# flag_id: 0.9\n# flag_maxaccepts: 7\n# flag_other: x\n" + HUB % "")
    assert r.path == "file" and r.flags == {"file_search": "/tmp/q.fsa", "id": "0.9", "maxaccepts": "7", "other": "x"} and r.graphs == ("http://hub/public", "http://hub/user/a")
    f = SearchFlags.of(r.flags)
    assert (f.identity, f.accepts, f.shortest, f.longest) == (0.9, 7, 20, 5000)
    assert SearchFlags.of({}).identity == 0.8  # nothing stays from the request before
    for bad in ({"id": "2"}, {"iddef": "5"}, {"maxrejects": "-1"}, {"maxaccepts": "many"}, {"minseqlength": "30", "maxseqlength": "20"}):
        with pytest.raises(ValueError):
            SearchFlags.of(bad)


def test_sequence_routes(spark, tmp_path):
    path = tmp_path / "q.fsa"
    path.write_text(">sequence_to_search\ngattacagattacag\nattacagattaca\n>other\ncccccccccccccccccccccccc\n")
    e = engine(spark)
    got = {r["subject"]: r for r in e.search(parse(f"# flag_file_search: {path}\n" + HUB % "")).collect()}
    assert set(got) == {"s/a", "s/b"} and got["s/a"]["percentMatch"] == 1.0  # s/c is in a graph that is not asked for
    sequence = HUB % '?subject sbol2:sequence ?seq . ?seq sbol2:elements "GATTACAGATTACAGATTACAGATTACA" .'
    assert [r["subject"] for r in e.search(parse("# flag_search_exact: True\n" + sequence)).collect()] == ["s/a"]
    assert {r["subject"] for r in e.search(parse("# flag_id: 0.99\n" + sequence)).collect()} == {"s/a"}


def test_keyword_routes_are_fuzzy(spark):
    words = HUB % "FILTER (CONTAINS(lcase(?displayId), lcase('protein')) || CONTAINS(lcase(?name), lcase('protein'))) ."
    asked = parse(words)
    assert asked.path == "keywords"
    assert {r["subject"] for r in engine(spark).search(asked).collect()} == {"s/a", "s/b"}
    assert {r["subject"] for r in engine(spark, fuzzy=False).search(asked).collect()} == {"s/a"}
    memo = Memo(engine(spark), most=1)
    first = memo.search(words)
    assert memo.search(words) is first and len(memo._kept) == 1
    memo.search(HUB % "")
    assert len(memo._kept) == 1 and memo.search(words) is not first
    memo.clear()
    assert not memo._kept


def test_patterns_over_components(spark):
    T, C, D_ = "type", "component", "definition"
    rows = [("a", T, "ComponentDefinition"), ("b", T, "ComponentDefinition"), ("c", T, "ComponentDefinition"), ("d", T, "Other"), ("a", C, "a1"), ("a1", D_, "b"), ("a", C, "a2"), ("a2", D_, "b"), ("b", C, "b1"), ("b1", D_, "c"), ("c", C, "c1"), ("c1", D_, "d"), ("a", "wasDerivedFrom", "x"), ("a", "wasDerivedFrom", "y"), ("d", "wasDerivedFrom", "x"), ("c", "role", "R"), ("a", "sequence", "q"), ("d", "sequence", "q"), ("b", "sequence", "r"), ("q", T, "Sequence"), ("q", "elements", "gatc"), ("r", "elements", "cc")]
    q = spark.createDataFrame([("g", s, p, o, "uri") for s, p, o in rows], readers.QUADS)
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(graph.sequence_chain(q)) == {("a", "gatc")}
    assert as_set(graph.component_usage(q)) == {("a", "x", "b"), ("a", "y", "b")}
    pairs = graph.component_pairs(q)
    assert as_set(pairs) == {("a", "b"), ("b", "c"), ("a", "c")}
    assert as_set(graph.either_end(pairs, q, [("role", "R")])) == {("b", "c"), ("a", "c")}


def test_pagerank_that_does_not_settle(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    with pytest.raises(RuntimeError):
        graph.pagerank(nodes, spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "a")], "src string, dst string"), tolerance=1e-12, most=2)


def test_parse_defaults():
    r = parse("FROM <g1> FROM <g2> where { FILTER (CONTAINS(lcase(?displayId), lcase('a')) || CONTAINS(lcase(?displayId), lcase('b'))) }")
    assert (r.limit, r.offset, r.keywords, r.graphs) == (50, 0, "a b", ("g1", "g2"))
    assert parse("where { } LIMIT 7 OFFSET 3").limit == 7


def test_alignment():
    assert sequences.align("gattaca", "gattaca") == (1.0, "7M")
    identity, cigar = sequences.align("gattacagattaca", "gattagattaca")
    assert identity == 12 / 14 and "2D" in cigar
    assert sequences.align("", "a") == (0.0, "")


def test_substring_semi_keeps_longer_numbers(spark):
    parts = spark.createDataFrame([("/x/1",), ("/x/10",), ("/y/1",)], "subject string")
    assert {r[0] for r in sequences.substring_semi(parts, parts.where("subject = '/x/1'")).collect()} == {"/x/1", "/x/10"}


def test_rebuild(spark, tmp_path):
    q = spark.createDataFrame([("g", s, p, o, "uri") for s, p, o in (("a", "type", "T"), ("a", "topLevel", "a"), ("b", "type", "T"), ("b", "topLevel", "b"), ("a", "uses", "b"), ("a", "displayId", "A_1"))], readers.QUADS)
    store = IndexStore(spark, str(tmp_path / "index"))
    optional = {"displayId": "displayId", "version": "version", "name": "title", "description": "description", "role": "role", "sboltype": "biotype"}
    terms = spark.createDataFrame([], readers.TERMS)
    got = rebuild(q, optional, terms, store)
    assert got == {"parts": 2, "skipped": 0, "edges": 3, "dropped": 0, "commit": 0}
    rows = {r["subject"]: r for r in store.current().collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["keywords"] == "A 1" and abs(sum(r["pagerank"] for r in rows.values()) - 1) < 1e-9
    assert store.table("ranks").count() == 2 and {r["step"] for r in store.table("stamps").collect()} == {"ranks", "index"}


def test_rebuild_with_clusters_from_the_statements(spark, tmp_path):
    base = "gattacacctgattgcatgcaatcggatctagctagcatcgatcagctacgatcagcatcagcat" * 2
    rows = [("a", "type", "ComponentDefinition"), ("b", "type", "ComponentDefinition"), ("c" * 600, "type", "ComponentDefinition")]
    rows += [(s, "topLevel", s) for s, _, _ in rows[:3]]
    rows += [(s, "sequence", f"q{s[0]}") for s in ("a", "b")] + [(f"q{s}", "type", "Sequence") for s in "ab"] + [("qa", "elements", base), ("qb", "elements", base[:100] + "g" + base[101:])]
    q = spark.createDataFrame([("g", *r, "uri") for r in rows], readers.QUADS)
    optional = {"displayId": "displayId", "version": "version", "name": "title", "description": "description", "role": "role", "sboltype": "biotype"}
    store = IndexStore(spark, str(tmp_path / "index"))
    terms = spark.createDataFrame([], readers.TERMS)
    got = rebuild(q, optional, terms, store, skip_clustering=False)
    assert (got["parts"], got["skipped"]) == (3, 1) and store.current().count() == 2
    clusters = {r["subject"]: r["cluster_id"] for r in store.table("clusters").collect()}
    assert set(clusters) == {"a", "b"} and len(set(clusters.values())) == 1
    made = []
    memo = Memo(lambda: made.append(1) or engine(spark), version=lambda: store.head()[0])
    first = memo.search(HUB % "")
    assert memo.search(HUB % "") is first and len(made) == 1
    rebuild(q, optional, terms, store)
    assert memo.search(HUB % "") is not first and len(made) == 2


def test_edges_that_are_dropped_are_counted(spark):
    from pyspark.sql import Observation

    seen = Observation("e")
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    graph.pagerank(nodes, spark.createDataFrame([("a", "b"), ("a", "x"), ("y", "z")], "src string, dst string"), iterations=1, dropped=seen)
    assert seen.get == {"edges": 3, "dropped": 2}

"""Endpoints on a local server, federated reads that fail, and files as they come."""

import json
import re
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.errors import PySparkException

from partloom.sources import readers, writers


class Hub:
    """An endpoint with rows, which counts requests and can fail."""

    def __init__(self, rows):
        self.rows, self.asked, self.bad, self.flaky, self.queries = rows, [], set(), set(), []
        hub = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                if self.path == "/registry":
                    return self.reply(json.dumps(hub.registry))
                query = urllib.parse.parse_qs(urllib.parse.urlsplit(self.path).query)["query"][0]
                offset, limit = int(re.search(r"OFFSET (\d+)", query)[1]), int(re.search(r"LIMIT (\d+)", query)[1])
                hub.asked.append((offset, limit))
                hub.queries.append(query)
                if offset in hub.flaky:
                    hub.flaky.discard(offset)
                    return self.send_error(503)
                if limit > 1 and offset in hub.bad:
                    return self.send_error(500)
                found = [{"a": {"type": "literal", "value": x}} if x else {} for x in hub.rows[offset : offset + limit]]
                self.reply(json.dumps({"results": {"bindings": found}}))

            def reply(self, text):
                self.send_response(200)
                self.end_headers()
                self.wfile.write(text.encode())

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


@pytest.fixture
def hub():
    h = Hub([f"r{i}" for i in range(25)])
    yield h
    h.server.shutdown()


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 25, 40, 130])
def test_pages_until_a_short_one(spark, hub, n):
    hub.rows = [f"r{i}" for i in range(n)]
    df = readers.endpoint(spark, hub.url, "SELECT ?a\nFROM <g>\nWHERE {}", ["a", "b"], page="10", graphs="drop")
    assert sorted((r["a"], r["b"]) for r in df.collect()) == sorted((f"r{i}", None) for i in range(n))
    pages = sorted({x for x in hub.asked if x[1] != 1 or n % 10 == 1 and x[0] == n - 1})
    assert [o for o, k in pages if k > 1 or o == n - 1] == list(range(0, n, 10)) and "FROM" not in hub.queries[0]
    assert len([x for x in hub.asked if x[1] == 1]) < 30


def test_a_bound_of_rows_and_values_that_are_not_bound(spark, hub):
    hub.rows[3] = None
    got = readers.endpoint(spark, hub.url, "Q", ["a"], page="4", rows="10").collect()
    assert len(got) == 10 and sum(r["a"] is None for r in got) == 1


def test_pages_that_fail(spark, hub):
    hub.flaky = {10}
    assert readers.endpoint(spark, hub.url, "Q", ["a"], page="10").count() == 25  # tried again
    hub.bad = {10}
    with pytest.raises(PySparkException, match="rows 10 to 20"):
        readers.endpoint(spark, hub.url, "Q", ["a"], page="10", retries="0").collect()


def test_stream_of_pages(spark, hub, tmp_path):
    spark.dataSource.register(readers.PagedEndpoint)
    seen = []

    def run():
        stream = spark.readStream.format("paged_endpoint").options(url=hub.url, query="Q", variables="a", page="10").load()
        q = stream.writeStream.foreachBatch(lambda df, k: seen.append(sorted(r["a"] for r in df.collect()))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    assert sum(seen, []) == sorted(f"r{i}" for i in range(25))
    seen.clear()
    run()  # nothing new
    assert sum(seen, []) == []
    hub.rows += ["s1", "s2"]
    run()
    assert sum(seen, []) == ["s1", "s2"]


def test_sources_that_fail_while_they_run(spark):
    good = spark.createDataFrame([("a", 1), ("a", 1)], "s string, n int")
    late = good.selectExpr("s", "cast(raise_error('late') as int) as n")
    got, failures = readers.federate(spark, {"good": lambda: good, "late": lambda: late, "no plan": lambda: spark.read.parquet("/no/such"), "more": lambda: good.selectExpr("'b' as s")})
    assert {tuple(r) for r in got.collect()} == {("a", 1), ("b", None)}
    assert {r["source"] for r in failures.collect()} == {"late", "no plan"} and "late" in failures.where("source = 'late'").first()["error"]
    assert readers.federated([lambda: late, lambda: good]).count() == 1
    with pytest.raises(ValueError):
        readers.federate(spark, {"late": lambda: late})


def test_registered_endpoints(spark, hub, tmp_path):
    other = Hub(["x", "r1"])
    broken = Hub(["y"])
    broken.bad = {0}
    broken.rows = ["y", "z"]
    (tmp_path / "registry.json").write_text(json.dumps([{"instanceUrl": other.url}, {"instanceUrl": broken.url + "/"}, {"name": "none"}]))
    local = spark.createDataFrame([("r1",), ("r2",)], "a string")
    got, failures = readers.federated_endpoints(spark, lambda: local, str(tmp_path / "registry.json"), "Q", ["a"], retries="0")
    assert {r["a"] for r in got.collect()} == {"r1", "r2", "x"} and [r["source"] for r in failures.collect()] == [broken.url + "/"]
    alone, none = readers.federated_endpoints(spark, lambda: local, str(tmp_path / "nothing.json"), "Q", ["a"])
    assert alone.count() == 2 and none.count() == 0
    assert readers.allowed_graphs([], "http://h/public", [other.url, broken.url + "/"]) == ["http://h/public", f"{other.url}/public", f"{broken.url}/public"]
    assert readers.allowed_graphs(["g", "g"], "d") == ["g"]
    other.server.shutdown()
    broken.server.shutdown()


def test_fasta_with_marks_in_headers(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 a->b promoter\nACG\nTAC\n\n>s2\n>s3 >x\r\nAC\r\n")
    (tmp_path / "b.fa").write_text("\n>s1 a->b promoter\nTT")
    got = sorted(tuple(r) for r in readers.read_fasta(spark, str(tmp_path / "*.fa")).collect())
    assert got == [("s1 a->b promoter", "ACGTAC"), ("s1 a->b promoter", "TT"), ("s2", ""), ("s3 >x", "AC")]


def test_fasta_round_trip(spark, tmp_path):
    rows = [("x>y", "acgt"), ("z", ""), ("> odd", "ac")]
    writers.write_fasta(spark.createDataFrame(rows, "subject string, sequence string"), str(tmp_path / "out"))
    assert sorted(tuple(r) for r in readers.read_fasta(spark, str(tmp_path / "out")).collect()) == [("odd", "ac"), ("x>y", "acgt"), ("z", "")]


def test_uc_columns_by_any_white_space(spark, tmp_path):
    (tmp_path / "t.uc").write_text("S\t0\t30\t*\t*\t*\t*\t*\tq1\t*\n\nH 0  28 97.5 + 0 0 28M q2 q1\n")
    got = readers.read_uc(spark, str(tmp_path / "t.uc")).orderBy("line").collect()
    assert [(r["rec"], r["cluster_no"], r["pct_id"], r["query_label"], r["target_label"]) for r in got] == [("S", 0, "*", "q1", "*"), ("H", 0, "97.5", "q2", "q1")]
    (tmp_path / "bad.uc").write_text("H 0 28\n")
    with pytest.raises(PySparkException, match="not a line of a UC table"):
        readers.read_uc(spark, str(tmp_path / "bad.uc")).collect()


def test_files_of_clusters_and_terms(spark, tmp_path):
    clusters = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "subject string, cluster_id long")
    writers.write_clusters(clusters, str(tmp_path / "c"))
    assert {(r["cluster"], tuple(r["parts"])) for r in readers.read_cluster_text(spark, str(tmp_path / "c")).collect()} == {("1", ("a", "b")), ("2", ("c",))}
    (tmp_path / "terms.json").write_text(json.dumps([{"id": "t", "lbl": "x", "synonyms": ["y"]}, {"id": "u"}]))
    assert {(r["id"], r["lbl"], tuple(r["synonyms"] or ())) for r in readers.read_terms(spark, str(tmp_path / "terms.json")).collect()} == {("t", "x", ("y",)), ("u", None, ())}
    assert readers.read_snapshot(spark, str(tmp_path / "none"), "a int").count() == 0
    clusters.write.parquet(str(tmp_path / "stored"))
    assert readers.read_snapshot(spark, str(tmp_path / "stored"), "subject string, cluster_id long").count() == 3
    grams = spark.createDataFrame([("a", ["x", "y"])], "subject string, grams array<string>")
    writers.write_grams(grams, str(tmp_path / "g"))
    assert spark.read.text(str(tmp_path / "g")).first()[0] == "a x y"


def test_envelope(spark):
    page = spark.createDataFrame([("b", "Bee", 1.0), ("a", None, 2.0)], "subject string, name string, order_by double")
    got = json.loads(writers.envelope(page).first()[0])
    assert got["head"] == {"vars": ["subject", "name"]} and [b["subject"]["value"] for b in got["results"]["bindings"]] == ["a", "b"]
    assert "name" not in got["results"]["bindings"][0] and got["results"]["bindings"][1]["name"]["value"] == "Bee"
    assert json.loads(writers.envelope(page.limit(0)).first()[0])["results"]["bindings"] == []

"""Texts made so that hashes collide, and texts that repeat themselves without end."""

import resource
import time

import numpy as np
import pytest

from partloom.llm import substring
from partloom.llm.chat import format_chat
from partloom.llm.jaccard import jaccard_components
from partloom.llm.quality import numbered, quality_rules, stats, windows
from partloom.llm.segments import Units
from partloom.llm.substring import substring_dedup


def thue_morse(n):
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a


A = thue_morse(4096)
B = A.translate(str.maketrans("ab", "ba"))  # the same polynomial hash modulo 2**64, whatever the base


def chunk(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))


def test_lines_and_words_that_collide(spark):
    texts = [f"{A}\n{B}", f"{A} x y z q {B} x y z q m n", f"{A}\n{A}", f"{A} x y z q {A} x y z q m n"]
    got = stats(*chunk(texts), distinct=True)
    assert got["n_dup_lines"].tolist() == [0, 0, 1, 0] and got["n_repeat_words"].tolist() == [0, 0, 0, 10] and got["n_distinct_words"].tolist() == [2, 8, 1, 7]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in quality_rules(docs, docs.limit(0).select("doc_id")).collect()}
    assert not rows[1]["base_failed"] and rows[3]["base_failed"]


def test_documents_that_collide(spark):
    docs = spark.createDataFrame([(1, "x y z"), (2, A), (3, B), (4, A.upper()), (5, f"p q {A} r s"), (6, f"p q {B} r s")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 2, 5: 5, 6: 6}


def test_windows_are_numbered_by_content():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, 400)
    for k in (1, 2, 3, 5, 8):
        got, seen = windows(x, k), {}
        for i in range(len(x) - k + 1):
            assert seen.setdefault(int(got[i]), tuple(x[i : i + k])) == tuple(x[i : i + k])
        assert len(seen) == len({tuple(x[i : i + k]) for i in range(len(x) - k + 1)})
    assert numbered(np.frombuffer(b"abcabx", np.uint8), np.array([2, 1, 2, 0, 1, 0])).tolist() == [0, 1, 0, 2, 3, 2]


def test_a_million_equal_words():
    n = 1_000_000
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    codes = np.zeros(2 * n + 1, np.int64)
    found = substring.search(Units(True, 50, 8))(codes, np.array([0, n, 2 * n + 1]), np.zeros(2, np.int64), np.array([1, 2]), np.ones(2, np.int64))
    assert len(found) == n + 1 - 49 and found[0] == n and time.time() - began < 60
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000


@pytest.mark.parametrize("tries", ["a few", "many"])
def test_longest_match_among_many_places(tries, monkeypatch):
    if tries == "many":
        monkeypatch.setattr(substring, "PLACES", 3)
    rng = np.random.default_rng(2)
    for period in (1, 2, 5):
        a = np.arange(300) % period
        b = np.arange(260) % period
        a[rng.integers(0, 300, 4)], b[rng.integers(0, 260, 3)] = 7, 7
        index = substring.Index(np.concatenate([a, b]), np.array([0, 300, 560]), np.zeros(2, np.int64), np.array([1, 2]), Units(True, 10, 3))
        for p in range(index.begin[1], index.end[1] - 3):
            places = index.places(p)
            if len(places):
                want = max(next(n for n in range(400) if index.text[p + n] != index.text[q + n]) for q in places.tolist())
                assert index.longest(p) == index._longest_of_many(p, places) == want


def test_repetitive_documents(spark):
    texts = [(1, "0 " * 40_000), (2, "0 " * 40_001 + "end"), (3, "0 1 " * 20_000), (4, "1 0 " * 20_000)]
    rows = {r["doc_id"]: r for r in substring_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [rows[k]["_n_removed"] for k in (1, 2, 3, 4)] == [0, 40_001, 0, 40_000]


def test_conversations_with_text_ids(spark):
    rows = [("a-1", "0", "user", "User: hi"), ("a-1", "1", "assistant", "Assistant: hello"), (None, "x", "user", "alone"), ("7", None, "user", None)]
    got = format_chat(spark.createDataFrame(rows, "conv_id string, turn string, role string, text string"))
    assert dict(got.dtypes)["conv_id"] == "string" and sorted((r["conv_id"] or "", r["turn"], r["given_role"]) for r in got.collect()) == [("", 0, "user"), ("7", 0, "user"), ("a-1", 0, "user"), ("a-1", 1, "assistant")]
    numbers = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id int, turn int, role string, text string")
    assert dict(format_chat(numbers).dtypes)["conv_id"] == "bigint"


def test_units_held_from_other_chunks_have_no_effect_on_samples(monkeypatch):
    """Held units are built once, whatever else is held, and two units under one hash are built apart."""
    import numpy as np

    from partloom.llm import sentencepiece_sampling as S

    pieces, rng = S.load_pieces(), np.random.default_rng(3)
    words = ["".join(chr(97 + x) for x in rng.integers(0, 5, rng.integers(1, 9))) for _ in range(300)] + ["naïve", "日本", "\t", "🙂🙂"]
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), n)).encode() for n in (0, 1, 2, 40, 300, 3, 900, 0, 77)]
    chunks = [texts[i : i + 3] for i in range(0, 9, 3)] * 3

    def samples(met, **options):
        out = []
        for no, chunk in enumerate(chunks):
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in chunk])])
            got = S.encode_chunk(np.frombuffer(b"".join(chunk), np.uint8), offsets, np.arange(3) + no, pieces, 3, met=met, **options)
            out.append([(s[0].tolist(), *s[1:]) for row in got for s in row])
        return out

    want, built = samples(None), []
    init = S.Lattice.__init__
    monkeypatch.setattr(S.Lattice, "__init__", lambda self, data, offsets, pieces: (built.append(len(data)), init(self, data, offsets, pieces))[1])
    assert samples(S.Met(pieces)) == want and sum(built) == sum(map(len, {u for x in texts for u in units(x, S)}))
    assert samples(S.Met(pieces, 700)) == want and samples(S.Met(pieces), range_bytes=500) == want
    monkeypatch.setattr(S, "EDGES_AT_ONCE", 50)
    assert [[s[0] for s in x] for x in samples(S.Met(pieces))] == [[s[0] for s in x] for x in want]
    monkeypatch.setattr(S, "EDGES_AT_ONCE", 1 << 18)
    spans = S.WORD_ROLLER.spans
    monkeypatch.setattr(S.WORD_ROLLER, "spans", lambda *x: spans(*x) % np.uint64(5))
    assert samples(S.Met(pieces)) == want


def units(text, S):
    import numpy as np

    data, starts, _ = S.units_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]), S.UNIT_BYTES)
    ends = [*starts[1:].tolist(), len(data)]
    return [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends)]


def test_workers_hold_little_of_pieces_units_and_past_tasks():
    """The trie of the model, 1 MB of held units, what a task leaves behind, and paths of one long text beyond the text."""
    import subprocess
    import sys
    from pathlib import Path

    script = """
import numpy as np
import pyarrow as pa
from partloom.llm import common
from partloom.llm import sentencepiece_sampling as S

def peak(what):
    return next(int(x.split()[1]) >> 10 for x in open("/proc/self/status") if x.startswith(what))  # of this process alone

pieces, rng = S.load_pieces(), np.random.default_rng(1)
assert sum(x.nbytes for x in vars(pieces).values() if isinstance(x, np.ndarray)) < 4 << 20
for no in range(256):  # the trie has every piece once
    assert pieces.data[pieces.start[pieces.byte_ids[no]]] == no
texts = [" ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 7)) for _ in range(120000)).encode()]
met = S.Met(pieces, 1 << 20)
S.encode_chunk(np.frombuffer(texts[0][:900_000], np.uint8), np.array([0, 900_000]), np.array([1]), pieces, met=met)
assert met.lattice.nodes > 800_000 and sum(x.nbytes for x in vars(met.lattice).values() if isinstance(x, np.ndarray)) < 80 * met.lattice.nodes
del met

def run(batches):
    held = [np.ones(1 << 16, np.uint8) for _ in range(1600)]  # 100 MB in small arrays
    common.WORD_ROLLER.prefix(common.BYTE_CODES[np.zeros(4_000_000, np.uint8)])
    yield from batches
before = peak("VmRSS")
assert list(common.lean(run)(iter([1, 2]))) == [1, 2]
assert peak("VmRSS") < before + 20 and len(common.WORD_ROLLER.up) == 1, (before, peak("VmRSS"))

text = np.frombuffer((texts[0] + b" ") * 16, np.uint8)[:15_000_000]
before = peak("VmRSS")
(got,) = S.encode_chunk(text, np.array([0, len(text)]), np.array([5]), pieces)
assert all(pieces.decode(s[0]) == text.tobytes() for s in got)
print(peak("VmHWM") - before, sum(len(s[0]) for s in got))
"""
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", script], env={"PYTHONPATH": root, "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    more, edges = map(int, done.stdout.split())
    assert more < 200 + 30 * edges / 1e6, (more, edges)

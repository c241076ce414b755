"""Hard negatives, token counts and the divergence audit against brute force or the library, and on awkward tables."""

import math
import random
import re
import time
from collections import Counter as Bag
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from partloom.llm import divergence, negatives, token_counts
from partloom.llm.common import chunks
from partloom.llm.divergence import divergence_audit, shares
from partloom.llm.negatives import hard_negatives
from partloom.llm.token_counts import LONG, MODEL, Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# 11 ---------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, place string, a int, score string"  # the last three clash with inner names


def brute_negatives(rows):
    whole = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((i, [math.floor(256 * x) if abs(x) < 1e300 else 256 * int(x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for k, (i, v, label) in enumerate(whole):
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, same == label) for m, (j, w, same) in enumerate(whole) if m != k)
        for s, j, _ in [x for x in scored if x[2]][:5]:
            inside = [(-t, h) for t, h, alike in scored if not alike and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, j, r + 1, h, -s, t) for r, (t, h) in enumerate(inside)]
    return sorted(out)


def vectors(n=400, wide=6, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(0.3, 1, wide).round(2).tolist(), int(rng.integers(4))) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS)


@pytest.mark.parametrize("block", [64, 16384])
def test_hard_negatives(spark, block):
    base = vectors()
    odd = [(None, [1.0] * 6, 1), (450, None, 1), (451, [1.0] * 6, None), (452, [1.0, None, 1.0], 1), (453, [float("nan")] * 6, 1), (454, [float("inf")] * 6, 1)]
    odd += [(500, [], 1), (550, [2.0, 1.0], 1), base[50], base[50], (100, [9.0] * 6, 3), (600, [0.0] * 6, 0)]
    odd += [(700 + k, [1.0] * 6, k % 2) for k in range(60)]  # ties
    got = [tuple(r) for r in hard_negatives(table(spark, base + odd), block_rows=block).collect()]
    want = brute_negatives(base + odd)
    assert len(want) > 50 and sorted(got) == want


def test_hard_negatives_beyond_exact_doubles(spark):
    rows = [(i, [x * 2.0**20 for x in v], label) for i, v, label in vectors(120, 3)]
    got = [tuple(r) for r in hard_negatives(table(spark, rows), block_rows=40).collect()]
    assert got and sorted(got) == brute_negatives(rows)
    huge = [(i, [1e308, -1e308, float(i)], i % 3) for i in range(60)]
    hard_negatives(table(spark, huge)).collect()


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives(table(spark, [])).count() == 0
    assert hard_negatives(table(spark, [(1, [1.0], 1), (2, [1.0], 2)])).count() == 0
    assert hard_negatives(table(spark, [(50, [1.0], 1), (51, [0.9], 2)])).count() == 0


def test_scores_sorted_in_blocks(monkeypatch):
    monkeypatch.setattr(negatives, "SCORES_AT_ONCE", 10)
    rng = np.random.default_rng(2)
    a, r, ids = rng.integers(-9, 9, (7, 4)).astype(float), rng.integers(-9, 9, (30, 4)).astype(float), rng.permutation(30)
    s = negatives.Scores(a, r, ids)
    for k, score, at in s.ordered(np.arange(7), np.arange(30)):
        assert [(-x, ids[s.by_id[p]]) for x, p in zip(score, at)] == sorted((-int(a[k] @ r[j]), ids[j]) for j in range(30))


# 12 ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def counter():
    return Counter(open(MODEL, encoding="utf-8").read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(MODEL)


def counted(counter, texts):
    return [n for _, _, data, offsets in chunks(pa.array(texts, pa.string()), 4096) for n in counter.count(data, offsets).tolist()]


def by_library(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_counts_of_odd_texts(counter, library):
    rng = random.Random(3)
    parts = [*"abcdest'' 1239!?-\n\t  ÉéÅİΣσςßñ中文字漢ㄱ가각각̧́Å  ​٣½Ⅷǅ😀\x00\x85�নিা", "'re", "'ll", "'ve", "'S", "ing", "the ", "<|endoftext|>", "<|startoftext|>", "<|endof"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(6000)] + [None, "", " ", "'", "''s", "'s's", "don't're", "<|endoftext|>" * 3]
    assert counted(counter, texts) == by_library(library, texts)


def test_token_counts_of_every_kind_of_character(counter, library):
    rng = random.Random(4)
    texts = [f"{chr(c)}a{chr(c)}" for c in rng.sample([*range(0xD800), *range(0xE000, 0x30000)], 8000)]
    assert counted(counter, texts) == by_library(library, texts)


@pytest.mark.parametrize("long", [0, 3, LONG])
def test_long_pre_tokens_by_rank(counter, library, monkeypatch, long):
    monkeypatch.setattr(token_counts, "LONG", long)
    rng = random.Random(5)
    texts = ["a" * n for n in range(1, 40)] + ["".join(rng.choices("abeinrst", k=rng.randint(2, 300))) for _ in range(200)]
    texts += ["a" * 5000, "".join(chr(rng.randint(0x4E00, 0x4FFF)) for _ in range(3000))]
    assert counted(counter, texts) == by_library(library, texts)


def test_long_pre_tokens_in_time(counter):
    rng = random.Random(6)
    began = time.time()
    counted(counter, ["a" * 1_000_000, "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(400_000))])
    assert time.time() - began < 60


def test_token_counts_cut_long_texts_at_spaces(spark, library, monkeypatch):
    text = "It's a <|endoftext|> wörd, 12 don't " * 50
    data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
    parts, rows = token_counts._cut_long(data, offsets, 100)
    c = Counter(open(MODEL, encoding="utf-8").read())
    assert len(rows) > 5 and sum(int(c.count(data[i:j], np.array([0, j - i]))[0]) for i, j in zip(parts[:-1], parts[1:])) == by_library(library, [text])[0]
    solid = np.frombuffer(b"x" * 500, np.uint8)
    assert len(token_counts._cut_long(solid, np.array([0, 500]), 100)[1]) == 1


def test_token_counts_table(spark, data, library):
    given = [(0, None), (1, ""), (2, "Hello, World's"), (2, "Hello, World's"), (None, "x"), (3, "so " * 2048), (4, "so " * 2049)]
    docs = spark.createDataFrame([(i, t, 5, "b") for i, t in given], "doc_id long, text string, n_tokens int, n_bytes string")
    got = sorted(map(repr, map(tuple, token_counts.token_counts(docs).collect())))
    assert got == sorted(repr((i, len((t or "").encode()), n, n > 2048)) for (i, t), n in zip(given, by_library(library, [t for _, t in given])))
    assert token_counts.token_counts(docs.limit(0)).count() == 0
    table = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    want = dict(zip(texts, by_library(library, list(texts.values()))))
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(table).collect()} == want


def test_merges_that_are_out_of_order_are_refused():
    of = token_counts.byte_characters()
    ids = {c: k for k, c in enumerate([*of, *(c + "$" for c in of), "abc", "ab"])}
    with pytest.raises(ValueError):
        token_counts.Merges(ids, [("ab", "c"), ("a", "b")], "$")


# 13 ---------------------------------------------------------------------------------------------------------------


def brute_audit(rows, min_docs=10):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Bag(w for d in own for w in set(d[2]))
        kept = sorted((w for w, n in df.items() if n >= min_docs), key=lambda w: w.encode())
        n = defaultdict(Bag)
        for _, source, words in own:
            n[source].update(w for w in words if df[w] >= min_docs)
        share = lambda bag: [1 + 10**9 * (bag[w] + 2) // (sum(bag.values()) + 2 * len(kept)) for w in kept]
        p, q = {s: share(b) for s, b in n.items()}, share(sum(n.values(), Bag()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = [(sum(map(f, p[s], p[t])), t) for t in p if t != s]
            terms = [(f(p[s][k], q[k]), w) for k, w in enumerate(kept) if n[s][w] and p[s][k] > q[k]]
            for part, found in (("pair", pairs), ("term", terms)):
                best = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, r + 1) for r, (v, item) in enumerate(best) if part == "pair" or r < 10]
    return sorted(out)


AUDITED = "text string, lang string, source string, n int, block string, kept long"  # the last three clash with inner names


def audited(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], AUDITED)


def some_documents(n=300, seed=7):
    rng = random.Random(seed)
    words = [a + b for a in "abÄßéx中" for b in ("", "A", "ö", "zz", "漢")]
    # one source holds a third of all rows
    return [(" ".join(rng.choices(words[: 5 + 10 * (i % 4)], k=rng.randint(0, 30))), rng.choice(["en", "de", None]), "hot" if i % 3 == 0 else rng.choice(["s1", "s2", "é", None])) for i in range(n)]


@pytest.mark.parametrize(("held", "block"), [(5, 3), (1 << 20, 4096)])
def test_divergence_audit(spark, monkeypatch, held, block):
    rows = some_documents() + [(None, "en", "s1"), ("", "en", "empty"), ("12 !?", "en", "signs"), ("only here", "xx", "alone"), ("x " * 40_000, "en", "long")]
    rows += [("Same words here", "fr", "a"), ("same WORDS here", "fr", "b")] * 12  # repeated rows and ties
    got = [tuple(r) for r in divergence_audit(audited(spark, rows), block_terms=block).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert sorted(got) == brute_audit(rows)


def test_counts_handed_on_in_parts(monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["a", "b", "cé", "d"], 20)) for _ in range(50)]
    group = rng.integers(0, 3, 50)
    parts = [divergence._count(group[i:j], data, offsets) for i, j, data, offsets in chunks(pa.array(texts), 200)]
    g, ids, n, df, words = divergence._sum(parts)
    got = {(int(a), words[int(b)].as_py().decode()): (int(c), int(d)) for a, b, c, d in zip(g, ids, n, df)}
    want = {(k, w): (sum(t.split().count(w) for t, x in zip(texts, group) if x == k), sum(w in t.split() for t, x in zip(texts, group) if x == k)) for k in range(3) for w in ("a", "b", "cé", "d")}
    assert len(parts) > 3 and got == {k: v for k, v in want.items() if v[0]}


def test_divergence_of_nothing(spark):
    assert divergence_audit(audited(spark, [])).count() == 0
    got = divergence_audit(audited(spark, [("a", "en", "x"), ("b", "en", "y")])).collect()
    assert sorted((r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got) == [("x", "pair", "y", 0, 1), ("y", "pair", "x", 0, 1)]


def test_shares_are_exact():
    rng = random.Random(9)
    for _ in range(300):
        total = rng.randint(1, 9 * 10**15 - 100)
        n, kept = rng.randint(0, total), rng.randint(1, 40)
        assert int(shares(np.array([n]), total, kept)[0]) == 1 + 10**9 * (n + 2) // (total + 2 * kept)

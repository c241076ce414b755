"""Queries without SQL against brute force on small tables, with rows that a narrower query would leave out."""

import math
import re

from partloom.operators import search, sequences
from partloom.queries import QUERIES


def documents(spark, path, texts):
    """Tables documents and labels (empty) of the texts, with ids from 1."""
    rows = [(i, t, "en", "src1", len(t)) for i, t in enumerate(texts, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_global_search_of_all_lengths(spark, tmp_path):
    base = "".join("gatc"[(i * i + i // 3) % 4] for i in range(700))
    texts = [base, base[:350] + "t" + base[351:], base + "gattaca", "gatc" * 4, base[:19], "acgt" * 1300, base[:300], ""]
    got = [tuple(r) for r in QUERIES["sequence_global_search"](spark, documents(spark, tmp_path, texts)).collect()]
    want = []
    for i, t in enumerate(texts, 1):
        words = {t[j : j + sequences.WORD] for j in range(len(t) - sequences.WORD + 1)}
        if 20 <= len(t) <= 5000 and any(w in base for w in words):
            identity, cigar = sequences.align(base, t)
            if round(100 * identity, 1) >= 80:
                want.append((f"doc/{i}", round(100 * identity, 1), cigar))
    assert got == sorted(want, key=lambda r: (-r[1], r[0]))
    assert {"doc/1", "doc/2", "doc/3"} <= {r[0] for r in got}


def edits(a, b):
    """Levenshtein distance; a single neighbouring swap is one edit."""
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        if len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]:
            return 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_text_search_brute_force(spark, tmp_path):
    near = ["onenth", "noenth"] + [f"on{x}nth" for x in "abcdfghijklmopqrstuvwxyz"] + [f"o{x}{y}nth" for x in "bcd" for y in "fghijklm"] + [f"reere{x}" for x in "bcdfg"]
    texts = [f"title {w}\nand {w} again" + " filler" * (i % 5) for i, w in enumerate(near)] + ["nothing here"]
    path = documents(spark, tmp_path, texts)
    rows = [(i, t, "en", "onetnh" if i == 54 else "src1", len(t)) for i, t in enumerate(texts, 1)]  # a word of displayId's field only
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    got = {r["subject"]: r["score"] for r in QUERIES["fuzzy_text_search"](spark, path).collect()}

    docs = {f"doc/{i}": ({"displayId": f"{s}_{i}", "version": "1", "name": t.split("\n")[0], "description": t, "type": "en", "keywords": f"{s} {i}"}, (1 + i % 97) / 97) for i, t, _, s, _ in rows}
    split = {s: {f: re.findall(r"\w+", v.lower()) for f, v in d.items()} for s, (d, _) in docs.items()}
    words = {w for d in split.values() for t in d.values() for w in t}
    alts = {t: sorted((edits(w, t), w) for w in words if edits(w, t) <= 2)[:50] for t in ("onenth", "reerea")}
    want = dict.fromkeys(docs, 0.0)
    for f, boost in search.FIELDS.items():
        full = [d[f] for d in split.values() if d[f]]
        mean = sum(map(len, full)) / len(full)
        for s, d in split.items():
            total = 0.0
            for t, found in alts.items():
                for e, w in found:
                    tf, df = d[f].count(w), sum(w in x for x in full)
                    if tf:
                        total += (1 - e / min(len(w), len(t))) * math.log(1 + (len(full) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d[f]) / mean))
            want[s] = max(want[s], boost * total)
    want = {s: q * q * math.log(1 + docs[s][1]) for s, q in want.items() if q}
    assert len(alts["onenth"]) == 50 and any(w == "onetnh" for _, w in alts["onenth"])
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 2e-6 for s in want)


def test_containment_and_ranks_of_whole_tables(spark, data):
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{data}/{t}.parquet").select(*c).distinct().collect()]
    down = {}
    for a, b in [(f"n{n}", f"r{r}") for n, r in read("nation", "n_nationkey", "n_regionkey")] + [(f"s{s}", f"n{n}") for s, n in read("supplier", "s_suppkey", "s_nationkey")] + [(f"p{p}", f"s{s}") for p, s in read("lineitem", "l_partkey", "l_suppkey")]:
        down.setdefault(a, set()).add(b)
    want = set()
    for a in down:
        level = {a}
        for _ in range(3):
            level = {c for x in level for c in down.get(x, ())}
            want |= {(a, c) for c in level}
    got = [tuple(r) for r in QUERIES["containment_three_hop"](spark, data).collect()]
    assert len(got) == len(want) and set(got) == want

    orders = {f"o{k}" for (k,) in read("orders", "o_orderkey")}
    assert {r["child"] for r in QUERIES["rank_of_expected"](spark, data).collect()} == orders
    assert QUERIES["upper_median_rank"](spark, data).first()["total"] == len(orders)

"""Pairs, forests and clusters of sequences against their plain definitions."""

import random

import numpy as np
import pytest

from partloom.operators import blocks, linkage, seeds, sequences
from partloom.operators.alignment import align, identity_of

from test_alignment import mutated


def family(seed=3, bases=4, copies=9, size=160):
    """Families of near copies, pieces of them, shuffled joins, equal and short ones, and unrelated ones."""
    rng = random.Random(seed)
    roots = ["".join(rng.choices("gatc", k=size + 20 * i)) for i in range(bases)]
    out = list(roots)
    for r in roots:
        out += [mutated(rng, r, rng.choice([0.01, 0.03, 0.1, 0.2])) for _ in range(copies)] + [r, r[:80], r[40:], r.upper()]
    out += [roots[0] + roots[1], roots[1][:90] + roots[2][60:], "gat" * 60, "gat" * 45, "", "g", "gattaca", None]
    return [(f"s{i:03d}", s) for i, s in enumerate(out)]


def table(spark, rows):
    return spark.createDataFrame(rows, "subject string, sequence string").repartition(3)


def firsts(rows):
    """The different sequences under their smallest subjects."""
    out = {}
    for s, x in sorted(r for r in rows if r[1] is not None):
        out.setdefault(x.lower(), s)
    return {s: x for x, s in out.items()}


def grams(s, k):
    return {s[i : i + k] for i in range(len(s) - k + 1)}


def plain_pairs(rows, k, within):
    own = sorted((s, grams(x, k)) for s, x in firsts(rows).items())
    out = {}
    for i, (a, x) in enumerate(own):
        for b, y in own[i + 1 :]:
            if x & y and 1 - len(x & y) / len(x | y) <= within + 1e-9:
                out[a, b] = 1 - len(x & y) / len(x | y)
    return out


@pytest.mark.parametrize(("k", "within"), [(8, 0.5), (3, 0.3), (5, 0.9), (8, 0.0), (2, 0.75)])
def test_gram_pairs_lose_nothing(spark, k, within):
    got = {(r["a"], r["b"]): r["dist"] for r in sequences.gram_pairs(table(spark, family()), k, within).collect()}
    want = plain_pairs(family(), k, within)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want) and (len(want) > 20 or not within)


def test_gram_pairs_with_another_distance(spark):
    want = {p: abs(len(grams(firsts(family())[p[0]], 8)) - len(grams(firsts(family())[p[1]], 8))) for p in plain_pairs(family(), 8, 0.5)}
    got = sequences.gram_pairs(table(spark, family()), 8, 0.5, lambda x, y: float(abs(len(x) - len(y))))
    assert {(r["a"], r["b"]): r["dist"] for r in got.collect()} == want
    with pytest.raises(ValueError):
        sequences.gram_pairs(table(spark, family()), 8, 1.0)


def merged(ids, pairs, clusters):
    """The definition: again and again the two clusters with the smallest distance of any two members."""
    own = {i: {i} for i in ids}
    while len(own) > clusters:
        near = [(d, p) for p, d in pairs.items() if next(c for c in own if p[0] in own[c]) != next(c for c in own if p[1] in own[c])]
        if not near:
            break
        a, b = sorted(next(c for c in own if x in own[c]) for x in min(near)[1])
        own[a] |= own.pop(b)
    return {i: c for c, who in own.items() for i in who}


@pytest.mark.parametrize("clusters", [1, 8, 20, 500])
def test_single_link_is_the_cubic_definition(spark, clusters):
    rows = family(copies=6)
    got = {r["subject"]: r["cluster"] for r in sequences.hierarchical_clusters(table(spark, rows), clusters, 8, 0.6).collect()}
    own = firsts(rows)
    by_first = merged(sorted(own), plain_pairs(rows, 8, 0.6), clusters)
    name = {x: s for s, x in own.items()}
    assert got == {s: by_first[name[x.lower()]] for s, x in rows if x is not None}


def test_forest_with_equal_distances(spark):
    rng = random.Random(4)
    pairs = {tuple(sorted(rng.sample(range(40), 2))): rng.choice([0.1, 0.2, 0.2, 0.3]) for _ in range(150)}
    edges = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}", d) for (a, b), d in pairs.items()], "a string, b string, dist double")
    root = {i: i for i in range(40)}
    find = lambda i: i if root[i] == i else find(root[i])
    want = set()
    for d, a, b in sorted((d, a, b) for (a, b), d in pairs.items()):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.add((f"n{a:02d}", f"n{b:02d}", d))
    assert {tuple(r) for r in linkage.spanning_forest(edges).collect()} == want
    assert linkage.spanning_forest(edges.limit(0)).count() == 0


def plain_score(x, y, run=28):
    best = 0
    for d in range(-len(y) + 1, len(x)):
        same = [x[i] == y[i - d] for i in range(max(d, 0), min(len(x), len(y) + d))]
        for u in range(len(same)):
            total = 0
            for v in range(u, len(same)):
                total += 5 if same[v] else -4
                if total > best and any(all(same[w : w + run]) for w in range(u, v - run + 2)):
                    best = total
    return best


def test_seeded_scores():
    rng = random.Random(5)
    for _ in range(12):
        a = "".join(rng.choices("gatc", k=70))
        b = "".join(rng.choices("gatc", k=rng.randint(0, 15))) + mutated(rng, a, rng.choice([0.0, 0.02, 0.06]))
        assert seeds.seeded_score(a.encode(), b.encode()) == plain_score(a, b)
    assert seeds.seeded_score(b"gat" * 20, b"gat" * 15) == 45 * 5 and seeds.seeded_score(b"g" * 27, b"g" * 27) == 0 and seeds.seeded_score(b"", b"gat") == 0


def test_seed_edges_and_threshold_clusters(spark):
    rows = family(copies=7)
    own = sorted(firsts(rows).items())
    want = {}
    for i, (a, x) in enumerate(own):
        for b, y in own[i + 1 :]:
            if grams(x, 28) & grams(y, 28) and (score := seeds.seeded_score(x.encode(), y.encode())) > 300:
                want[a, b] = score
    assert {(r["a"], r["b"]): r["score"] for r in sequences.seed_edges(table(spark, rows), 300).collect()} == want and len(want) > 30
    label = {s: s for s, _ in own}
    for _ in own:
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    name = {x: s for s, x in own}
    got = {r["subject"]: r["component"] for r in sequences.threshold_clusters(table(spark, rows), 300).collect()}
    assert got == {s: label[name[x.lower()]] for s, x in rows if x is not None} and len(set(got.values())) < len(own) - 20


def in_sequence(rows, identity, share):
    """Greedy clustering one by one."""
    own = sorted(firsts(rows).items(), key=lambda r: (-len(r[1]), r[0]))
    few = {s: set(seeds.minimizers(x.encode()).tolist()) for s, x in own}
    heads, out = [], {}
    for s, x in own:
        found = []
        for k, (c, y) in enumerate(heads):
            common = len(few[s] & few[c])
            if common and common >= share * min(len(few[s]), len(few[c])):
                got = identity_of(align(x, y), x, y)
                if got >= identity:
                    found.append((-got, k, c))
        if found:
            out[s] = (min(found)[2], -min(found)[0])
        else:
            heads.append((s, x))
            out[s] = (s, 1.0)
    name = {x: s for s, x in own}
    return {s: out[name[x.lower()]] for s, x in rows if x is not None}


@pytest.mark.parametrize(("identity", "share"), [(0.8, 0.1), (0.9, 0.0)])
def test_greedy_clusters_are_those_of_the_sequential_definition(spark, identity, share):
    rows = family(copies=12, size=120)
    got = {r["subject"]: (r["centroid"], r["identity"]) for r in sequences.greedy_clusters(table(spark, rows), identity, share=share).collect()}
    assert got == in_sequence(rows, identity, share) and 5 < len({c for c, _ in got.values()}) < 60


def test_centroids_in_a_chain(spark):
    pairs = spark.createDataFrame([(f"n{i:02d}", f"n{i - 1:02d}") for i in range(1, 12)] + [("n05", "n00")], "later string, earlier string")
    got = {r["id"]: r["is_centroid"] for r in linkage.centroids(pairs).collect()}
    state = {"n00": True}
    for i in range(1, 12):
        state[f"n{i:02d}"] = not any(state[e] for e in [f"n{i - 1:02d}"] + ["n00"] * (i == 5))
    assert got == {k: v for k, v in state.items() if k != "n00"}
    assert linkage.centroids(pairs.limit(0)).count() == 0


def test_clusters_of_nothing(spark):
    none = table(spark, [])
    assert sequences.greedy_clusters(none).count() == sequences.threshold_clusters(none).count() == sequences.hierarchical_clusters(none, 3).count() == 0


@pytest.mark.parametrize("above", [0, 200])
def test_scores_of_letters_that_repeat(above):
    """Texts of one letter, of short periods and of both: chains of equal words give the scores of all diagonals."""
    rng = random.Random(6)
    piece = lambda: rng.choice(["g" * 60, "a" * 45, "ta" * 25, "gat" * 15, "gatcc" * 9, "".join(rng.choices("gatc", k=30))])
    left, right = (["".join(piece() for _ in range(rng.randint(1, 2))) for _ in range(4)] for _ in range(2))
    want = {(i, j): s for i, x in enumerate(left) for j, y in enumerate(right) if (s := plain_score(x, y)) > above}
    assert seeds._scores_of_blocks(left, right, False, above, 28, 10) == want and want


def test_long_texts_of_one_letter_are_not_squares():
    """4,000 by 3,000 equal words of one pair were twelve million matches, each moved and sorted."""
    import tracemalloc

    tracemalloc.start()
    assert seeds._scores_of_blocks(["a" * 4000], ["a" * 3000], False, 500, 28, 10) == {(0, 0): 15_000}
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("same", [True, False])
def test_frequent_words_are_not_counted_for_every_pair(monkeypatch, same):
    """Texts that share frequent words and differ in rare ones: words of all pairs were looked up before pairs were dropped."""
    rng, looked_up, bincount = random.Random(8), [0], np.bincount
    often = ["".join(rng.choices("gatc", k=40)) for _ in range(6)]
    texts = ["".join(rng.sample(often, 3)) + "".join(rng.choices("gatc", k=200)) for _ in range(300)]
    texts += [mutated(rng, t, 0.02) for t in texts[:40]]

    def counting(x, *args, **kw):
        looked_up[0] += len(x)
        return bincount(x, *args, **kw)

    monkeypatch.setattr(blocks.np, "bincount", counting)
    one, two = (texts, texts) if same else (texts[:200], texts[150:])
    got = {(p, q): (c, x, y) for cols in blocks.near_texts(one, two, same, 8, 0.5) for p, q, c, x, y in zip(*(col.tolist() for col in cols))}
    own, other = [grams(t, 8) for t in one], [grams(t, 8) for t in two]
    every = [(i, j) for i in range(len(one)) for j in range(len(two)) if not same or i < j]
    want = {(i, j): (len(own[i] & other[j]), len(own[i]), len(other[j])) for i, j in every if 2 * len(own[i] & other[j]) >= len(own[i] | other[j])}
    assert {tuple(sorted(p)) if same else p for p in got} == want.keys() and len(got) == len(want) >= 10 * (1 + same)
    assert all(c == want[tuple(sorted(p)) if same else p][0] for p, (c, _, _) in got.items())
    assert looked_up[0] < sum(len(own[i] & other[j]) for i, j in every) / 3


def test_diagonals_beside_each_other_score_as_one_by_one():
    rng = np.random.default_rng(9)
    x, y = (np.frombuffer("".join(rng.choice(["g" * 40, "ta" * 25, "gatcc" * 9, "tc"], 60)).encode(), np.uint8) for _ in range(2))
    begin, other, size = rng.integers(0, 500, 3000), rng.integers(0, 500, 3000), np.append(rng.integers(0, 300, 2990), [min(len(x), len(y)) - 500] * 10)
    args = (x, y, begin, begin - other, size, 28, 5, -4)
    want = seeds._scores_one_by_one(*args)
    assert np.array_equal(seeds._scores_on_diagonals(*args), want) and (want > 0).mean() > 0.2
    few = tuple(a[:3] if isinstance(a, np.ndarray) and a is not x and a is not y else a for a in args)
    assert np.array_equal(seeds._scores_on_diagonals(*few), want[:3])


def test_single_link_of_a_chain_takes_few_rounds(spark, monkeypatch):
    """Each of 200 in a chain takes its edge to the one before; components of the chain were found by labels, and then once more."""
    made, checkpointed = [0], linkage.checkpointed

    def counting(df):
        made[0] += 1
        return checkpointed(df)

    def not_again(*_):
        raise AssertionError("trees are known from the forest")

    monkeypatch.setattr(linkage, "checkpointed", counting)
    monkeypatch.setattr(linkage, "connected_components", not_again)
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}", i / 1000) for i in range(199)] + [("x1", "x2", 0.5)], "a string, b string, dist double")
    nodes = edges.selectExpr("explode(array(a, b)) id").union(spark.createDataFrame([("alone",)], "id string")).distinct()
    got = {r["id"]: r["cluster"] for r in linkage.single_link(nodes, edges, 1).collect()}
    assert got == {f"n{i:03d}": "n000" for i in range(200)} | {"x1": "x1", "x2": "x1", "alone": "alone"}
    assert made[0] <= 16

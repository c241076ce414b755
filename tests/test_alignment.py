"""Sequence search against plain dynamic programming and against the search that aligns everything."""

import random

import numpy as np
import pytest

from partloom.operators import alignment, sequences
from partloom.operators.alignment import cigar, identity_of, local_scores, passing


def mutated(rng, s, rate):
    out = []
    for c in s:
        x = rng.random()
        if x < rate / 3:
            continue
        out.append(rng.choice("gatc") if x < rate else c)
        if rng.random() < rate / 3:
            out.append(rng.choice("gatc"))
    return "".join(out)


def related(seed=1, n=60, size=120):
    rng = random.Random(seed)
    base = "".join(rng.choices("gatc", k=size))
    out = [base, base[:50], base[30:], base + base, base[::-1]]
    out += [mutated(rng, base[rng.randint(0, 40) : rng.randint(60, size)], rng.choice([0.02, 0.1, 0.2, 0.3])) for _ in range(n)]
    out += ["".join(rng.choices("gatc", k=rng.randint(1, 200))) for _ in range(20)] + [mutated(rng, base, 0.1) + "".join(rng.choices("gatc", k=80)) for _ in range(10)]
    return base, [s for s in out if s]


def plain_local(a, b, w):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if x == y else -w), h[i - 1][j] - w, h[i][j - 1] - w)
            best = max(best, h[i][j])
    return best


@pytest.mark.parametrize("cells", [500, 1 << 15])
def test_local_scores(monkeypatch, cells):
    monkeypatch.setattr(alignment, "DIAGONAL_CELLS", cells)
    base, others = related(n=25)
    for w in (1, 2):
        assert local_scores(base.encode(), [s.encode() for s in others], w).tolist() == [plain_local(base, s, w) for s in others]
    assert local_scores(b"", [b"gat"], 2).tolist() == [0] and local_scores(b"gat", [], 2).tolist() == [] and local_scores(b"gat", [b""], 2).tolist() == [0]


@pytest.mark.parametrize("identity", [0.6, 0.75, 0.8, 0.95])
def test_the_bound_loses_nothing(identity):
    for seed in range(4):
        base, others = related(seed)
        can = passing(base.encode(), [s.encode() for s in others], identity)
        reach = np.array([sequences.align(base, s)[0] >= identity for s in others])
        assert not (reach & ~can).any() and reach.sum() > 3
        assert identity < 0.75 or not can.all()


def test_definitions_of_identity():
    a, b = "gattacagattaca", "gattagattaca"
    ops = alignment.align(a, b)
    same = 12
    assert cigar(ops) == sequences.align(a, b)[1] and ops.count("D") == 2
    assert identity_of(ops, a, b, 0) == 1.0 and identity_of(ops, a, b, 1) == identity_of(ops, a, b, 4) == same / 14
    assert identity_of(ops, a, b, 2) == same / 14 and identity_of(ops, a, b, 3) == 1 - 1 / 14
    ops = alignment.align("gattaca", "ccgattaca")
    assert identity_of(ops, "gattaca", "ccgattaca", 1) == 7 / 9 and identity_of(ops, "gattaca", "ccgattaca", 2) == 1.0


def test_identity_in_rows_is_that_of_the_alignment():
    for seed in range(6):
        base, others = related(seed, n=25, size=60)
        for s in others:
            for a, b in ((base, s), (s, base)):
                assert alignment.identity(a, b) == identity_of(alignment.align(a, b), a, b)
    assert alignment.identity("", "gat") == alignment.identity("gat", "") == 0.0


@pytest.mark.parametrize("cells", [300, 1 << 15])
def test_identities_of_many_at_once(monkeypatch, cells):
    monkeypatch.setattr(alignment, "DIAGONAL_CELLS", cells)
    for seed in range(4):
        base, others = related(seed, n=30, size=70)
        others += ["g", "", base * 3]
        assert alignment.identities(base.encode(), [s.encode() for s in others]).tolist() == [alignment.identity(base, s) for s in others]
    assert alignment.identities(b"g", [b"g", b"a", b"gg"]).tolist() == [alignment.identity("g", x) for x in ("g", "a", "gg")]
    assert alignment.identities(b"", [b"g"]).tolist() == [0.0]
    monkeypatch.setattr(alignment, "LONGEST", 100)
    assert alignment.identities(base.encode(), [others[0].encode(), b"gat"]).tolist() == [1.0, alignment.identity(base, "gat")]


def by_hand(rows, q, identity, most, definition, rejects):
    own = {q[i : i + 8] for i in range(len(q) - 7)}
    found = []
    for s, x in rows:
        n = len(own & {x[i : i + 8] for i in range(len(x) - 7)})
        if 20 <= len(x) <= 5000 and n:
            ops = alignment.align(q, x)
            found.append((n, len(x), s, round(100 * identity_of(ops, q, x, definition), 1), cigar(ops)))
    found.sort(key=lambda r: (-r[0], r[1], r[2]))
    good, yes, no = [], 0, 0
    for r in found:
        if rejects and (yes == most or no == rejects):
            break
        if r[3] >= 100 * identity:
            yes += 1
            good.append((r[2], r[3], r[4]))
        else:
            no += 1
    good.sort(key=lambda r: (-r[1], r[0]))
    return good if rejects or not most else good[:most]


@pytest.mark.parametrize(("identity", "most", "definition", "rejects"), [(0.8, 50, 2, 0), (0.8, 5, 2, 0), (0.8, 0, 1, 0), (0.7, 50, 0, 0), (0.7, 50, 3, 0), (0.8, 6, 2, 3), (0.9, 50, 2, 1), (0.8, 50, 4, 40)])
def test_global_search_by_hand(spark, identity, most, definition, rejects):
    base, others = related(7)
    rows = [(f"s{i:03d}", x) for i, x in enumerate(others)]
    table = spark.createDataFrame([*rows, ("empty", ""), ("none", None)], "subject string, sequence string")
    got = [tuple(r) for r in sequences.global_search(table, base.upper(), identity, most, definition=definition, rejects=rejects).collect()]
    want = by_hand(rows, base, identity, most, definition, rejects)
    assert got == want and got


def test_global_search_of_too_short_a_query(spark):
    table = spark.createDataFrame([("a", "gattaca" * 5)], "subject string, sequence string")
    assert sequences.global_search(table, "gattaca").count() == 0 and sequences.global_search(table, "").count() == 0


def plain_overlap(q, s, t):
    """Edit distances from any border: is there an end with few enough of them?"""
    d = np.zeros((len(q) + 1, len(s) + 1), int)
    for i in range(1, len(q) + 1):
        for j in range(1, len(s) + 1):
            d[i, j] = min(d[i - 1, j - 1] + (q[i - 1] != s[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1)
    ends = [(d[i, -1], min(i, len(s))) for i in range(1, len(q) + 1)] + [(d[-1, j], min(j, len(q))) for j in range(1, len(s) + 1)]
    return any(e <= (1 / t - 1) * m + 1e-6 and m >= t * max(min(len(q), len(s)) // 2, 1) - 1e-6 for e, m in ends)


@pytest.mark.parametrize("bits", [100, 1 << 18])
def test_bit_vectors_are_the_plain_distances(monkeypatch, bits):
    monkeypatch.setattr(alignment, "VECTOR_BITS", bits)
    base, others = related(n=20, size=70)
    for q in (base, others[7], others[-20]):
        for t in (0.6, 0.8, 0.95):
            assert alignment.overlapping(q.encode(), [s.encode() for s in others], t).tolist() == [plain_overlap(q, s, t) for s in others]


def test_a_shared_phrase_inside_is_not_aligned(monkeypatch):
    """Unrelated sequences with one long phrase in common have a high local score, but no border lies near."""
    rng = random.Random(8)
    phrase = "".join(rng.choices("gatc", k=90))
    around = lambda: "".join(rng.choices("gatc", k=150)) + phrase + "".join(rng.choices("gatc", k=150))
    query, others = around(), [around().encode() for _ in range(40)]
    assert not alignment.passing(query.encode(), others, 0.8).any()
    assert (alignment.reached(query.encode(), [*others, query[20:].encode()], 0.8) >= 0).tolist() == [False] * 40 + [True]

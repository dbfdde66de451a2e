from __future__ import annotations

import random

import numpy as np
import pytest

from lorewright.llm import wide_simhash as W

SCHEMA = "doc_id long, text string"


def jaccard(a: str, b: str, k: int = 5) -> float:
    x, y = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def corpus():
    pick = random.Random(4)
    word = lambda: "".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 7)))
    rows, near = [], []
    for d in range(0, 400, 4):
        body = [word() for _ in range(pick.choice([12, 40, 150, 900]))]
        rows.append((d, " ".join(body)))
        changed = list(body)
        for _ in range(max(1, len(body) // 100)):
            changed[pick.randrange(len(body) // 2, len(body))] = word()
        rows.append((d + 1, "\n".join(changed)))
        near.append((rows[-2], rows[-1]))
        far = [w if pick.random() < 0.8 else word() for w in body]
        rows.append((d + 2, " ".join(far)))
    return rows, near


def test_catches_similar_and_leaves_others(spark):
    rows, near = corpus()
    got = {r["doc_id"]: r["component_id"] for r in W.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    sure = [(a[0], b[0]) for a, b in near if jaccard(a[1], b[1]) >= 0.88]
    assert len(sure) > 30
    assert sum(got[a] == got[b] for a, b in sure) >= 0.97 * len(sure)
    text = dict(rows)
    for d, c in got.items():
        assert c == d or jaccard(text[d], text[c]) > 0.6
    kept = W.drop_similar(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


@pytest.mark.parametrize("block", [2048, 7])
def test_large_group(spark, monkeypatch, block):
    """A group of near copies of one text is one component, in blocks too."""
    monkeypatch.setattr(W, "BLOCK", block)
    monkeypatch.setattr(W, "SMALL_BLOCK", block)
    pick = random.Random(9)
    base = [f"w{pick.randrange(10**6)}" for _ in range(300)]
    rows = []
    for d in range(120):
        body = list(base)
        body[pick.randrange(300)] = f"x{d}"
        rows.append((1000 - d, " ".join(body)))
    got = W.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component_id"] for r in got} == {881}


def test_odd_rows(spark):
    rows = [(3, None), (2, ""), (5, " \n"), (7, "one two"), (6, "ONE  two"), (7, "one two"), (None, "one two"), (8, "three")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["doc_id"], r["component_id"]) for r in W.similar_documents(df).collect())
    assert got == [(2, 2), (3, 2), (5, 2), (6, 6), (7, 6), (7, 6), (8, 8)]
    assert sorted((r["doc_id"] or 0) for r in W.drop_similar(df).collect()) == [0, 2, 6, 8]
    assert W.drop_similar(df.limit(0)).count() == 0


def test_filter_keeps_all_within_budget():
    pick = np.random.default_rng(1)
    a = pick.integers(0, 2**63, (40, W.WORDS), dtype=np.uint64)
    b = a.copy()
    for i in range(40):
        for k in pick.choice(W.BITS, size=3 * i, replace=False):
            b[i, k // 64] ^= np.uint64(1) << np.uint64(k % 64)
    for bits in (0, 20, 82):
        for i in range(40):
            assert W._near(a[i : i + 1], b[i : i + 1], bits)[0] == (3 * i <= bits)


def overlapping(pick, first, shared, second):
    """Two texts with so many shingles of their own and in common."""
    words = lambda n: [f"w{pick.randrange(10**12)}" for _ in range(n)]
    body = words(shared + 4)
    return " ".join(words(first) + body), " ".join(body + words(second))


def linked(spark, pairs):
    """Of each pair of texts, whether they are in one component."""
    rows = [(2 * k + i, t) for k, pair in enumerate(pairs) for i, t in enumerate(pair)]
    got = {r["doc_id"]: r["component_id"] for r in W.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    return [got[2 * k] == got[2 * k + 1] for k in range(len(pairs))]


def test_decides_at_the_bound(spark):
    """All pairs of a similarity of 0.8 are linked, none of 0.797."""
    pick = random.Random(3)
    enough = [overlapping(pick, 100, 900, 125) for _ in range(40)]
    less = [overlapping(pick, 102, 897, 126) for _ in range(40)]
    assert all(jaccard(*p) == 0.8 for p in enough) and all(0.79 < jaccard(*p) < 0.8 for p in less)
    assert linked(spark, enough + less) == [True] * 40 + [False] * 40


def test_exact_links_as_brute_force():
    pick = np.random.default_rng(2)
    for _ in range(20):
        base = [pick.choice(1000, 60, replace=False) for _ in range(4)]
        sets = [np.unique(np.where(pick.random(60) < pick.choice([0.02, 0.08, 0.15]), pick.integers(0, 1000, 60), base[k % 4])).astype(np.uint64) for k in range(40)]
        ids = pick.permutation(40) + 100
        got = np.arange(200)
        for a, others in W.exact_links(ids, sets, 0.8):
            got[got == a] = min(a, *others)
            got[others] = min(a, *others)
        want = np.arange(200)
        for i in range(40):
            for j in range(i):
                if len(np.intersect1d(sets[i], sets[j])) * 5 >= 4 * len(np.union1d(sets[i], sets[j])):
                    a, b = want[ids[i]], want[ids[j]]
                    want[(want == a) | (want == b)] = min(a, b)
        assert (got == want).all()


@pytest.mark.parametrize("parts", [(0, 4, 1), (1, 8, 1), (0, 12, 3), (0, 12, 2), (0, 24, 6), (2, 22, 2), (0, 48, 12), (0, 120, 30), (50, 400, 50)])
def test_catches_all_lengths(spark, parts):
    """Texts of a similarity of 0.8 or a little more are linked, however short."""
    pick = random.Random(5)
    pairs = [overlapping(pick, *parts) for _ in range(200)]
    assert all(0.8 <= jaccard(*p) < 0.86 for p in pairs)
    assert sum(linked(spark, pairs)) >= 199


@pytest.mark.parametrize("run", ["spam " * 200, "buy it now " * 70])
def test_dominating_run_is_no_copy(spark, run):
    """Texts of which most is one repeated run keep their own text and links."""
    pick = random.Random(6)
    own = [" ".join(f"w{pick.randrange(10**12)}" for _ in range(150)) for _ in range(12)]
    rows = [(d, run + body) for d, body in enumerate(own)] + [(20, own[5] + " " + run), (21, run + run + own[7])]
    got = {r["doc_id"]: r["component_id"] for r in W.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {**{d: d for d in range(12)}, 20: 5, 21: 7}

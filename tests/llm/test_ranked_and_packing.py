"""Ranked search against brute force, packing against the library and by what must hold of it."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lorewright.llm import packing, ranked

SCHEMA = "doc_id long, text string, score long, rank int, ids string, row long"
ITEMS = "item_id string, text string, doc_id long, term string"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(seed: int, n: int) -> list[str | None]:
    pick = random.Random(seed)
    common = [f"w{i}" for i in range(12)]
    rare = [f"R{i}x" for i in range(200)] + ["Über", "naïve", "漢字", "don't", "a_b", "Ａ"]
    out: list[str | None] = [None, "", "  .,\n", "w1", "W1 w1"]
    while len(out) < n:
        body = [pick.choice(common if pick.random() < 0.8 else rare) for _ in range(pick.randint(1, 60))]
        out.append(pick.choice([" ", "\n", ", "]).join(body))
        if pick.random() < 0.2:
            out += [out[-1]] * pick.randint(1, 4)
    return out


# --- ranked search


def found(text: str | None) -> list[str]:
    return re.findall(ranked.TERM_PATTERN, (text or "").translate(LOWER))


def brute(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    counts = [(d, Counter(found(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in counts if c]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        wanted = Counter(found(text))
        scores = []
        for d, c, size in held:
            m = 100 - 25 + (25 * size * n) // total
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in wanted.items() if t in c)
            if s > 0:
                scores.append((-s, d is not None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return out


def rows_of(df) -> list[tuple]:
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    pick = random.Random(3)
    docs = [(pick.randrange(-500, 5000), t) for t in texts(1, 700)]
    return docs + [(None, "w1 R1x Über"), (None, "R2x"), docs[40], docs[40]]


def test_search_is_brute_force(spark, corpus):
    """Ties, copies, null and repeated keys and items, odd characters; one chunk and several, one block and many."""
    items = [(f"i{n}", t) for n, t in enumerate(texts(2, 40))] + [(None, "w1 w2 R1x"), ("again", "R3x r3X w4"), ("again", "R3x r3X w4"), ("none", "nothing of this")]
    expected = sorted(brute(corpus, items, 20), key=str)
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEMS)
    rows = spark.createDataFrame([(d, t, 0, 0, "", 0) for d, t in corpus], SCHEMA)
    for parts, pairs in ((1, ranked.BLOCK_PAIRS), (7, 50)):
        got = ranked.search(ranked.build_index(rows.repartition(parts)), table, 20, block_pairs=pairs)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert rows_of(got) == expected


def test_search_keeps_equal_scores_by_key(spark):
    """More copies than are kept: the least keys win wherever they lie."""
    docs = [(k, "same words here") for k in range(3000)] + [(k, "other text of more words") for k in range(3000, 6000)]
    random.Random(1).shuffle(docs)
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = ranked.search(ranked.build_index(rows), spark.createDataFrame([("a", "same"), ("b", "text")], "item_id string, text string"), 20)
    assert [tuple(r)[:3] for r in sorted(got.collect())] == [("a", i + 1, i) for i in range(20)] + [("b", i + 1, 3000 + i) for i in range(20)]


def test_search_of_long_texts(spark):
    pick = random.Random(5)
    long = " ".join(f"t{pick.randrange(3000)}" for _ in range(300_000))
    docs, items = [(1, long), (2, "t1 t2"), (3, long + " t2")], [("long", long[:60_000]), ("short", "t2 t3000")]
    got = ranked.search(ranked.build_index(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(items, "item_id string, text string"))
    assert rows_of(got) == sorted(brute(docs, items, 20), key=str)


def test_search_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items, no_items = spark.createDataFrame([("i", "a")], "item_id string, text string"), spark.createDataFrame([], "item_id string, text string")
    assert ranked.search(ranked.build_index(none), items).collect() == []
    assert ranked.search(ranked.build_index(some), no_items).collect() == []
    assert ranked.search(ranked.build_index(spark.createDataFrame([(1, None)], "doc_id long, text string")), items).collect() == []
    with pytest.raises(TypeError):
        ranked.build_index(spark.createDataFrame([("x", "a")], "doc_id string, text string"))


def test_index_holds_the_maxima(spark, corpus):
    rows = ranked.build_index(spark.createDataFrame(corpus, "doc_id long, text string").coalesce(1)).postings.where("term is not null").collect()
    assert len({(r["chunk"], r["term"]) for r in rows}) == len(rows)
    for r in rows:
        ords, impacts = np.frombuffer(r["ords"], "<u2"), np.frombuffer(r["impacts"], "<i4")
        assert r["df"] == len(ords) == len(impacts)
        for level, bits in ((1, 4), (2, 8), (3, 12)):
            best = defaultdict(int)
            for o, i in zip(ords.tolist(), impacts.tolist(), strict=True):
                best[o >> bits] = max(best[o >> bits], i)
            assert np.frombuffer(r[f"max{level}"], "<i4").tolist() == [best[x] for x in sorted(best)]


# --- packing


def checked(docs: list[tuple], pieces: list, room: int) -> float:
    """Every id lies once in a sequence without gaps; gives the padding's share."""
    library = Tokenizer.from_file(TOKENIZER)
    want = Counter((d, *library.encode(t or "", add_special_tokens=False).ids, 1) for d, t in docs)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
        assert len(p["ids"]) == 4 * p["length"] > 0
    assert sum(p["length"] for p in pieces) == sum(len(k) * n for k, n in ((x[1:], n) for x, n in want.items()))
    for (d, *ids), n in want.items():
        if sum(1 for x in want.elements() if x[0] == d) > 1:
            continue
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            assert np.frombuffer(p["ids"], "<u4").tolist() == ids[at : at + p["length"]]
            at += p["length"]
        assert at == len(ids) and n == 1
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    pad = total = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= room
        pad, total = pad + (room - at if at & (at - 1) else 0), total + at
    return pad / max(1, pad + total)


@pytest.mark.parametrize("room,classes", [(64, 256), (64, 8), (128, 20)])
def test_pack_holds_every_id_once(spark, room, classes):
    """Null, empty and long texts, copies, null and repeated keys, clashing names."""
    pick = random.Random(9)
    docs = [(n, t) for n, t in enumerate(texts(6, 400))] + [(1000, " ".join(f"v{pick.randrange(99)}" for _ in range(5000))), (None, "w1 w2"), (7, "one more with that key")]
    docs += [(2000 + n, "the very same text again and again") for n in range(150)]
    rows = spark.createDataFrame([(d, t, 0, 0, "", 5) for d, t in docs], SCHEMA).repartition(3)
    got = packing.pack(rows, TOKENIZER, 1, room, classes=classes)
    assert got.columns == ["doc_id", "doc_tokens", "start", "length", "sequence_id", "offset", "ids"]
    padding = checked(docs, got.collect(), room)
    assert padding < (0.02 if classes == 256 else 0.12)


def test_pack_of_few_and_no_rows(spark):
    kind = "doc_id long, text string"
    assert packing.pack(spark.createDataFrame([], kind), TOKENIZER, 1).collect() == []
    for docs in ([(1, None)], [(1, "a"), (2, None)], [(5, "a b c " * 700)]):
        assert checked(docs, packing.pack(spark.createDataFrame(docs, kind), TOKENIZER, 1, 256).collect(), 256) == 0
    with pytest.raises(TypeError):
        packing.pack(spark.createDataFrame([("x", "a")], "doc_id string, text string"), TOKENIZER, 1)


def patterns_of(sizes: list[int], room: int) -> list[tuple]:
    return [p for p in product(*(range(room // s + 1) for s in sizes)) if sum(a * s for a, s in zip(p, sizes, strict=True)) <= room]


def test_knapsack_is_brute_force():
    pick = random.Random(2)
    for _ in range(30):
        sizes = np.array(sorted(pick.sample(range(2, 15), 4)))
        worth = np.array([pick.random() for _ in sizes])
        best, last = packing._knapsack(sizes, worth, 20)
        for room in range(21):
            assert best[room] == pytest.approx(max(float(np.dot(p, worth)) for p in patterns_of(sizes.tolist(), room)))
            taken = packing._pattern(sizes, last, room)
            assert taken @ sizes <= room and taken @ worth == pytest.approx(best[room])


def test_column_generation_meets_its_bound():
    """Its patterns meet the demand exactly, at the least value there is: by duality, and by hand."""
    pick = random.Random(4)
    for _ in range(20):
        sizes = np.array(sorted(pick.sample(range(5, 60), 8)))
        demand = np.array([float(pick.randint(1, 500)) for _ in sizes])
        columns, use, bound = packing.column_generation(sizes, demand, 100, gap=1e-6)
        assert (columns @ sizes <= 100).all() and (use >= 0).all()
        assert use @ columns == pytest.approx(demand)
        assert bound <= use.sum() + 1e-6 and use.sum() <= bound * (1 + 1e-5)
        assert bound >= float(sizes @ demand) / 100 - 1e-6
    # Halves of a third: 3 of 34 do not fit 100, so 2 a sequence is best.
    _, use, bound = packing.column_generation(np.array([34]), np.array([10.0]), 100)
    assert use.sum() == pytest.approx(5) and bound <= 5 + 1e-9


def test_plan_never_takes_more_than_there_is():
    pick = np.random.default_rng(1)
    for n in (1, 5, 100, 5000):
        lengths = np.minimum(2047, 1 + pick.gamma(1.2, 400, n).astype(int))
        counts = np.bincount(lengths, minlength=2048)
        plan = packing.plan_patterns(counts, 2048, 64)
        demand = np.add.reduceat(counts, np.append(0, plan.edges[:-1] + 1))
        taken, filled = np.zeros(len(plan.edges), int), defaultdict(int)
        for pattern, k, each in plan.uses:
            taken[k] += each * plan.times[pattern]
            filled[pattern] += each * int(plan.edges[k])
        assert (taken <= demand).all() and all(v <= 2048 for v in filled.values())
        assert (demand - taken) @ plan.edges <= 2048 * (len(plan.edges) + 1)


def test_ids_are_not_shuffled_with_lengths(spark):
    """What places pieces reads lengths alone."""
    tokens = packing.encode(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"), TOKENIZER, 1)
    assert "ids" not in packing.place(tokens).columns
    assert tokens.select(F.sum("n")).first()[0] == 5

"""Each stage of the pipeline against brute force, on what the stage before kept."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from test_text_operators import LOWER, SCHEMA, contamination, removed, spaced
from tokenizers import Tokenizer

import corpus_pipeline

WORDS = "alpha beta gamma delta rho sigma tau kappa lambda omega".split()


def corpus() -> tuple[list[tuple], list[tuple], list[tuple], dict[int, str]]:
    """Documents, benchmark, labels, and what each planted document is."""
    pick = random.Random(11)
    word = lambda: "".join(pick.choice("abcdefghijklmnop") for _ in range(pick.randint(3, 8)))
    text = lambda n: " ".join(pick.choice(WORDS) if pick.random() < 0.3 else word() for _ in range(n))
    items = [(f"b{i}", " ".join(word() for _ in range(30))) for i in range(4)]
    shared = text(60)
    rows, kind = [], {}

    def add(what: str, body: str | None, key: int | None = -1) -> str | None:
        key = len(rows) * 3 if key == -1 else key
        rows.append((key, body, pick.choice(["en", "fr"]), f"s{pick.randrange(4)}", len(body or "")))
        if key is not None:
            kind[key] = what
        return body

    for n in range(260):
        body = add("clean", text(pick.randint(60, 200)))
        if n % 6 == 0:
            add("toxic", text(80) + " vilest scum" * 6)
        if n % 9 == 0:
            add("copy", body)
            words = body.split()
            words[pick.randrange(len(words))] = "changed"
            add("near", "\n".join(words))
        if n % 13 == 0:
            add("shares", f"{text(80)}\n{shared} {text(40)}")
        if n % 20 == 0:
            add("leaked", items[n // 20 % 4][1].upper() + " " + text(20))
    for body in (None, None, "", " \n\t", "one two", "One  two"):
        add("odd", body)
    rows += [rows[5], rows[5], (None, rows[8][1], None, None, 0), (None, None, "en", "s1", 0)]
    labels = [(k, int(kind[k] != "toxic"), int(kind[k] == "toxic")) for k in kind if k % 2 == 0 and kind[k] in ("clean", "toxic")]
    return rows, items, labels + [(None, 0, 1), (rows[0][0], None, None)], kind


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows, items, labels, kind = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, kind


def groups(rows: list[tuple]) -> dict[int, int]:
    """The least key that pairs of a similarity of 0.8 lead to, over rows with keys."""

    def shingles(t):
        w = spaced((t or "").translate(LOWER))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    held = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    root = {k: k for k, _ in held}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(held):
        for b, y in held[:i]:
            if len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k: find(k) for k in root}


def test_stages_are_brute_force(spark, tables):
    folder, kind = tables
    steps = [[tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "bpe_encoding"]
    for stage in stages.values():
        out = stage(spark, spark.createDataFrame(steps[-1], SCHEMA), folder)
        steps.append([tuple(r) for r in out.collect()])
    given, good, single, cut, clean, coded = steps
    key = lambda rows: sorted(rows, key=str)
    # Classifier: toxic ones go, others stay as they are.
    bad = [r for r in given if kind.get(r[0]) == "toxic"]
    assert key(good) == key(r for r in given if r not in bad)
    # Near duplicates: one of each group, and rows without a key, stay as they are.
    root = groups(good)
    keep = {r for r in good if r[0] is None or root[r[0]] == r[0]}
    assert {r[0] for r in single if r[0] is not None} == {k for k, c in root.items() if k == c} and set(single) == keep
    assert sum(kind[k] in ("copy", "near") for k in root if root[k] != k) > 50
    # Passages: words that a lesser key has in a window of 13 go, others and their layout stay.
    want = sorted(((d, n, w) for d, _, n, w in removed([(r[0], r[1]) for r in single])), key=str)
    kept = {r[0]: r for r in single}
    assert sorted(((r[0], " ".join(spaced(r[1]))) for r in cut), key=str) == sorted(((d, w) for d, _, w in want), key=str)
    assert sum(n > 0 for _, n, _ in want) > 10
    gone = {d for d, n, _ in want if n}
    assert all(r == kept[r[0]] for r in cut if r[0] not in gone and r[0] is not None)
    assert all(r[4] == len(r[1]) and r[2:4] == kept[r[0]][2:4] for r in cut if r[0] in gone)
    # Benchmark text: documents of which a twentieth is in it go.
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    dirty = [x[4] for x in contamination([(r[0], r[1]) for r in cut], items)]
    assert key(clean) == key(r for r, is_dirty in zip(cut, dirty, strict=True) if not is_dirty) and sum(dirty) > 5
    # Token ids: those of the library.
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    for doc, lang, source, n, ids, decoded in coded:
        encoded = [library.encode(r[1] or "", add_special_tokens=False).ids for r in clean if (r[0], r[2], r[3]) == (doc, lang, source)]
        assert (n, ids, decoded) in [(len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()) for e in encoded]
    assert len(coded) == len(clean)


def test_run_is_its_stages(spark, tables):
    """The whole run over the tables gives what the stages give one after the other."""
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema)
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, docs.collect()))

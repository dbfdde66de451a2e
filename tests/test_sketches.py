"""Sketches within their errors, the fold as a function, and ids by a bounded set."""

from __future__ import annotations

import bisect
import random

from pyspark.sql import functions as F

from lorewright.operators import folding, sketches, state
from lorewright.streaming import bounded, jobs, queue


def test_merged_sketches_are_within_their_errors(spark):
    pick = random.Random(1)
    rows = [(2000 + n % 2, n % 12, pick.gauss(0, 100), int(300 * pick.random() ** 3)) for n in range(40_000)] + [(2000, 2, None, None)]
    monthly = sketches.sketched(spark.createDataFrame(rows, "y int, m int, v double, i int"), ["y", "m"], "v", "i")
    assert monthly.count() == 12
    yearly = sketches.merged(monthly, ["y"]).cache()
    for r in sketches.quantiles(yearly, ["y"], [0.05, 0.5, 0.95]).collect():
        values = sorted(x[2] for x in rows if x[0] == r["y"] and x[2] is not None)
        assert r["n"] == sum(x[0] == r["y"] for x in rows)
        assert abs(bisect.bisect(values, r["value"]) / len(values) - r["at"]) < 0.02
        true = len({x[3] for x in rows if x[0] == r["y"] and x[3] is not None})
        assert abs(r["distinct"] - true) <= max(2, 0.03 * true)
    counts = {y: {} for y in (2000, 2001)}
    for y, _, _, i in rows:
        if i is not None:
            counts[y][i] = counts[y].get(i, 0) + 1
    for r in sketches.frequent_items(yearly, ["y"], 10).collect():
        assert r["item"] is None or r["count"] == counts[r["y"]][r["item"]]
    assert sketches.quantiles(sketches.merged(monthly.limit(0), ["y"]), ["y"], [0.5]).collect() == []


def test_fold_function_is_the_fold(spark):
    """Random items, empty and null fields; shares that each hold a part of a review."""
    pick = random.Random(2)
    rows = [
        (n, pick.choice(["duplicate", "suggestion"]), pick.choice([" A", "a ", "Missing page: b", "c"]), pick.choice(["open", "open", "resolved", None]), pick.choice(["", None, f"d{n}"]), pick.choice(["", None, f"2024-01-{1 + n % 28:02d}"]), pick.choice([None, [], ["p", "q"], ["q", "r", "q"]]))
        for n in range(400)
    ]
    items = spark.createDataFrame(rows, "seq long, type string, title string, status string, detail string, created string, pages array<string>").repartition(3)
    want = {r["id"]: (r["status"], r["detail"], r["created"], r["n_items"], list(r["pages"])) for r in state.fold_reviews(items).collect()}
    for parts in (1, 7):
        got = {r["id"]: (r["status"], r["detail"], r["created"], r["n_items"], list(r["pages"])) for r in folding.fold_reviews(items, parts=parts).collect()}
        assert got == want
    assert folding.fold_reviews(items.limit(0)).collect() == []


def test_ids_by_a_bounded_set(spark, tmp_path):
    """Repeats after an id went out of the set are new; the set holds across batches."""
    pick = random.Random(3)
    rows = [(f"c{pick.randrange(2)}", n, f"m{pick.randrange(14)}", f"text {n}") for n in range(600)]
    kind = "channel string, seq long, message_id string, text string"
    for k in range(0, 600, 150):
        batch = rows[k : k + 150]
        random.Random(k).shuffle(batch)
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    held, want = {}, set()
    for channel, seq, message, _ in rows:
        last = held.setdefault(channel, [])
        if message not in last:
            want.add(seq)
            last.append(message)
            del last[:-5]
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with queue.rocksdb_state(spark):
        got = jobs.run_to_end(bounded.first_of_ids(stream, 5)).select("seq", F.col("text")).collect()
    assert sorted(r["seq"] for r in got) == sorted(want) and all(r["text"] == f"text {r['seq']}" for r in got)
    assert len(want) > len({(c, m) for c, _, m, _ in rows})

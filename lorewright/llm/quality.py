"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic regression, fitted on a bounded sample of labelled documents, gives
each document evidence: the log odds of being bad against the sample's.  A site
is a host and a path within it.  The expected share of bad documents of every
host and path comes from grouped sums of the documents' probabilities; hosts
are shrunk toward the global share and paths toward their host, by as much as
the spread between them, estimated by moments, warrants.  A sparse site so
says little.  The posterior adds the site's log odds, taken without the document
itself, to the evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime, textops

#: Labelled rows that the classifier is fitted on, at most.
MAX_LABELLED = 5000
#: Words that it may use, at most; documents that a word must be in, and share
#: of the bad ones.  Near copies count once (so many of so many minima equal).
MAX_WORDS, WORD_SUPPORT, WORD_SHARE = 256, 8, 0.008
COPY_MINIMA, COPY_EQUAL = 16, 6
#: Beside whole words, their first so many bytes, where a word has more.
STEMS = (5, 6, 7)
#: Sites that are broadcast, at most; more are joined by shuffle.
MAX_BROADCAST_SITES = 100_000
BINS = 12
PENALTY, WORD_PENALTY = 1.0, 0.05
THRESHOLD = 0.65
SHAPES = ("upper", "letter", "mark", "digit", "repeated_line", "distinct_word", "top_word", "words", "word_length")

_LETTER = textops.byte_class(bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))
_UPPER, _DIGIT = textops.byte_class(bytes(range(0x41, 0x5B))), textops.byte_class(bytes(range(0x30, 0x3A)))
_MARK = textops.byte_class(b"!%$#*&|@{}<>=~^_;")
_LINE = ~textops.byte_class(b"\n\r")
_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def _per_row(of: np.ndarray, n: int, weights=None) -> np.ndarray:
    return np.bincount(of, weights, n).astype(float)


def _rows_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def _unique(row: np.ndarray, hashes: np.ndarray):
    """Row, hash and count of each distinct hash of a row."""
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    edge = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])))) if len(row) else np.zeros(0, np.int64)
    return row[edge], hashes[edge], np.diff(edge, append=len(row))


def measure(raw: np.ndarray, offsets: np.ndarray, words_only: np.ndarray | None = None):
    """Shapes of each row, and (row, hash) of its distinct words and stems."""
    n = len(offsets) - 1
    folded = _FOLD[raw]
    starts, ends, first = textops.word_spans(folded, offsets, _LETTER)
    all_rows = _rows_of(first)
    row, hashes, count = _unique(all_rows, textops.span_hashes(folded, starts, ends))
    tokens_at, tokens_to, first_token = textops.word_spans(raw, offsets, textops.NOT_SPACE)
    lines_at, lines_to, first_line = textops.word_spans(raw, offsets, _LINE)
    line_row = _rows_of(first_line)
    distinct_line, _, _ = _unique(line_row, textops.span_hashes(raw, lines_at, lines_to))
    size = np.diff(offsets).astype(float)
    words, tokens, lines = np.diff(first).astype(float), np.diff(first_token).astype(float), np.diff(first_line).astype(float)

    def share(member: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(member[raw], dtype=np.int64)))
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(of, 1)

    top = np.zeros(n)
    np.maximum.at(top, row, count)
    shapes = np.stack([
        share(_UPPER, size), share(_LETTER, size), share(_MARK, tokens), share(_DIGIT, size), 1 - _per_row(distinct_line, n) / np.maximum(lines, 1),
        _per_row(row, n) / np.maximum(words, 1), top / np.maximum(words, 1), np.log1p(words), size / np.maximum(tokens, 1),
    ], axis=1)
    stems = [(row, hashes)]
    for k, length in enumerate(STEMS):
        more = np.flatnonzero(ends - starts > length)
        stem = textops.mix(textops.span_hashes(folded, starts[more], starts[more] + length) + np.uint64(k + 1))
        stems.append((all_rows[more], stem) if words_only is None else _known(all_rows[more], stem, words_only))
    row, hashes = (np.concatenate(x) for x in zip(*stems, strict=True))
    if words_only is None:
        row, hashes, _ = _unique(row, hashes)
    return shapes, row, hashes


def _known(row: np.ndarray, hashes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(words):
        return row[:0], hashes[:0]
    ok = words[np.minimum(np.searchsorted(words, hashes), len(words) - 1)] == hashes
    return row[ok], hashes[ok]


@dataclass
class Model:
    """Bins of the shapes, hashes of the words, weights and the base rate."""

    edges: list[np.ndarray]
    words: np.ndarray
    weights: np.ndarray
    base: float

    def design(self, shapes: np.ndarray, row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(shapes), len(self.weights)), np.float32)
        out[:, 0] = 1
        at = 1
        for k, edges in enumerate(self.edges):
            out[np.arange(len(shapes)), at + np.searchsorted(edges, shapes[:, k], side="right")] = 1
            at += len(edges) + 1
        if len(self.words):
            place = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            known = self.words[place] == hashes
            out[row[known], at + place[known]] = 1
        return out

    def evidence(self, shapes, row, hashes) -> np.ndarray:
        """Log odds of bad less those of the sample."""
        return self.design(shapes, row, hashes) @ self.weights - np.log(self.base / (1 - self.base))


def _minima(row: np.ndarray, hashes: np.ndarray, n: int) -> list[list[int]]:
    """The least of so many mixes of each row's hashes, as signed integers; none of a row without words."""
    first = np.searchsorted(row, np.arange(n))
    some = np.flatnonzero(np.diff(first, append=len(row)))
    out: list[list[int]] = [[] for _ in range(n)]
    if len(some):
        minima = np.stack([np.minimum.reduceat(textops.mix(hashes + np.uint64(k)), first[some]) for k in range(COPY_MINIMA)], axis=1)
        for i, mine in zip(some.tolist(), minima.astype(np.int64).tolist(), strict=True):
            out[i] = mine
    return out


def _copies(minima: list[list[int]]) -> np.ndarray:
    """Rows whose distinct words are mostly those of an earlier row."""
    out = np.zeros(len(minima), bool)
    seen: dict[tuple[int, int], list[int]] = {}
    for i, mine in enumerate(minima):
        equal: dict[int, int] = {}
        for k, m in enumerate(mine):
            for j in seen.get((k, m), ()):
                equal[j] = equal.get(j, 0) + 1
        if max(equal.values(), default=0) >= COPY_EQUAL:
            out[i] = True
            continue
        for k, m in enumerate(mine):
            seen.setdefault((k, m), []).append(i)
    return out


def _word_choice(measured: DataFrame, once: list[str], rows: int, bad: float) -> np.ndarray:
    """Hashes of the words whose presence tells most (log likelihood ratio), sorted.

    Words are counted in Spark, over all words of the texts ``once``, of which
    ``rows`` there are and ``bad`` of them bad; the driver gets the chosen ones.
    """
    spark = measured.sparkSession

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(w, np.int64) for w in batch.column("words").to_pylist()]
            words, at, n = np.unique(np.concatenate([*parts, np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
            in_bad = np.bincount(at, np.repeat(batch.column("bad").to_numpy(), list(map(len, parts))), len(words))
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n, pa.int64()), pa.array(in_bad)], names=["word", "n", "a"])

    kept = measured.join(F.broadcast(spark.createDataFrame([(x,) for x in once], "of string")), "of").select("bad", "words")
    counts = kept.mapInArrow(textops.lean(counted), "word long, n long, a double").groupBy("word").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))
    base = bad / rows
    n, a = F.col("n").cast("double"), F.col("a")
    cells = [(a, n * base), (n - a, n * (1 - base)), (bad - a, (rows - n) * base), (rows - bad - (n - a), (rows - n) * (1 - base))]
    told = sum((x * F.log(F.greatest(x, F.lit(1e-9)) / F.greatest(e, F.lit(1e-9))) for x, e in cells), F.lit(0.0)) * 2
    fit_ones = counts.where((n >= WORD_SUPPORT) & (a >= WORD_SHARE * bad) & (a > n * base)).withColumn("told", told).where("told > 25")
    # Equal ones by the hash as it is without a sign.
    chosen = fit_ones.orderBy(F.desc("told"), F.col("word") < 0, "word").limit(MAX_WORDS).select("word").collect()
    return np.sort(np.array([r["word"] for r in chosen], np.int64).astype(np.uint64))


def fit(shapes: np.ndarray, row: np.ndarray, hashes: np.ndarray, bad: np.ndarray, words: np.ndarray) -> Model:
    """Logistic regression by Newton steps with a ridge penalty; ``row`` and ``hashes`` say which of the words a row has."""
    edges = [np.unique(np.quantile(shapes[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(shapes.shape[1])]
    base = float(np.clip(bad.mean(), 0.01, 0.99))
    model = Model(edges, words, np.zeros(1 + sum(len(e) + 1 for e in edges) + len(words)), base)
    x = model.design(shapes, row, hashes).astype(float)
    w = model.weights
    w[0] = np.log(base / (1 - base))
    ridge = np.full(len(w), PENALTY)
    ridge[len(w) - len(words) :] = WORD_PENALTY
    ridge[0] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (bad - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    return model


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in textops.split_chunks(batch, "text"):
            shapes, row, hashes = measure(*textops.utf8(chunk.column("text")))
            order = np.lexsort((hashes, row))
            row, hashes = row[order], hashes[order]
            first = np.searchsorted(row, np.arange(len(chunk) + 1))
            words = [hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [chunk.column("of"), chunk.column("bad"), pa.array(list(shapes), pa.list_(pa.float64())), pa.array(_minima(row, hashes, len(chunk)), pa.list_(pa.int64())), pa.array(words, pa.binary())], names=["of", "bad", "shapes", "minima", "words"]
            )


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> Model | None:
    """A model of bad (quality 0 or toxic 1) from at most ``max_labelled`` rows.

    A key is bad if any of its labels says so, and good if all say so in both
    columns; labels that leave it open, by a null, are not used.  The sample is
    the keys with the least hash, so it is the same whenever it is drawn.  Of
    rows of one key that with the least text counts.  All words and stems of a
    text are counted, in Spark; what reaches the driver are shapes and minima of
    the sample's texts, the chosen words and who has them.  None if no label's document exists or all labels agree: nothing
    can then be learned.
    """
    is_bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1.0).when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), 0.0)
    known = labels.select(F.col(key).alias("of"), is_bad.alias("bad")).where("of is not null")
    chosen = known.groupBy("of").agg(F.max("bad").alias("bad"), F.count_if(F.col("bad").isNull()).alias("open")).where("bad = 1 or (bad = 0 and open = 0)").drop("open")
    chosen = chosen.orderBy(F.xxhash64("of"), "of").limit(max_labelled)
    joined = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("of"))
    joined = joined.groupBy("of").agg(F.max("bad").alias("bad"), F.min("text").alias("text")).withColumn("of", F.col("of").cast("string"))
    measured = runtime.cut(joined, textops.lean(_measured), "of string, bad double, shapes array<double>, minima array<bigint>, words binary")
    rows = sorted(map(tuple, measured.select("of", "bad", "shapes", "minima").collect()))
    bad = np.array([r[1] for r in rows])
    if not len(rows) or bad.min() == bad.max():
        return None
    once = ~_copies([r[3] for r in rows])
    words = _word_choice(measured, [r[0] for r, is_one in zip(rows, once, strict=True) if is_one], int(once.sum()), float(bad[once].sum()))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(w, np.uint64) for w in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("of"), pa.array([np.flatnonzero(np.isin(words, x)) for x in parts], pa.list_(pa.int64()))], names=["of", "places"])

    # Of each labelled text the numbers of the chosen words that it has.
    places = dict(map(tuple, measured.select("of", "words").mapInArrow(textops.lean(held), "of string, places array<bigint>").collect()))
    row = np.repeat(np.arange(len(rows)), [len(places[r[0]]) for r in rows])
    hashes = words[np.array([p for r in rows for p in places[r[0]]], np.int64)]
    return fit(np.array([r[2] for r in rows]), row, hashes, bad, words)


def _evidence(model: Model, text: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in textops.split_chunks(batch, text):
                made = model.evidence(*measure(*textops.utf8(chunk.column(text)), model.words))
                yield pa.RecordBatch.from_arrays([*(chunk.column(c) for c in columns), pa.array(made, pa.float64())], names=[*columns, "evidence"])

    return run


def _shrink(groups: DataFrame, share: str, toward) -> DataFrame:
    """Adds ``strength``: pseudo-rows that the spread of the groups warrants.

    By moments: the variance between groups beyond what sampling explains
    gives the Beta prior's weight, from 2 to 1000 rows.
    """
    m = toward * (1 - toward)
    spread = groups.agg(
        F.sum(F.col("n") * F.pow(F.col(share) - toward, 2)).alias("between"), F.sum(m).alias("within"), F.sum(F.col("n") * m).alias("scale")
    ).select(F.greatest(F.lit(1e-6), F.try_divide(F.col("between") - F.col("within"), F.col("scale"))).alias("rho"))
    strength = spread.select(F.least(F.lit(1000.0), F.greatest(F.lit(2.0), F.coalesce(1 / F.col("rho") - 1, F.lit(1000.0)))).alias("strength"))
    return groups.crossJoin(F.broadcast(strength))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """(``key``, ``text_hash``, ``evidence``, ``host_rate``, ``site_rate``, ``p_bad``, ``keep``) of every row.

    ``keep`` is false where the posterior of being bad exceeds ``threshold``.
    Null and empty texts have the shape of an empty one; a null host or path is
    a site of its own; rows repeated are judged alike.  Without a model (no
    usable labels) the evidence is 0, rates are null and all rows stay.
    Columns other than the named are not looked at.
    """
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col(text).alias("text"))
    model = train(docs, labels, key, text)
    if model is None:
        none = F.lit(None).cast("double")
        return rows.select(F.col("id").alias(key), "text_hash", F.lit(0.0).alias("evidence"), none.alias("host_rate"), none.alias("site_rate"), none.alias("p_bad"), F.lit(True).alias("keep"))
    columns = ["id", "text_hash", "host", "path"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*columns).schema) + ", evidence double"
    scored = runtime.cut(runtime.spread(rows), textops.lean(_evidence(model, "text", columns)), schema)
    # Rows with the evidence's probability under the sample's base rate.
    odds = F.exp(F.least(F.lit(30.0), F.greatest(F.lit(-30.0), F.col("evidence") + float(np.log(model.base / (1 - model.base))))))
    paths = runtime.cut(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(odds / (1 + odds)).alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("share", F.col("s") / F.col("n"))
    whole = paths.agg((F.sum("s") / F.sum("n")).alias("prior"))
    hosts = _shrink(hosts.crossJoin(F.broadcast(whole)), "share", F.col("prior"))
    hosts = runtime.cut(hosts.select(F.col("host").alias("of_host"), ((F.col("s") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength"))).alias("host_rate")))
    within = paths.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).withColumn("share", F.col("s") / F.col("n"))
    within = _shrink(within, "share", F.col("host_rate"))
    sites = runtime.cut(within.select(F.col("host").alias("site_host"), F.col("path").alias("site_path"), "host_rate", "s", "n", "strength"))
    if sites.count() <= MAX_BROADCAST_SITES:
        sites = F.broadcast(sites)
    met = scored.join(sites, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")))
    # A document's own probability is in its evidence, so its site speaks without it.
    rate = (F.col("s") - odds / (1 + odds) + F.col("strength") * F.col("host_rate")) / (F.col("n") - 1 + F.col("strength"))
    met = met.withColumn("site_rate", F.greatest(F.lit(0.0), rate))
    safe = F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col("site_rate")))
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + F.log(safe / (1 - safe)))))
    return met.withColumn("p_bad", posterior).select(F.col("id").alias(key), "text_hash", "evidence", "host_rate", "site_rate", "p_bad", (F.col("p_bad") <= threshold).alias("keep"))


def reject_bad(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, unchanged."""
    kept = classify(docs, labels, key, text, host, path, threshold).where("keep").select(F.col(key).alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    return docs.join(kept, docs[key].eqNullSafe(kept["kept_id"]) & (F.xxhash64(docs[text]) == kept["kept_hash"]), "left_semi")

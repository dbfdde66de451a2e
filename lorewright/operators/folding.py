"""The fold of reviews as an aggregate function of its own, in two stages."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


@F.arrow_udf(T.StringType())
def _part(seq: pa.Array, status: pa.Array, detail: pa.Array, created: pa.Array, pages: pa.Array) -> str:
    """What some items of a review come to, as JSON that ``_whole`` can put together."""
    out = {"n": len(seq), "resolved": False, "detail": None, "created": None, "pages": {}}
    for n, s, d, c, ps in zip(seq.to_pylist(), status.to_pylist(), detail.to_pylist(), created.to_pylist(), pages.to_pylist(), strict=True):
        out["resolved"] |= s == "resolved"
        if d:
            out["detail"] = min(filter(None, (out["detail"], [n, d])))
        if c:
            out["created"] = min(filter(None, (out["created"], c)))
        for place, page in enumerate(ps or ()):
            out["pages"][page] = min(filter(None, (out["pages"].get(page), [n, place])))
    return json.dumps(out)


@F.arrow_udf(T.StringType())
def _whole(parts: pa.Array) -> str:
    held = [json.loads(p) for p in parts.to_pylist()]
    least = lambda name: min((h[name] for h in held if h[name]), default=None)
    pages: dict[str, list[int]] = {}
    for h in held:
        for page, at in h["pages"].items():
            pages[page] = min(at, pages.get(page, at))
    detail = least("detail")
    return json.dumps({"n_items": sum(h["n"] for h in held), "status": "resolved" if any(h["resolved"] for h in held) else "open", "detail": detail[1] if detail else "", "created": least("created"), "pages": sorted(pages, key=pages.get)})


def fold_reviews(items: DataFrame, order: str = "seq", parts: int = 32) -> DataFrame:
    """As ``state.fold_reviews``: one row per review, by an aggregate function over Arrow arrays.

    Items are folded in ``parts`` shares of each review first, and the shares then;
    so no task holds all items of a review that has a great part of them.
    """
    keyed = items.withColumn("id", X.review_id(F.col("type"), F.col("title"))).withColumn("part", F.pmod(F.xxhash64(order), F.lit(parts)))
    shares = keyed.groupBy("id", "part").agg(_part(F.col(order).cast("long"), "status", "detail", "created", "pages").alias("said"))
    whole = shares.groupBy("id").agg(_whole("said").alias("said"))
    kind = "n_items long, status string, detail string, created string, pages array<string>"
    return whole.select("id", F.from_json("said", kind).alias("s")).select("id", "s.status", "s.detail", "s.created", "s.n_items", "s.pages")

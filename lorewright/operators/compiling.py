"""From materials to typed entries, with a pluggable text generator.

``generate(text) -> str`` stands for the model; ``stub`` is deterministic and
needs no network.  Parsing, checks and routing are columns of one DataFrame, so
accepted and rejected blocks come from one pass.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsers
from ..functions import text as X
from ..schema import CATEGORY_OF, RESERVED_NAMES


#: What separates words; other white space is part of them.
_GAP = re.compile(r"[ \t\n\f\r]+")


def _quoted(text: str) -> str:
    """A double-quoted YAML scalar on one line, whatever the text holds."""
    return '"' + "".join(f"\\{c}" if c in '"\\' else c if c == " " or c.isprintable() else f"\\U{ord(c):08x}" for c in text) + '"'


def stub(text: str) -> str:
    """Blocks as a model would write them: one entry per text, of a type by its length."""
    words = [w for w in _GAP.split(text) if w]
    kind = sorted(CATEGORY_OF)[len(words) % len(CATEGORY_OF)]
    title = " ".join(words[:6]) or "Untitled"
    slug = "-".join("".join(c for c in w.lower() if c.isalnum()) for w in words[:4]).strip("-") or "untitled"
    slug = f"{slug}-page" if slug.upper() in RESERVED_NAMES else slug
    body = " ".join(words[:80])
    # A mark or a fence that the text begins with is not one of the answer's.
    body = f"\\{body}" if body.startswith(("---", "```", "~~~")) else body
    page = f"---\ntype: {kind}\ntitle: {_quoted(title)}\ntags: []\n---\n# {title}\n\n{body}\n"
    return f"---FILE: knowledge/{CATEGORY_OF[kind]}/{slug}.md---\n{page}---END FILE---\n"


def generated(materials: DataFrame, generate: Callable[[str], str] = stub) -> DataFrame:
    """(``source_path``, ``output``, ``error``); a failure is a row's error, not the job's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["source_path"], b["content"], strict=True):
                try:
                    rows.append((path, generate(text or ""), None))
                except Exception as failure:  # noqa: BLE001  a plugged-in model may fail in any way
                    rows.append((path, None, str(failure)))
            yield pd.DataFrame(rows, columns=["source_path", "output", "error"])

    return materials.select("source_path", "content").mapInPandas(run, "source_path string, output string, error string")


def compiled(materials: DataFrame, generate: Callable[[str], str] = stub, filled: Column | None = None) -> DataFrame:
    """A row per block: ``source_path``, ``path``, ``type``, ``content``, ``reject``; materials that are not ``filled``, by default blank ones, give none."""
    filled = X.nonempty(F.col("content")).isNotNull() if filled is None else filled
    blocks = generated(materials.where(filled), generate).select("source_path", F.explode(parsers.file_blocks_of("output")).alias("b"))
    page = blocks.select("source_path", F.col("b.path").alias("path"), parsers.sanitized(F.col("b.content")).alias("content"))
    kind = X.strip(F.regexp_extract("content", r"(?m)\A---\s*\n(?:.*\n)*?type:[ \t]*(.*)$", 1))
    return page.withColumn("type", kind).withColumn("reject", X.routing_issue(F.col("path"), F.col("type")))


def detected_groups(summaries: DataFrame, generate: Callable[[str], str], size: int = 80) -> DataFrame:
    """Duplicate groups that a detector names, batch by batch: (``batch``, ``slugs``, ``confidence``)."""
    from . import merge

    batches = merge.overlapping_batches(summaries, ["title", "slug"], size)
    text = batches.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", F.concat_ws(" | ", "slug", "title").alias("line")))), lambda x: x["line"]), "\n").alias("content"))
    asked = generated(text.select(F.col("batch").cast("string").alias("source_path"), "content"), generate)

    def parse(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            found = [(int(k), g["slugs"], g["confidence"]) for k, t in zip(b["source_path"], b["output"], strict=True) for g in parsers.duplicate_groups(t or "")]
            yield pd.DataFrame(found, columns=["batch", "slugs", "confidence"])

    return asked.mapInPandas(parse, "batch long, slugs array<string>, confidence string")

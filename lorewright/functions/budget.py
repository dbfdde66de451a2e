"""Sizes and tiers as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shares and bounds of the prompt budget.
DEFAULT_CONTEXT = 204_800
GENERATION = ((512_000, 32_768), (256_000, 24_576), (128_000, 16_384), (0, 8_192))


def _part(c: Column, share: float) -> Column:
    return F.floor(c * F.lit(share)).cast("long")


def context(size: Column) -> Column:
    return F.when(size > 0, size).otherwise(F.lit(DEFAULT_CONTEXT)).cast("long")


def budgets(size: Column) -> dict[str, Column]:
    """The five parts of a context of ``size`` characters."""
    whole = context(size)
    pages = _part(whole, 0.5)
    return {"max_ctx": whole, "response_reserve": _part(whole, 0.15), "index_budget": _part(whole, 0.05), "page_budget": pages, "max_page_size": F.least(pages, F.greatest(F.lit(5000).cast("long"), _part(pages, 0.3)))}


def source_budget(size: Column, stable: Column) -> Column:
    """Characters of source that fit beside reserves, 8,000 at least."""
    whole = context(size)
    least, floor = F.lit(12_000).cast("long"), F.lit(8_000).cast("long")
    left = whole - _part(whole, 0.15) - F.least(_part(whole, 0.25), F.greatest(least, stable)) - F.greatest(least, _part(whole, 0.08))
    return F.greatest(floor, F.least(F.lit(300_000).cast("long"), F.greatest(floor, _part(whole, 0.6)), left))


def chunk_sizes(budget: Column) -> tuple[Column, Column]:
    """Target and overlap of chunks."""
    target = F.greatest(F.lit(12_000).cast("long"), F.least(F.lit(60_000).cast("long"), _part(budget, 0.55)))
    return target, F.greatest(F.lit(800).cast("long"), F.least(F.lit(3_000).cast("long"), _part(target, 0.08)))


def tier(value: Column, steps: tuple[tuple[float, float], ...], strict: bool = False) -> Column:
    """The result of the first step whose bound the value reaches (or passes)."""
    out = None
    for bound, result in steps:
        ok = value > bound if strict else value >= bound
        out = F.when(ok, F.lit(result)) if out is None else out.when(ok, F.lit(result))
    return out


def generation_tokens(size: Column) -> Column:
    return tier(context(size), GENERATION)


def review_tokens(size: Column) -> Column:
    return F.least(F.lit(8_192), F.greatest(F.lit(4_096), F.floor(generation_tokens(size) / 2).cast("int")))


def layout_iterations(nodes: Column) -> Column:
    return tier(nodes, ((2500, 28), (1200, 40), (600, 65), (250, 90), (-1, 140)), strict=True)


def label_density(nodes: Column) -> Column:
    return tier(nodes, ((2500, 0.08), (1200, 0.14), (600, 0.24), (-1, 0.4)), strict=True)


def node_size(degree: Column, top: Column, nodes: Column) -> Column:
    scale = F.when(nodes <= 150, F.lit(1.0)).otherwise(F.greatest(F.lit(0.35), F.sqrt(150.0 / nodes)))
    return (8 + F.sqrt(degree / F.greatest(F.lit(1), top)) * 20) * scale

"""Windows of tokens over a text, as one column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

SIZE, OVERLAP = 1200, 100
_BLANK = X.SPACE[1:-1]
_IDEOGRAPH = r"\x{3400}-\x{9fff}"
#: A token, which is one ideograph or a run of other characters, and the white space after it.
PIECE = rf"(?:[{_IDEOGRAPH}]|[^{_BLANK}{_IDEOGRAPH}]+)[{_BLANK}]*"


def token_windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of (``index`` from 1, ``tokens``, ``main``): windows of ``size`` tokens, each with the last ``overlap`` of the one before it.

    ``main`` is the text from the window's first token to its last.  A text
    without tokens, null too, has no windows; none but the first is all overlap.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))
    step = size - overlap
    # Bound once by transform, so that the text is taken apart once.
    made = F.transform(F.array(pieces), lambda p: F.transform(
        F.when(F.size(p) > 0, F.sequence(F.lit(0), F.floor(F.greatest(F.size(p) - overlap - 1, F.lit(0)) / step).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda n: F.struct((n + 1).alias("index"), F.least(F.lit(size), F.size(p) - n * step).alias("tokens"), F.rtrim(F.array_join(F.slice(p, n * step + 1, size), ""), F.lit(X.SPACES)).alias("main")),
    ))
    return F.element_at(made, 1)


def windows_sql(text: str, size: int = SIZE, overlap: int = OVERLAP) -> tuple[str, str]:
    """DuckDB SQL of the same: an expression for the pieces ``p``, and one for the list of windows of them."""
    step = size - overlap
    pieces = f"regexp_extract_all(coalesce({text}, ''), '{PIECE}')"
    trimmed = f"regexp_replace(array_to_string(p[n * {step} + 1 : n * {step} + {size}], ''), '[{_BLANK}]+$', '')"
    made = f"list_transform(range(0, case when len(p) = 0 then 0 else greatest(len(p) - {overlap} - 1, 0) // {step} + 1 end), lambda n: {{'index': n + 1, 'tokens': least({size}, len(p) - n * {step}), 'main': {trimmed}}})"
    return pieces, made

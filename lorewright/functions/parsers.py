"""Parsers of marked-up text, in Python, for what expressions can't say.

Each is a plain function on a string; ``column`` makes an Arrow-batched column
function of it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..schema import CHUNK, FILE_BLOCK, RESERVED_NAMES, REVIEW_BLOCK, REVIEW_TYPES
from . import chunking, pages
from .chunking import chunks, overlap, semantic_blocks, split_long
from .pages import ci_union, fold_arrays, front_matter, inline_items, light_front_matter, read_array, sanitize, write_array, write_scalar

__all__ = ["chunks", "ci_union", "fold_arrays", "front_matter", "inline_items", "light_front_matter", "overlap", "read_array", "sanitize", "semantic_blocks", "split_long", "write_array", "write_scalar"]


#: Texts of a batch that are Python objects at once; the rest of it stays in Arrow.
SLICE = 256


def column(fn: Callable, kind: T.DataType) -> Callable[[Column], Column]:
    """A column function that applies ``fn`` to each text of a batch, so many at once; null to null, and as "" where ``kind`` is a struct."""
    to = to_arrow_type(kind)

    def one(text):
        if text is None and not isinstance(kind, T.StructType):
            return None
        out = fn("" if text is None else text)
        return list(out.items()) if isinstance(kind, T.MapType) and out is not None else out

    @F.arrow_udf(kind)
    def apply(texts: pa.Array) -> pa.Array:
        made = [pa.array([one(t) for t in texts.slice(n, SLICE).to_pylist()], to) for n in range(0, len(texts), SLICE)]
        return pa.concat_arrays(made) if made else pa.array([], to)

    return apply


def nfkc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


# --- blocks -----------------------------------------------------------------


def safe_path(path: str) -> bool:
    """Below ``knowledge/``, without steps up, and writable on any system."""
    parts = path.replace("\\", "/").split("/")
    if parts[0] != "knowledge" or len(parts) < 2 or re.search(r"[\x00-\x1f]", path):
        return False
    return all(p and p != ".." and not re.search(r'[<>:"|?*]|[ .]$', p) and p.split(".")[0].upper() not in RESERVED_NAMES for p in parts)


_FILE = re.compile(r"(?im)^---[^\S\n]*FILE:[^\S\n]*(.+?)[^\S\n]*---[^\S\n]*$")
#: In a block: a code fence up to the one that closes it, or to the end; else the line that ends the block.
_FENCE_OR_END = re.compile(r"(?ims)^[^\S\n]{0,3}(?P<fence>`{3,}|~{3,})(?:.*?^[^\S\n]{0,3}(?P=fence)[^\n]*$|.*\Z)|^---[^\S\n]*END[^\S\n]+FILE[^\S\n]*---[^\S\n]*$")


def file_blocks(text: str) -> dict:
    """``blocks`` (path, content), ``warnings`` and ``truncated`` paths of the
    ``---FILE: path---`` blocks; a closing line inside a code fence closes nothing."""
    text, at = text.replace("\r\n", "\n"), 0
    found: list[tuple[str, str | None]] = []
    while start := _FILE.search(text, at):
        end = next((m for m in _FENCE_OR_END.finditer(text, start.end()) if m["fence"] is None), None)
        found.append((start[1].strip().replace("\\", "/"), text[start.end() + 1 : end.start() - 1] if end else None))
        at = end.end() if end else len(text)
    closed = [(p, c) for p, c in found if c is not None]
    return {
        "blocks": [{"path": p, "content": c} for p, c in closed if safe_path(p)],
        "warnings": [f"unclosed: {p}" if c is None else f"unsafe: {p}" if p else "empty path" for p, c in found if c is None or not safe_path(p)],
        "truncated": [p for p, c in found if c is None and safe_path(p)],
    }


#: How the lines of a review name its lists, and what parts their items.
_LISTS = {"OPTIONS": ("options", "|"), "PAGES": ("pages", ","), "SEARCH": ("search", "|")}
_REVIEW_START = re.compile(r"---REVIEW:\s*([\w-]+)\s*\|(.*?)---\s*", re.A)


def review_blocks(text: str) -> list[dict]:
    """Items of the ``---REVIEW: type | title---`` blocks that are closed.

    Types that are not known are ``confirm``.  Lines ``OPTIONS:``, ``PAGES:`` and
    ``SEARCH:`` give lists; the others are the detail.
    """
    out, item, detail = [], None, []
    for line in text.replace("\r\n", "\n").split("\n"):
        if item is None:
            if (start := _REVIEW_START.fullmatch(line)) and start[2].strip():
                kind = start[1].lower()
                item, detail = {"type": kind if kind in REVIEW_TYPES else "confirm", "title": start[2].strip()}, []
            continue
        name, colon, rest = line.partition(":")
        if line.startswith("---END REVIEW---"):
            lists = {"options": ["Approve", "Skip"], "pages": [], "search": []}
            out.append(lists | item | {"detail": "\n".join(detail).strip()})
            item = None
        elif colon and name in _LISTS:
            to, part = _LISTS[name]
            if values := [x.strip() for x in rest.split(part) if x.strip()]:
                item[to] = values
        else:
            detail.append(line)
    return out


# --- JSON answers -----------------------------------------------------------


def first_object(text: str) -> str | None:
    """The first balanced ``{...}``; braces in strings do not count."""
    depth, begin = 0, None
    for m in re.finditer(r'"(?:\\.|[^"\\])*"|[{}]', text[text.find("{") :] if "{" in text else "", re.S):
        if m[0] == "{":
            begin = m.start() if begin is None else begin
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth == 0:
                return text[text.find("{") :][begin : m.end()]
    return None


def _answer(text: str, key: str) -> list[dict]:
    try:
        found = json.loads(first_object(text) or "null")
    except ValueError:
        return []
    rows = found.get(key) if isinstance(found, dict) else None
    return [x for x in rows if isinstance(x, dict)] if isinstance(rows, list) else []


def duplicate_groups(text: str) -> list[dict]:
    out = []
    for g in _answer(text, "groups"):
        slugs = [s for s in g["slugs"] if isinstance(s, str)] if isinstance(g.get("slugs"), list) else []
        if len(slugs) > 1:
            out.append({"slugs": slugs, "reason": g["reason"] if isinstance(g.get("reason"), str) else "", "confidence": g.get("confidence") if g.get("confidence") in ("high", "medium") else "low"})
    return out


def proposed_links(text: str) -> list[dict]:
    rows = [(g.get("term"), g.get("target")) for g in _answer(text, "links")]
    return [{"term": a, "target": b} for a, b in rows if isinstance(a, str) and isinstance(b, str) and a.strip() and b.strip()]


# --- links in text ----------------------------------------------------------

_LINK = re.compile(r"\[\[([^\]|]+?)(\|[^\]]+?)?\]\]")


def clean_target(target: str) -> str:
    target = re.sub(r"\Aknowledge/", "", target.replace("\\", "/"), flags=re.I)
    return re.sub(r"\.md\Z", "", target, flags=re.I).strip()


def rewrite_target(text: str, old: str, new: str) -> str:
    """Links to ``old`` point to ``new``; aliases and all else stay."""
    key, to = clean_target(old).lower(), clean_target(new)
    return _LINK.sub(lambda m: f"[[{to}{m[2] or ''}]]" if clean_target(m[1]).lower() == key else m[0], text)


def append_link(text: str, target: str) -> str:
    """A link under the ``## Related`` heading, made if missing; no second one."""
    to = clean_target(target)
    if any(clean_target(m[1]).lower() == to.lower() for m in _LINK.finditer(text)):
        return text
    if m := re.search(r"^##\s+Related\s*$", text, re.I | re.M):
        return f"{text[: m.end()]}\n- [[{to}]]{text[m.end() :]}"
    return f"{text.rstrip()}\n\n## Related\n- [[{to}]]\n"


def linkify(text: str, links: list[tuple[str, str]]) -> tuple[str, list[str]]:
    """First occurrences of terms outside links become links, one per target; the header stays."""
    page = pages.Page.of(text)
    body = page.rest if page else text
    head, done = text[: len(text) - len(body)], {}
    for term, target in links:
        if not term or target.lower() in done:
            continue
        # Odd parts are links, or what an open bracket begins.
        parts = re.split(r"(\[\[.*?(?:\]\]|\Z))", body, flags=re.S)
        free = next((n for n in range(0, len(parts), 2) if term in parts[n]), None)
        if free is not None:
            link = f"[[{term}]]" if term.lower() == target.lower() else f"[[{target}|{term}]]"
            parts[free] = parts[free].replace(term, link, 1)
            body, done[target.lower()] = "".join(parts), target
    return head + body, list(done.values())


def markdown_links(text: str) -> str:
    """``[[target|label]]`` as ``[label](#target)``, code left alone."""

    def one(m: re.Match) -> str:
        if m[1] is None:
            return m[0]
        target, label = m[1].strip(), (m[2] or "").strip()
        return "[" + re.sub(r"([\[\]])", r"\\\1", label or target) + "](#" + quote(target, safe="-_.!~*'()") + ")"

    return re.sub(r"```[\s\S]*?```|`[^`\n]+`|\[\[([^\]|\n]+)(?:\|([^\]\n]*))?\]\]", one, text)


def unwrap_link(text: str) -> tuple[str, str]:
    m = re.fullmatch(r"\[\[([^\]|]+)(?:\|([^\]]*))?\]\]", text)
    return (m[1].strip(), (m[2] or "").strip() or m[1].strip()) if m else (text, text)


# --- bytes and columns -------------------------------------------------------


def decode(data: bytes) -> str:
    """UTF-8, else GBK, else Latin-1."""
    for name in ("utf-8", "gbk"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


_STRINGS = T.ArrayType(T.StringType())


def _rows(fields: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ANSWER = _rows({"blocks": T.ArrayType(FILE_BLOCK), "warnings": _STRINGS, "truncated": _STRINGS})
GROUP = _rows({"slugs": _STRINGS, "reason": T.StringType(), "confidence": T.StringType()})
LINK = _rows({"term": T.StringType(), "target": T.StringType()})
LINKED = _rows({"text": T.StringType(), "done": _STRINGS})

answer_blocks = column(file_blocks, ANSWER)
file_blocks_of = column(lambda t: file_blocks(t)["blocks"], T.ArrayType(FILE_BLOCK))
review_blocks_of = column(review_blocks, T.ArrayType(REVIEW_BLOCK))
groups_of = column(duplicate_groups, T.ArrayType(GROUP))
links_of = column(proposed_links, T.ArrayType(LINK))
object_of = column(first_object, T.StringType())
sanitized = column(sanitize, T.StringType())
as_markdown = column(markdown_links, T.StringType())
decoded = column(lambda b: decode(bytes(b)), T.StringType())
full_header = column(pages.full_header, T.MapType(T.StringType(), T.StringType()))
header_map = column(lambda t: {k: ",".join(v) if isinstance(v, list) else v for k, v in light_front_matter(t).items()}, T.MapType(T.StringType(), T.StringType()))


def stream_line_of(line: Column) -> Column:
    """``delta``, ``done``, ``error``, ``finish`` and ``tokens`` of a ``data:`` line of an event stream.

    ``finish`` says why the answer ends, ``tokens`` how many it all took; both are
    null in lines that do not say so.  Lines of another kind give nothing.
    """
    body = F.nullif(F.trim(F.regexp_extract(line, r"(?s)^\s*data:(.*)$", 1)), F.lit(""))
    said = F.try_parse_json(body)
    at = lambda path, kind: F.try_variant_get(said, path, kind)
    content = "$.choices[0].delta.content"
    parts = F.array_join(F.transform(at(content, "array<struct<text: string>>"), lambda x: x["text"]), "")
    text = F.when(F.schema_of_variant(F.try_variant_get(said, content, "variant")) == "STRING", at(content, "string"))
    error = F.coalesce(at("$.error.message", "string"), at("$.error", "string"), F.lit(""))
    delta = F.when(error == "", F.coalesce(parts, text, F.lit(""))).otherwise(F.lit(""))
    return F.struct(delta.alias("delta"), F.coalesce(body == "[DONE]", F.lit(False)).alias("done"), error.alias("error"), at("$.choices[0].finish_reason", "string").alias("finish"), at("$.usage.total_tokens", "bigint").alias("tokens"))


def nfkc_of(c: Column) -> Column:
    """The text in compatible form; only texts with other than ASCII characters leave the JVM."""
    return F.coalesce(_NFKC(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)


_NFKC = column(nfkc, T.StringType())


def rewritten(old: str, new: str) -> Callable[[Column], Column]:
    return column(lambda t: rewrite_target(t, old, new), T.StringType())


def appended(target: str) -> Callable[[Column], Column]:
    return column(lambda t: append_link(t, target), T.StringType())


def linkified(links: list[tuple[str, str]]) -> Callable[[Column], Column]:
    """A struct of ``text`` and ``done``, the targets that were linked."""
    return column(lambda t: dict(zip(LINKED.names, linkify(t, links), strict=True)), LINKED)


def header_list(name: str) -> Callable[[Column], Column]:
    return column(lambda t: read_array(t, name), _STRINGS)


def with_list(name: str, values: list[str]) -> Callable[[Column], Column]:
    return column(lambda t: write_array(t, name, values), T.StringType())


def with_scalar(name: str, value: str) -> Callable[[Column], Column]:
    return column(lambda t: write_scalar(t, name, value), T.StringType())


def pieces_of(target: int) -> Callable[[Column], Column]:
    return column(lambda t: split_long(t, target), _STRINGS)


@F.pandas_udf(T.StringType())
def folded(new: pd.Series, old: pd.Series) -> pd.Series:
    """Each page with the lists of an older one's header, which may be null."""
    return pd.Series([fold_arrays(n, o) if n is not None else None for n, o in zip(new, old, strict=True)], dtype=object)


def chunks_of(text: Column, target: int = 1200, overlap_chars: int = 100) -> Column:
    return column(lambda t: chunking.chunks(t, target, overlap_chars), T.ArrayType(CHUNK))(text)

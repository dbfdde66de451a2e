"""Text functions on columns.

All stay in the JVM, but for the compatible form (NFKC) of texts that have other
than ASCII characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CATEGORY_OF, RESERVED_NAMES
from .parsers import nfkc_of

# Scores, limits and patterns of link suggestions and guards.
SAME_NAME, CONTAINED = 0.96, 0.82
ENTRY_ROOT = "knowledge/"
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1680}]"
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
USAGE_LIMIT = r"(?i)\b429\b|rate[_\s-]*limit|usage\s+limit|quota|too many requests"
REVIEW_PREFIX = "(?i)^(missing[\\s-]?page[:：]\\s*|duplicate[\\s-]?page[:：]\\s*|possible[\\s-]?duplicate[:：]\\s*|缺失页面[:：]\\s*|缺少页面[:：]\\s*|重复页面[:：]\\s*|疑似重复[:：]\\s*)"
CJK = "[\\x{4e00}-\\x{9fff}]"
CJK_TOKEN = "[\\x{3400}-\\x{9fff}]"
#: Fixed value: the fields in which services tell of reasoning, and their text as it is written.
REASONING = r'"(?:reasoning_content|reasoning)"\s*:\s*"((?:[^"\\]|\\.)*)"'
TRIM_MARK = "\n\n[...trimmed for prompt budget...]"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(SPACES))


def nonempty(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def base_name(c: Column) -> Column:
    return F.substring_index(F.replace(c, F.lit("\\"), F.lit("/")), "/", -1)


def clean_target(c: Column) -> Column:
    """A link's target as a path: slashes, no root folder, no suffix, case kept."""
    return strip(F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), f"^(?i){ENTRY_ROOT}", ""), r"(?i)\.md$", ""))


def normal_target(c: Column) -> Column:
    return F.lower(clean_target(c))


def strip_suffix(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)\.md$", "")


def link_key(c: Column) -> Column:
    """Key of a proposed link: before ``|`` and ``#``, last part, lower-cased."""
    return F.lower(strip(strip_suffix(base_name(strip(F.regexp_replace(nfkc_of(c), r"[|#][\s\S]*$", ""))))))


def similarity(a: Column, b: Column) -> Column:
    """0 to 1 between two targets; the edit distance is the last resort."""
    return alike(normal_target(a), normal_target(b))


def alike(x: Column, y: Column, p: Column | None = None, q: Column | None = None, least: float = 0.0) -> Column:
    """``similarity`` of targets that are normal ones, whose last parts may be given; what their lengths keep below ``least`` is 0."""
    p, q = base_name(x) if p is None else p, base_name(y) if q is None else q
    longest = F.greatest(F.length(p), F.length(q))
    return (
        F.when((x == "") | (y == "") | x.isNull() | y.isNull(), F.lit(0.0))
        .when(x == y, F.lit(1.0))
        .when(p == q, F.lit(SAME_NAME))
        .when(F.contains(x, y) | F.contains(y, x), F.lit(CONTAINED))
        .when((F.length(p) < 5) | (F.length(q) < 5), F.lit(0.0))
        .when(1 - F.abs(F.length(p) - F.length(q)).cast("double") / longest < least, F.lit(0.0))
        .otherwise(1 - F.levenshtein(p, q).cast("double") / longest)
    )


def bigrams(c: Column) -> Column:
    """Distinct character pairs, in order; one character stands alone."""
    t = normal_target(nfkc_of(c))
    # A look-ahead takes every pair without using it up.
    pairs = F.regexp_extract_all(t, F.lit("(?s)(?=(..))"), F.lit(1))
    return F.when(F.length(t) < 2, F.filter(F.array(t), lambda x: x != "")).otherwise(F.array_distinct(pairs))


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits of two or more; a run with CJK also gives its characters."""
    runs = F.filter(F.regexp_extract_all(F.lower(nfkc_of(c)), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1)), lambda x: (F.length(x) >= 2) | x.rlike(CJK_TOKEN))
    chars = F.flatten(F.transform(F.filter(runs, lambda x: x.rlike(CJK_TOKEN)), lambda x: F.filter(F.split(x, ""), lambda y: y != "")))
    return F.array_distinct(F.concat(F.filter(runs, lambda x: F.length(x) >= 2), chars))


def wikilinks(c: Column) -> Column:
    """Targets of ``[[target]]`` and ``[[target|alias]]``, trimmed, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[\[([^\]|]+?)(\|[^\]]+?)?\]\]"), F.lit(1)), strip)


def slugify(c: Column) -> Column:
    """A text as part of a file name; ``query`` where nothing is left."""
    return _slug(nfkc_of(c))


def _slug(c: Column) -> Column:
    t = F.regexp_replace(strip(c), rf"{SPACE}", "-")
    t = F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}-]", ""), "-+", "-")
    return F.coalesce(F.nullif(F.left(F.lower(F.regexp_replace(t, "^-+|-+$", "")), F.lit(50)), F.lit("")), F.lit("query"))


def entry_filename(title: Column, at: Column) -> Column:
    return F.concat(slugify(title), F.date_format(at, "-yyyy-MM-dd-HHmmss"), F.lit(".md"))


def collapse_space(c: Column) -> Column:
    """Runs of blanks to one, blank lines to one line break."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t\r\f\x{0b}]+", " "), r"\s*\n\s*", "\n"))


def content_id(c: Column) -> Column:
    return F.left(F.sha1(c.cast("binary")), F.lit(12))


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def review_title(c: Column) -> Column:
    return F.lower(strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, rf"^{SPACE}+", ""), REVIEW_PREFIX, ""), rf"{SPACE}+", " ")))


def review_id(kind: Column, title: Column) -> Column:
    return F.concat(kind, F.lit("::"), review_title(title))


def group_key(slugs: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(slugs, F.lower)), ",")


def truncated(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 1)), F.lit("…"))).otherwise(c)


def trim_long(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.regexp_replace(F.left(c, F.lit(n)), f"{SPACE}+$", ""), F.lit(TRIM_MARK))).otherwise(c)


def first_body_line(c: Column) -> Column:
    """The first line that is neither blank nor a heading nor a table row."""
    lines = F.transform(F.split(c, "\n"), strip)
    return F.coalesce(F.try_element_at(F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^[#|]")), F.lit(1)), F.lit(""))


def title_of(meta_title: Column, body: Column, slug: Column) -> Column:
    heading = F.regexp_extract(body, r"(?m)^#\s+(.+)$", 1)
    return F.coalesce(nonempty(meta_title), nonempty(heading), F.regexp_replace(slug, "[-_]+", " "))


def marked_section(c: Column, heading: str) -> Column:
    return strip(F.regexp_extract(c, rf"(?is)(?:^|\n)##\s+{heading}\s*\n(.*?)(?=\n##\s|\z)", 1))


def block_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("---FILE:\\s*[^-]+---"))


def wants_review(c: Column) -> Column:
    """Long, or of many file blocks, or ending in an open review block."""
    return (F.length(c) >= 10_000) | (block_count(c) >= 4) | c.rlike(r"(?i)---REVIEW:\s*[A-Za-z0-9_-]+\s*\|")


def usage_limited(c: Column) -> Column:
    return F.coalesce(c.rlike(USAGE_LIMIT), F.lit(False))


def matches_language(body: Column, script: str = CJK, ratio: float = 0.15, sample: int = 1500, least: int = 20) -> Column:
    """Whether enough of a sample, code and formulas aside, is in a script."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"```[\s\S]*?```", ""), r"\$\$[\s\S]*?\$\$", ""), r"\$[^$\n]*\$", "")
    part = F.left(strip(plain), F.lit(sample))
    return (F.length(part) < least) | (F.regexp_count(part, F.lit(script)) / F.length(part) >= ratio)


def routing_issue(path: Column, kind: Column) -> Column:
    """Why an entry's path does not fit its type; null if it does."""
    parts = F.split(path, "/")
    folder = F.try_element_at(parts, F.lit(2))
    known = F.create_map(*[x for k, v in CATEGORY_OF.items() for x in (F.lit(k), F.lit(v))])
    return (
        F.when((F.size(parts) != 3) | ~F.coalesce(F.try_element_at(parts, F.lit(3)).endswith(".md"), F.lit(False)), F.lit("path"))
        .when(~folder.isin(*CATEGORY_OF.values()), F.concat(F.lit("folder "), folder))
        .when(~F.coalesce(F.try_element_at(known, F.lower(strip(kind))) == folder, F.lit(False)), F.concat(F.lit("type "), F.coalesce(F.nullif(F.lower(strip(kind)), F.lit("")), F.lit("missing"))))
    )


def safe_path(path: Column) -> Column:
    """Whether a path may be written on any system below the entries' folder."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.split(p, "/")
    bad = lambda s: (s == "") | (s == "..") | s.rlike(r'[<>:"|?*]') | s.rlike(r"[ .]$") | F.upper(F.substring_index(s, ".", 1)).isin(*RESERVED_NAMES)
    return F.coalesce(p.startswith(ENTRY_ROOT) & ~path.rlike(r"[\x{00}-\x{1f}]") & ~F.exists(parts, bad), F.lit(False))


def stub_title(slug: Column) -> Column:
    return F.coalesce(nonempty(F.regexp_replace(base_name(clean_target(slug)), "[-_]+", " ")), F.lit("Missing Page"))


def stub_path(slug: Column) -> Column:
    parts = F.transform(F.split(clean_target(nfkc_of(slug)), "/"), _slug)
    return F.concat(F.lit("queries/"), F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("missing-page")), F.lit(".md"))


def stamp_dates(c: Column, today: str) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\bYYYY-MM-DD\b", today), r"\b\d{4}-\d{2}-\d{2}\b", today)


def stamped_sources(sources: Column, identity: Column) -> Column:
    kept = F.filter(F.transform(F.coalesce(sources, F.array().cast("array<string>")), strip), lambda x: x != "")
    return F.when(F.array_contains(kept, identity), kept).otherwise(F.concat(kept, F.array(identity)))


def message_text(content: Column) -> Column:
    """``text`` of a JSON object ("" if it has none), or the content itself."""
    parsed = F.try_parse_json(content)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    return F.when(parsed.isNull() | ~is_object, content).otherwise(F.coalesce(F.try_variant_get(parsed, "$.text", "string"), F.lit("")))


def reasoning_chars(line: Column) -> Column:
    """Characters, as they are written, of the reasoning fields of a line of an event stream."""
    found = F.regexp_extract_all(F.coalesce(line, F.lit("")), F.lit(REASONING), F.lit(1))
    return F.aggregate(found, F.lit(0).cast("long"), lambda n, x: n + F.length(x))


def human_bytes(n: Column, largest: str = "MB") -> Column:
    """Bytes in the unit that makes them short, up to the ``largest``, KB or MB."""
    small = F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB"))
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    return out.otherwise(small) if largest == "KB" else out.when(n < 1024 * 1024, small).otherwise(F.concat(F.format_string("%.1f", n / 1048576), F.lit(" MB")))


def safe_relative(path: Column) -> Column:
    """Whether a material's path stays below its folder and is Markdown."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.coalesce(~p.startswith("/") & ~p.rlike("^[A-Za-z]:") & ~F.array_contains(F.split(p, "/"), "..") & p.endswith(".md"), F.lit(False))


def compiled_flag(text: Column) -> Column:
    """The ``compiled:`` line of the header alone."""
    header = F.concat(F.regexp_extract(text, r"^---\r?\n([\s\S]*?)\r?\n---", 1), F.lit("\n"))
    return F.lower(strip(F.regexp_extract(header, r"(?:^|\n)compiled:([^\n]*)\n", 1))) == "true"


def marked_compiled(text: Column) -> Column:
    """The text with its header's flag set to true; added if it has none."""
    flagged = text.rlike(r"^---\r?\n(?s:.*?)(?m:^compiled:)")
    return F.when(flagged, F.regexp_replace(text, r"(?s)^(---\r?\n(?:.*?\n)?)compiled:[^\n]*", "$1compiled: true")).when(text.startswith("---\n"), F.concat(F.lit("---\ncompiled: true\n"), F.substr(text, F.lit(5)))).otherwise(text)

"""Pages as lines: a header of fields, and a body.

A header is what stands between two ``---`` lines at the start.  ``Page`` splits
it into fields once, each with the lines that belong to it, and every reader
and writer of fields works on that list; lines that no one sets come out as they
went in.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace

FENCE = "---"
# Fields that a page may begin with, and how far its end mark may be.
KNOWN_FIELDS = ("type", "title", "created", "updated", "tags", "related", "sources")
HEADER_LINES = 30
# What the fence around a whole page may be marked as.
FENCE_MARKS = ("", "yaml", "yml", "md", "markdown")

_NAME = re.compile(r"[A-Za-z_][\w-]*(?=[ \t]*:)")


def _bare(line: str) -> str:
    return line.rstrip("\r\n")


def _is_mark(line: str) -> bool:
    return line.strip() == FENCE


@dataclass(frozen=True)
class Field:
    """A field's name ("" for lines before any) and its lines, ends included."""

    name: str
    lines: tuple[str, ...]

    @property
    def value(self) -> str:
        """What follows the colon on the first line."""
        return _bare(self.lines[0]).partition(":")[2].strip()

    def items(self) -> list[str]:
        """The values of a list, inline or a line each; [] of anything else."""
        if self.value.startswith("["):
            inside = "".join(map(_bare, self.lines)).partition("[")[2]
            return inline_items(inside[: inside.rfind("]")] if "]" in inside else inside)
        dashed = [line.strip() for line in self.lines[1:]]
        return [] if self.value else [x for d in dashed if d.startswith("-") and (x := unquoted(d[1:]))]

    @property
    def is_list(self) -> bool:
        return self.value.startswith("[") or not self.value and any(line.strip().startswith("-") for line in self.lines[1:])


@dataclass(frozen=True)
class Page:
    """The opening line, the header's fields, and the rest from the closing line on."""

    opening: str
    fields: tuple[Field, ...]
    rest: str

    @classmethod
    def of(cls, text: str) -> Page | None:
        """The page of a text, or None if it has no whole header."""
        lines = text.splitlines(keepends=True)
        if not lines or not _is_mark(lines[0]):
            return None
        end = next((n for n, line in enumerate(lines[1:], 1) if _is_mark(line)), None)
        if end is None:
            return None
        grouped: list[tuple[str, list[str]]] = []
        for line in lines[1:end]:
            if name := _NAME.match(line):
                grouped.append((name[0], [line]))
            elif grouped:
                grouped[-1][1].append(line)
            else:
                grouped.append(("", [line]))
        return cls(lines[0], tuple(Field(n, tuple(own)) for n, own in grouped), "".join(lines[end:]))

    def text(self) -> str:
        return self.opening + "".join(line for f in self.fields for line in f.lines) + self.rest

    @property
    def header(self) -> str:
        return "".join(line for f in self.fields for line in f.lines)

    @property
    def body(self) -> str:
        return self.rest.partition("\n")[2]

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def having(self, name: str, value: str) -> Page:
        """With the field set, in its place or as the last one."""
        new = Field(name, (f"{name}: {value}" + self.opening[len(_bare(self.opening)) :],))
        if self.field(name) is None:
            return replace(self, fields=(*self.fields, new))
        return replace(self, fields=tuple(new if f.name == name else f for f in self.fields))


def unquoted(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


#: What an inline list is made of: runs in double or single quotes, which the end may close, commas, and other runs.
_PART = re.compile(r"""(?s)"((?:\\.?|[^"\\])*)"?|'([^']*)'?|(,)|([^,"']+)""")


def inline_items(body: str) -> list[str]:
    """Items between commas; quotes hold commas, in double ones a backslash its next character."""
    items = [""]
    for double, single, comma, bare in _PART.findall(body):
        if comma:
            items.append("")
        else:
            items[-1] += re.sub(r"(?s)\\(.?)", r"\1", double) + single + bare
    return [x for x in map(str.strip, items) if x]


def header_and_body(text: str) -> tuple[str | None, str]:
    page = Page.of(text)
    return (page.header, page.body) if page else (None, text)


def front_matter(text: str) -> tuple[dict, str]:
    """Header as a dict and the body; what is no valid header is all body."""
    import yaml

    page = Page.of(text)
    try:
        meta = yaml.safe_load(page.header) if page else None
    except yaml.YAMLError:
        meta = None
    return (meta, page.body) if isinstance(meta, dict) else ({}, text)


def _yaml(header: str) -> object:
    """A header by the YAML library's C parser, where it has one; what that rejects goes to the other, which decides."""
    import yaml

    for loader in (getattr(yaml, "CBaseLoader", yaml.BaseLoader), yaml.BaseLoader):
        try:
            return yaml.load(header, Loader=loader)
        except yaml.YAMLError:
            continue
    return None


def full_header(text: str) -> dict[str, str]:
    """A header's fields as they are written, in full YAML: lists of words joined by commas, what is deeper as JSON.

    What is no valid header gives none.  Without a YAML library, plain lines are read.
    """
    try:
        import yaml  # noqa: F401
    except ImportError:
        return {k: ",".join(v) if isinstance(v, list) else v for k, v in light_front_matter(text).items()}
    page = Page.of(text)
    meta = _yaml(page.header) if page else None

    def said(value: object) -> str:
        if isinstance(value, list) and all(isinstance(x, str) for x in value):
            return ",".join(value)
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)

    return {str(k): said(v) for k, v in meta.items()} if isinstance(meta, dict) else {}


def light_front_matter(text: str) -> dict:
    """A header of plain ``key: value``, ``[a, b]`` and ``- item`` lines."""
    page = Page.of(text)
    return {f.name: f.items() if f.is_list else unquoted(f.value) for f in (page.fields if page else ()) if f.name}


def read_array(text: str, name: str) -> list[str]:
    """A header's list; [] if it has none."""
    page = Page.of(text)
    field = page.field(name) if page else None
    return field.items() if field else []


def write_array(text: str, name: str, values: list[str]) -> str:
    """The text with a header's list set, inline; without a header unchanged."""
    page = Page.of(text)
    return page.having(name, "[" + ", ".join(json.dumps(v, ensure_ascii=False) for v in values) + "]").text() if page else text


def write_scalar(text: str, name: str, value: str) -> str:
    """The text with a header's plain field set; a list of that name is left, and so are texts without a header."""
    page = Page.of(text)
    field = page.field(name) if page else None
    return text if page is None or field and field.is_list else page.having(name, value).text()


def ci_union(*lists: list[str]) -> list[str]:
    """All values, case apart once, as first seen."""
    first: dict[str, str] = {}
    for v in (v for values in lists for v in values):
        first.setdefault(v.lower(), v)
    return list(first.values())


def fold_arrays(new: str, old: str | None, names: tuple[str, ...] = ("sources", "tags", "related")) -> str:
    """The new page with the lists of the old one's header put before its own."""
    for name in names:
        before = read_array(old or "", name)
        both = ci_union(before, read_array(new, name))
        if before and both != read_array(new, name):
            new = write_array(new, name, both)
    return new


# --- clean-up of generated pages ---------------------------------------------


def sanitize(text: str) -> str:
    """A page as it should have been generated.

    A fence around it goes, or around its header alone; so does a line
    ``frontmatter:`` before the header.  A header whose first mark is missing
    gets it, and links listed without brackets become a list.
    """
    lines = text.removeprefix("\ufeff").splitlines(keepends=True)
    kept = _with_mark(_without_label(_without_fence(lines)))
    page = Page.of("".join(kept))
    if page is None:
        return text if kept == lines else "".join(kept)
    for field in page.fields:
        links = [x.strip() for x in field.value.split("]],")] if field.name else []
        links = [x if x.endswith("]]") else x + "]]" for x in links]
        if len(links) > 1 and all(x.startswith("[[") and x.count("[[") == 1 for x in links):
            page = page.having(field.name, "[" + ", ".join(f'"{x}"' for x in links) + "]")
    return page.text()


def _first_filled(lines: list[str]) -> int:
    return next((n for n, line in enumerate(lines) if line.strip()), len(lines))


def _without_fence(lines: list[str]) -> list[str]:
    at = _first_filled(lines)
    if at == len(lines) or not lines[at].strip().startswith("```") or lines[at].strip()[3:].lower() not in FENCE_MARKS:
        return lines
    inner = lines[at + 1 :]
    closing = [n for n, line in enumerate(inner) if line.strip() == "```"]
    last = max((n for n, line in enumerate(inner) if line.strip()), default=-1)
    if closing and closing[-1] == last:
        return [*inner[: last - 1], _bare(inner[last - 1])] if last else []
    marks = [n for n, line in enumerate(inner) if _is_mark(line)]
    if len(marks) > 1 and marks[0] == 0 and marks[1] + 1 in closing:
        return inner[: marks[1] + 1] + inner[marks[1] + 2 :]
    return lines


def _without_label(lines: list[str]) -> list[str]:
    labelled = len(lines) > 1 and "".join(lines[0].split()) == "frontmatter:" and _is_mark(lines[1])
    return lines[1:] if labelled else lines


def _with_mark(lines: list[str]) -> list[str]:
    at = _first_filled(lines)
    name = _NAME.match(lines[at].lstrip()) if at < len(lines) else None
    if name is None or name[0].lower() not in KNOWN_FIELDS:
        return lines
    for line in lines[at + 1 : at + HEADER_LINES]:
        if _is_mark(line):
            return [FENCE + "\n", *lines[at:]]
        if line.lstrip().startswith("#"):
            break
    return lines

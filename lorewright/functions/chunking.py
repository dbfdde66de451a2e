"""Long texts as chunks: blocks under their headings, packed to a size."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

# Ends of sentences, the least chunk, how much longer than its
# target a block may be, and what share of an overlap a clean start may cost.
SENTENCE_ENDS = ".!?。！？"
LEAST_TARGET, SLACK, KEPT_SHARE = 1000, 1.25, 0.4

_END = re.compile(rf"[{SENTENCE_ENDS}]|\n+")
_HEADING = re.compile(r"(#{1,6})\s+(\S.*)")


def packed(sizes: Iterable[int], limit: int, between: int = 0) -> Iterator[list[int]]:
    """Numbers of items, gathered in order while their sizes, and what stands between, fit."""
    held: list[int] = []
    total = 0
    for n, size in enumerate(sizes):
        if held and total + between + size > limit:
            yield held
            held, total = [], 0
        total += size + (between if held else 0)
        held.append(n)
    if held:
        yield held


def sentences(text: str) -> list[str]:
    """Stretches that end with a sentence's end or line breaks; joined they are the text."""
    edges = [0, *(m.end() for m in _END.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(edges, edges[1:], strict=False) if a < b]


def split_long(block: str, target: int) -> list[str]:
    """A block that is much longer than the target, by sentences.

    Sentences are gathered to the target; one that is longer by itself is cut by
    length, and what is left of it stands alone.
    """
    if len(block) <= SLACK * target:
        return [block]
    made: list[str] = []
    for is_long, group in groupby(sentences(block), lambda s: len(s) > target):
        run = list(group)
        if is_long:
            made += [s[i : i + target] for s in run for i in range(0, len(s), target)]
        else:
            made += ["".join(run[n] for n in part) for part in packed(map(len, run), target)]
    return [x for x in map(str.strip, made) if x]


def semantic_blocks(text: str, target: int) -> list[tuple[str, str]]:
    """(heading path, block) of headings and paragraphs, long paragraphs split."""
    open_headings: list[tuple[int, str]] = []
    out: list[tuple[str, str]] = []

    def kind(line: str) -> tuple[str, str]:
        # A heading is a group of its own; so its line is part of what groups.
        return ("heading", line) if _HEADING.match(line) else ("text" if line.strip() else "gap", "")

    for (what, _), group in groupby(text.replace("\r\n", "\n").split("\n"), kind):
        lines = list(group)
        if what == "heading":
            for line in lines:
                depth, title = len(_HEADING.match(line)[1]), _HEADING.match(line)[2].strip()
                open_headings = [*(h for h in open_headings if h[0] < depth), (depth, title)]
                out.append((" > ".join(t for _, t in open_headings), line.strip()))
        elif what == "text":
            path = " > ".join(t for _, t in open_headings)
            out += [(path, piece) for piece in split_long("\n".join(lines).strip(), target)]
    return out


def overlap(text: str, most: int) -> str:
    """The end of a text, from where a paragraph or else a sentence begins if that leaves enough."""
    tail = text[max(0, len(text) - max(0, most)) :]
    if tail == text:
        return text
    for begins in (r"\n\s*\n", rf"(?<=[{SENTENCE_ENDS}])\s+"):
        places = [m.end() for m in re.finditer(begins, tail) if m.start() > 0]
        if places and len(tail) - places[0] > KEPT_SHARE * most:
            return tail[places[0] :].strip()
    return tail.strip()


def chunks(text: str, target: int = 1200, overlap_chars: int = 100) -> list[dict]:
    """Blocks gathered to about ``target`` characters, each chunk with the end of the one before it.

    A chunk's heading is that of its first block.
    """
    target = max(LEAST_TARGET, target)
    blocks = semantic_blocks(text, target)
    groups = list(packed((len(b) for _, b in blocks), target, between=2))
    mains = ["\n\n".join(blocks[n][1] for n in group) for group in groups]
    before = ["", *(overlap(m, overlap_chars) for m in mains)]
    return [
        {"id": f"chunk-{n}", "index": n, "total": len(mains), "heading_path": blocks[group[0]][0], "overlap_before": before[n - 1], "main": main}
        for n, (group, main) in enumerate(zip(groups, mains, strict=True), 1)
    ]


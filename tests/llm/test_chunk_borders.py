"""Borders of content-defined chunks, byte by byte."""

from __future__ import annotations

import random

import numpy as np

from lorewright.llm import chunks


def borders(text: bytes) -> list[tuple[int, int]]:
    """Plainly: from each start the first byte whose hash of eight has its top bits zero, six of them before the usual length and four after."""
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + chunks.MOST)
        for i in range(start + chunks.LEAST - 1, end):
            h = sum(int(chunks._GEAR[text[i - k]]) << k for k in range(chunks.REACH)) & 0xFFFFFFFF
            # The byte that makes the usual length is the first to be judged loosely.
            if h >> (26 if i - start + 1 < chunks.USUAL else 28) == 0:
                end = i + 1
                break
        out.append((start, end))
        start = end
    return out


def test_borders_byte_by_byte():
    pick = random.Random(1)
    texts = [b"", b"a", b"short", b"x" * 1000, bytes(pick.randrange(256) for _ in range(5000))]
    texts += [" ".join(pick.choice(["lorem", "ipsum", "dolor", "é", "漢字"]) for _ in range(pick.randint(0, 200))).encode() for _ in range(60)]
    offsets = np.cumsum([0, *map(len, texts)])
    row, start, end = chunks.chunk_ends(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for n, text in enumerate(texts):
        mine = row == n
        got = sorted(zip((start[mine] - offsets[n]).tolist(), (end[mine] - offsets[n]).tolist(), strict=True))
        assert got == borders(text)
        assert all(b - a <= chunks.MOST for a, b in got) and all(b - a >= chunks.LEAST for a, b in got[:-1])

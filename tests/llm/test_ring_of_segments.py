"""The chains of the wide fingerprints' ring."""

from __future__ import annotations

import numpy as np

from lorewright.llm import wide_simhash as W


def brute(apart, bits):
    return any(all(8 * sum(apart[(s + t) % 8] for t in range(n)) <= n * bits for n in range(1, 9)) for s in range(8))


def test_chains_are_brute_force():
    pick = np.random.default_rng(3)
    rows = pick.integers(0, 30, (4000, 8)).astype(np.int32)
    for bits in (60, 100, 120, 140):
        got = W._ringed(rows, bits)
        assert got.tolist() == [brute(r, bits) for r in rows.tolist()]
        assert got[rows.sum(axis=1) <= bits].all() and 0 < got.sum() < len(rows)


def test_near_is_all_within_the_budget():
    pick = np.random.default_rng(4)
    a = pick.integers(0, 1 << 63, (40, 8), np.uint64)
    b = np.concatenate([a ^ (pick.integers(0, 1 << 63, (40, 8), np.uint64) & pick.integers(0, 1 << 63, (40, 8), np.uint64)) for _ in range(20)])
    apart = np.bitwise_count(a[:, None] ^ b[None]).sum(axis=2)
    for bits in (110, 126, 130):
        assert W._near(a, b, bits).tolist() == (apart <= bits).any(axis=0).tolist()

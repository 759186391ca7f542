"""Local search of packing on lengths without short documents, where best fit leaves no gap that a document fits."""

import random
import time
from collections import Counter

import pytest

from millrace.llm import packing


def test_search_goes_on_until_no_exchange_helps():
    random.seed(3)
    counts = Counter(random.randint(500, 1100) for _ in range(3000))
    start = packing.best_fit(counts)
    found = packing.local_search(start)
    held = Counter()
    for pattern, bins in found:
        assert packing.fill(pattern) <= packing.CAPACITY
        for length, times in pattern:
            held[length] += times * bins
    assert held == counts
    assert sum(b for _, b in found) < 0.98 * sum(b for _, b in start)
    pool = Counter()
    for pattern, bins in found:
        if packing.fill(pattern) < packing.CAPACITY:
            pool[pattern] += bins
    for giver in pool:
        for taker in pool:
            if giver == taker and pool[giver] < 2:
                continue
            a, b = packing.fill(giver), packing.fill(taker)
            for x, out in packing.all_offers(giver):
                for y, into in [(0, ()), *packing.all_offers(taker)]:
                    if len(out) + len(into) <= 3 and (into or len(out) == 1):
                        assert not (x > y and b + x - y <= packing.CAPACITY and x - y > a - b)


def lengths(kind: str, n: int) -> dict[int, int]:
    """A histogram of n pieces."""
    if kind == "long":
        return {k: n // 601 + (k % 7 < n % 7) for k in range(500, 1101)}
    weights = {k: 1 / (k + 20) for k in range(1, 2049)}
    return {k: c for k, w in weights.items() if (c := int(n * w / sum(weights.values())))}


@pytest.mark.parametrize("kind", ["long", "mixed"])
def test_plans_are_bounded(kind):
    """From 200,000 to 20,000,000,000 pieces plans stay of one order, hold every piece, and lose few bins against the full search."""
    sizes = {}
    for n in (200_000, 20_000_000, 20_000_000_000):
        counts = lengths(kind, n)
        began = time.process_time()
        found = packing.search(counts)
        sizes[n] = len(found)
        assert time.process_time() - began < 60
        held = Counter()
        for pattern, bins in found:
            assert 0 < packing.fill(pattern) <= packing.CAPACITY and bins > 0
            for length, times in pattern:
                held[length] += times * bins
        assert held == counts
        if n == 200_000:
            full = sum(b for _, b in packing.local_search(packing.best_fit(counts)))
            assert sum(b for _, b in found) <= 1.01 * full
        bound = sum(k * c for k, c in counts.items()) / packing.CAPACITY
        share = sum(b for _, b in found) / bound
        assert share <= 1.001 if kind == "mixed" else share <= 1.05
    assert max(sizes.values()) <= 8 * min(sizes.values()) and max(sizes.values()) < 60_000

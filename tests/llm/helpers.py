"""Awkward documents, and brute-force versions that need no Spark."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def some_text(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward_rows(seed: int = 5) -> list[tuple]:
    """Nulls in every column, blank and very long texts, ties, repeated rows, exact and near copies, shared passages."""
    rng = random.Random(seed)
    passage = some_text(rng, 60)
    base = some_text(rng, 200)
    rows = []
    for i in range(40):
        words = some_text(rng, rng.choice([3, 12, 80, 150])).split()
        if i % 5 == 0:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
    for i in range(40, 60):  # near copies of one text
        words = base.split()
        words[rng.randrange(200)] = f"edit{i}"
        rows.append((i, " ".join(words), "en", "s0", 0))
    rows += [(60, base, "en", "s1", 0), (61, base, "en", None, 0), (62, base, None, "s1", None)]
    rows += [(70, None, "en", "s0", None), (71, "", "en", "s0", 0), (72, " \n\t ", "fr", "s2", 4), (73, "one", "en", "s2", 3)]
    rows += [(74, some_text(rng, 20_000, 20), "en", "s2", 0), (75, "the " * 300, "en", "s1", 0), (76, "a  b\n\nc\x0bd\x1ce É é ²", "fr", "s1", 0)]
    rows += [(None, "no id here at all", "en", "s1", 0), (None, "no id here at all", "en", "s1", 0), (None, some_text(rng, 90), None, None, None)]
    rows += [(80, "same id, first text of two", "en", "s0", 0), (80, "same id, second text of two", "en", "s0", 0)]
    rows += [(81, "a row that is there twice", "de", "s2", 0)] * 2
    return rows


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text: str | None) -> frozenset:
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = words_of(lowered)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def near_components(rows: list[tuple]) -> list[set[int]]:
    """Components of row numbers over links of at least 75 per cent."""
    sets = [shingle_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    found: dict[int, set[int]] = {}
    for i in range(len(rows)):
        found.setdefault(root(i), set()).add(i)
    return list(found.values())


def covered_words(texts: list[str | None], window: int = 35) -> list[list[bool]]:
    """For each text, which words lie in a window that also starts elsewhere."""
    split = [words_of(t) for t in texts]
    counts = Counter(tuple(w[k : k + window]) for w in split for k in range(len(w) - window + 1))
    marks = []
    for w in split:
        m = [False] * len(w)
        for k in range(len(w) - window + 1):
            if counts[tuple(w[k : k + window])] > 1:
                m[k : k + window] = [True] * window
        marks.append(m)
    return marks

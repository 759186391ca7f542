"""Conversation tries, spelling variants and the positional index against brute force, over awkward rows."""

from __future__ import annotations

import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
import oracle  # noqa: E402
from helpers import SCHEMA, awkward_rows, words_of  # noqa: E402

from millrace.llm import inverted, registry, spelling, trie  # noqa: E402

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TURNS = "conv_id long, turn long, role string, text string"


def clashing(df, names):
    return df.withColumns({c: F.lit(1) for c in names}).repartition(3)


@pytest.mark.parametrize("name", ["op11_partial_tries", "op12_automaton_halves", "op13_positional_index"])
@pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="driver tables are absent")
def test_query_equals_its_sql(spark, name):
    oracle.assert_same(registry.queries()[name](spark, oracle.FOLDER), oracle.connect(), registry.oracles()[name])


# Conversation tries


def trie_by_force(rows):
    told = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            told[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(ts, key=lambda x: x[0])] for c, ts in told.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(members[p]) - 1) * (len(words_of(p[-1][1])) if p else 0)
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()
    )


def awkward_turns():
    rng = random.Random(3)
    rows = []
    for c in list(range(130)) + [20_000 + i for i in range(60)]:  # every conversation starts in one of two ways
        for turn in range(rng.choice([1, 1, 2, 4, 6])):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", f"t{turn} a b {rng.randrange(2 if turn < 3 else 9)}"))
    rows += [(c, t, "user", f"same {t}") for c in range(300, 400) for t in range(5)]
    rows += [(c, None, "user", "first of all") for c in (0, 7, 300, 501)]
    rows += [(500, t, None, None) for t in range(3)] + [(500, 3, "", "")] * 2 + [(502, 0, "user", "ab"), (503, 0, "usera", "b")]
    rows += [(7000, t, "user", f"long {t % 7}") for t in range(200)] + [(None, 1, "user", "nobody's"), (None, None, None, None)]
    rows += [(901, 0, "user", "w " * 20_000), (-3, 0, "user", "x"), (-3, 1, "user", "y"), (-20, 0, "user", "z")]
    return rows


@pytest.mark.parametrize(("block", "piece", "combined", "fan"), [(4096, 4096, 100_000, 32), (7, 3, 20, 2)])
def test_trie(spark, monkeypatch, block, piece, combined, fan):
    for name, value in (("BLOCK", block), ("PIECE", piece), ("COMBINED", combined), ("FAN", fan)):
        monkeypatch.setattr(trie, name, value)
    rows = awkward_turns()
    turns = clashing(spark.createDataFrame(rows, TURNS), ("row", "part", "depth", "h1", "words", "n", "_c", "_p", "first"))
    got = trie.prefix_trie(turns)
    assert got.columns[:8] == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == trie_by_force(rows)


def test_trie_of_nothing(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).count() == 0


def test_sums_of_hashes_wrap(spark):
    values = [2**63 - 1, 2**63 - 1, -5, -(2**63), 12345]
    df = spark.createDataFrame([(v,) for v in values], "a long").agg(trie.wrapped(F.sum(F.col("a").cast("decimal(20,0)"))).alias("s"))
    want = sum(values) % 2**64
    assert df.first().s == (want - 2**64 if want >= 2**63 else want)


# Spelling variants


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spellings_by_force(rows, misspelt):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if misspelt and h % misspelt == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    n = {w: c for w, c in n.items() if c >= 2}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return Counter((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def spelling_rows():
    rng = random.Random(11)
    rows, letters = [], "abÉé"
    base = ["".join(rng.choice(letters) for _ in range(rng.choice([7, 7, 8, 9, 12]))) for _ in range(60)]
    words = list(base)
    for w in base:  # near words, doubled letters and chains of them
        for _ in range(4):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + w[i : i + 1] * 2 + w[i + 1 :], w[: i - 1] + rng.choice(letters) + w[i:] if i else w])
            words.append(w)
    words += ["a" * k for k in range(6, 14)] + ["hundred" + "x" * k for k in range(3)] + ["z" * 3000, "z" * 3001]
    for i, w in enumerate(words):
        rows += [(i * 7 + k, f"{w} {w.upper()}, {w}" if k % 2 else f"1{w}2", None, None, None) for k in range(1 + (40 if i % 5 == 0 else i % 3))]
    rows += [(None, "aaaaaaaa " * 900, "en", None, 0)] + [(5, "hundred " * 200, "en", None, 0)] * 2
    return rows + awkward_rows()


@pytest.mark.parametrize(("misspelt", "holders", "shard"), [(31, 48, 20_000), (31, 1, 40), (None, 3, 7)])
def test_spellings(spark, monkeypatch, misspelt, holders, shard):
    rows = spelling_rows()
    docs = clashing(spark.createDataFrame(rows, SCHEMA), ("word", "run", "id", "h", "key", "gap", "start", "length", "n"))
    monkeypatch.setattr(spelling, "near_words", lambda v, real=spelling.near_words: real(v, holders, shard))
    got = Counter(tuple(r) for r in spelling.group_spellings(docs, misspelt=misspelt).select("word", "form", "root", "n", "n_near", "form_n").collect())
    want = spellings_by_force(rows, misspelt)
    assert got == want and sum(1 for w in want if w[1]) > 10


def test_segments_of_many_words_are_split(spark):
    rng = random.Random(2)
    words = sorted({"commonx" + "".join(rng.choice("abc") for _ in range(7)) for _ in range(400)})
    vocabulary = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    held = spelling.segments(vocabulary, 5).filter("length = as_length").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("gap"))
    assert held.filter("n > 5 and gap > 1").count() == 0
    got = {r.word: r.near for r in spelling.near_words(vocabulary, 5, 50).collect()}
    want = {w: c for w in words if (c := sum(one_edit(w, x) for x in words))}
    assert got == want


def test_spellings_of_nothing(spark):
    assert spelling.group_spellings(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.group_spellings(spark.createDataFrame([(1, None, None, None, None), (2, "short words only here", None, None, None)], SCHEMA)).count() == 0


# Positional index


def index_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def contamination_by_force(rows, items, near_terms=3, span=10):
    windows, docs = defaultdict(set), [index_words(r[1]) for r in rows]
    for item, text in items:
        w = index_words(text)
        for i in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[i : i + 10])].add("null" if item is None else str(item))
    counts = Counter(w for d in docs for w in d)
    rare = []
    for item, text in {(i, tuple(index_words(t))) for i, t in items}:
        known = sorted({w for w in text if w in counts}, key=lambda w: (counts[w], text.index(w)))[:near_terms]
        if len(known) > 1:
            rare.append(("null" if item is None else str(item), known))
    out = Counter()
    for (doc_id, *_), w in zip(rows, docs, strict=True):
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if owners := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= owners
        at = defaultdict(list)
        for i, x in enumerate(w):
            at[x].append(i)
        near = {item for item, known in rare if any(all(any(abs(p - q) <= span for q in at[x]) for x in known[1:]) for p in at.get(known[0], ()))}
        out[doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), len(near)] += 1
    return out


def test_positional_index(spark):
    rng = random.Random(8)
    rows = awkward_rows() + [(100 + i, " ".join(f"v{rng.randrange(60)}" for _ in range(80)), "en", "s0", 0) for i in range(40)]
    texts = [r[1] for r in rows if r[1] and len(r[1].split()) > 40]
    items = [(i, " ".join(texts[i % len(texts)].split()[5 : 5 + n]).title()) for i, n in enumerate([1, 2, 3, 9, 10, 11, 14, 30, 2, 12, 10, 25])]
    items += [(10, items[7][1]), (10, "v1"), (None, items[9][1]), (3, None), (4, " .,; "), (5, ""), (77, "the the the"), (78, "the " * 12), (79, "never seen here"), (80, "v1 never v2"), (81, "É, é!"), (9, items[9][1])]
    shuffled = texts[0].split()[10:22]
    rng.shuffle(shuffled)
    items.append((82, " ".join(shuffled)))
    docs = clashing(spark.createDataFrame(rows, SCHEMA), ("row", "term", "pos", "w", "at", "word", "n_words"))
    bench = clashing(spark.createDataFrame(items, "item_id long, text string"), ("item", "terms", "doc_id", "size"))
    got = Counter(tuple(r) for r in inverted.decontaminate(docs, bench).collect())
    want = contamination_by_force(rows, items)
    assert got == want and sum(w[5] for w in want) > 10 and sum(w[6] for w in want) > 10


def test_index_serves_several_tests(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "c d x e"), (3, None)], "doc_id long, text string")
    index = inverted.build_index(docs)
    assert {tuple(r)[1:] for r in inverted.indexed_documents(index).collect()} == {(1, 7), (2, 4), (3, 0)}
    for text, starts in (("c d", {(1, 2), (2, 0)}), ("d e f", {(1, 3)}), ("x", {(2, 2)}), ("d c", set())):
        items = spark.createDataFrame([(1, text)], "item_id long, text string")
        matches, owners = inverted.phrase_matches(index, items)
        named = matches.join(inverted.indexed_documents(index), "row")
        assert {(r.doc_id, r.start) for r in named.collect()} == starts and owners.count() == 1
    near = inverted.near_matches(index, spark.createDataFrame([(1, "e x c")], "item_id long, text string"), span=2)
    assert [r.doc_id for r in near.join(inverted.indexed_documents(index), "row").collect()] == [2]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "some text here")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in inverted.decontaminate(docs, items).collect()] == [(1, 3, 0, 0)]
    assert inverted.decontaminate(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0

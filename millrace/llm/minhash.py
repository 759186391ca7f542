"""MinHash near-duplicates: SuperMinHash, banding, verification and union-find grouping.

1. Texts are made distinct, shingled and signed. SuperMinHash gives every shingle
   a rank in each register through one permutation, so registers are correlated
   and the estimate varies less; a text stops as soon as no later rank can lower
   a register (O. Ertl, SuperMinHash, arXiv:1706.05698). Texts with equal shingle
   sets become one node.
2. 32 bands of 4 registers put nodes into buckets. A pair at the threshold misses
   all bands with a probability of 5e-6, one at 0.8 of 5e-8.
3. Inside a bucket signatures are compared with the leaders found so far: a node
   close to one is represented by it, and a node that may be near one is
   connected to it. Their union-find components hold every linked pair of the
   buckets, as distance obeys the triangle inequality, with fewer edges than
   members. A large bucket is dealt out in parts, whose leaders meet again in pairs of parts; there
   none is represented by another, so that two linked nodes of different parts are
   one representation each apart, as within a part.
4. Each component's full shingle sets then meet once. Linked sets share one of
   their rarest shingles (a quarter of them, and one), so sets fall into candidate
   groups, and exact links are searched breadth first inside these. Components beyond a
   bound are dealt out in blocks: links are searched inside each block, then among
   one text of each group found. If texts are left outside the component's main group,
   all of them are put into finer components by their rarest shingles, which
   meet as the first ones did; only of a finer component that is still beyond the bound do
   the texts outside the main group meet every block. What many texts share
   is nobody's rarest, so common boilerplate makes no work, nor does a large group of copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import flag_maybe_in, free_shuffles, materialize, maybe_in, read_table, ship_by_value
from millrace.llm.grams import gram_hashes, joined, word_hashes
from millrace.llm.substrings import distinct_texts, text_key

WORDS = 5
THRESHOLD = 75  # per cent
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Estimated similarity from which a node is represented by a leader, and from which it is connected to one.
ABSORB, CONNECT = 0.85, 0.45
#: Members of a bucket that one task compares at once, and shingles of a component that one task holds.
PART, MAX_SHINGLES = 4096, 6_000_000
#: So few sets are compared with each other without a look at their rarest shingles; bits of the sketch of frequencies.
COMPARED_AT_ONCE, SKETCH_BITS = 32, 20
#: Shingles that are signed together.
SIGNED_TOGETHER = 200_000
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x94D049BB133111EB)
_LEVEL = np.uint64(57)


def _times_odd(n: int) -> np.uint64:
    return np.uint64((n * int(_ODD)) & 0xFFFFFFFFFFFFFFFF)


def shingles(text: bytes) -> np.ndarray:
    """The set of 5-word shingles as sorted 64-bit hashes; fewer words are one shingle, none give none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = min(len(words), WORDS)
    grams = gram_hashes(word_hashes(words), n)
    return np.unique(grams if n == WORDS else grams + _times_odd(n))


def _drawn(x: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """For each element: its value at this level (level first, then 57 random bits), and the place it swaps with."""
    u = (x + _times_odd(level + 1)) * _MIX
    u = (u ^ (u >> np.uint64(31))) * _ODD
    u ^= u >> np.uint64(29)
    swap = level + (((u & np.uint64(0xFFFFFFFF)) * np.uint64(REGISTERS - level)) >> np.uint64(32)).astype(np.int64)
    v = u * _MIX
    return (np.uint64(level) << _LEVEL) | ((v ^ (v >> np.uint64(32))) >> np.uint64(7)), swap


def super_minhash(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures (one row of registers per set, none empty) of several sets at once, level by level."""
    count = len(sets)
    registers = np.full(count * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    x = np.concatenate(sets)
    of = np.repeat(np.arange(count), [len(s) for s in sets])
    order = None
    for level in range(REGISTERS):
        value, swap = _drawn(x, level)
        if level == 0:
            place = first = swap
        else:
            if order is None:  # the permutation so far: place 0 and place `first` have changed
                order = np.tile(np.arange(REGISTERS, dtype=np.uint8), (len(x), 1))
                rows = np.arange(len(x))
                order[rows, first] = 0
                order[rows, 0] = first
            rows = np.arange(len(x))
            place = order[rows, swap].astype(np.int64)
            order[rows, swap] = order[rows, level]
            order[rows, level] = place
        np.minimum.at(registers, of * REGISTERS + place, value)
        # A later value is at least level + 1: sets whose registers are all below are done.
        open_sets = registers.reshape(count, REGISTERS).max(axis=1) >= (np.uint64(level + 1) << _LEVEL)
        going = open_sets[of]
        if not going.any():
            break
        if not going.all():
            x, of, first = x[going], of[going], first[going]
            order = None if order is None else order[going]
    return registers.reshape(count, REGISTERS)


def band_hashes(registers: np.ndarray) -> np.ndarray:
    parts = registers.reshape(-1, BANDS, ROWS)
    h = parts[:, :, 0] + np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for i in range(1, ROWS):
        h = joined(h, parts[:, :, i])
    return h.view(np.int64)


def short_signature(registers: np.ndarray) -> np.ndarray:
    """A byte for each register, enough to estimate the share that agrees."""
    return ((registers ^ (registers >> np.uint64(32))) * _ODD >> np.uint64(56)).astype(np.uint8)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def signed(keys: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [i for i, s in enumerate(sets) if len(s)]
        bands: list = [[]] * len(sets)
        short: list = [b""] * len(sets)
        if full:
            registers = super_minhash([sets[i] for i in full])
            for i, b, s in zip(full, band_hashes(registers), short_signature(registers), strict=True):
                bands[i], short[i] = b, s.tobytes()
        prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(short, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            ["_key", "n_shingles", "_print", "_short", "_bands"],
        )

    keys, sets, total = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            keys.append(key)
            sets.append(shingles(text or b""))
            total += len(sets[-1])
            if total >= SIGNED_TOGETHER or len(keys) >= 4096:
                yield signed(keys, sets)
                keys, sets, total = [], [], 0
    if keys:
        yield signed(keys, sets)


def _lead(absorb: float):
    return lambda batches: _leaders(batches, absorb)


def _leaders(batches: Iterator[pa.RecordBatch], absorb: float) -> Iterator[pa.RecordBatch]:
    """Sorted (bucket, part, node, short): edges (a, b), and leaders as edges to themselves.

    Only the leaders of the current bucket are held, 128 bytes each.
    """
    key, found, leaders, labels, n = None, [], np.empty((64, REGISTERS), np.uint8), np.empty(64, np.int64), 0
    nodes: list[int] = []

    def flush() -> pa.RecordBatch:
        bucket, a, b = zip(*found, strict=True) if found else ((), (), ())
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["bucket", "a", "b"])

    for batch in batches:
        for bucket, part, node, short in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (bucket, part) != key:
                key, n, nodes = (bucket, part), 0, []
            own = np.frombuffer(short, np.uint8)
            absorbed, label = False, n
            if n:
                share = (leaders[:n] == own).mean(axis=1)
                near = np.flatnonzero(share >= CONNECT)
                if len(near):  # one edge to each of the components that the near leaders form so far
                    met, at = np.unique(labels[near], return_index=True)
                    found += [(bucket, nodes[i], node) for i in near[at].tolist()]
                    label = met[0]
                    if len(met) > 1:
                        labels[:n][np.isin(labels[:n], met)] = label
                    absorbed = share.max() >= absorb
            if not absorbed:
                if n == len(leaders):
                    leaders, labels = np.concatenate([leaders, np.empty_like(leaders)]), np.concatenate([labels, np.empty_like(labels)])
                leaders[n], labels[n] = own, label
                n += 1
                nodes.append(node)
                found.append((bucket, node, node))
            if len(found) >= 50_000:
                yield flush()
    yield flush()


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one partition: each node once, with the least node it reaches there."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    def flush() -> pa.RecordBatch:
        rows = [(x, r) for x in list(parent) if (r := root(x)) != x]
        parent.clear()
        a, b = zip(*rows, strict=True) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 500_000:
            yield flush()
    yield flush()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node each node of `edges` (a, b) reaches, for nodes that reach a lesser one.

    Union-find contracts each partition; then large-star and small-star steps
    alternate (Kiveris et al., Connected Components in MapReduce and Beyond,
    SOCC 2014) until every node hangs on its root. Each step's edges are written
    to the shared folder.
    """
    edges = materialize(edges.select("a", "b").filter("a <> b").mapInArrow(_contract, "a long, b long").distinct(), "cc-edges")

    def star(pairs: DataFrame) -> DataFrame:
        """pairs (u, v): v's to the least of u and its v's."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        return pairs.join(least, F.col("u") == F.col("w")).select("u", "v", "m")

    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        large = star(both).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "cc-large")
        pairs = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
        stars = star(pairs)
        edges = materialize(stars.select(F.col("v").alias("a"), F.col("m").alias("b")).union(stars.select("u", "m")).filter("a <> b").distinct(), "cc-small")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before or state[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        free_shuffles(edges.sparkSession)


def rarest(n: np.ndarray | int) -> np.ndarray | int:
    """Of a set of n shingles in any order common to all sets, so many first ones hold one of each linked set's."""
    return n - (THRESHOLD * n + 99) // 100 + 1


def candidate_groups(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A label for each set, the same for sets that can be linked: linked sets share one of their rarest shingles.

    Shingles are put in order of the number of sets that hold them, so what many
    sets share comes last and is left out, unless sets consist of little else.
    """
    n = len(sizes)
    held = np.bincount(codes)
    rank = np.empty(len(held), np.int64)
    rank[np.argsort(held, kind="stable")] = np.arange(len(held))
    owner = np.repeat(np.arange(n), sizes)
    token = np.sort(owner * len(held) + rank[codes]) - owner * len(held)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = place < rarest(sizes)[owner]
    token, owner = token[first], owner[first]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    same = token[1:] == token[:-1]
    a, b = owner[:-1][same], owner[1:][same]
    labels = np.arange(n)
    while len(a):
        least = np.minimum(labels[a], labels[b])
        before = labels.copy()
        np.minimum.at(labels, labels[a], least)
        np.minimum.at(labels, labels[b], least)
        while (labels[labels] != labels).any():
            labels = labels[labels]
        if (labels == before).all():
            break
    return labels


def linked_groups(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the least index it reaches over links of at least THRESHOLD per cent; only sets that can be linked are compared."""
    if len(sets) < COMPARED_AT_ONCE:
        return reached_groups(sets)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    labels = candidate_groups(codes, np.array([len(s) for s in sets]))
    order = np.argsort(labels, kind="stable")
    group = np.arange(len(sets))
    for members in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1):
        if len(members) > 1:
            group[members] = members[reached_groups([sets[i] for i in members])]
    return group


def reached_groups(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the least index it reaches over links of at least THRESHOLD per cent.

    Breadth first: a reached set is compared, over full sets, with those not
    reached yet, all at once, so a group of near copies costs little more than
    its own size.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.zeros(int(codes.max()) + 1, np.int32)
    group = np.full(n, -1)
    left = np.arange(n)
    left_codes, left_starts = codes, starts[:-1]
    for seed in range(n):
        if group[seed] >= 0:
            continue
        group[seed] = seed
        todo = [seed]
        while todo and len(left):
            at = todo.pop()
            own = codes[starts[at] : starts[at + 1]]
            marked[own] = 1
            shared = np.add.reduceat(marked[left_codes], left_starts)
            marked[own] = 0
            hit = (100 * shared >= THRESHOLD * (sizes[left] + len(own) - shared)) | (left == at)
            reached = left[hit]
            todo += [int(i) for i in reached if group[i] < 0]
            group[reached] = seed
            if hit.any():
                keep = ~hit
                left_codes = left_codes[np.repeat(keep, sizes[left])]
                left = left[keep]
                left_starts = np.concatenate([[0], np.cumsum(sizes[left])])[:-1]
        if not len(left):
            break
    return group


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (component, part, node, text): edges of exact links, each to the least node of its group."""

    def links(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        least = linked_groups(sets) if len(sets) > 1 else np.zeros(1, np.int64)
        rows = [(nodes[i], nodes[g]) for i, g in enumerate(least.tolist()) if nodes[g] != nodes[i]]
        a, b = zip(*rows, strict=True) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    key, nodes, sets = None, [], []
    for batch in batches:
        comp, part, node = (batch.column(i).to_pylist() for i in range(3))
        for c, p, x, text in zip(comp, part, node, batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
            if (c, p) != key:
                if nodes:
                    yield links(nodes, sets)
                key, nodes, sets = (c, p), [], []
            if nodes and nodes[-1] == x:  # a text that meets its own block is there twice
                continue
            nodes.append(x)
            sets.append(shingles(text))
    if nodes:
        yield links(nodes, sets)


def grouped(df: DataFrame, keys: list[str], order: str, fn: Callable, schema: str) -> DataFrame:
    """Rows of a key together and in order, streamed through `fn`."""
    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(fn, schema)


def in_pairs_of_parts(leaders: DataFrame) -> DataFrame:
    """The leaders of a bucket dealt into parts of about PART, and each part together with every other, so that any two meet and no task holds more than two parts."""
    parts = leaders.groupBy(F.col("bucket").alias("_b")).agg(F.ceil(F.count(F.lit(1)) / F.lit(PART)).alias("parts"))
    own, other = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")), F.col("other")
    dealt = leaders.join(parts, F.col("bucket") == F.col("_b")).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return dealt.select("bucket", (F.least("own", other) * F.col("parts") + F.greatest("own", other)).alias("part"), "node", "_short")


def coarse_edges(nodes: DataFrame) -> DataFrame:
    """Edges between nodes whose signatures may be near, from their buckets."""
    rows = materialize(nodes.select(F.explode("_bands").alias("bucket"), "node"), "minhash-bands")
    shared = materialize(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("bucket").alias("_b"), F.ceil(F.col("n") / F.lit(PART)).alias("parts")), "minhash-buckets")
    members = maybe_in(rows, F.col("bucket"), shared, F.col("_b"), 24).join(shared, F.col("bucket") == F.col("_b"))
    members = members.select("bucket", "node", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), (F.col("parts") > 1).alias("again"))
    shorts = nodes.select(F.col("node").alias("_n"), "_short")
    signed = materialize(members.join(shorts, F.col("node") == F.col("_n")).select("bucket", "part", "node", "_short", "again"), "minhash-members")
    schema = "bucket long, a long, b long"
    first = materialize(grouped(signed.select("bucket", "part", "node", "_short"), ["bucket", "part"], "node", _lead(ABSORB), schema), "minhash-first")
    large = signed.filter("again").select("bucket", "node", "_short")
    leaders = first.filter("a = b").select(F.col("bucket").alias("_b"), F.col("a").alias("_a"))
    met = large.join(leaders, (F.col("bucket") == F.col("_b")) & (F.col("node") == F.col("_a"))).select("bucket", "node", "_short")
    second = grouped(in_pairs_of_parts(materialize(met, "minhash-leaders")), ["bucket", "part"], "node", _lead(2.0), schema)  # no leader stands for another
    return first.unionByName(second).filter("a <> b").select("a", "b")


def blocks_of(shingles: str, name: str = "blocks") -> Column:
    return F.ceil(F.sum(shingles) / F.lit(MAX_SHINGLES)).cast("int").alias(name)


def met_links(keyed: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Exact links (a, b) among the texts of each (comp, part) of `rows` (comp, part, node, _key)."""
    met = rows.join(texts_of(keyed, rows), F.col("_key") == F.col("_k")).select("comp", "part", "node", "_text")
    return materialize(grouped(met, ["comp", "part"], "node", _verify, "a long, b long"), name)


def texts_of(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """_k and _text of the keys in `rows`."""
    return maybe_in(keyed, F.col("_key"), rows, F.col("_key")).groupBy("_key").agg(F.first("_text").alias("_text")).withColumnRenamed("_key", "_k")


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts hold a shingle, by the last bits of its hash."""
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            np.add.at(counts, (shingles(text) & np.uint64(len(counts) - 1)).astype(np.int64), 1)
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["slot", "n"])


def _rarest(shared):
    """Rows (comp, node, root, other, text): a key for each of a text's rarest shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            keys, which = [], []
            for i, (comp, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(4).cast(pa.binary()).to_pylist(), strict=True)):
                s = shingles(text)
                order = np.lexsort((s, counts[(s & np.uint64(len(counts) - 1)).astype(np.int64)]))
                first = s[order[: rarest(len(s))]]
                keys.append(((first ^ _times_odd(comp)) * _MIX).view(np.int64))
                which.append(np.full(len(first), i))
            rows = pa.array(np.concatenate(which) if which else np.empty(0, np.int64))
            key = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([key, *(batch.column(i).take(rows) for i in (1, 2, 3))], ["key", "node", "root", "other"])

    return run


def finer_components(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, comp) of the texts that can be linked with one of another group: those that share one of their rarest shingles.

    `groups` has comp, node, _key, root and other, which is false for the main group of
    its component. Rarity is by a sketch of fixed size; any order would do, but this one
    leaves out what many texts share. A key's texts are tied to its least, not to each other.
    """
    spark = keyed.sparkSession
    told = groups.join(texts_of(keyed, groups), F.col("_key") == F.col("_k")).select("comp", "node", "root", "other", "_text")
    told = materialize(told, "minhash-large-texts")
    sketch = told.select("_text").mapInArrow(_sketch, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    found = sketch.toArrow()  # at most 2**SKETCH_BITS rows
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    keys = materialize(told.mapInArrow(_rarest(spark.sparkContext.broadcast(counts)), "key long, node long, root long, other boolean"), "minhash-rarest")
    free_shuffles(spark)
    own = keys.filter("other")
    met = own.union(maybe_in(keys.filter("not other"), F.col("key"), own, F.col("key"), 24))
    shared = met.groupBy(F.col("key").alias("_k")).agg(F.min("node").alias("least"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("_k", "least")
    edges = met.join(shared, F.col("key") == F.col("_k")).select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    finer = materialize(components(edges), "minhash-finer")
    return finer.select("node", F.col("root").alias("comp")).union(finer.select("root", "root").distinct())


def with_main(groups: DataFrame) -> DataFrame:
    """Adds other: whether a text is outside the main group, the one with most shingles, of its component."""
    sums = groups.groupBy("comp", "root").agg(F.sum("n_shingles").alias("s"))
    main = sums.groupBy(F.col("comp").alias("_c")).agg(F.max(F.struct("s", "root"))["root"].alias("_main"))
    return groups.join(main, F.col("comp") == F.col("_c")).withColumn("other", F.col("root") != F.col("_main")).drop("_c", "_main")


def large_roots(keyed: DataFrame, large: DataFrame) -> DataFrame:
    """(_a, root) for components of several blocks: `large` has comp, node, _key, n_shingles, blocks."""
    spark = keyed.sparkSession
    placed = large.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    inside = met_links(keyed, placed.withColumn("part", F.col("block")), "minhash-inside")

    def with_group(links: DataFrame) -> DataFrame:
        roots = components(links).select(F.col("node").alias("_n"), "root")
        return placed.join(roots, F.col("node") == F.col("_n"), "left").withColumn("root", F.coalesce("root", "node")).drop("_n")

    firsts = with_group(inside).filter("node = root")
    count = firsts.groupBy(F.col("comp").alias("_c")).agg(blocks_of("n_shingles", "_of"))
    firsts = firsts.join(count, F.col("comp") == F.col("_c")).withColumn("part", F.pmod(F.xxhash64("root"), F.col("_of")).cast("int"))
    across = met_links(keyed, firsts, "minhash-across")
    free_shuffles(spark)
    known = inside.union(across)
    groups = materialize(with_main(with_group(known)), "minhash-grouped")
    if not groups.filter("other").isEmpty():
        finer = finer_components(keyed, groups).withColumnRenamed("node", "_n").withColumnRenamed("comp", "_finer")
        again = groups.join(finer, F.col("node") == F.col("_n")).select(F.col("_finer").alias("comp"), "node", "_key", "n_shingles", "root")
        sizes = again.groupBy(F.col("comp").alias("_c")).agg(blocks_of("n_shingles"))
        again = materialize(with_main(again.join(sizes, F.col("comp") == F.col("_c")).drop("_c")), "minhash-again")
        known = known.union(met_links(keyed, again.filter("blocks = 1").withColumn("part", F.lit(0)), "minhash-finer-links"))
        still = again.filter("blocks > 1").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        if not still.isEmpty():
            known = known.union(met_by_all_blocks(keyed, still))
        free_shuffles(spark)
    return components(known).select(F.col("node").alias("_a"), "root")


def met_by_all_blocks(keyed: DataFrame, placed: DataFrame) -> DataFrame:
    """Links of the texts outside the main group with all texts of their component."""
    others = placed.filter("other")
    count = others.groupBy(F.col("comp").alias("_c")).agg(blocks_of("n_shingles", "_of"))
    every = F.sequence(F.lit(0), F.col("_of") - 1)
    own = others.join(count, F.col("comp") == F.col("_c")).withColumn("_k2", F.pmod(F.xxhash64("node", F.lit(1)), F.col("_of")).cast("int"))
    sent = own.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("comp", (F.col("_k2") * F.col("blocks") + F.col("_j")).alias("part"), "node", "_key")
    met = placed.join(count, F.col("comp") == F.col("_c")).withColumn("_k2", F.explode(every)).select("comp", (F.col("_k2") * F.col("blocks") + F.col("block")).alias("part"), "node", "_key")
    return met_links(keyed, sent.union(met), "minhash-rest")


def near_groups(keyed: DataFrame) -> DataFrame:
    """keyed (_key, _text) -> _key, n_shingles, root: texts of one component share a root; root is null for texts without words."""
    spark = keyed.sparkSession
    copied = materialize(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("_key").alias("_copied")), "minhash-copied")
    signed = distinct_texts(keyed, copied).mapInArrow(_sign, "_key binary, n_shingles long, _print binary, _short binary, _bands array<long>")
    signed = materialize(signed.withColumn("_row", F.monotonically_increasing_id()), "minhash-signed")
    free_shuffles(spark)
    words = signed.filter("n_shingles > 0")
    same = words.groupBy("_print").agg(F.min("_row").alias("node"), F.count(F.lit(1)).alias("n"))
    equal = materialize(same.filter("n > 1").select(F.col("_print").alias("_p"), "node"), "minhash-equal")
    flagged = flag_maybe_in(words, F.col("_print"), equal, F.col("_p"))
    alone = flagged.filter("not _maybe").withColumn("node", F.col("_row"))
    others = flagged.filter("_maybe").join(equal, F.col("_print") == F.col("_p"), "left").withColumn("node", F.coalesce("node", "_row")).drop("_p")
    nodes = materialize(alone.unionByName(others).drop("_maybe", "_print"), "minhash-nodes")
    firsts = nodes.filter("node = _row")

    coarse = materialize(components(coarse_edges(firsts)), "minhash-coarse")
    free_shuffles(spark)
    comps = coarse.select("node", F.col("root").alias("comp")).union(coarse.select("root", "root").distinct())
    keys = firsts.select(F.col("node").alias("_n"), "_key", "n_shingles")
    members = comps.join(keys, F.col("node") == F.col("_n")).select("comp", "node", "_key", "n_shingles")
    members = materialize(members, "minhash-comps")
    free_shuffles(spark)
    sizes = members.groupBy("comp").agg(blocks_of("n_shingles")).withColumnRenamed("comp", "_c")
    dealt = members.join(sizes, F.col("comp") == F.col("_c")).drop("_c")
    roots = met_links(keyed, dealt.filter("blocks = 1").withColumn("part", F.lit(0)), "minhash-links").select(F.col("a").alias("_a"), F.col("b").alias("root"))
    free_shuffles(spark)
    large = materialize(dealt.filter("blocks > 1"), "minhash-large")
    if not large.isEmpty():
        roots = roots.union(large_roots(keyed, large))
    found = nodes.join(roots, F.col("node") == F.col("_a"), "left").select("_key", "n_shingles", F.coalesce("root", "node").alias("root"))
    return materialize(found.union(signed.filter("n_shingles = 0").select("_key", "n_shingles", F.lit(None).cast("long"))), "minhash-groups")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_shingles, component_id (the least id reachable) and kept (whether it is the document's own).

    Null and blank texts have no shingles and are linked with nothing. A null id
    counts as no id: it is never the least unless it is the only one. Repeated
    rows are one component. Very long texts are shingled whole. Extra columns are
    ignored, whatever their names; an empty table gives an empty result. Equal texts
    are found by 96 bits of md5, equal shingle sets by 128-bit hashes, and shingles
    are told apart, between two texts of one component, by 64-bit hashes.
    """
    placed = placed_rows(docs, id_col, text_col)
    least = placed.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")).withColumnRenamed("root", "_r")
    found = placed.join(least, F.col("root") == F.col("_r"), "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def placed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, _k (text key), n_shingles and root of every row."""
    key = text_key(F.col(text_col))
    groups = near_groups(docs.select(key.alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")))
    base = docs.select(F.col(id_col).alias("doc_id"), key.alias("_k"))
    return materialize(base.join(groups, F.col("_k") == F.col("_key")).select("doc_id", "_k", "n_shingles", "root"), "minhash-placed")


def near_dedup_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with the columns of `docs`: of each component the row with the least id (null last), and of repeated such rows one.

    Edge cases as in near_duplicates(). Only texts of components with more than one row are shuffled.
    """
    placed = placed_rows(docs, id_col, text_col).filter("root is not null")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_k"))
    groups = placed.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).filter("n > 1")
    stays = groups.select(F.col("root").alias("_r"), F.col("first.doc_id").alias("_stay"), F.col("first._k").alias("_stay_k"))
    tied = materialize(placed.select("_k", "root").distinct().join(stays, F.col("root") == F.col("_r")).select(F.col("_k").alias("_tied"), "_r", "_stay", "_stay_k"), "minhash-tied")
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text_key(F.col(text_col)).alias("_key"), F.col(id_col).alias("_id"))
    flagged = flag_maybe_in(boxed, F.col("_key"), tied, F.col("_tied"))
    judged = flagged.filter("_maybe").join(tied, F.col("_key") == F.col("_tied"), "left")
    firsts = judged.filter((F.col("_key") == F.col("_stay_k")) & F.col("_id").eqNullSafe(F.col("_stay"))).groupBy("_r").agg(F.first("_row").alias("_row"))
    stay = flagged.filter("not _maybe").select("_row").union(judged.filter("_tied is null").select("_row")).union(firsts.select("_row"))
    return stay.select("_row.*")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


ship_by_value(__name__)

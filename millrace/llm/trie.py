"""Prefix trie of conversations from mergeable partial tries.

A node is a sequence of first turns, named by 128 bits that are a sum over its
turns of hashes of turn and depth; so a prefix's name follows from the sums of its
blocks, and a conversation of any length is dealt out in blocks of turns.
Partitions of whole blocks, in order of conversations, emit locally combined node
tables: members, the smallest of them, and the ordered list of conversations that
end at the node, in pieces of bounded size. Tables are merged in rounds keyed by
node and a group of partitions, until one is left; the pieces of an end list are
disjoint and are read in order, so a digest needs one piece at a time.

The rollup is bottom-up by doubling: after k rounds a node has the sums of its
descendants nearer than 2**k, so a trie of depth d takes log2(d) rounds, whatever
its shape.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import free_shuffles, materialize, read_table, ship_by_value, word_count

#: Turns of a block, conversations of a piece of an end list, nodes and ends that a partition combines at once, and tables that a merge makes one.
BLOCK, PIECE, COMBINED, FAN = 4096, 4096, 100_000, 32
#: Conversations share the first turns of the first one in each GROUP; HEADS - 1 is the most they share.
GROUP, HEADS = 20, 4


def ordered_turns(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(turns, fragments): conv_id, part, row, h1, h2, words in global order; the first row and turns before each fragment, total.

    Ranges of (conversation, turn) are sorted, so a long conversation spans several
    partitions; its fragments are no more than these.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    told = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), text, role).alias("h2"), word_count(text).alias("words")
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2")]
    told = told.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*order, "_salt").sortWithinPartitions(*order)
    told = materialize(told.select("conv_id", F.monotonically_increasing_id().alias("row"), "h1", "h2", "words"), "trie-turns").withColumn("part", F.shiftright("row", 33))
    fragments = told.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("conv_id")
    before = F.sum("n").over(whole.orderBy("part")) - F.col("n")
    fragments = fragments.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), "first", before.alias("before"), F.sum("n").over(whole).alias("turns"))
    return told, materialize(fragments, "trie-fragments")


def rebuilt(turns: DataFrame, fragments: DataFrame) -> DataFrame:
    """conv_id, depth, h1, h2, words, last of every rebuilt turn, and a row of depth 0 for each conversation.

    The first h turns are those of the first conversation of the group, where h is the
    checksum of the id modulo HEADS; the conversation's own follow from its (h + 1)th on.
    """
    placed = (F.col("conv_id") == F.col("_c")) & (F.col("part") == F.col("_p"))
    pos = F.col("row") - F.col("first") + F.col("before")
    firsts = turns.filter(F.pmod("conv_id", F.lit(GROUP)) == 0).join(fragments.filter(F.col("before") < HEADS - 1), placed).withColumn("pos", pos).filter(F.col("pos") < HEADS - 1)
    heads = firsts.groupBy(F.col("conv_id").alias("_base")).agg(F.array_sort(F.collect_list(F.struct("pos", "h1", "h2", "words"))).alias("heads"))  # HEADS - 1 rows at most
    told = fragments.withColumn("h", F.pmod(F.crc32(F.col("_c").cast("string").cast("binary")), F.lit(HEADS)).cast("int")).withColumn("base", F.col("_c") - F.pmod("_c", F.lit(GROUP)))
    told = told.join(heads, F.col("base") == F.col("_base"), "left").withColumn("shared", F.slice(F.coalesce("heads", F.array().cast(heads.schema["heads"].dataType)), F.lit(1), F.col("h")))
    told = told.select("_c", "_p", "first", "before", "h", "shared", F.size("shared").alias("k"), (F.size("shared") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).cast("long").alias("length"))
    told = materialize(told, "trie-members")
    members = told.filter("before = 0").withColumnRenamed("_c", "conv_id")
    columns = ["conv_id", "depth", "h1", "h2", "words", (F.col("depth") == F.col("length")).alias("last")]
    none = F.lit(0).cast("long")
    tops = members.select("conv_id", none.alias("depth"), none.alias("h1"), none.alias("h2"), none.alias("words"), "length").select(columns)
    head = members.select("conv_id", "length", F.explode("shared").alias("x")).select("conv_id", "length", (F.col("x.pos") + 1).alias("depth"), "x.h1", "x.h2", "x.words").select(columns)
    own = turns.join(told, placed).withColumn("pos", pos).filter("pos >= h").withColumn("depth", F.col("k") + F.col("pos") - F.col("h") + 1).select(columns)
    return tops.union(head).union(own)


def wrapped(total: Column) -> Column:
    """A sum of longs, taken as a decimal, as the long it wraps around to."""
    whole = F.lit(str(1 << 64)).cast("decimal(38,0)")
    left = F.pmod(total.cast("decimal(38,0)"), whole)
    return F.when(left >= F.lit(str(1 << 63)).cast("decimal(38,0)"), left - whole).otherwise(left).cast("long")


def carried(rows: DataFrame) -> DataFrame:
    """rows with block, their hashes a and b, and the sums ca and cb of the blocks before; only blocks after the first are joined."""
    mixed = rows.select("conv_id", F.floor(F.col("depth") / F.lit(BLOCK)).alias("block"), "depth", *[F.when(F.col("depth") > 0, F.xxhash64(h, "depth")).otherwise(F.lit(0)).alias(c) for h, c in (("h1", "a"), ("h2", "b"))], "words", "last")
    mixed = materialize(mixed, "trie-rebuilt")
    long = mixed.filter("block > 0").select(F.col("conv_id").alias("_c")).distinct()
    sums = mixed.join(long, F.col("conv_id") == F.col("_c"), "left_semi").groupBy("conv_id", "block").agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in "ab"])
    upto = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), *[wrapped(F.coalesce(F.sum(c).over(upto), F.lit(0))).alias(f"c{c}") for c in "ab"]).filter("_b > 0")
    later = mixed.filter("block > 0").join(sums, (F.col("conv_id") == F.col("_c")) & (F.col("block") == F.col("_b"))).drop("_c", "_b")
    none = F.lit(0).cast("long")
    return mixed.filter("block = 0").withColumns({"ca": none, "cb": none}).union(later)


def _names(values: np.ndarray, carry: np.ndarray, new: np.ndarray, run: np.uint64) -> np.ndarray:
    """Running sums that restart from `carry` where `new`; before the first restart they go on from `run`."""
    sums = np.cumsum(values)
    starts = np.flatnonzero(new)
    base = np.full(len(values), run, np.uint64)
    if len(starts):
        of = np.cumsum(new) - 1
        base = np.where(of >= 0, (carry[starts] - (sums[starts] - values[starts]))[of], base)
    return sums + base


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conv_id, block, depth: the nodes met here with their members and ends."""
    part = TaskContext.get().partitionId()
    nodes: dict[tuple[int, int], list] = {}
    held = 0
    before, runs = None, [np.uint64(0)] * 2

    def flush() -> pa.RecordBatch:
        rows = []
        for (a, b), (qa, qb, depth, words, n, conv, ends) in nodes.items():
            rows.append((a, b, qa, qb, depth, words, n, conv, ends[:PIECE]))
            rows += [(a, b, qa, qb, depth, words, 0, conv, ends[i : i + PIECE]) for i in range(PIECE, len(ends), PIECE)]
        nodes.clear()
        columns = list(zip(*rows, strict=True)) if rows else [()] * 9
        arrays = [pa.array(c, pa.int64()) for c in columns[:8]]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(columns[8], pa.list_(pa.int64())), pa.array([part] * len(rows), pa.int64())], ["pa", "pb", "qa", "qb", "depth", "words", "n", "conv_id", "ends", "part"])

    for batch in batches:
        if not batch.num_rows:
            continue
        conv, block, depth, words = (batch.column(i).to_numpy() for i in range(4))
        a, b, ca, cb = (batch.column(i).to_numpy().view(np.uint64) for i in range(4, 8))
        new = np.r_[before != (conv[0], block[0]), (conv[1:] != conv[:-1]) | (block[1:] != block[:-1])]
        names = [_names(v, c, new, r) for v, c, r in ((a, ca, runs[0]), (b, cb, runs[1]))]
        before, runs = (conv[-1], block[-1]), [x[-1] for x in names]
        parents = [(x - v).view(np.int64).tolist() for x, v in zip(names, (a, b), strict=True)]
        rows = zip(*(x.view(np.int64).tolist() for x in names), *parents, depth.tolist(), words.tolist(), conv.tolist(), batch.column(8).to_pylist(), strict=True)
        for x, y, qa, qb, d, w, c, last in rows:
            node = nodes.get((x, y))
            if node is None:
                node = nodes[x, y] = [qa, qb, d, w, 0, c, []]
                held += 1
            node[4] += 1
            if last:
                node[6].append(c)
                held += 1
        if held > COMBINED:
            yield flush()
            held = 0
    yield flush()


def merged(partials: DataFrame) -> DataFrame:
    """One table of nodes from the tables of partitions: groups of FAN tables become one, until one is left."""
    tables = (partials.agg(F.max("part")).first()[0] or 0) + 1
    nodes = partials.drop("ends")
    while True:
        tables = math.ceil(tables / FAN)
        nodes = nodes.withColumn("part", F.floor(F.col("part") / F.lit(FAN))).groupBy("pa", "pb", "part")
        nodes = nodes.agg(*[F.first(c).alias(c) for c in ("qa", "qb", "depth", "words")], F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"))
        if tables == 1:
            return materialize(nodes.drop("part"), "trie-nodes")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of end lists sorted by node and first conversation: one digest a node, one piece in memory."""
    key, sha, done = None, None, []

    def flush() -> pa.RecordBatch:
        a, b, s = zip(*done, strict=True) if done else ((), (), ())
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.string())], ["ea", "eb", "ends_sha256"])

    for batch in batches:
        for a, b, ends in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if (a, b) != key:
                if key is not None:
                    done.append((*key, sha.hexdigest()))
                key, sha = (a, b), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(",".join(map(str, ends)).encode())
        if len(done) > COMBINED:
            yield flush()
    if key is not None:
        done.append((*key, sha.hexdigest()))
    yield flush()


def end_digests(partials: DataFrame) -> DataFrame:
    pieces = partials.filter(F.size("ends") > 0).select("pa", "pb", F.col("ends")[0].alias("first"), "ends")
    return pieces.repartition("pa", "pb").sortWithinPartitions("pa", "pb", "first").mapInArrow(_digest, "ea long, eb long, ends_sha256 string")


def rolled_up(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """nodes (pa, pb, qa, qb, depth and `sums`) with each of `sums` added up over the node's subtree, itself included."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    now, step = nodes.select("pa", "pb", "qa", "qb", "depth", *sums), 1
    while step <= deepest:
        sent = now.filter(F.col("depth") >= step).groupBy(F.col("qa").alias("_a"), F.col("qb").alias("_b")).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
        joined = now.join(sent, (F.col("pa") == F.col("_a")) & (F.col("pb") == F.col("_b")), "left").drop("_a", "_b")
        joined = joined.select("pa", "pb", "qa", "qb", "depth", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums])
        # Ancestors twice as far: the root is known, nodes less deep have none.
        above = now.filter(F.col("depth") > step).select(F.col("pa").alias("_a"), F.col("pb").alias("_b"), F.col("qa").alias("_qa"), F.col("qb").alias("_qb"))
        deep, none = F.col("depth") > 2 * step, F.lit(0).cast("long")
        far = joined.filter(deep).join(above, (F.col("qa") == F.col("_a")) & (F.col("qb") == F.col("_b"))).select("pa", "pb", F.col("_qa").alias("qa"), F.col("_qb").alias("qb"), "depth", *sums)
        now = materialize(far.union(joined.filter(~deep).select("pa", "pb", none.alias("qa"), none.alias("qb"), "depth", *sums)), "trie-sums")
        step *= 2
        free_shuffles(nodes.sparkSession)
    return now.select(F.col("pa").alias("_a"), F.col("pb").alias("_b"), *sums)


def prefix_trie(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node of the trie of rebuilt conversations, the root included.

    Turns are ordered by turn, null first, and within one turn by hashes of role and
    text; repeated rows are turns of their own. A null role or text is empty. Rows
    with a null id belong to no conversation and are left out. Very long texts are
    hashed and counted whole, and long conversations cost as many rows as turns.
    Extra columns are ignored, whatever their names; an empty table gives an empty
    result. Nodes are known by 128 bits.
    """
    spark = turns.sparkSession
    rows = carried(rebuilt(*ordered_turns(turns, id_col, turn_col, role_col, text_col)))
    dealt = rows.select("conv_id", "block", "depth", "words", "a", "b", "ca", "cb", "last").repartitionByRange("conv_id", "block").sortWithinPartitions("conv_id", "block", "depth")
    schema = "pa long, pb long, qa long, qb long, depth long, words long, n long, conv_id long, ends array<long>, part long"
    partials = materialize(dealt.mapInArrow(_combine, schema), "trie-partials")
    free_shuffles(spark)
    nodes = merged(partials)
    children = nodes.filter("depth > 0").groupBy(F.col("qa").alias("_a"), F.col("qb").alias("_b")).agg(F.count(F.lit(1)).alias("n_children"))
    told = nodes.join(children, (F.col("pa") == F.col("_a")) & (F.col("pb") == F.col("_b")), "left").drop("_a", "_b").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    told = told.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n") - 1) * F.col("words"))
    told = materialize(told, "trie-children")
    sums = rolled_up(told, ["n_leaves", "saved_tokens"])
    root = told.filter("depth = 0").select("conv_id").first()  # one row
    parents = told.filter("n_children > 0 and depth > 0").select(F.col("pa").alias("_pa"), F.col("pb").alias("_pb"), F.col("conv_id").alias("_parent"))
    parent = F.when(F.col("depth") == 1, F.lit(root[0] if root else None).cast("long")).otherwise(F.col("_parent"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    full = (
        told.drop("n_leaves", "saved_tokens")
        .join(sums, (F.col("pa") == F.col("_a")) & (F.col("pb") == F.col("_b")))
        .join(end_digests(partials), (F.col("pa") == F.col("ea")) & (F.col("pb") == F.col("eb")), "left")
        .join(parents, (F.col("depth") > 1) & (F.col("qa") == F.col("_pa")) & (F.col("qb") == F.col("_pb")), "left")
    )
    return full.select("conv_id", "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


#: CRC-32 is worked out byte by byte from its polynomial, as this SQL has no function for it.
OP11_SQL = r"""
WITH k AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)) AS bytes FROM (SELECT DISTINCT conv_id FROM t)),
h AS (SELECT conv_id, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1])), 4294967295) % 4 AS h, conv_id - ((conv_id % 20) + 20) % 20 AS base FROM i, k),
s AS (SELECT h.conv_id, h, (SELECT count(*) FROM t WHERE t.conv_id = base AND pos < h) AS shared, base FROM h),
r AS (SELECT s.conv_id, pos + 1 AS depth, role, text FROM s JOIN t ON t.conv_id = base AND pos < h UNION ALL
      SELECT s.conv_id, shared + pos - h + 1, role, text FROM s JOIN t ON t.conv_id = s.conv_id AND pos >= h),
p AS (SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, md5(string_agg(md5(length(role) || ':' || role || text), ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS path FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM s),
l AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM p),
n AS (SELECT path, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM l GROUP BY path, depth),
c AS (SELECT parent, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY parent),
a AS (SELECT p.path, sum((n_convs - 1) * n.words) AS saved, count(*) FILTER (n_children IS NULL) AS leaves FROM n LEFT JOIN c ON c.parent = n.path JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN c ON c.parent = n.path JOIN a ON a.path = n.path LEFT JOIN n u ON u.path = n.parent
"""

ship_by_value(__name__)

"""Benchmark decontamination with a distributed positional inverted index (DataFrame functions only).

The index holds one posting (term, row, pos) for every word of the corpus. It is
partitioned by document and sorted by term within a partition, so building it
shuffles nothing and a frequent word's list lies in all partitions; a document's
first posting has no term and carries its id and length. A posting also has a
byte for each of the words beside it. The index knows nothing of the test and
serves any number of tests.

Exact phrases: each window of a test item is looked up by its rarest word (by the
index's own counts); that list, cut by the neighbours' bytes and adjusted by the
word's offset, gives candidate starts, which are intersected with the list of the second rarest word, and what
is left with all others at once. Lists meet on (row, pos), a key that no word
makes hot, and only postings that a fixed-size bitmap lets through are shuffled.

Proximity: an item is near where its rarest words stand within a few words of its
very rarest one, in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import free_shuffles, materialize, maybe_in, read_table

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Words of an item that must stand near each other, and how near.
NEAR_TERMS, NEAR_SPAN = 3, 10
#: Bits of the bitmaps of wanted places.
PLACE_BITS = 24
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ASIDE = "".join(chr(i) for i in [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def tokens(text: Column) -> Column:
    """Words as an array: runs of a-z, 0-9 and everything beyond ASCII, after A-Z are lower-cased. Null has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), _UPPER + _ASIDE, _UPPER.lower() + " " * len(_ASIDE))
    return F.array_remove(F.split(spaced, " "), "")


def code(term: Column) -> Column:
    """A word's hash as 1 to 255; 0 stands for the ends of a document."""
    return (F.pmod(term, F.lit(255)) + 1).cast("int")


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (term, row, pos, around, doc_id) of all words; where term is null, pos is the number of words of the document.

    `around` is 256 times the code of the word before plus that of the word after.
    """
    told = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.transform(tokens(F.col(text_col)), lambda x: F.xxhash64(x)).alias("term"))
    told = told.select("row", "doc_id", F.size("term").alias("n"), "term", F.transform("term", code).alias("c"))
    end = F.array(F.lit(0))
    zipped = F.arrays_zip("term", F.slice(F.concat(end, "c"), F.lit(1), F.col("n")).alias("b"), F.slice(F.concat("c", end), F.lit(2), F.col("n")).alias("a"))
    told = told.select("row", "doc_id", "n", zipped.alias("z"))
    first = F.array(F.lit(None).cast(told.schema["z"].dataType.elementType))
    every = told.select("row", "doc_id", "n", F.posexplode(F.concat(first, "z")).alias("at", "x"))
    word = F.col("at") > 0
    postings = every.select(F.col("x.term"), "row", F.when(word, F.col("at") - 1).otherwise(F.col("n")).alias("pos"), (F.col("x.b") * 256 + F.col("x.a")).alias("around"), F.when(~word, F.col("doc_id")).alias("doc_id"))
    return materialize(postings.sortWithinPartitions("term"), "index-postings")


def indexed_documents(index: DataFrame) -> DataFrame:
    """row, doc_id and n_words of every document of the index."""
    return index.filter("term is null").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (the id as a string) and the hashes of its words; items without words go."""
    told = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.transform(tokens(F.col(text_col)), lambda x: F.xxhash64(x)).alias("terms"))
    return told.filter(F.size("terms") > 0).distinct()


def term_counts(index: DataFrame, terms: DataFrame) -> DataFrame:
    """counted, n_corpus: how often each of `terms` (term) stands in the corpus; absent words have no row."""
    wanted = terms.select("term").distinct()
    found = maybe_in(index.filter("term is not null").select("term"), F.col("term"), wanted, F.col("term"))
    counts = found.groupBy(F.col("term").alias("counted")).agg(F.count(F.lit(1)).alias("n_corpus"))
    return materialize(counts.join(wanted, F.col("counted") == F.col("term"), "left_semi"), "index-counts")


def windows_of(items: DataFrame, counts: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(windows, owners): w and its (offset, term) pairs, rarest first, of windows whose words all occur; item and w."""
    size = F.least(F.size("terms"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("terms") - size + 1)
    cut = items.select("item", F.explode(F.transform(starts, lambda s: F.slice("terms", s, size))).alias("terms"))
    owners = materialize(cut.select("item", "terms", F.xxhash64(F.size("terms"), "terms").alias("w"), F.hash("terms").alias("w2")).distinct(), "index-windows")
    placed = owners.select("w", "w2", "terms").distinct().select("w", "w2", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    known = placed.join(counts, F.col("term") == F.col("counted"))
    ranked = known.groupBy("w", "w2", "size").agg(F.array_sort(F.collect_list(F.struct("n_corpus", "offset", "term"))).alias("by"))
    windows = ranked.filter(F.size("by") == F.col("size")).select("w", "w2", F.transform("by", lambda x: F.struct(x["offset"].alias("offset"), x["term"].alias("term"))).alias("by"))
    return materialize(windows, "index-lookups"), owners.select("item", "w", "w2").distinct()


def at_places(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of `wanted` (row, pos, term and others) whose term stands at that place."""
    place = F.xxhash64("term", "row", "pos")
    lists = maybe_in(index.filter("term is not null").select("term", "row", "pos"), F.col("term"), wanted, F.col("term"))
    lists = maybe_in(lists, place, wanted, place, PLACE_BITS)
    lists = lists.select(F.col("term").alias("_t"), F.col("row").alias("_r"), F.col("pos").alias("_p"))
    same = (F.col("term") == F.col("_t")) & (F.col("row") == F.col("_r")) & (F.col("pos") == F.col("_p"))
    return wanted.join(lists, same, "left_semi")


def phrase_matches(index: DataFrame, items: DataFrame, *, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text", counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches, owners): w, row, start and size of every occurrence of a window; which item (as a string) has which w.

    Windows are known by 96 bits, words by 64.
    """
    told = item_terms(items, id_col, text_col)
    counts = counts if counts is not None else term_counts(index, told.select(F.explode("terms").alias("term")))
    windows, owners = windows_of(told, counts, window)
    first, second = F.col("by")[0], F.try_element_at("by", F.lit(2))
    beside = lambda d: code(F.get(F.filter("by", lambda x: x["offset"] == first["offset"] + d), F.lit(0))["term"])
    anchors = windows.select(
        "w", "w2", F.size("by").alias("size"), first["term"].alias("t1"), first["offset"].alias("o1"), second["term"].alias("t2"), second["offset"].alias("o2"), beside(-1).alias("b1"), beside(1).alias("a1")
    )
    anchors = materialize(anchors, "index-anchors")
    lists = maybe_in(index.filter("term is not null").select("term", "row", "pos", "around"), F.col("term"), anchors, F.col("t1"))
    # The words beside the rarest one are known by 8 bits each: most places go here, before anything is shuffled.
    fits = (F.coalesce(F.col("b1"), F.expr("around div 256")) == F.expr("around div 256")) & (F.coalesce(F.col("a1"), F.expr("around % 256")) == F.expr("around % 256"))
    starts = lists.join(anchors, (F.col("term") == F.col("t1")) & fits).select("w", "w2", "size", "row", (F.col("pos") - F.col("o1")).alias("start"), "t2", "o2").filter("start >= 0")
    starts = materialize(starts, "index-starts")
    pairs = starts.filter("size > 1").select("w", "w2", "size", "row", "start", F.col("t2").alias("term"), (F.col("start") + F.col("o2")).alias("pos"))
    pairs = materialize(at_places(index, pairs).select("w", "w2", "size", "row", "start"), "index-pairs")
    free_shuffles(index.sparkSession)
    rest = windows.filter(F.size("by") > 2).select(F.col("w").alias("_w"), F.col("w2").alias("_w2"), F.explode(F.slice("by", 3, window)).alias("x"))
    wanted = pairs.filter("size > 2").join(rest, (F.col("w") == F.col("_w")) & (F.col("w2") == F.col("_w2")))
    wanted = materialize(wanted.select("w", "w2", "size", "row", "start", F.col("x.term").alias("term"), (F.col("start") + F.col("x.offset")).alias("pos")), "index-wanted")
    whole = at_places(index, wanted).groupBy("w", "w2", "size", "row", "start").agg(F.count(F.lit(1)).alias("n")).filter("n = size - 2").drop("n")
    columns = ["w", "w2", "size", "row", "start"]
    matches = starts.filter("size = 1").select(columns).union(pairs.filter("size = 2").select(columns)).union(whole.select(columns))
    return materialize(matches, "index-matches"), owners


def near_matches(index: DataFrame, items: DataFrame, *, terms: int = NEAR_TERMS, span: int = NEAR_SPAN, id_col: str = "item_id", text_col: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """item and row, once each, where the item's rarest words all stand at most `span` words from one place of the very rarest.

    The words are the `terms` rarest of the item that occur in the corpus, ties in
    the item's order; an item with fewer than two such words is near nothing.
    """
    told = item_terms(items, id_col, text_col)
    counts = counts if counts is not None else term_counts(index, told.select(F.explode("terms").alias("term")))
    each = told.select(F.xxhash64("item", "terms").alias("key"), "item", F.posexplode("terms").alias("at", "term"))
    firsts = each.groupBy("key", "item", "term").agg(F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy("key", "item").orderBy("n_corpus", "at"))
    rare = firsts.join(counts, F.col("term") == F.col("counted")).withColumn("rank", rank).filter(F.col("rank") <= terms)
    rare = materialize(rare.select("key", "item", "term", "rank", F.max("rank").over(Window.partitionBy("key", "item")).alias("of")).filter("of > 1"), "index-rare")
    lists = maybe_in(index.filter("term is not null").select("term", "row", "pos"), F.col("term"), rare, F.col("term"))
    found = materialize(lists.withColumnRenamed("term", "_t").join(rare, F.col("_t") == F.col("term")).select("key", "item", "rank", "of", "row", "pos"), "index-near")
    block = lambda c: F.floor(c / F.lit(span))
    anchors = found.filter("rank = 1").select("key", "item", "of", "row", F.col("pos").alias("anchor"), F.explode(F.array(block(F.col("pos") - span), block(F.col("pos")), block(F.col("pos") + span))).alias("block"))
    others = found.filter("rank > 1").select(F.col("key").alias("_k"), F.col("item").alias("_i"), F.col("row").alias("_r"), F.col("rank").alias("other"), "pos", block(F.col("pos")).alias("_b"))
    same = (F.col("key") == F.col("_k")) & (F.col("item") == F.col("_i")) & (F.col("row") == F.col("_r")) & (F.col("block") == F.col("_b")) & (F.abs(F.col("pos") - F.col("anchor")) <= span)
    met = anchors.join(others, same).select("key", "item", "of", "row", "anchor", "other").distinct()
    return met.groupBy("key", "item", "of", "row", "anchor").agg(F.count(F.lit(1)).alias("n")).filter("n = of - 1").select("item", "row").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: words, words hit by windows of test items, the items with occurring windows, and n_near items.

    Null and blank texts have no words; an item without words is no window. A null
    item id is written `null`; items that share an id count once. Null and repeated
    document ids are kept as they are, repeated rows and copies are judged alike,
    very long texts whole. Extra columns are ignored, whatever their names; an empty
    table on either side gives no hits (no documents: no rows). Words are known by 64-bit hashes.
    """
    index = build_index(docs, id_col=id_col, text_col=text_col)
    terms = item_terms(items, item_id_col, item_text_col)
    counts = term_counts(index, terms.select(F.explode("terms").alias("term")))
    named = {"id_col": item_id_col, "text_col": item_text_col, "counts": counts}
    matches, owners = phrase_matches(index, items, window=window, **named)
    places = matches.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("pos")).distinct()
    hit = places.groupBy(F.col("row").alias("_hit")).agg(F.count(F.lit(1)).alias("n_hit"))
    owned = owners.select("item", F.col("w").alias("_w"), F.col("w2").alias("_w2"))
    found = matches.select("w", "w2", "row").distinct().join(owned, (F.col("w") == F.col("_w")) & (F.col("w2") == F.col("_w2"))).select("row", "item").distinct()
    listed = found.groupBy(F.col("row").alias("_found")).agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("_items"))
    near = near_matches(index, items, **named).groupBy(F.col("row").alias("_near")).agg(F.count(F.lit(1)).alias("n_near"))
    facts = materialize(hit.join(listed, F.col("_hit") == F.col("_found")).select(F.col("_hit").alias("_a"), "n_hit", "n_items", "_items"), "index-hits")
    near = materialize(near, "index-nears")
    joined = indexed_documents(index).join(facts, F.col("row") == F.col("_a"), "left").join(near, F.col("row") == F.col("_near"), "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select("doc_id", "n_words", none("n_hit"), none("n_items"), F.sha2(F.coalesce("_items", F.lit("")).cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), none("n_near"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS iid, coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, len(x) AS size, array_to_string(x, ' ') AS gram FROM (SELECT item, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda s: w[s:s + 9])) AS x FROM i WHERE len(w) > 0)),
p AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
x AS (SELECT rid, pos, list(word) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS next FROM p),
y AS (SELECT rid, pos, size, array_to_string(next[:size], ' ') AS gram FROM x, (SELECT DISTINCT size FROM g) WHERE size <= len(next)),
m AS (SELECT DISTINCT rid, pos, item, y.size FROM y JOIN g USING (size, gram)),
h AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + size)) AS place FROM m) GROUP BY rid),
l AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid),
c AS (SELECT word, count(*) AS n FROM p GROUP BY word),
t AS (SELECT iid, item, word, min(pos) AS pos FROM (SELECT iid, item, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM i) GROUP BY ALL),
r AS (SELECT iid, item, t.word, row_number() OVER (PARTITION BY iid ORDER BY n, t.pos) AS rank FROM t JOIN c USING (word) QUALIFY rank <= 3),
o AS (SELECT *, max(rank) OVER (PARTITION BY iid) AS k FROM r),
q AS (SELECT o.*, rid, p.pos FROM o JOIN p USING (word) WHERE k > 1),
n AS (SELECT rid, count(DISTINCT item) AS n_near FROM (
  SELECT a.iid, a.item, a.rid, a.pos FROM q a JOIN q b ON a.iid = b.iid AND a.rid = b.rid AND a.rank = 1 AND b.rank > 1 AND abs(a.pos - b.pos) <= 10
  GROUP BY a.iid, a.item, a.rid, a.pos, a.k HAVING count(DISTINCT b.rank) = a.k - 1) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN h USING (rid) LEFT JOIN l USING (rid) LEFT JOIN n USING (rid)
"""

"""Spelling variant grouping with Aho-Corasick automata over the halves of words.

Two words one edit apart share all of one but a gap that holds the edit. Every
word is cut in two, and the rest around each gap, written as a ring (what follows
the gap, a mark for the word's ends, what precedes it), is a segment: for the two
halves, the other half tied to its end of the word. Shards of automata hold the
segments; every word, doubled around the mark, is scanned by the shards that can
hold one of its own, and a hit is a pair whose segment lies at the right offset;
lengths are compared and the gaps are checked for exactly one edit.

A segment of too many words is not compared within itself: its gap is halved and
the longer segments take its place, until few words share one. With a gap of a
single letter only as many words can share a segment as there are letters, so no
group stays large, and nothing is dropped.

Each pair is found at one gap only (the one that holds the first difference), so
sums over shards are exact, and a shard emits one row a word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import free_shuffles, materialize, maybe_in, read_table, ship_by_value

LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form occurs so many times as often as its variant.
RATIO = 10
#: Of documents' runs, one in MISSPELT loses a letter (a fixed part of the query's definition of a word).
MISSPELT = 31
#: Words of one segment that are compared with each other, and segments of one automaton.
MAX_HOLDERS, SHARD = 48, 20_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RUN = "[A-Za-zÀ-ÿ]"


def corpus_words(docs: DataFrame, id_col: str, text_col: str, misspelt: int | None) -> DataFrame:
    """word and n: letter runs in small letters; with `misspelt`, one in so many loses the letter that its checksum names."""
    found = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"{RUN}{{{LEAST_LENGTH},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.explode(found).alias("run")).withColumn("run", F.translate("run", _UPPER, _UPPER.lower()))
    if misspelt:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        cut = F.expr("concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
        runs = runs.select(F.when(F.col("h") % misspelt == 0, cut).otherwise(F.col("run")).alias("run")).filter(F.length("run") >= LEAST_LENGTH)
    return runs.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def segment(word: Column, as_length: Column, start: Column, gap: Column) -> Column:
    """64 bits that name what a word of `as_length` letters is around the gap."""
    after = as_length - start - gap
    return F.xxhash64(as_length, start, gap, F.substring(word, F.lit(1), start), F.when(after > 0, F.right(word, after)).otherwise(F.lit("")))


def segments(vocabulary: DataFrame, max_holders: int = MAX_HOLDERS) -> DataFrame:
    """key, word, n, length, as_length, start, gap: what a word holds (as_length = length) and what may be held by a word one shorter."""
    told = vocabulary.select("word", "n", F.length("word").alias("length"))
    told = told.select("*", F.explode(F.sequence(F.greatest(F.col("length") - 1, F.lit(LEAST_LENGTH)), F.col("length"))).alias("as_length"))
    gaps = F.explode(F.array(F.lit(0), F.lit(1)))
    half = F.expr("as_length div 2").cast("int")
    rows = told.withColumn("half", half).withColumn("side", gaps)
    rows = rows.select("word", "n", "length", "as_length", F.when(F.col("side") == 0, 0).otherwise(F.col("half")).alias("start"), F.when(F.col("side") == 0, F.col("half")).otherwise(F.col("as_length") - F.col("half")).alias("gap"))
    done = None
    while True:
        rows = materialize(rows.select(segment(F.col("word"), F.col("as_length"), F.col("start"), F.col("gap")).alias("key"), "word", "n", "length", "as_length", "start", "gap"), "spelling-segments")
        hot = rows.filter("length = as_length and gap > 1").groupBy(F.col("key").alias("_hot")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_holders).select("_hot")
        hot = materialize(hot, "spelling-hot")
        here = rows.join(hot, F.col("key") == F.col("_hot"), "left_anti")
        done = here if done is None else done.union(here)
        if hot.isEmpty():
            break
        more = maybe_in(rows, F.col("key"), hot, F.col("_hot")).join(hot, F.col("key") == F.col("_hot"), "left_semi")
        half = F.expr("gap div 2").cast("int")
        more = more.withColumn("half", half).withColumn("side", gaps)
        rows = more.select(
            "word", "n", "length", "as_length", (F.col("start") + F.when(F.col("side") == 0, 0).otherwise(F.col("half"))).alias("start"), F.when(F.col("side") == 0, F.col("half")).otherwise(F.col("gap") - F.col("half")).alias("gap")
        )
    return done


class Shard:
    """An automaton of segments, and for each word met so far the sums over its near words."""

    def __init__(self) -> None:
        self.held: dict[str, list[tuple[str, int, int, int]]] = {}
        self.holders: dict[str, int] = {}
        self.scanned: set[str] = set()
        self.sums: dict[str, list] = {}
        self.automaton = None

    def hold(self, word: str, n: int, start: int, gap: int) -> None:
        self.held.setdefault(word[start + gap :] + "\0" + word[:start], []).append((word, n, start, gap))
        self.holders[word] = n

    def built(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for pattern, words in self.held.items():
            self.automaton.add_word(pattern, words)
        self.automaton.make_automaton()
        for word, n in self.holders.items():
            self.scan(word, n)

    def add(self, word: str, near: str, n: int) -> None:
        found = self.sums.get(word)
        if found is None:
            self.sums[word] = [1, n, near]
        else:
            found[0] += 1
            if n > found[1] or (n == found[1] and near < found[2]):
                found[1:] = n, near

    def scan(self, word: str, n: int) -> None:
        if word in self.scanned:
            return
        self.scanned.add(word)
        length = len(word)
        for _, words in self.automaton.iter(word + "\0" + word):
            for other, m, start, gap in words:
                more = length - len(other)
                if more == 0:
                    a, b = other[start : start + gap], word[start : start + gap]
                    if a != b and sum(map(str.__ne__, a, b)) == 1:
                        self.add(word, other, m)
                elif more == 1:  # the gaps differ by one inserted letter, counted at the gap of the first difference
                    a, b = other[start : start + gap], word[start : start + gap + 1]
                    i = 0
                    while i < gap and a[i] == b[i]:
                        i += 1
                    if a[i:] == b[i + 1 :] and (i < gap or start + gap == length - 1):
                        self.add(word, other, m)
                        self.add(other, word, n)

    def rows(self) -> pa.RecordBatch:
        if self.automaton is None:
            self.built()
        words = list(self.sums)
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), *(pa.array([self.sums[w][k] for w in words], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string())))], ["word", "near", "n", "best"]
        )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, holders first."""
    at, shard = None, Shard()
    for batch in batches:
        for s, scans, word, n, start, gap in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if s != at:
                if at is not None:
                    yield shard.rows()
                at, shard = s, Shard()
            if not scans:
                shard.hold(word, n, start, gap)
            else:
                if shard.automaton is None:
                    shard.built()
                shard.scan(word, n)
    if at is not None:
        yield shard.rows()


def near_words(vocabulary: DataFrame, max_holders: int = MAX_HOLDERS, shard: int = SHARD) -> DataFrame:
    """word, near (its near words' number), best and best_n (the most frequent, ties: the smallest), of words with near words."""
    rows = segments(vocabulary, max_holders)
    held = rows.filter("length = as_length").groupBy(F.col("key").alias("_held")).agg(F.count(F.lit(1)).alias("_n"))
    held = materialize(held, "spelling-held")
    scans = F.col("length") > F.col("as_length")
    # A word alone on its segment meets only words one longer; these go only where a segment is held.
    longer = maybe_in(rows.filter(scans), F.col("key"), held, F.col("_held"), 24)
    sought = rows.filter(scans).select(F.col("key").alias("_key"))
    several = held.filter("_n > 1").select(F.col("_held").alias("_key"))
    holders = maybe_in(rows.filter(~scans), F.col("key"), sought.union(several), F.col("_key"), 24)
    count = held.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    shards = max(1, math.ceil(count / shard))
    dealt = holders.union(longer).select(F.pmod("key", F.lit(shards)).alias("shard"), scans.alias("scans"), "word", "n", "start", "gap")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "scans")
    sums = dealt.mapInArrow(_compare, "word string, near long, n long, best string")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("best").alias("w")))
    return sums.groupBy("word").agg(F.sum("near").alias("near"), best.alias("b")).select("word", "near", F.col("b.w").alias("best"), (-F.col("b.n")).alias("best_n"))


def follow(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form), where a form may have a form itself.

    A form occurs RATIO times as often as its variant, so a chain is no longer than the
    number of digits of the largest count, and so are the rounds.
    """
    ends = links.select("word", F.col("form").alias("root"))
    steps = links.select(F.col("word").alias("_w"), F.col("form").alias("_f"))
    while True:
        joined = materialize(ends.join(steps, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_f", "root").alias("root"), F.col("_f").isNotNull().alias("moved")), "spelling-roots")
        ends = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return ends


def group_spellings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", misspelt: int | None = None, ratio: int = RATIO) -> DataFrame:
    """One row per word of LEAST_LENGTH letters or more that occurs LEAST_COUNT times or more: form, root, n, n_near, form_n.

    Null, empty and blank texts have no words; a null id is written `null`. Repeated
    rows count as often as they stand; very long texts and very long runs are words
    as all others. Of near words equal in n the smallest in code-point order is the
    form. Extra columns are ignored, whatever their names; an empty table gives an
    empty result. Segments are dealt to shards by 64-bit hashes and compared as text.
    """
    vocabulary = materialize(corpus_words(docs, id_col, text_col, misspelt), "spelling-words")
    free_shuffles(docs.sparkSession)
    near = near_words(vocabulary).withColumnRenamed("word", "_w")
    told = vocabulary.join(near, F.col("word") == F.col("_w"), "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    told = told.select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    told = materialize(told, "spelling-forms")
    free_shuffles(docs.sparkSession)
    roots = follow(told.filter("form is not null").select("word", "form")).withColumnRenamed("word", "_w")
    return told.join(roots, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(read_table(spark, sf_dir, "documents"), misspelt=MISSPELT)


#: CRC-32 is worked out byte by byte from its polynomial, as this SQL has no function for it.
OP12_SQL = """
WITH RECURSIVE k AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs),
r AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
      FROM (SELECT coalesce(doc_id::VARCHAR, 'null') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents) GROUP BY ALL),
b AS (SELECT *, list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda h: ('0x' || h)::BIGINT)) AS bytes FROM r),
h AS (SELECT run, n, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, k),
c AS (SELECT n, CASE WHEN h % 31 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM c WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n AS m FROM d a JOIN d b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
      UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.cut = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.cut = v.word),
s AS (SELECT word, count(*) AS n_near, first(near ORDER BY m DESC, near) AS best, max(m) AS best_n FROM p GROUP BY word),
f AS (SELECT v.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM v LEFT JOIN s USING (word)),
t AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON t.next = f.word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, root FROM t WHERE next IS NULL) USING (word)
"""

ship_by_value(__name__)

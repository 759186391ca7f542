"""Curation, split and sampling queries over the driver tables: a text stands for a comment or a snippet, a source for a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.taxonomy import RULES, classify, classify_all, hardness
from millrace.operators import curation as C
from millrace.operators import splits as S
from millrace.plans import documents as documents_of

LIMITS = C.Limits(comment_chars=(20, 4000), ascii_ratio=0.95, languages=("en", "fr", "de"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


SPACE = r"[ \t\n\x0b\f\r]"
# Unicode's white space and Latin letters, for a matcher whose classes are ASCII only.
U_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LATIN = r"[\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]"


def sql_trim(c: str) -> str:
    return f"regexp_replace({c}, '\\A{U_SPACE}+|{U_SPACE}+\\z', '', 'g')"


def sql_words(c: str) -> str:
    """Letters beyond ASCII become an underscore: a word character that no pattern names, so that word borders agree."""
    return f"regexp_replace({c}, '{LATIN}', '_', 'g')"


def reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).withColumn("_trimmed", T.pytrim(F.coalesce("text", F.lit("")))).withColumn("_low", F.lower("_trimmed"))  # once, not in every rule
    return rows.withColumn("reject_reason", C.first_reason(C.comment_reasons(F.col("_trimmed"), F.col("lang"), LIMITS, F.col("_low"))))


def _rx(p: str) -> str:
    return p.replace("'", "''")


_T = sql_trim("coalesce(text, '')")
REASON_SQL = rf"""
CASE WHEN coalesce(lang, '') NOT IN ('en', 'fr', 'de') THEN 'language_not_selected'
     WHEN length({_T}) = 0 THEN 'empty_comment'
     WHEN regexp_matches({_T}, '(?i){_rx(T.NON_ACTIONABLE)}') THEN 'comment_non_actionable'
     WHEN regexp_matches({sql_words(_T)}, '(?i){_rx(T.OUTSIDE_CONTEXT)}') THEN 'comment_references_outside_context'
     WHEN length({_T}) NOT BETWEEN 20 AND 4000 THEN 'comment_length'
     WHEN length(regexp_replace({_T}, '[^\x00-\x7F]', '', 'g'))::DOUBLE / length({_T}) < 0.95 THEN 'comment_not_ascii'
END"""


def funnel_reasons(spark, d):
    return reasons(spark, d).groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def funnel_grouping_sets(spark, d):
    return C.funnel_counts(reasons(spark, d), ["lang", "source"])


def ascii_ratio(spark, d):
    return documents(spark, d).select("doc_id", T.ascii_ratio(F.col("text")).alias("ratio"))


def content_id(spark, d):
    h = T.content_hash(F.col("text"), F.col("text"))
    return documents(spark, d).select("doc_id", T.norm_comment(F.col("text")).alias("norm"), h.alias("hash"), T.short_id(h).alias("id"))


def keyed(spark, d):
    return keys_of(documents(spark, d))


def keys_of(rows: DataFrame) -> DataFrame:
    """Digest of the collapsed text, source and first word: what dedup and quotas go by."""
    return rows.select(
        "doc_id", "source", F.sha1(F.regexp_replace("text", SPACE + "+", " ")).alias("hash"), F.lower(F.substring_index("text", " ", 1)).alias("first_word")
    )


KEYED = rf"SELECT doc_id, source, sha1(regexp_replace(text, '{SPACE}+', ' ', 'g')) AS hash, lower(split_part(text, ' ', 1)) AS first_word FROM documents"


def dedup_first_wins(spark, d):
    return C.first_wins(keyed(spark, d), "hash", ["doc_id"])


def quota_cascade(spark, d):
    return C.cascade(keyed(spark, d), hash_col="hash", repo_col="source", comment_col="first_word", order=["doc_id"], per_repo=10, per_comment=3)


def quota_exact_greedy(spark, d):
    v = C.greedy(keyed(spark, d), hash_col="hash", repo_col="source", comment_col="first_word", order_col="doc_id", per_repo=10, per_comment=3)
    return v.select(F.col("order_key").alias("doc_id"), "verdict")


def most_common_sources(spark, d):
    return C.most_common(documents(spark, d), "source", "doc_id")


def balanced_sample(spark, d):
    score = F.col("n_chars")
    return S.round_robin_sample(documents(spark, d).select("doc_id", "lang", "source", "n_chars"), ["lang", "source"], score, F.col("doc_id"), 200, 13)


def hard_benchmark(spark, d):
    rows = documents(spark, d).withColumn("_low", F.lower("text"))  # once, not in every rule
    rows = rows.select("doc_id", classify(F.col("text"), small=F.col("_low")).alias("category"), ((F.col("n_chars") % 11) / 10).alias("grounding"), (F.col("n_chars") % 9).alias("changed"))
    rows = rows.withColumn("hardness", hardness(F.col("grounding"), F.col("changed"), F.col("category")))
    return S.round_robin_sample(rows, ["category"], F.col("hardness"), F.col("doc_id"), 100, 7)


def splits(spark, d):
    """Three splits by document number; a third of the repositories can occur in any split, the others in train only or in valid and test."""
    split = F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "valid").otherwise("test")
    rows = documents(spark, d).select("doc_id", "n_chars", split.alias("split"), F.md5(F.col("doc_id").cast("string")).alias("h"))
    repo = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("r"), F.substring("h", 1, 2))).when(F.col("split") == "train", F.concat(F.lit("t"), F.substring("h", 1, 2))).otherwise(F.concat(F.lit("s"), F.substring("h", 1, 1)))
    return rows.select("doc_id", "n_chars", repo.alias("repo"), "split")


SPLITS = """
SELECT doc_id, n_chars, split, CASE WHEN doc_id % 3 = 0 THEN 'r' || left(md5(doc_id::VARCHAR), 2) WHEN split = 'train' THEN 't' || left(md5(doc_id::VARCHAR), 2) ELSE 's' || left(md5(doc_id::VARCHAR), 1) END AS repo
FROM (SELECT *, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'valid' ELSE 'test' END AS split FROM documents)"""
SEPARATE = f"""
WITH s AS ({SPLITS}), t AS (SELECT DISTINCT repo FROM s WHERE split = 'train'),
c AS (SELECT repo FROM s WHERE split = 'valid' INTERSECT SELECT repo FROM s WHERE split = 'test')
SELECT doc_id, n_chars, repo, split FROM s
WHERE split = 'train' OR (repo NOT IN (SELECT repo FROM t) AND (repo NOT IN (SELECT repo FROM c)
  OR split = CASE WHEN instr('02468ace', right(sha1(repo), 1)) > 0 THEN 'valid' ELSE 'test' END))"""


def split_separate(spark, d):
    return S.separate(splits(spark, d))


def leak_overlaps(spark, d):
    return S.overlaps(splits(spark, d), "repo")


def split_profile(spark, d):
    return S.profile(S.separate(splits(spark, d)), "split", "repo", "n_chars")


def contamination_semi(spark, d):
    """Documents that hold any eight words in a row of a benchmark text, or the whole of a shorter one: a semi join on runs of words."""

    def words(text):
        return F.filter(F.split(F.lower(text), SPACE + "+"), lambda x: x != "")

    def runs(of, k):
        return F.when(F.size(of) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.size(of) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(of, i, k), " ")))

    items = spark.read.parquet(f"{d}/benchmark.parquet").select(words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    short = [r[0] for r in items.filter(F.size("w") < 8).select(F.size("w")).distinct().collect()]  # at most seven
    marks = items.select(F.explode(F.when(F.size("w") < 8, F.array(F.array_join("w", " "))).otherwise(runs(F.col("w"), 8))).alias("run")).distinct()
    held = documents(spark, d).select("doc_id", words(F.col("text")).alias("w"))
    empty = F.array().cast("array<string>")
    every = F.concat(*[F.coalesce(runs(F.col("w"), k), empty) for k in (8, *sorted(short))])
    found = held.select("doc_id", F.explode(F.array_distinct(every)).alias("run"))
    return found.join(marks, "run", "left_semi").select("doc_id").distinct()


#: Remarks that between them reach every rule; the last reaches none.
REMARKS = (
    "```suggestion\nx\n```", "small typo above", "the docstring lies", "nil can get here", "handle the exception", "a panic hides this", "rename it", "snake case please", "redundant, drop it", "refactor that",
    "prefer a set", "deprecated since two", "off-by-one", "the boundary is wrong", "too slow", "an expensive copy", "an injection risk", "leaks the password", "add a unit test", "mock the clock", "indent by four", "stray semicolon",
    "Why so?", "thoughts? wdyt", "hmm",
)


def comments(spark, d):
    """A remark before each benchmark text and each turn of a conversation, all of them whole; the remark follows from the number."""
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("id"), F.lit(0).alias("part"), "text")
    turns = spark.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit(1).alias("part"), "text")
    remark = F.element_at(F.array(*[F.lit(r) for r in REMARKS]), (F.col("id") % len(REMARKS) + 1).cast("int"))
    return items.union(turns).select("id", "part", F.when(F.col("id") % 2 == 0, remark).otherwise(F.concat(remark, F.lit(" "), F.coalesce("text", F.lit("")))).alias("comment"))


COMMENTS = (
    "SELECT id, part, CASE WHEN id % 2 = 0 THEN r ELSE r || ' ' || coalesce(text, '') END AS comment FROM (SELECT *, ["
    + ", ".join("'" + _rx(r).replace("\n", "' || chr(10) || '") + "'" for r in REMARKS)
    + f"][(id % {len(REMARKS)} + 1)::INT] AS r FROM (SELECT item_id AS id, 0 AS part, text FROM benchmark UNION ALL SELECT conv_id * 1000 + turn, 1, text FROM conversations))"
)


def taxonomy_histogram(spark, d):
    return comments(spark, d).groupBy(classify(F.col("comment")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def taxonomy_multi(spark, d):
    return comments(spark, d).select("id", "part", F.array_join(classify_all(F.col("comment")), ",").alias("labels"))


def taxonomy_documents(spark, d):
    rows = documents(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_low", F.lower("text"))  # once, not in every rule
    return rows.select("doc_id", classify(F.col("text"), small=F.col("_low")).alias("category"))


def _rule(p: str) -> str:
    """The pattern in the notation of a matcher without lookahead: `$` as the very end, after one line end at most."""
    return _rx(p.replace(r"\s*$", r"\s*\z"))


ALL = "SELECT * FROM documents"
CLASSIFY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(comment, '(?i){_rule(p)}') THEN '{label}'" for label, p in RULES) + " ELSE 'other' END"
LABELS_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(comment, '(?i){_rule(p)}') THEN '{label}' END" for label, p in RULES) + "], lambda x: x IS NOT NULL)"


def diffs(spark, d):
    """Hunks made of documents: the marker of a line follows from its number."""
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda line, i: F.concat(F.when(i % 3 == 0, " ").when(i % 3 == 1, "-").otherwise("+"), line)), "\n")
    return documents(spark, d).select("doc_id", marked.alias("diff"))


def strip_markers(spark, d):
    diff = F.col("diff")
    return diffs(spark, d).select("doc_id", T.strip_markers(diff, "old").alias("old_code"), T.strip_markers(diff, "new").alias("new_code"), T.changed_line_count(diff, diff).alias("changed"))


MARKERS_SQL = f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM ({ALL})),
m AS (SELECT doc_id, list_transform(range(1, len(ls) + 1), lambda i: [CASE (i - 1) % 3 WHEN 0 THEN ' ' WHEN 1 THEN '-' ELSE '+' END, ls[i]]) AS ms FROM l)
SELECT doc_id, array_to_string(list_transform(list_filter(ms, lambda x: x[1] <> '+'), lambda x: x[2]), chr(10)) AS old_code,
       array_to_string(list_transform(list_filter(ms, lambda x: x[1] <> '-'), lambda x: x[2]), chr(10)) AS new_code, len(list_filter(ms, lambda x: x[1] <> ' '))::INT AS changed
FROM m"""


def grounding(spark, d):
    """The comment quotes two words; the new code replaces one of them."""
    t = F.col("text")
    rows = documents(spark, d).select("doc_id", t.alias("old"), F.replace(t, F.lit(" the "), F.lit(" value_name ")).alias("new"))
    rows = rows.withColumn("comment", F.concat(F.lit("use `"), F.when(F.col("doc_id") % 3 == 0, "value_name").when(F.col("doc_id") % 3 == 1, "the").otherwise("nothing_here"), F.lit("` with the value_name and that")))
    return rows.select("doc_id", T.grounding(F.col("comment"), F.col("old"), F.col("new")).alias("grounding"))


def _names(c: str) -> str:
    return f"list_distinct(regexp_extract_all({c}, '{T.NAME_TOKEN}'))"


GROUNDING_SQL = rf"""
WITH r AS (SELECT doc_id, text AS o, replace(text, ' the ', ' value_name ') AS n,
  CASE doc_id % 3 WHEN 0 THEN 'value_name' WHEN 1 THEN 'the' ELSE 'nothing_here' END AS q FROM ({ALL})),
t AS (SELECT doc_id, {_names('o')} AS ot, {_names('n')} AS nt, {_names("'use `' || q || '` with the value_name and that'")} AS ct, {_names('q')} AS st FROM r),
s AS (SELECT doc_id, ct, st, list_filter(nt, lambda x: NOT list_contains(ot, x)) AS ad, list_filter(ot, lambda x: NOT list_contains(nt, x)) AS re FROM t)
SELECT doc_id, least(1::DOUBLE, 0.5::DOUBLE * CASE WHEN list_has_any(st, ad) THEN 1::DOUBLE WHEN list_has_any(st, list_concat(ad, re)) THEN 0.5::DOUBLE ELSE 0::DOUBLE END
  + 0.35::DOUBLE * least(1::DOUBLE, len(list_intersect(ct, ad))::DOUBLE / greatest(1, least(len(ad), 8))) + 0.15::DOUBLE * least(1::DOUBLE, len(list_intersect(ct, re))::DOUBLE / greatest(1, least(len(re), 8)))) AS grounding
FROM s"""


#: Hunks by number: which reject reason each is made for; the rest are good ones, some of them equal.
HUNKS = 17


def hunks(spark, d):
    """Hunks made of parts: a line of code from the name, a remark, and one fault by number."""
    p, pick = spark.read.parquet(f"{d}/part.parquet"), F.col("p_partkey") % HUNKS
    block = F.floor(F.col("p_partkey") / 40).cast("string")
    made = p.select("p_partkey", pick.alias("pick"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.concat(F.lit(", "), block).alias("rest"), "p_brand", "p_type")
    old = F.concat(F.lit(" def run():\n-    return "), F.col("name"), F.col("rest"))
    new = F.concat(F.lit(" def run():\n+    return checked_"), F.col("name"), F.col("rest"))
    same = F.concat(F.lit(" def run():\n     return "), F.col("name"), F.col("rest"))
    long = F.concat(old, F.repeat(F.lit("\n x = 1"), 20))
    wide = F.concat(F.lit(" def run():"), F.repeat(F.concat(F.lit("\n-    use("), F.col("name"), F.lit(")")), 9))
    good = F.concat(F.lit("please return `checked_"), F.col("name"), F.lit("` here"))
    comment = (
        F.when(F.col("pick") == 1, " \n").when(F.col("pick") == 2, "LGTM!").when(F.col("pick") == 3, "same as the other one, see above").when(F.col("pick") == 4, "too short")
        .when(F.col("pick") == 5, F.concat(good, F.repeat(F.lit(" é"), 30))).when(F.col("pick") == 10, "something quite unrelated to it, as ever").otherwise(good)
    )
    return made.select(
        "p_partkey",
        F.when(F.col("pick") == 6, same).when(F.col("pick") == 7, "-").when(F.col("pick") == 8, long).when(F.col("pick") == 9, wide).otherwise(old).alias("old"),
        F.when(F.col("pick") == 6, same).when(F.col("pick") == 8, F.concat(new, F.repeat(F.lit("\n x = 1"), 20))).otherwise(new).alias("new"),
        comment.alias("comment"),
        F.when(F.col("pick") == 0, "zig").otherwise("py").alias("lang"),
        F.concat(F.col("p_type"), F.col("p_brand")).alias("repo"),
    )


def full_funnel(spark, d):
    """The whole reject chain over hunks that meet each of its fourteen reasons."""
    judged = C.with_reject_reason(hunks(spark, d)).select("p_partkey", "reject_reason", "category", "hash", "repo", "comment_norm")
    full = C.cascade_verdicts(judged, hash_keys=["hash"], repo_keys=["repo"], comment_keys=["comment_norm"], order=["p_partkey"], per_repo=3, per_comment=2)
    return full.select("p_partkey", "category", F.coalesce("reject_reason", F.lit("kept")).alias("verdict"))


def full_funnel_documents(spark, d):
    """The chain over whole documents as hunks, with quotas that are met at that size."""
    rows = documents(spark, d).select(
        "doc_id",
        F.concat(F.lit("-"), F.regexp_replace("text", "\n", "\n ")).alias("old"),
        F.concat(F.lit("+"), F.regexp_replace(F.replace("text", F.lit(" the "), F.lit(" this_value ")), "\n", "\n ")).alias("new"),
        F.concat(F.lit("please use `this_value` here: "), F.col("text")).alias("comment"),
        F.lit("py").alias("lang"),
        F.col("source").alias("repo"),
    )
    judged = C.with_reject_reason(rows).select("doc_id", "reject_reason", "category", "hash", "repo", "comment_norm")
    full = C.cascade_verdicts(judged, hash_keys=["hash"], repo_keys=["repo"], comment_keys=["comment_norm"], order=["doc_id"], per_repo=5, per_comment=3)
    return full.select("doc_id", "category", F.coalesce("reject_reason", F.lit("kept")).alias("verdict"))


#: What each hunk is made for; good hunks are equal if name and block are, and their remarks if the name is.
FUNNEL_SQL = rf"""
WITH m AS (SELECT p_partkey, p_partkey % {HUNKS} AS pick, replace(p_name, ' ', '_') AS name, p_type || p_brand AS repo FROM part),
j AS (SELECT *, 'please return `checked_' || name || '` here' AS good,
  CASE pick WHEN 0 THEN 'language_not_selected' WHEN 1 THEN 'empty_comment' WHEN 2 THEN 'comment_non_actionable' WHEN 3 THEN 'comment_references_outside_context' WHEN 4 THEN 'comment_length'
    WHEN 5 THEN 'comment_not_ascii' WHEN 6 THEN 'no_actual_change' WHEN 7 THEN 'empty_side' WHEN 8 THEN 'hunk_length' WHEN 9 THEN 'change_too_large' WHEN 10 THEN 'ungrounded_change' END AS reason FROM m),
k AS (SELECT *, CASE pick WHEN 1 THEN '' WHEN 2 THEN 'LGTM!' WHEN 3 THEN 'same as the other one, see above' WHEN 4 THEN 'too short' WHEN 5 THEN good || repeat(' é', 30) WHEN 10 THEN 'something quite unrelated to it, as ever' ELSE good END AS comment FROM j),
a AS (SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY reason IS NULL, name, p_partkey // 40 ORDER BY p_partkey) > 1 THEN 'duplicate' ELSE reason END AS r1 FROM k),
b AS (SELECT *, CASE WHEN r1 IS NULL AND row_number() OVER (PARTITION BY r1 IS NULL, repo ORDER BY p_partkey) > 3 THEN 'repo_quota' ELSE r1 END AS r2 FROM a),
c AS (SELECT *, CASE WHEN r2 IS NULL AND row_number() OVER (PARTITION BY r2 IS NULL, comment ORDER BY p_partkey) > 2 THEN 'comment_quota' ELSE r2 END AS r3 FROM b)
SELECT p_partkey, {CLASSIFY_SQL.replace("(comment,", "(" + sql_words("comment") + ",")} AS category, coalesce(r3, 'kept') AS verdict FROM c"""


def drop_counts(spark, d):
    return S.drop_counts(splits(spark, d))


def collision_counts(spark, d):
    judged = C.cascade_verdicts(keyed(spark, d).withColumn("reject_reason", F.lit(None).cast("string")), hash_keys=["hash"], repo_keys=["source"], comment_keys=["first_word"], order=["doc_id"], per_repo=10**9, per_comment=10**9)
    return S.collision_counts(judged.withColumn("split", F.coalesce("source", F.lit(""))))


def shared_texts(spark, d):
    """Documents of one source that stand, white space collapsed and letters small, in another."""
    rows = documents(spark, d).select("doc_id", F.col("text").alias("code"), F.when(F.col("source") == "src0", "train").otherwise("valid").alias("split"))
    return S.shared_texts(rows, F.col("code"), F.col("code")).select("doc_id")


def benchmark_pool(spark, d):
    """Documents as a pool of examples, benchmark items as the handwritten ones."""
    text = F.coalesce("text", F.lit(""))
    pool = documents(spark, d).select(
        F.col("doc_id").cast("string").alias("id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("category"), ((F.col("n_chars") % 11) / 10).alias("grounding"), (F.col("n_chars") % 9).cast("int").alias("n_changed_lines")
    )
    own = spark.read.parquet(f"{d}/benchmark.parquet").select(F.concat(F.lit("b"), "item_id").alias("id"), F.lit("en").alias("lang"), F.lit("own").alias("category"), F.concat(F.lit("p"), F.length(text) % 3).alias("probe"))
    return pool, own


def benchmark_table(spark, d):
    pool, own = benchmark_pool(spark, d)
    return documents_of.benchmark(pool, own, 60, 7).select("part", "id", "category", "origin", "probe", F.round("hardness", 9).alias("hardness"))


def benchmark_card(spark, d):
    pool, own = benchmark_pool(spark, d)
    return documents_of.benchmark_card(documents_of.benchmark(pool, own, 60, 7), pool).withColumn("probes", F.array_join("probes", ","))


BENCH_SQL = """
pool AS (SELECT doc_id::VARCHAR AS id, coalesce(source, '') AS category, (n_chars % 11)::DOUBLE / 10 AS g, n_chars % 9 AS c FROM documents),
hard AS (SELECT *, 0.5::DOUBLE * (1::DOUBLE - g) + 0.2::DOUBLE * least(1::DOUBLE, CASE WHEN c = 0 THEN 1 ELSE c END / 6::DOUBLE) AS hardness FROM pool),
rk AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY hardness DESC, md5('7:' || id)) AS rk FROM hard),
picked AS (SELECT * FROM rk ORDER BY rk, md5('7:' || category) LIMIT 60),
own AS (SELECT 'b' || item_id AS id, 'p' || length(coalesce(text, '')) % 3 AS probe FROM benchmark)"""


QUERIES = {
    "funnel_reasons": (funnel_reasons, f"SELECT coalesce({REASON_SQL}, 'kept') AS reason, count(*) AS n FROM documents GROUP BY 1"),
    "funnel_grouping_sets": (
        funnel_grouping_sets,
        f"""WITH r AS (SELECT coalesce({REASON_SQL}, 'kept') AS reject_reason, lang, source FROM documents)
SELECT 'reject_reason' AS slice, reject_reason AS value, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'lang', coalesce(lang, 'unknown'), count(*) FROM r GROUP BY 2
UNION ALL SELECT 'source', coalesce(source, 'unknown'), count(*) FROM r GROUP BY 2""",
    ),
    "ascii_ratio": (
        ascii_ratio,
        r"SELECT doc_id, CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))::DOUBLE / length(text) ELSE 0 END AS ratio FROM documents",
    ),
    "content_id": (
        content_id,
        rf"""WITH n AS (SELECT doc_id, text, lower(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^{U_SPACE[1:-1]}]+', '', 'g'), '{U_SPACE}+', ' ', 'g'), '^ | $', '', 'g')) AS norm FROM ({ALL})),
h AS (SELECT doc_id, norm, sha1(regexp_replace(text, '{U_SPACE}+', ' ', 'g') || '||' || norm) AS hash FROM n)
SELECT doc_id, norm, hash, left(hash, 16) AS id FROM h""",
    ),
    "dedup_first_wins": (dedup_first_wins, f"SELECT * FROM ({KEYED}) QUALIFY row_number() OVER (PARTITION BY hash ORDER BY doc_id) = 1"),
    "quota_cascade": (
        quota_cascade,
        f"""WITH a AS (SELECT * FROM ({KEYED}) QUALIFY row_number() OVER (PARTITION BY hash ORDER BY doc_id) = 1),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10) SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY first_word ORDER BY doc_id) <= 3""",
    ),
    "quota_exact_greedy": (
        quota_exact_greedy,
        f"""WITH RECURSIVE k AS ({KEYED}), o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM k),
f AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS doc_id, 'none' AS verdict, []::VARCHAR[] AS hashes, []::VARCHAR[] AS repos, []::VARCHAR[] AS comments UNION ALL
  SELECT i, doc_id, verdict, CASE WHEN verdict = '' THEN list_append(hashes, hash) ELSE hashes END, CASE WHEN verdict = '' THEN list_append(repos, coalesce(source, '?')) ELSE repos END,
         CASE WHEN verdict = '' THEN list_append(comments, coalesce(first_word, '?')) ELSE comments END
  FROM (SELECT o.*, hashes, repos, comments, CASE WHEN list_contains(hashes, coalesce(hash, '?')) THEN 'duplicate' WHEN len(list_filter(repos, lambda x: x = coalesce(source, '?'))) >= 10 THEN 'repo_quota'
          WHEN len(list_filter(comments, lambda x: x = coalesce(first_word, '?'))) >= 3 THEN 'comment_quota' ELSE '' END AS verdict FROM f JOIN o ON o.i = f.i + 1))
SELECT doc_id, verdict FROM f WHERE i > 0""",
    ),
    "most_common_sources": (
        most_common_sources,
        "WITH c AS (SELECT source AS value, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY 1) SELECT value, n, row_number() OVER (ORDER BY n DESC, f) AS rank FROM c",
    ),
    "balanced_sample": (
        balanced_sample,
        """WITH r AS (SELECT doc_id, lang, source, n_chars, concat_ws('|', coalesce(lang, ''), coalesce(source, '')) AS cell FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY n_chars DESC, md5('13:' || doc_id)) AS rk FROM r)
SELECT doc_id, lang, source, n_chars FROM k ORDER BY rk, md5('13:' || cell) LIMIT 200""",
    ),
    "hard_benchmark": (
        hard_benchmark,
        f"""WITH c AS (SELECT doc_id, n_chars, {CLASSIFY_SQL.replace('(comment,', '(' + sql_words('text') + ',')} AS category FROM ({ALL})),
g AS (SELECT doc_id, category, (n_chars % 11)::DOUBLE / 10 AS grounding, n_chars % 9 AS changed FROM c),
h AS (SELECT *, 0.5::DOUBLE * (1::DOUBLE - grounding) + 0.2::DOUBLE * least(1::DOUBLE, CASE WHEN changed = 0 THEN 1 ELSE changed END / 6::DOUBLE)
  + CASE WHEN category IN ('design_question', 'logic_bug', 'performance', 'security', 'other') THEN 0.3::DOUBLE ELSE 0 END AS hardness FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY hardness DESC, md5('7:' || doc_id)) AS rk FROM h)
SELECT doc_id, category, grounding, changed, hardness FROM k ORDER BY rk, md5('7:' || category) LIMIT 100""",
    ),
    "split_separate": (split_separate, SEPARATE),
    "leak_overlaps": (
        leak_overlaps,
        f"WITH s AS ({SPLITS}) SELECT repo AS key, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1",
    ),
    "split_profile": (
        split_profile,
        f"""WITH s AS ({SEPARATE}) SELECT split, count(*) AS n, count(DISTINCT repo) AS n_repos, avg(n_chars) AS mean, min(n_chars) AS least, max(n_chars) AS greatest,
count(*)::DOUBLE / sum(count(*)) OVER () AS ratio, (list_sort(list(n_chars)))[(count(*) // 2 + 1)::INT] AS median FROM s GROUP BY split""",
    ),
    "contamination_semi": (
        contamination_semi,
        rf"""WITH b AS (SELECT list_filter(regexp_split_to_array(lower(text), '{SPACE}+'), lambda x: x <> '') AS w FROM benchmark),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{SPACE}+'), lambda x: x <> '') AS w FROM documents),
m AS (SELECT DISTINCT unnest(CASE WHEN len(w) < 8 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) END) AS run FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT least(len(w), 8) AS k FROM b WHERE len(w) > 0),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS run FROM d, k WHERE len(w) >= k)
SELECT DISTINCT doc_id FROM g WHERE run IN (SELECT run FROM m)""",
    ),
    "taxonomy_histogram": (taxonomy_histogram, f"WITH c AS (SELECT id, {sql_words('comment')} AS comment FROM ({COMMENTS})) SELECT {CLASSIFY_SQL} AS category, count(*) AS n FROM c GROUP BY 1"),
    "taxonomy_multi": (
        taxonomy_multi,
        f"WITH c AS (SELECT id, part, {sql_words('comment')} AS comment FROM ({COMMENTS})), l AS (SELECT id, part, {LABELS_SQL} AS ls FROM c) SELECT id, part, CASE WHEN len(ls) > 0 THEN array_to_string(ls, ',') ELSE 'other' END AS labels FROM l",
    ),
    "taxonomy_documents": (taxonomy_documents, f"WITH c AS (SELECT doc_id, {sql_words('text')} AS comment FROM documents) SELECT doc_id, {CLASSIFY_SQL} AS category FROM c"),
    "strip_markers": (strip_markers, MARKERS_SQL),
    "grounding": (grounding, GROUNDING_SQL),
    "full_funnel": (full_funnel, FUNNEL_SQL),
    "full_funnel_documents": (full_funnel_documents, None),
    "drop_counts": (
        drop_counts,
        f"""WITH s AS ({SPLITS}), t AS (SELECT DISTINCT repo FROM s WHERE split = 'train'), c AS (SELECT repo FROM s WHERE split = 'valid' INTERSECT SELECT repo FROM s WHERE split = 'test'),
x AS (SELECT *, repo IN (SELECT repo FROM t) AS tr, repo IN (SELECT repo FROM c) AND repo NOT IN (SELECT repo FROM t) AS co, CASE WHEN instr('02468ace', right(sha1(repo), 1)) > 0 THEN 'valid' ELSE 'test' END AS side FROM s)
SELECT count(*) FILTER (split = 'valid' AND tr) AS valid, count(*) FILTER (split = 'test' AND tr) AS test, count(*) FILTER (split = 'valid' AND co AND side = 'test') AS valid_lost_to_test,
count(*) FILTER (split = 'test' AND co AND side = 'valid') AS test_lost_to_valid, count(DISTINCT repo) FILTER (co) AS contested_repos FROM x""",
    ),
    "collision_counts": (
        collision_counts,
        f"SELECT coalesce(source, '') AS split, count(*) FILTER (r > 1) AS collisions FROM (SELECT source, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS r FROM ({KEYED})) GROUP BY 1",
    ),
    "shared_texts": (
        shared_texts,
        f"""WITH k AS (SELECT doc_id, source, regexp_replace(text, '{U_SPACE}+', ' ', 'g') AS t FROM documents)
SELECT doc_id FROM k WHERE source IS DISTINCT FROM 'src0' AND t IN (SELECT t FROM k WHERE source = 'src0')""",
    ),
    "benchmark_table": (
        benchmark_table,
        f"WITH {BENCH_SQL[1:]} SELECT 0 AS part, id, 'own' AS category, 'handwritten' AS origin, probe, NULL::DOUBLE AS hardness FROM own UNION ALL SELECT 1, id, category, 'curated', 'natural_distribution', round(hardness, 9) FROM picked",
    ),
    "benchmark_card": (
        benchmark_card,
        f"""WITH {BENCH_SQL[1:]} SELECT (SELECT count(*) FROM own) + (SELECT count(*) FROM picked) AS n_total, (SELECT count(*) FROM own) AS n_handwritten, (SELECT count(*) FROM picked) AS n_curated,
(SELECT round(avg(hardness), 4) FROM picked) AS curated_mean_hardness, (SELECT array_to_string(list_sort(list(DISTINCT probe)), ',') FROM own) AS probes, (SELECT round(avg(hardness), 4) FROM hard) AS pool_mean_hardness""",
    ),
}

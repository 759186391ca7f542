"""Scoring, comparison, judging and probe queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scores as SC
from millrace.functions import text as T
from millrace.operators import compare as CP
from millrace.operators import judge as J
from millrace.operators import metrics as M
from millrace.operators import probes as P
from millrace.operators import selection as SL
from millrace.plans import documents as DOC
from millrace.plans.curation_queries import ALL, U_SPACE, documents, sql_trim

SYSTEM = T.SYSTEM


def ragged(spark, d):
    """Texts with blank edges, trailing spaces and mixed line ends."""
    return documents(spark, d).select("doc_id", F.concat(F.lit("\n \n"), F.replace("text", F.lit(". "), F.lit(".  \r\n")), F.lit(" \r\n\n")).alias("code"))


RAGGED = f"SELECT doc_id, chr(10) || ' ' || chr(10) || replace(text, '. ', '.  ' || chr(13) || chr(10)) || ' ' || chr(13) || chr(10) || chr(10) AS code FROM ({ALL})"


def normalize_code(spark, d):
    return ragged(spark, d).select("doc_id", T.normalize_code(F.col("code")).alias("normal"))


#: Unicode's white space but for the line end.
BLANK = U_SPACE.replace(r"\t-\r", r"\t\x0b-\r")
NORMALIZE = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({{c}}, '\r\n?', chr(10), 'g'), '(?m){BLANK}+$', '', 'g'), '\A\n+', ''), '\n+\z', '')"


def edge_trim(spark, d):
    return ragged(spark, d).select("doc_id", T.strip_blank_edges(F.replace("code", F.lit("\r"), F.lit(""))).alias("trimmed"))


def tokenize_code(spark, d):
    return documents(spark, d).select("doc_id", F.size(T.code_tokens(F.col("text"))).alias("n"), F.md5(T.token_text(F.col("text"))).alias("tokens_md5"))


def predictions(spark, d):
    """Every turn of the conversations, whole, as code: gold changes one word; the prediction does that, does nothing, does something else, or both."""
    t = spark.read.parquet(f"{d}/conversations.parquet")
    old = F.coalesce("text", F.lit(""))
    gold = F.replace(old, F.lit(" the "), F.lit(" a "))
    other = lambda c: F.replace(c, F.lit(" of "), F.lit("\nfor "))
    pick = (F.col("conv_id") + F.col("turn")) % 4
    rows = t.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.coalesce("role", F.lit("")).alias("category"), F.when(F.col("conv_id") % 3 == 0, "py").otherwise("go").alias("lang"), pick.alias("pick"),
        F.when(F.col("turn") == 1, "x = 1").otherwise(old).alias("old_code"), gold.alias("gold"),
        F.when(pick == 0, gold).when(pick == 1, old).when(pick == 2, other(old)).otherwise(other(gold)).alias("prediction"),
    )
    rows = rows.withColumn("prediction", F.when((F.col("old_code") == "x = 1") & (F.col("pick") == 3), "y = (2,)").otherwise(F.col("prediction")))
    return rows.withColumn("parse_mode", F.when(F.col("pick") == 0, "fenced").when(F.col("pick") == 1, "raw").when(F.col("pick") == 2, "fenced_unterminated").otherwise("")).drop("pick")


PREDICTIONS = f"""
SELECT id, category, lang, o AS old_code, replace(x, ' the ', ' a ') AS gold, CASE WHEN o = 'x = 1' AND pick = 3 THEN 'y = (2,)' ELSE
  CASE pick WHEN 0 THEN replace(x, ' the ', ' a ') WHEN 1 THEN x WHEN 2 THEN replace(x, ' of ', chr(10) || 'for ') ELSE replace(replace(x, ' the ', ' a '), ' of ', chr(10) || 'for ') END END AS prediction,
  CASE pick WHEN 0 THEN 'fenced' WHEN 1 THEN 'raw' WHEN 2 THEN 'fenced_unterminated' ELSE '' END AS parse_mode
FROM (SELECT conv_id * 1000 + turn AS id, coalesce(role, '') AS category, CASE WHEN conv_id % 3 = 0 THEN 'py' ELSE 'go' END AS lang, (conv_id + turn) % 4 AS pick, coalesce(text, '') AS x, CASE WHEN turn = 1 THEN 'x = 1' ELSE coalesce(text, '') END AS o FROM conversations)"""
TOKEN = rf"[A-Za-z_][\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]*|\p{{Nd}}+\.\p{{Nd}}+|\p{{Nd}}+|[^A-Za-z0-9_{U_SPACE[1:-1]}]"


def _n(c: str) -> str:
    return NORMALIZE.replace("{c}", c)


# The letters beyond ASCII of German, French and Spanish that SQL's distance, which counts bytes, is to take as one each.
ACCENTED = "äöüßÄÖÜéèêçÉÈÊÇñíóÑÍÓ"


def _bytes(c: str) -> str:
    return f"translate({c}, '{ACCENTED}', {' || '.join(f'chr({x})' for x in [*range(1, 9), *range(14, 32)][: len(ACCENTED)])})"


SCORES = rf"""
WITH n AS (SELECT id, category, lang, parse_mode, prediction, old_code, {_n('prediction')} AS p, {_n('gold')} AS g, {_n('old_code')} AS o FROM ({PREDICTIONS})),
t AS (SELECT *, regexp_extract_all(p, '{TOKEN}') AS tp, regexp_extract_all(g, '{TOKEN}') AS tg, list_distinct(string_split(p, chr(10))) AS lp, list_distinct(string_split(g, chr(10))) AS lg, list_distinct(string_split(o, chr(10))) AS lo,
  levenshtein({_bytes('p')}, {_bytes('g')})::DOUBLE / greatest(length(p), length(g), 1) AS dist_pred_gold, levenshtein({_bytes('o')}, {_bytes('g')})::DOUBLE / greatest(length(o), length(g), 1) AS dist_old_gold FROM n),
u AS (SELECT *, coalesce(list_sum(list_transform(list_intersect(list_distinct(tp), tg), lambda x: least(len(list_filter(tp, lambda y: y = x)), len(list_filter(tg, lambda y: y = x))))), 0) AS hit,
  list_concat(list_filter(lg, lambda x: NOT list_contains(lo, x)), list_filter(lo, lambda x: NOT list_contains(lg, x))) AS ge, list_concat(list_filter(lp, lambda x: NOT list_contains(lo, x)), list_filter(lo, lambda x: NOT list_contains(lp, x))) AS pe FROM t),
v AS (SELECT *, len(list_intersect(ge, pe)) AS lh FROM u)
SELECT id, category, lang, parse_mode, prediction, CASE WHEN lang = 'py' AND o = 'x = 1' THEN p IN ('x = 1', 'y = (2,)') END AS syntax_ok, p = g AS exact_match,
  CASE WHEN hit = 0 THEN 0 ELSE 2 * (hit::DOUBLE / greatest(len(tp), 1)) * (hit::DOUBLE / greatest(len(tg), 1)) / (hit::DOUBLE / greatest(len(tp), 1) + hit::DOUBLE / greatest(len(tg), 1)) END AS token_f1,
  1::DOUBLE - dist_pred_gold AS edit_sim, dist_pred_gold, dist_old_gold, dist_old_gold - dist_pred_gold AS delta_to_gold,
  dist_pred_gold < dist_old_gold - 1e-9::DOUBLE AS improved, dist_pred_gold > dist_old_gold + 1e-9::DOUBLE AS regressed, p = o AS copied,
  CASE WHEN len(ge) = 0 THEN CASE WHEN len(pe) = 0 THEN 1::DOUBLE ELSE 0 END WHEN lh = 0 THEN 0
       ELSE 2 * (lh::DOUBLE / greatest(len(pe), 1)) * (lh::DOUBLE / greatest(len(ge), 1)) / (lh::DOUBLE / greatest(len(pe), 1) + lh::DOUBLE / greatest(len(ge), 1)) END AS changed_right_lines
FROM v"""


def scored(spark, d):
    return SC.with_scores(predictions(spark, d))


def edit_scores(spark, d):
    """Only `x = 1` is an original that parses; prose is not, so its syntax has no verdict. The eleven scores of each turn."""
    return scored(spark, d).drop("category", "lang", "parse_mode", "prediction", "old_code", "gold")


def attached_scores(spark, d):
    return SC.attach_scores(predictions(spark, d)).select("id", "scores.*")


def edit_scores_documents(spark, d):
    """Scores over whole documents; the distance is exact in linear memory, and its time grows with the edits times the length."""
    old = F.coalesce("text", F.lit(""))
    gold = F.replace(old, F.lit(" the "), F.lit(" a "))
    rows = documents(spark, d).select("doc_id", old.alias("old_code"), gold.alias("gold"), F.when(F.col("doc_id") % 2 == 0, gold).otherwise(old).alias("prediction"), "lang")
    return SC.with_scores(rows).drop("prediction", "old_code", "gold", "lang")


def score_headline(spark, d):
    h = M.headline(scored(spark, d))
    return h.select(*[F.round(c, 6).alias(c) if c not in ("n", "python_syntax_checked") else c for c in h.columns])


def score_slices(spark, d):
    s = M.by_slices(scored(spark, d), ["category", "lang"], M.SLICE_MEANS)
    return s.select("slice", "value", "n", *[F.round(c, 6).alias(c) for c in M.SLICE_MEANS])


def metric_block(spark, d):
    return M.metric_block(scored(spark, d), "id")


def parse_fenced(spark, d):
    t, pick = F.col("text"), F.col("doc_id") % 5
    text = (
        F.when(pick == 0, F.concat(F.lit("Sure:\n```py\n\n"), t, F.lit("\n```\nmore")))
        .when(pick == 1, F.concat(F.lit("```\n"), t))
        .when(pick == 2, F.concat(F.lit("Here is the revised code:\n\n"), t, F.lit("\n\n")))
        .when(pick == 3, F.lit(" \n "))
        .otherwise(F.concat(F.lit("```a\none\n```\n```b\ntwo\n```"), F.lit("")))
    )
    return documents(spark, d).select("doc_id", T.parse_generation(text).alias("r")).select("doc_id", "r.code", "r.how")


PARSE_SQL = f"""
SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN '' WHEN 4 THEN 'one' ELSE regexp_replace(regexp_replace(text, '\\A({BLANK}*\\n)+', ''), '(\\n{BLANK}*)+\\z', '') END AS code,
  CASE doc_id % 5 WHEN 0 THEN 'fenced' WHEN 1 THEN 'fenced_unterminated' WHEN 2 THEN 'raw' WHEN 3 THEN 'empty' ELSE 'fenced' END AS how FROM ({ALL})"""


def corpus_bleu(spark, d):
    """BLEU of the predictions, and of the unchanged code as the floor."""
    rows = predictions(spark, d)
    model = M.corpus_bleu(rows, "id", "prediction", "gold").select(F.lit("model").alias("hypothesis"), F.round("bleu", 6).alias("bleu"))
    floor = M.corpus_bleu(rows, "id", "old_code", "gold").select(F.lit("copy").alias("hypothesis"), F.round("bleu", 6).alias("bleu"))
    return model.union(floor)


def _bleu_sql(hypothesis: str, name: str) -> str:
    return rf"SELECT '{name}' AS hypothesis, ({_bleu(hypothesis)}) AS bleu"


def _bleu(hypothesis: str, gold: str = "gold", places: int = 6) -> str:
    return rf"""
SELECT round(CASE WHEN count(*) FILTER (total > 0) < 4 OR sum(hits) = 0 THEN 0 ELSE
  CASE WHEN max(total) FILTER (n = 1) < max(gold_total) FILTER (n = 1) THEN exp(1 - max(gold_total) FILTER (n = 1)::DOUBLE / max(total) FILTER (n = 1)) ELSE 1 END * exp(sum(ln(100::DOUBLE * hits / total)) / 4) END, {places}) AS bleu
FROM (SELECT n, sum(least(p, q))::BIGINT AS hits, sum(p)::BIGINT AS total, sum(q)::BIGINT AS gold_total FROM (
  SELECT id, n, g, sum(side) AS p, sum(1 - side) AS q FROM (
    SELECT id, side, n, unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], ' '))) AS g FROM (
      SELECT id, 1 AS side, regexp_extract_all({hypothesis}, '{TOKEN}') AS t FROM p UNION ALL SELECT id, 0, regexp_extract_all({gold}, '{TOKEN}') FROM p), range(1, 5) AS r(n) WHERE len(t) >= n)
  GROUP BY 1, 2, 3) GROUP BY n)"""


def runs_of(spark, d):
    """Two runs over all labelled documents: the base is right about quality, the tuned run about toxicity."""
    labels = spark.read.parquet(f"{d}/labels.parquet")

    def run(exact, factor):
        sim = (F.col("doc_id") * factor % 100) / 100
        scores = {"exact_match": exact, "improved": F.col("doc_id") * factor % 3 == 0, "regressed": F.col("doc_id") * factor % 7 == 1, "copied": F.col("doc_id") * factor % 5 == 2, "edit_sim": sim, "edit_line_f1": sim * sim, "token_f1": (sim + 1) / 2, "delta_to_gold": sim - 0.5}
        return labels.select(F.col("doc_id").alias("id"), F.concat(F.lit("text "), F.col("doc_id") * factor).alias("prediction"), F.struct(*[c.alias(k) for k, c in scores.items()]).alias("scores"))

    about = documents(spark, d).select(F.col("doc_id").alias("id"), "lang", F.col("source").alias("category"), F.when(F.col("doc_id") % 2 == 0, "handwritten").otherwise("").alias("origin"))
    return run(F.col("quality") == 1, 1).join(about, "id", "left"), run(F.col("toxic") == 0, 7)


RUNS = """
b AS (SELECT doc_id AS id, quality = 1 AS exact_match, (doc_id % 100)::DOUBLE / 100 AS sim, doc_id AS f FROM labels),
t AS (SELECT doc_id AS id, toxic = 0 AS exact_match, (doc_id * 7 % 100)::DOUBLE / 100 AS sim, doc_id * 7 AS f FROM labels),
p AS (SELECT b.id, source AS category, lang, CASE WHEN doc_id % 2 = 0 THEN 'handwritten' ELSE '' END AS origin, b.exact_match AS base_exact_match, t.exact_match AS tuned_exact_match, b.sim AS base_edit_sim, t.sim AS tuned_edit_sim, t.sim - b.sim AS delta_sim, b.f AS bf, t.f AS tf
  FROM b JOIN t USING (id) LEFT JOIN documents d ON d.doc_id = b.id),
o AS (SELECT *, CASE WHEN tuned_exact_match AND NOT base_exact_match THEN 'win' WHEN base_exact_match AND NOT tuned_exact_match THEN 'loss' WHEN delta_sim > 0.02::DOUBLE THEN 'win' WHEN delta_sim < -0.02::DOUBLE THEN 'loss' ELSE 'tie' END AS outcome FROM p)"""


def paired(spark, d):
    return CP.paired_predictions(*runs_of(spark, d))


def coverage(spark, d):
    """Keys that only one side has: labelled documents against all documents."""
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id")
    return CP.coverage(labels, documents(spark, d), "doc_id")


def win_loss_tie(spark, d):
    return CP.outcome_rows(paired(spark, d))


def outcome_counts(spark, d):
    return CP.routed(paired(spark, d)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def extremes(spark, d):
    return CP.extremes(CP.routed(paired(spark, d)), "id").select("id", "outcome", "delta_sim")


def paired_slices(spark, d):
    return CP.comparison_slices(paired(spark, d), ["category", "lang", "origin"])


def category_gains(spark, d):
    gains = CP.by_gain(paired_slices(spark, d))
    return gains.select("value", "delta_exact_match")


def mcnemar(spark, d):
    m = CP.mcnemar(paired(spark, d), "base_exact_match", "tuned_exact_match")
    return m.select("fixed", "broken", F.round("p_value", 10).alias("p_value"), "significant")


def mcnemar_small(spark, d):
    rows = paired(spark, d).withColumn("bucket", (F.col("id") % 37).cast("long"))
    m = CP.mcnemar(rows, "base_exact_match", "tuned_exact_match", ["bucket"])
    return m.select("bucket", "fixed", "broken", F.round("p_value", 10).alias("p_value"), "significant")


P_SQL = "round(CASE WHEN fixed + broken = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(fixed + broken + 1) - lgamma(i + 1) - lgamma(fixed + broken - i + 1) + (fixed + broken) * ln(0.5::DOUBLE))) FROM range(0, least(fixed, broken) + 1) AS r(i))) END, 10)"


def paired_metrics(spark, d):
    """The eight metrics of both runs with their intervals (10,000 resamples) and exact tests."""
    t = CP.paired_table(paired(spark, d), "id")
    rounded = [F.round(c, 9).alias(c) for c in ("base", "tuned", "delta", "ci_low", "ci_high")]
    return t.select("metric", "n", *rounded, "significant", "fixed", "broken", F.round("p_value", 10).alias("p_value"))


def comparison_headline(spark, d):
    h = DOC.headline(CP.paired_table(paired(spark, d), "id"))
    return h.drop("verdict", "exact_match_ci95")


def bootstrap_ci(spark, d):
    diffs = paired(spark, d).select("id", (F.col("tuned_exact_match").cast("int") - F.col("base_exact_match").cast("int")).alias("diff"))
    c = CP.bootstrap_ci(diffs, "diff", "id")
    return c.select(*[F.round(x, 9).alias(x) for x in ("delta", "ci_low", "ci_high")], "significant")


VALUES_SQL = """
e AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, [base_exact_match::INT::DOUBLE, (bf % 3 = 0)::INT::DOUBLE, (bf % 7 = 1)::INT::DOUBLE, (bf % 5 = 2)::INT::DOUBLE, base_edit_sim, base_edit_sim * base_edit_sim, (base_edit_sim + 1) / 2, base_edit_sim - 0.5::DOUBLE] AS a,
  [tuned_exact_match::INT::DOUBLE, (tf % 3 = 0)::INT::DOUBLE, (tf % 7 = 1)::INT::DOUBLE, (tf % 5 = 2)::INT::DOUBLE, tuned_edit_sim, tuned_edit_sim * tuned_edit_sim, (tuned_edit_sim + 1) / 2, tuned_edit_sim - 0.5::DOUBLE] AS b FROM p),
v AS (SELECT i, m, ['exact_match', 'improved', 'regressed', 'copied', 'edit_sim', 'edit_line_f1', 'token_f1', 'delta_to_gold'][m] AS metric, a[m] AS a, b[m] AS b, (b[m] - a[m])::DECIMAL(28,10) AS d FROM e, range(1, 9) AS r(m)),
n AS (SELECT count(*) AS n FROM e),
draws AS (SELECT r, ('0x' || substr(md5('0:' || r || ':' || (k // 4)), 1 + 8 * (k % 4), 8))::BIGINT % n AS i FROM (SELECT r, n, unnest(range(n)) AS k FROM range(10000) AS a(r), n)),
c AS (SELECT r, i, count(*) AS times FROM draws GROUP BY 1, 2),
s AS (SELECT metric, r, sum(d * times)::DOUBLE / any_value(n) AS x FROM c JOIN v USING (i), n GROUP BY 1, 2),
k AS (SELECT metric, x, row_number() OVER (PARTITION BY metric ORDER BY x, r) - 1 AS pos FROM s),
ci AS (SELECT metric, max(x) FILTER (pos = 250) AS ci_low, max(x) FILTER (pos = 9750) AS ci_high FROM k GROUP BY 1),
w AS (SELECT metric, any_value(m) AS m, count(*) AS n, avg(a) AS base, avg(b) AS tuned, sum(d)::DOUBLE / count(*) AS delta, count(*) FILTER (b = 1 AND a = 0) AS fixed, count(*) FILTER (a = 1 AND b = 0) AS broken FROM v GROUP BY 1)"""
PAIRED_SQL = f"""
WITH {RUNS}, {VALUES_SQL}
SELECT metric, n, round(base, 9) AS base, round(tuned, 9) AS tuned, round(delta, 9) AS delta, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, ci_low > 0 OR ci_high < 0 AS significant,
  CASE WHEN m <= 4 THEN fixed END AS fixed, CASE WHEN m <= 4 THEN broken END AS broken, CASE WHEN m <= 4 THEN {P_SQL} END AS p_value FROM w JOIN ci USING (metric)"""
HEADLINE_SQL = f"""
WITH {RUNS}, {VALUES_SQL}, z AS (SELECT * FROM w JOIN ci USING (metric)), y AS (SELECT *, {P_SQL} AS p_value FROM z WHERE metric = 'exact_match')
SELECT n, round(base, 4) AS base_exact_match, round(tuned, 4) AS tuned_exact_match, round(delta, 4) AS exact_match_delta, ci_low > 0 OR ci_high < 0 AS exact_match_significant, p_value AS mcnemar_p, fixed AS examples_fixed, broken AS examples_broken,
  (SELECT round(base, 4) FROM z WHERE metric = 'improved') AS base_improved_rate, (SELECT round(tuned, 4) FROM z WHERE metric = 'improved') AS tuned_improved_rate,
  (SELECT round(base, 4) FROM z WHERE metric = 'copied') AS base_copy_rate, (SELECT round(tuned, 4) FROM z WHERE metric = 'copied') AS tuned_copy_rate FROM y"""
_ROUNDED = ", ".join(f"round(avg(base_{m}{c}), 4) AS base_{m}, round(avg(tuned_{m}{c}), 4) AS tuned_{m}, round(avg(tuned_{m}{c}) - avg(base_{m}{c}), 4) AS delta_{m}" for m, c in (("exact_match", "::INT"), ("edit_sim", "")))
SLICES_SQL = " UNION ALL ".join(f"SELECT '{s}' AS slice, coalesce(nullif({s}, ''), 'unknown') AS value, count(*) AS n, {_ROUNDED} FROM p GROUP BY 2" for s in ("category", "lang", "origin"))
BOOTSTRAP_SQL = f"WITH {RUNS}, {VALUES_SQL} SELECT round(delta, 9) AS delta, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, ci_low > 0 OR ci_high < 0 AS significant FROM w JOIN ci USING (metric) WHERE metric = 'exact_match'"


def verdicts(spark, d):
    """Two judged orders for each benchmark item, with answers made from an md5; some don't parse."""
    items = J.both_orders(spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", (F.col("item_id") % 3).alias("category")))
    h = F.conv(F.substring(F.md5(F.concat(F.col("item_id").cast("string"), F.col("base_is_a").cast("string"))), 1, 4), 16, 10).cast("long")
    winner = F.when(h % 3 == 0, "A").when(h % 3 == 1, "B").otherwise("tie")
    answer = F.concat(F.lit('Verdict: {"score_a": '), (h % 5 + 1).cast("string"), F.lit(', "score_b": '), (F.floor(h / 7) % 5 + 1).cast("string"), F.lit(', "winner": "'), winner, F.lit('", "reason": "x"} end'))
    return items.withColumn("answer", F.when(h % 11 == 0, "no verdict").otherwise(answer))


VOTES = """
i AS (SELECT item_id, item_id % 3 AS category, b.base_is_a, ('0x' || left(md5(item_id::VARCHAR || b.base_is_a::VARCHAR), 4))::BIGINT AS h FROM benchmark, (VALUES (true), (false)) AS b(base_is_a)),
v AS (SELECT item_id, category, base_is_a, (CASE WHEN base_is_a THEN h % 5 + 1 ELSE h // 7 % 5 + 1 END)::DOUBLE AS base_score, (CASE WHEN base_is_a THEN h // 7 % 5 + 1 ELSE h % 5 + 1 END)::DOUBLE AS tuned_score,
  CASE h % 3 WHEN 0 THEN CASE WHEN base_is_a THEN 'base' ELSE 'tuned' END WHEN 1 THEN CASE WHEN base_is_a THEN 'tuned' ELSE 'base' END ELSE 'tie' END AS winner FROM i WHERE h % 11 <> 0),
c AS (SELECT item_id, category, avg(base_score) AS base_score, avg(tuned_score) AS tuned_score, CASE WHEN count(DISTINCT winner) = 1 THEN min(winner) ELSE 'tie' END AS winner, count(DISTINCT winner) > 1 AS order_inconsistent, count(*) AS n_votes FROM v GROUP BY 1, 2)"""


def judge_votes(spark, d):
    return J.consensus(J.votes(verdicts(spark, d)), "item_id", "category")


def judge_summary(spark, d):
    return J.summary(judge_votes(spark, d), ["category"])


def judge_failures(spark, d):
    return J.failures(verdicts(spark, d))


def mcq(spark, d):
    """The first components of a vector are the options' log-probabilities, the label modulo their number is the answer."""
    k = (F.col("label") % 3 + 2).cast("int")
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", (F.col("label") % 2).alias("domain"), F.slice("embedding", F.lit(1), k).cast("array<double>").alias("l"), k.alias("n_choices"), (F.col("label") % k).alias("answer"))
    tokens = F.transform("l", lambda x, i: (i + F.col("vec_id")) % 3)
    return rows.withColumn("chosen", P.best_option(F.col("l"), tokens))


MCQ = """
e AS (SELECT vec_id, label % 2 AS domain, label % 3 + 2 AS n_choices, label % (label % 3 + 2) AS answer, list_transform(range(1, label % 3 + 3), lambda i: CASE WHEN (i - 1 + vec_id) % 3 > 0 THEN embedding[i]::DOUBLE / ((i - 1 + vec_id) % 3) ELSE '-inf'::DOUBLE END) AS m FROM embeddings),
a AS (SELECT vec_id, domain, n_choices, answer, (list_position(m, list_max(m)) - 1)::INT AS chosen FROM e)"""


def mcq_argmax(spark, d):
    return mcq(spark, d).select("vec_id", "chosen")


def mcq_by_domain(spark, d):
    return P.accuracy(mcq(spark, d), ["domain"])


KINDS = ("one_word", "contains", "yes_no", "n_lines", "max_words", "no_letter", "unknown")
ARGS = ("", "tion", "", "2", "30", "x", "")


def checked(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("conv_id") % 7 + 1).cast("int"))
    arg = F.element_at(F.array(*[F.lit(k) for k in ARGS]), (F.col("conv_id") % 7 + 1).cast("int"))
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    return rows.select("conv_id", "turn", kind.alias("kind"), "text", P.passes(kind, arg, F.col("text")).alias("passed"))


CHECKED = rf"""
k AS (SELECT conv_id, turn, text, {sql_trim("text")} AS s, ['one_word', 'contains', 'yes_no', 'n_lines', 'max_words', 'no_letter', 'unknown'][(conv_id % 7 + 1)::INT] AS kind FROM conversations),
c AS (SELECT *, len(list_filter(regexp_split_to_array(s, '{U_SPACE}+'), lambda x: x <> '')) AS nw FROM k),
r AS (SELECT conv_id, turn, kind, text, CASE kind WHEN 'one_word' THEN nw = 1 WHEN 'contains' THEN contains(lower(s), 'tion') WHEN 'yes_no' THEN regexp_replace(upper(s), '[.!]+$', '') IN ('YES', 'NO')
  WHEN 'n_lines' THEN len(list_filter(string_split(s, chr(10)), lambda x: trim(x) <> '')) = 2 WHEN 'max_words' THEN nw BETWEEN 1 AND 30 WHEN 'no_letter' THEN NOT contains(lower(s), 'x') ELSE false END AS passed FROM c)"""


def rule_checks(spark, d):
    return checked(spark, d).drop("text")


def instruction_rates(spark, d):
    return P.instruction_rates(checked(spark, d))


def json_checks(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    return rows.select("event_id", P.passes(F.lit("json_key"), F.col("event_type"), F.col("props")).alias("has_type_key"), P.passes(F.lit("json_array"), F.lit("1"), F.col("props")).alias("is_array"))


def retention(spark, d):
    """Rates of the two halves of the labels by language, and what is left of the first."""
    rows = spark.read.parquet(f"{d}/labels.parquet").join(documents(spark, d).select("doc_id", "lang"), "doc_id")
    rates = rows.groupBy("lang").agg(F.avg(F.when(F.col("doc_id") % 2 == 0, F.col("quality"))).alias("base"), F.avg(F.when(F.col("doc_id") % 2 == 1, F.col("quality"))).alias("tuned"))
    return rates.select("lang", P.retention(F.col("base"), F.col("tuned")).alias("retention_pct"))


def chat_messages(spark, d):
    text = F.col("text")
    messages = T.training_messages(SYSTEM, text, F.concat(F.lit("  "), text, F.lit(" ")), F.reverse(text), F.when(F.col("doc_id") % 2 == 0, "py").otherwise("zig"))
    rows = documents(spark, d).select("doc_id", messages.alias("m")).select("doc_id", "m", T.fold_system(F.col("m")).alias("f"))
    return rows.select("doc_id", F.array_join(F.transform("m", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("chat"), F.size("f").alias("n_folded"), F.col("f")[0]["content"].alias("first_folded"))


CHAT_SQL = rf"""
WITH t AS (SELECT doc_id, text AS x, {sql_trim("text")} AS y, CASE WHEN doc_id % 2 = 0 THEN 'Python' ELSE 'zig' END AS name, CASE WHEN doc_id % 2 = 0 THEN 'python' ELSE '' END AS fence, chr(10) AS e FROM ({ALL})),
u AS (SELECT *, 'A reviewer left this note on ' || name || ' code:' || e || '> ' || y || e || e || 'Snippet:' || e || '```' || fence || e || x || e || '```' || e || e || 'Rewrite the snippet so that it does what the note asks.' AS q FROM t)
SELECT doc_id, 'system:{SYSTEM}|user:' || q || '|assistant:```' || fence || e || reverse(x) || e || '```' AS chat, 2 AS n_folded, '{SYSTEM}' || e || e || q AS first_folded FROM u"""


def subarray_search(spark, d):
    words = F.split(F.lower("text"), "[^a-z]+")
    rows = documents(spark, d).select("doc_id", words.alias("w"))
    return rows.select("doc_id", T.contains_run(F.col("w"), F.array(F.lit("of"), F.lit("the"))).alias("has_run"))


def syntax_ok(spark, d):
    """A statement that parses, one that does not, and an original that does not, for every document."""
    i = F.col("doc_id").cast("string")
    code = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x = "), i)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("def f"), i, F.lit("(:"))).otherwise(F.concat(F.lit("for k in y:\n    k += "), i))
    old = F.when(F.col("doc_id") % 7 == 0, "if:").otherwise("y = 2")
    rows = documents(spark, d).select("doc_id", code.alias("code"), old.alias("old"), F.when(F.col("doc_id") % 5 == 0, "go").otherwise("py").alias("lang"))
    return rows.select("doc_id", SC.syntax_ok(F.col("old"), F.col("code"), F.col("lang")).alias("syntax_ok"))


def variants(spark, d):
    """Whether a run's name says base, and whether its answer changes what it was given."""
    rows = documents(spark, d)
    return rows.select("doc_id", T.variant_of(F.concat(F.coalesce("source", F.lit("")), F.when(F.col("doc_id") % 2 == 0, "-BASE").otherwise("-lora"))).alias("variant"), T.changed_input(F.col("text"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" \n"), F.col("text"))).otherwise(F.concat(F.col("text"), F.lit("x")))).alias("changed"))


def prediction_rows(spark, d):
    """Answers to every turn as predictions, with the defaults for what an example lacks."""
    t = spark.read.parquet(f"{d}/conversations.parquet")
    rows = t.select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("id"), F.lit("py").alias("lang"), "role", F.when(F.col("turn") % 2 == 0, "own").alias("origin"), F.lit("c").alias("comment"), F.col("text").alias("old_code"), F.col("text").alias("new_code"), F.concat(F.lit("```py\n"), F.coalesce("text", F.lit("")), F.lit("\n```")).alias("raw_output"))
    made = DOC.prediction_rows(rows.withColumnRenamed("role", "category"), "valid")
    return made.select("id", "category", "repo", "origin", "probe", F.md5("gold").alias("gold_md5"), F.md5("prediction").alias("prediction_md5"), "parse_mode")


def judge_pairs(spark, d):
    """The first 50 examples, by number, that both runs have."""
    base, tuned = runs_of(spark, d)
    return J.judge_pairs(base.select("id", "category", "prediction"), tuned, "id", "id", 50).select("id", "category", "base_prediction", "tuned_prediction")


def last_wins(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role")
    return CP.last_wins(rows, "conv_id", "turn")


def id_selection(spark, d):
    return SL.in_order_of(documents(spark, d).select("doc_id", "lang"), "doc_id", [7, 3, 10**9, 5]).withColumnRenamed("_pos", "pos")


def miss_rate(spark, d):
    return SL.miss_rate(documents(spark, d), F.contains(F.col("text"), F.lit(" the ")), "doc_id")


def pair_verdicts(spark, d):
    v = SL.pair_verdict(F.col("base_exact_match"), F.col("tuned_exact_match"), F.col("base_edit_sim"), F.col("tuned_edit_sim"), 0.02)
    return paired(spark, d).groupBy(v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def trained_share(spark, d):
    return SL.trained_share(documents(spark, d).withColumn("trained", F.col("lang") == "en"), "n_chars", "trained")


def judge_prompts(spark, d):
    p = J.judge_prompt(F.coalesce("lang", F.lit("")), F.col("old_code"), F.lit("why"), F.col("gold"), F.col("prediction"), F.col("old_code"))
    return predictions(spark, d).select("id", F.md5(p).alias("prompt_md5"))


def retention_overall(spark, d):
    """What is left of the rates of one half of the labels in the other, and of the weaker rate."""
    rows = spark.read.parquet(f"{d}/labels.parquet")
    half = lambda k: rows.filter(F.col("doc_id") % 2 == k).agg(F.avg(F.col("quality").cast("double")).alias("mcq_accuracy"), F.avg(1.0 - F.col("toxic")).alias("instruction_pass_rate"), F.avg(F.col("toxic").cast("double")).alias("spurious_code_fence_rate"))
    return P.retention_table(half(0), half(1)).select("mcq_retention_pct", "instruction_retention_pct", "overall_retention_pct")


def distinct_labels(spark, d):
    return DOC.labels_of(documents(spark, d), "source").select(F.array_join("labels", ",").alias("labels"))


_SLICE_SQL = "round(avg(exact_match::INT), 6) AS exact_match, round(avg(improved::INT), 6) AS improved_rate, round(avg(changed_right_lines), 6) AS edit_line_f1"
_HEAD_SQL = """count(*) AS n, {r}(avg((parse_mode IN ('fenced', 'fenced_unterminated'))::INT), {k}) AS format_compliance, {r}(avg((trim(prediction) = '')::INT), {k}) AS empty_rate,
{r}(avg(exact_match::INT), {k}) AS exact_match, {r}(avg(improved::INT), {k}) AS improved_rate, {r}(avg(regressed::INT), {k}) AS regressed_rate, {r}(avg(copied::INT), {k}) AS copy_rate, {r}(avg(edit_sim), {k}) AS edit_similarity,
{r}(avg(token_f1), {k}) AS token_f1, {r}(avg(changed_right_lines), {k}) AS edit_line_f1, {r}(avg(delta_to_gold), {k}) AS delta_to_gold, {r}(avg(1 - dist_old_gold), {k}) AS copy_baseline_edit_similarity, {r}(avg(syntax_ok::INT), {k}) AS python_syntax_ok, count(syntax_ok) AS python_syntax_checked"""

QUERIES = {
    "normalize_code": (normalize_code, f"SELECT doc_id, {_n('code')} AS normal FROM ({RAGGED})"),
    "edge_trim": (edge_trim, rf"SELECT doc_id, regexp_replace(regexp_replace(replace(code, chr(13), ''), '\A([ \t]*\n)+', ''), '(\n[ \t]*)+\z', '') AS trimmed FROM ({RAGGED})"),
    "tokenize_code": (tokenize_code, f"SELECT doc_id, len(regexp_extract_all(text, '{TOKEN}'))::INT AS n, md5(array_to_string(regexp_extract_all(text, '{TOKEN}'), ' ')) AS tokens_md5 FROM ({ALL})"),
    "edit_scores": (edit_scores, f"SELECT * EXCLUDE (category, lang, parse_mode, prediction) FROM ({SCORES})"),
    "attached_scores": (
        attached_scores,
        f"SELECT id, exact_match, improved, regressed, copied, round(edit_sim, 4) AS edit_sim, round(delta_to_gold, 4) + 0.0::DOUBLE AS delta_to_gold, round(changed_right_lines, 4) AS edit_line_f1, round(token_f1, 4) AS token_f1, syntax_ok FROM ({SCORES})",
    ),
    "edit_scores_documents": (edit_scores_documents, None),
    "score_headline": (score_headline, f"SELECT {_HEAD_SQL.format(r='round', k=6)} FROM ({SCORES})"),
    "score_slices": (
        score_slices,
        f"WITH s AS ({SCORES}) SELECT 'category' AS slice, category AS value, count(*) AS n, {_SLICE_SQL} FROM s GROUP BY category UNION ALL SELECT 'lang', lang, count(*), {_SLICE_SQL} FROM s GROUP BY lang",
    ),
    "metric_block": (
        metric_block,
        f"WITH p AS (SELECT id, {_n('prediction')} AS prediction, {_n('gold')} AS gold, {_n('old_code')} AS old_code FROM ({PREDICTIONS})), h AS (SELECT {_HEAD_SQL.format(r='round', k=4)} FROM ({SCORES})) SELECT *, ({_bleu('prediction', places=3)}) AS bleu, ({_bleu('old_code', places=3)}) AS copy_baseline_bleu FROM h",
    ),
    "parse_fenced": (parse_fenced, PARSE_SQL),
    "corpus_bleu": (corpus_bleu, f"WITH p AS ({PREDICTIONS}) {_bleu_sql('prediction', 'model')} UNION ALL {_bleu_sql('old_code', 'copy')}"),
    "coverage": (coverage, "SELECT doc_id, 'tuned' AS only_in FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION SELECT doc_id, 'base' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"),
    "win_loss_tie": (
        win_loss_tie,
        f"""WITH {RUNS} SELECT id, coalesce(lang, '') AS lang, coalesce(category, '') AS category, origin, '' AS probe, '' AS comment, '' AS old_code, '' AS gold, 'text ' || bf AS base_prediction, 'text ' || tf AS tuned_prediction,
base_exact_match AS base_exact, tuned_exact_match AS tuned_exact, base_edit_sim, tuned_edit_sim, round(delta_sim, 4) AS delta_edit_sim, outcome FROM o""",
    ),
    "outcome_counts": (outcome_counts, f"WITH {RUNS} SELECT outcome, count(*) AS n FROM o GROUP BY 1"),
    "extremes": (
        extremes,
        f"WITH {RUNS} SELECT * FROM (SELECT id, outcome, delta_sim FROM o WHERE outcome = 'win' ORDER BY delta_sim DESC, id LIMIT 25) UNION ALL SELECT * FROM (SELECT id, outcome, delta_sim FROM o WHERE outcome = 'loss' ORDER BY delta_sim, id LIMIT 25)",
    ),
    "paired_slices": (paired_slices, f"WITH {RUNS} {SLICES_SQL}"),
    "category_gains": (category_gains, f"WITH {RUNS} SELECT value, delta_exact_match FROM ({SLICES_SQL}) WHERE slice = 'category'"),
    "mcnemar": (mcnemar, f"WITH {RUNS}, c AS (SELECT count(*) FILTER (tuned_exact_match AND NOT base_exact_match) AS fixed, count(*) FILTER (base_exact_match AND NOT tuned_exact_match) AS broken FROM p) SELECT fixed, broken, {P_SQL} AS p_value, {P_SQL} < 0.05 AS significant FROM c"),
    "mcnemar_small": (
        mcnemar_small,
        f"WITH {RUNS}, c AS (SELECT id % 37 AS bucket, count(*) FILTER (tuned_exact_match AND NOT base_exact_match) AS fixed, count(*) FILTER (base_exact_match AND NOT tuned_exact_match) AS broken FROM p GROUP BY 1) SELECT bucket, fixed, broken, {P_SQL} AS p_value, {P_SQL} < 0.05 AS significant FROM c",
    ),
    "paired_metrics": (paired_metrics, PAIRED_SQL),
    "comparison_headline": (comparison_headline, HEADLINE_SQL),
    "bootstrap_ci": (bootstrap_ci, BOOTSTRAP_SQL),
    "judge_votes": (judge_votes, f"WITH {VOTES} SELECT * FROM c"),
    "judge_summary": (
        judge_summary,
        f"""WITH {VOTES} SELECT category, count(*) AS n, count(*) FILTER (winner = 'tuned') AS tuned_wins, count(*) FILTER (winner = 'base') AS base_wins, count(*) FILTER (winner = 'tie') AS ties, avg(base_score) AS base_mean, avg(tuned_score) AS tuned_mean,
avg(tuned_score) - avg(base_score) AS delta, CASE WHEN count(*) FILTER (winner <> 'tie') > 0 THEN count(*) FILTER (winner = 'tuned')::DOUBLE / count(*) FILTER (winner <> 'tie') ELSE 0 END AS win_rate, avg(order_inconsistent::INT) AS order_inconsistent_rate FROM c GROUP BY 1""",
    ),
    "judge_failures": (judge_failures, f"WITH {VOTES} SELECT (SELECT count(*) FROM i) - (SELECT count(*) FROM v) AS failures"),
    "mcq_argmax": (mcq_argmax, f"WITH {MCQ} SELECT vec_id, chosen FROM a"),
    "mcq_by_domain": (mcq_by_domain, f"WITH {MCQ} SELECT domain, count(*) AS n, avg((chosen = answer)::INT) AS accuracy, avg(1::DOUBLE / n_choices) AS random_baseline FROM a GROUP BY 1"),
    "rule_checks": (rule_checks, f"WITH {CHECKED} SELECT conv_id, turn, kind, passed FROM r"),
    "instruction_rates": (instruction_rates, f"WITH {CHECKED} SELECT count(*) AS n, count(*) FILTER (passed)::DOUBLE / greatest(count(*), 1) AS pass_rate, count(*) FILTER (contains(text, '```'))::DOUBLE / greatest(count(*), 1) AS spurious_fence_rate FROM r"),
    "json_checks": (json_checks, "SELECT event_id, coalesce(list_contains(json_keys(props), event_type), false) AS has_type_key, coalesce(json_type(props) = 'ARRAY' AND json_array_length(props) = 1, false) AS is_array FROM events"),
    "retention": (
        retention,
        """WITH r AS (SELECT lang, avg(quality) FILTER (l.doc_id % 2 = 0) AS base, avg(quality) FILTER (l.doc_id % 2 = 1) AS tuned FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY lang)
SELECT lang, CASE WHEN coalesce(base, 0) = 0 THEN 100 ELSE tuned / base * 100 END AS retention_pct FROM r""",
    ),
    "chat_messages": (chat_messages, CHAT_SQL),
    "subarray_search": (
        subarray_search,
        f"WITH w AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z]+') AS w FROM ({ALL})) SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) > 0 AS has_run FROM w",
    ),
    "syntax_ok": (syntax_ok, "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN doc_id % 3 <> 1 END AS syntax_ok FROM documents"),
    "variants": (variants, "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'base' ELSE 'tuned' END AS variant, doc_id % 3 <> 0 AS changed FROM documents"),
    "prediction_rows": (
        prediction_rows,
        rf"""SELECT (conv_id * 1000 + turn)::VARCHAR AS id, role AS category, '' AS repo, CASE WHEN turn % 2 = 0 THEN 'own' ELSE 'valid' END AS origin, '' AS probe, md5(text) AS gold_md5,
md5(regexp_replace(regexp_replace(coalesce(text, ''), '\A({BLANK}*\n)+', ''), '(\n{BLANK}*)+\z', '')) AS prediction_md5, 'fenced' AS parse_mode FROM conversations""",
    ),
    "judge_pairs": (judge_pairs, f"WITH {RUNS} SELECT id, category, 'text ' || bf AS base_prediction, 'text ' || tf AS tuned_prediction FROM p ORDER BY id LIMIT 50"),
    "retention_overall": (
        retention_overall,
        """WITH r AS (SELECT avg(quality) FILTER (doc_id % 2 = 1) / avg(quality) FILTER (doc_id % 2 = 0) * 100 AS m, avg(1 - toxic) FILTER (doc_id % 2 = 1) / avg(1 - toxic) FILTER (doc_id % 2 = 0) * 100 AS i FROM labels)
SELECT round(m, 1) AS mcq_retention_pct, round(i, 1) AS instruction_retention_pct, round(least(m, i), 1) AS overall_retention_pct FROM r""",
    ),
    "distinct_labels": (distinct_labels, "SELECT array_to_string(list_sort(list(DISTINCT coalesce(source, ''))), ',') AS labels FROM documents"),
    "id_selection": (id_selection, "SELECT doc_id, lang, CASE doc_id WHEN 7 THEN 0 WHEN 3 THEN 1 ELSE 3 END AS pos FROM documents WHERE doc_id IN (7, 3, 5)"),
    "miss_rate": (miss_rate, "SELECT count(*) AS n, avg((NOT contains(text, ' the '))::INT) AS miss_rate FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 200)"),
    "pair_verdicts": (
        pair_verdicts,
        f"""WITH {RUNS} SELECT CASE WHEN tuned_exact_match AND base_exact_match THEN 'both exact' WHEN tuned_exact_match THEN 'tuned exact' WHEN base_exact_match THEN 'base exact'
WHEN delta_sim > 0.02::DOUBLE THEN 'tuned closer' WHEN base_edit_sim - tuned_edit_sim > 0.02::DOUBLE THEN 'base closer' ELSE 'tie' END AS verdict, count(*) AS n FROM p GROUP BY 1""",
    ),
    "trained_share": (trained_share, "SELECT sum(n_chars) FILTER (lang = 'en')::BIGINT AS trained, sum(n_chars)::BIGINT AS total, sum(n_chars) FILTER (lang = 'en')::DOUBLE / sum(n_chars)::DOUBLE AS share FROM documents"),
    "judge_prompts": (
        judge_prompts,
        f"""WITH p AS (SELECT *, chr(10) AS e FROM ({PREDICTIONS})) SELECT id, md5('A reviewer wrote about ' || lang || ' code: why' || e || '<before>' || e || old_code || e || '</before>' || e || '<merged>' || e || gold || e || '</merged>'
|| e || '<A>' || e || prediction || e || '</A>' || e || '<B>' || e || old_code || e || '</B>' || e || 'Which of A and B does what the reviewer asked, as the merged code does? Answer as JSON.') AS prompt_md5 FROM p""",
    ),
    "last_wins": (last_wins, "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, min(turn) AS first_line FROM conversations GROUP BY 1"),
}

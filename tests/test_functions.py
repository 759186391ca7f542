"""Text, score and statistics functions on small inputs with known results."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions import scores as SC
from millrace.functions import taxonomy as X
from millrace.functions import text as T
from millrace.operators import compare as CP
from millrace.operators import curation as C
from millrace.operators import judge as J
from millrace.operators import metrics as M
from millrace.operators import percentiles as Q
from millrace.operators import probes as P
from millrace.operators import runs as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def lit(value):
    return F.lit(value).cast("string") if value is None or isinstance(value, str) else F.lit(value)


def test_strip_markers(spark):
    diff = " keep\n-old\n+new\n\\ No newline at end of file\n\nplain\n  two"
    assert one(spark, T.strip_markers(lit(diff), "old")) == "keep\nold\n\nplain\n two"
    assert one(spark, T.strip_markers(lit(diff), "new")) == "keep\nnew\n\nplain\n two"
    assert one(spark, T.changed_line_count(lit("-a\n b\n-c"), lit("+a\n b"))) == 3


@pytest.mark.parametrize(
    ("comment", "old", "new", "want"),
    [("use `errors_is` here", "foo bar", "foo errors_is", 0.5 + 0.35 + 0.0), ("`foo` gone", "foo", "baz", 0.25 + 0.15), ("nothing shared", "aaa", "bbb", 0.0), ("", "", "", 0.0)],
)
def test_grounding(spark, comment, old, new, want):
    assert one(spark, T.grounding(lit(comment), lit(old), lit(new))) == pytest.approx(want)


def test_normalize_and_trim(spark):
    assert one(spark, T.normalize_code(lit("\n \n  a  \r\nb\t\r\n\n"))) == "  a\nb"
    assert one(spark, T.strip_blank_edges(lit(" \n\n  x \n y\n \n"))) == "  x \n y"
    assert one(spark, T.strip_blank_edges(lit(" \n "))) == ""
    assert one(spark, T.pytrim(lit("  x "))) == "x"


def test_tokens(spark):
    assert one(spark, T.token_text(lit("foo(bar, 1.5)+naïve_2"))) == "foo ( bar , 1.5 ) + naïve_2"


@pytest.mark.parametrize(
    ("text", "code", "how"),
    [
        ("Sure!\n```py\nx = 1\n```\nor\n```\ny\n```", "x = 1", "fenced"),
        ("```\nx = `` 1", "x = `` 1", "fenced_unterminated"),
        ("Here's the code:\n\n  x", "x", "raw"),
        ("  x\n", "  x", "raw"),
        ("", "", "empty"),
        (None, "", "empty"),
        (" \n ", "", "empty"),
    ],
)
def test_parse_generation(spark, text, code, how):
    got = one(spark, T.parse_generation(lit(text)))
    assert (got.code.strip() if how == "raw" else got.code, got.how) == (code.strip() if how == "raw" else code, how)


@pytest.mark.parametrize(
    ("comment", "label"),
    [
        ("```suggestion\nx\n```", "suggested_edit"),
        ("fix the typo in this error message", "typo_or_docs"),
        ("can this be null?", "null_check"),
        ("Why is this public", "design_question"),
        ("please RENAME", "naming"),
        ("hmm", "other"),
    ],
)
def test_classify(spark, comment, label):
    assert one(spark, X.classify(lit(comment))) == label


def test_classify_all_and_hardness(spark):
    assert one(spark, X.classify_all(lit("rename this, it is slow"))) == ["naming", "performance"]
    assert one(spark, X.hardness(lit(None).cast("double"), F.lit(0), lit("security"))) == pytest.approx(0.25 + 0.2 / 6 + 0.3)


def test_scores(spark):
    df = spark.createDataFrame([("a", "b", "a"), ("b", "b", "a"), ("zzz", "b", "a"), ("a\n", "a", "a")], "prediction string, gold string, old_code string")
    copied, perfect, worse, same = SC.with_scores(df).collect()
    assert copied.copied and not copied.improved and copied.changed_right_lines == 0.0
    assert perfect.exact_match and perfect.improved and perfect.changed_right_lines == 1.0 and perfect.edit_sim == 1.0
    assert worse.edit_sim == 0.0 and not worse.improved
    assert same.exact_match and same.changed_right_lines == 1.0


def test_bag_f1(spark):
    assert one(spark, SC.token_f1(T.code_tokens(lit("a a b")), T.code_tokens(lit("a b b")))) == pytest.approx(2 / 3)
    assert one(spark, SC.token_f1(T.code_tokens(lit("x")), T.code_tokens(lit("y")))) == 0.0


def test_syntax_is_tri_state(spark):
    rows = spark.createDataFrame([("x = 1", "y = (", "py"), ("x = (", "y", "py"), ("x", "y = 1", "py"), ("x", "y", "go")], "o string, p string, l string")
    got = [r[0] for r in rows.select(SC.syntax_ok(F.col("o"), F.col("p"), F.col("l"))).collect()]
    assert got == [False, None, True, None]


@pytest.mark.parametrize(("fixed", "broken"), [(0, 0), (10, 0), (3, 0), (7, 12), (600, 700), (1500, 1400)])
def test_mcnemar(spark, fixed, broken):
    n, k = fixed + broken, min(fixed, broken)
    want = min(1.0, 2 * sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1))) if n else 1.0
    assert one(spark, SC.mcnemar_p(F.lit(fixed), F.lit(broken))) == pytest.approx(want, rel=1e-9)


def test_bootstrap_brackets_the_mean(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(60)], "i int, d double")
    got = CP.bootstrap_ci(df, "d", "i", resamples=300).first()
    assert got.ci_low < got.delta < got.ci_high and got.significant
    none = CP.bootstrap_ci(df.filter("i < 0"), "d", "i", resamples=10).first()
    assert tuple(none) == (0.0, 0.0, 0.0, False)


def test_bleu_identities(spark):
    df = spark.createDataFrame([(1, "a b c d e", "a b c d f"), (2, "x y z w", "x y z w")], "i int, p string, g string")
    assert M.corpus_bleu(df, "i", "g", "g").first()[0] == pytest.approx(100.0)
    assert 0 < M.corpus_bleu(df, "i", "p", "g").first()[0] < 100
    assert M.corpus_bleu(df.filter("i < 0"), "i", "p", "g").first()[0] == 0.0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 20, 100])
def test_order_statistics(spark, n):
    values = sorted((i * 37) % 101 for i in range(n))
    df = spark.createDataFrame([(v,) for v in values], "v int")
    got = Q.elements_at(df, [], "v", {"p50": Q.nearest_rank(0.5), "p95": Q.nearest_rank(0.95), "median": Q.at_fraction(0.5)}).first()
    assert (got.p50, got.p95, got["median"]) == (values[max(0, math.ceil(0.5 * n) - 1)], values[max(0, math.ceil(0.95 * n) - 1)], values[n // 2])


def test_verdicts(spark):
    ok = one(spark, J.parse_verdict(lit('x {"score_a": 4, "score_b": 2, "winner": "A"} y')))
    assert (ok.score_a, ok.winner) == (4.0, "A")
    assert one(spark, J.parse_verdict(lit('{"score_a": 4}'))) is None and one(spark, J.parse_verdict(lit("none"))) is None
    assert [one(spark, J.slot_to_model(lit(s), F.lit(b))) for s, b in (("A", True), ("A", False), ("B", True), ("tie", True))] == ["base", "tuned", "tuned", "tie"]


def test_judging_with_a_stub(spark):
    pairs = spark.createDataFrame([(1, "p"), (2, "q")], "id int, prompt string")
    asked = J.ask(J.both_orders(pairs), F.concat_ws("|", "prompt", F.col("base_is_a").cast("string")), lambda p: '{"score_a": 5, "score_b": 1, "winner": "A"}' if p.startswith("p") else "bad")
    got = J.consensus(J.votes(asked), "id").collect()
    assert len(got) == 1 and got[0].winner == "tie" and got[0].order_inconsistent and got[0].n_votes == 2
    assert J.failures(asked).first()[0] == 2


@pytest.mark.parametrize(
    ("kind", "arg", "text", "want"),
    [
        ("one_word", None, " yes ", True), ("contains", "ABC", "xabcx", True), ("yes_no", None, "Yes.!", True), ("yes_no", None, "maybe", False), ("n_lines", "2", "a\n\nb", True), ("max_words", "2", "", False),
        ("max_words", "2", "a b", True), ("no_letter", "e", "abc", True), ("json_key", "k", '```json\n{"k": 1}\n```', True), ("json_key", "k", "[1]", False), ("json_array", "2", "[1, 2]", True), ("json_array", "2", "{", False), ("other", None, "x", False),
    ],
)
def test_checks(spark, kind, arg, text, want):
    assert one(spark, P.passes(lit(kind), lit(arg), lit(text))) is want


def test_best_option(spark):
    assert one(spark, P.best_option(F.array(F.lit(-4.0), F.lit(-1.0), F.lit(-1.0)), F.array(F.lit(2), F.lit(0), F.lit(1)))) == 2


def test_early_stop_trace(spark):
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate([1.0, 0.8, 0.79995, 0.9, 0.85, 0.7])], "run string, step int, loss double")
    got = R.early_stop(df, "run", ["step"], "loss").orderBy("step").collect()
    assert [r.bad_count for r in got] == [0, 0, 1, 2, 3, 0] and [r.stop for r in got] == [False] * 4 + [True, False]


def test_messages(spark):
    m = one(spark, T.fold_system(T.training_messages("S", lit("o"), lit(" c "), lit("n"), lit("py"))))
    assert [x.role for x in m] == ["user", "assistant"] and m[0].content.startswith("S\n\nA reviewer left this note on Python") and m[1].content == "```python\nn\n```"
    assert one(spark, T.response_template(lit("[INST] U [/INST] AAAA"), "AAAA", "U")) == " [/INST]"
    assert one(spark, T.contains_run(F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (2, 3))))) is True
    assert one(spark, T.contains_run(F.array(F.lit(1)), F.array(*map(F.lit, (1, 2))))) is False


def test_the_keywords_of_outside_context_lose_no_match(spark):
    import re

    said = [
        "as discussed", "As we agreed on it", "as you said", "AS YOU MENTIONED", "see above", "See  above", "see below.", "see the docs", "ditto", "same as it", "Same here", "same comment", "per our chat", "per the convo", "offline", "see #12", "this PR", "previous comment",
        "previous review", "refer to", "mentioned above", "mentioned earlier", "mentioned before", "ſame here", "thıs pr", "nothing", "as we go", "", "xK ditto", "unditto", "a per the way",
    ]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    got = {r.s: (r.a, r.b) for r in df.select("s", T.outside_context(F.col("s")).alias("a"), F.col("s").rlike("(?iuU)" + T.OUTSIDE_CONTEXT).alias("b")).collect()}
    assert all(a == b for a, b in got.values()) and sum(a for a, _ in got.values()) > 20
    assert all(got[s][0] == bool(re.search(T.OUTSIDE_CONTEXT, s, re.I)) for s in said if s.isascii())
    strip = spark.createDataFrame([("  \x1c a b \x85\n",)], "s string").select(T.pytrim(F.col("s"))).first()[0]
    assert strip == "  \x1c a b \x85\n".strip() == "a b"


def test_bootstrap_draws_blocks_first_and_then_inside(spark):
    import hashlib

    def draws(name, n):
        return [int(hashlib.md5(f"{name}:{k // 4}".encode()).hexdigest()[8 * (k % 4) : 8 * (k % 4) + 8], 16) for k in range(n)]

    n, resamples = 11, 600
    rows = [(i, float(i % 3), float(i * i % 7)) for i in range(n)]
    d = [b - a for _, a, b in rows]
    pairs = spark.createDataFrame(rows, "i long, base_x double, tuned_x double").repartition(3)
    for block, most in ((4096, 16), (11, 0), (4, 16), (4, 0), (1, 5)):
        got = CP.bootstrap_table(pairs, "i", ["x"], resamples=resamples, block=block, most=most).first()
        means = []
        for r in range(resamples):
            picked = [x % n for x in draws(f"0:{r}", n)]
            if n > block:
                times = [sum(i // block == b for i in picked) for b in range(-(-n // block))]
                picked = [b * block + x % min(block, n - b * block) for b, m in enumerate(times) for x in draws(f"0:{r}:{b}", m)]
            assert len(picked) == n
            means.append(sum(d[i] for i in picked) / n)
        means.sort()
        assert (got.n, got.ci_low, got.ci_high) == (n, pytest.approx(means[15]), pytest.approx(means[585]))


def test_bootstrap_shuffles_no_draws(spark):
    counts = CP.block_counts(spark, 0, 1000, 50_000, 4096)
    assert counts.count() == 4 * 13 and counts.select(F.sum(F.aggregate("times", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] == 1000 * 50_000


def test_bleu_counts_inside_the_row(spark):
    rows = [(1, "a b a b c", "a b c a b a b"), (2, "x", "x y"), (3, "", "z"), (4, None, "q q"), (5, "k k k k k", "k k")]
    got = {r.n: tuple(r)[1:] for r in M.bleu_counts(spark.createDataFrame(rows, "id long, p string, g string"), "id", "p", "g").collect()}
    want = {}
    for n in (1, 2, 3, 4):
        hits = total = gold = 0
        for _, p, g in rows:
            a, b = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in ((p or "").split(), g.split()))
            hits, total, gold = hits + (a & b).total(), total + a.total(), gold + b.total()
        want[n] = (hits, total, gold)
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_exact_quotas_equal_a_fold(spark, seed):
    rng = random.Random(seed)
    rows = [(i * 3, f"h{rng.randrange(120)}", rng.choice(["hot", "hot", None, *"abcdefgh"]), f"c{min(rng.randrange(25), rng.randrange(25))}") for i in range(400)]
    rng.shuffle(rows)
    limits = ((5, 3), (1, 1), (9, 4))[seed]
    seen, repos, comments, want = set(), Counter(), Counter(), {}
    for at, h, repo, comment in sorted(rows, key=lambda r: r[0]):
        want[at] = "duplicate" if h in seen else "repo_quota" if repos[repo] >= limits[0] else "comment_quota" if comments[comment] >= limits[1] else ""
        if not want[at]:
            seen.add(h)
            repos[repo] += 1
            comments[comment] += 1
    df = spark.createDataFrame(rows, "at long, hash string, repo string, comment string").repartition(3)
    names = {"hash_col": "hash", "repo_col": "repo", "comment_col": "comment", "order_col": "at"}
    assert dict(C.greedy(df, **names, per_repo=limits[0], per_comment=limits[1]).collect()) == want and len(set(want.values())) == 4
    assert C.greedy(df.limit(0), **names, per_repo=1, per_comment=1).count() == 0
    if seed == 0:
        assert {v for _, v in C.greedy(df, **names, per_repo=0, per_comment=1).collect()} == {"repo_quota"}


def test_numbers_are_md5_for_any_head_and_count():
    import hashlib

    for head, start, end in (("0:5", 0, 1200), ("0:9999:299", 95, 1100), ("7", 0, 1), ("1" * 60, 3, 9)):
        want = [int(hashlib.md5(f"{head}:{k}".encode()).hexdigest()[8 * j : 8 * j + 8], 16) for k in range(start, end) for j in range(4)]
        assert [x.tolist() for x in CP.numbers([f"{head}:".encode()] * 2, start, end, {})] == [want, want]
    pieces = [(i, x.tolist()) for i, x in CP.draws_of(["0:9", "0:10"], [7, 5], 1000)]
    assert sorted((i, len(x)) for i, x in pieces) == [(0, 7), (1, 5)]


def test_bootstrap_says_how_many_tasks_draw(spark):
    """Blocks are few bytes and long work; dealt by bytes, all of them would go to a few tasks."""
    pairs = spark.range(400).selectExpr("id as i", "0.0D as base_x", "cast(id % 3 as double) as tuned_x")
    table = CP.bootstrap_table(pairs, "i", ["x"], resamples=20, block=4, most=0)
    assert "REPARTITION_BY_NUM" in table._jdf.queryExecution().executedPlan().toString() and table.count() == 1


@pytest.mark.parametrize("copies", (1, 2))
def test_bootstrap_deals_a_block_to_a_partition(spark, copies):
    """By a hash, some of 100 partitions had several blocks and some none."""
    counts, step = CP.block_counts(spark, 0, 500, 400, 4), CP.step_of(400)
    blocks = spark.range(100).selectExpr("id as _b", "array(id) as values")
    got = CP.dealt(counts, blocks, step, 100, copies).select("b", "r", "times", "values", F.spark_partition_id().alias("p")).collect()
    assert len(got) == len({r.p for r in got}) == 100 * copies and all(r.values == [r.b] for r in got)
    want = {(r.b, r.first + i): m for r in counts.collect() for i, m in enumerate(r.times)}
    assert {(r.b, i): m for r in got for i, m in zip(r.r, r.times, strict=True)} == want and sum(len(r.r) for r in got) == len(want)


def test_bootstrap_bounds_the_draws_of_a_task():
    for n in (1, 399, 204_478, 1_226_868, 6_000_000, 60_000_000):
        assert 1 <= CP.step_of(n) <= 250 and CP.step_of(n) * n <= 1 << 26
    assert CP.step_of(204_478) == 250 and CP.step_of(1 << 40) == 1


def test_scores_take_one_python_process_a_task_and_no_text_of_other_languages(spark):
    rows = [("a b c", "a c c", "a b c", "go"), (None, "x", "x", "py"), ("", "", "y", "py"), ("x = 1", "x = 2", "x = 1", "py"), ("if:", "x", "x = 1", "py"), ("x", "x", "if:", "py"), ("é ü", "e ü", "é", None)]
    scored = SC.with_scores(spark.createDataFrame(rows, "prediction string, gold string, old_code string, lang string"))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("BatchEvalPython") == 1
    got = [(r.dist_pred_gold, r.dist_old_gold, r.token_f1, r.syntax_ok) for r in scored.collect()]
    want = [(0.2, 0.2, 2 / 3, None), (None, 0.0, None, True), (0.0, 1.0, 0.0, True), (0.2, 0.2, 2 / 3, True), (1.0, 0.8, 0.0, False), (0.0, 1.0, 1.0, None), (1 / 3, 1.0, 0.5, None)]
    assert [tuple(x if x is None or isinstance(x, bool) else pytest.approx(x) for x in r) for r in want] == got


@pytest.mark.parametrize("label", [k for k, _ in X.RULES])
def test_keywords_stand_wherever_their_rule_matches(spark, label):
    """Each alternative of the rule, filled in at random, also in capitals, with letters that fold to ASCII and glued to others."""
    rng, pattern = random.Random(label), dict(X.RULES)[label]
    parts = re.split(r"\|(?![^(]*\))", pattern)
    fill = lambda p: re.sub(r"\[([^\]])[^\]]*\]", r"\1", re.sub(r"\((?:[^()|]|\([^()]*\))*((?:\|[^()|]*)*)\)\??", lambda m: rng.choice(m.group(0).strip("()?").split("|")), p.replace("(n't)?", ""))).replace(r"\b", "").replace(r"\s", " ").replace(".*", rng.choice(["", " a "])).replace("\\", "").strip("^$*")
    made = [x for p in parts for _ in range(8) for x in (fill(p),)]
    said = [w for x in made for y in (x, x.upper(), x.replace("s", "ſ"), x.replace("i", "İ"), x.replace("k", "K"), x.replace("?", ""), x + " >= y") for w in (y, f"q {y} q", f"é{y}", f"{y}é", f"a_{y}_b", f"({y})", f"x {y}\n")]
    df = spark.createDataFrame([(x,) for x in dict.fromkeys(said)], "s string").withColumn("low", F.lower("s"))
    got = df.select("s", X._may(F.col("s"), F.col("low"), [label]).alias("may"), F.col("s").rlike(X._FLAGS + pattern).alias("is"), (X.classify(F.col("s"), small=F.col("low")) == X.classify(F.col("s"), X.RULES)).alias("same")).collect()
    assert not [r.s for r in got if getattr(r, "is") and not r.may] and all(r.same for r in got) and sum(getattr(r, "is") for r in got) > 10


def test_rules_are_not_tried_on_texts_without_a_keyword(spark):
    plan = spark.range(1).select(X.classify(F.concat(F.lit("lorem"), F.col("id").cast("string"))).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("(?<![a-z0-9_])") < plan.index("spell(ing|ed)")

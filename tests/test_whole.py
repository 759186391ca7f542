"""Whole-text queries against brute force on a small fixture with what a cut would hide."""

import hashlib
import re
from collections import Counter

import pytest

from millrace.functions.scores import edit_distance
from millrace.functions.taxonomy import RULES
from millrace.plans import curation_queries as C
from millrace.plans import registry

LONG = "so it was " * 70
TEXTS = [
    LONG + "in the middle of the night, a deadlock",
    LONG + "the end of it\nof the file and the typo",
    LONG + "plain words",
    LONG + "and of the null",
    "short of the mark",
    "",
    "Größe of the naïve Straße – déjà 3.5 vu_é Ünïcode",
    "señor, ¿why?\u00a0",
]
LANGS = ["en", "de", None, "fr"]
TURNS = ["Ja\u00a0wohl", "Évaluation", "YES", "eins\n\u00a0\nzwei", "größer", "É\u00a0x", "ä", "ß"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    rows = [(i, t, LANGS[i % 4], f"s{i % 2}", len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(TURNS)], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def rows_of(spark, folder):
    return {r.doc_id: r.text for r in C.documents(spark, folder).collect()}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def versions(i, old):
    gold = old.replace(" the ", " a ")
    return gold, [gold, old][i % 2]


@pytest.mark.parametrize("a, b", [("", ""), ("", "ab"), ("kitten", "sitting"), ("é\U0001f600a", "e\U0001f600"), ("ab" * 60, "ba" * 55), ("x" * 200, "y" * 190), (LONG, LONG[3:] + "q")])
def test_distance(a, b):
    assert edit_distance(a, b) == edit_distance(b, a) == levenshtein(a, b)


def test_scores_see_the_whole_text(spark, folder):
    got = {r.doc_id: r for r in registry.queries()["edit_scores_documents"](spark, folder).collect()}
    texts = rows_of(spark, folder)
    assert set(got) == set(texts)
    for i, old in texts.items():
        gold, pred = versions(i, old)
        n = max(len(gold), len(old), 1)
        assert got[i].dist_old_gold == levenshtein(old, gold) / n
        assert got[i].dist_pred_gold == levenshtein(pred, gold) / max(len(pred), len(gold), 1)
        p, g = (re.findall(r"[A-Za-z_]\w*|\d+\.\d+|\d+|[^\sA-Za-z0-9_]", t) for t in (pred, gold))
        hit = (Counter(p) & Counter(g)).total()
        assert got[i].token_f1 == pytest.approx(2 * hit / (len(p) + len(g)) if hit else 0)
    assert got[0].dist_old_gold > 0


def test_labels_see_the_whole_text(spark, folder):
    got = dict(registry.queries()["taxonomy_documents"](spark, folder).collect())
    want = {i: next((label for label, p in RULES if re.search(p, t, re.I)), "other") for i, t in rows_of(spark, folder).items()}
    assert got == want and got[0] == "logic_bug" and got[1] == "typo_or_docs"


def test_remarks_reach_every_rule(spark, folder):
    spark.createDataFrame([(i, "plain") for i in range(50)], "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    assert {r.category for r in registry.queries()["taxonomy_histogram"](spark, folder).collect()} == {label for label, _ in RULES} | {"other"}


def test_texts_are_carried_whole(spark, folder):
    texts = rows_of(spark, folder)
    chats = {r.doc_id: r.chat for r in registry.queries()["chat_messages"](spark, folder).collect()}
    assert all(f"\n{t}\n```" in chats[i] for i, t in texts.items())
    parsed = {r.doc_id: r.code for r in registry.queries()["parse_fenced"](spark, folder).collect()}
    assert all(parsed[i] == texts[i] for i in (0, 1, 2) if i in texts)


def test_no_document_is_left_out(spark, folder):
    texts = dict(enumerate(TEXTS))
    for name in ("content_id", "strip_markers", "normalize_code", "edge_trim", "subarray_search", "grounding", "hard_benchmark", "full_funnel_documents", "syntax_ok"):
        assert {r.doc_id for r in registry.queries()[name](spark, folder).collect()} == set(texts), name
    assert None not in {r.prompt_md5 for r in registry.queries()["judge_prompts"](spark, folder).collect()}
    sizes = {r.doc_id: r.n for r in registry.queries()["tokenize_code"](spark, folder).collect()}
    assert sizes == {i: len(re.findall(r"[A-Za-z_]\w*|\d+\.\d+|\d+|[^\sA-Za-z0-9_]", t)) for i, t in texts.items()}
    norm = {r.doc_id: r.norm for r in registry.queries()["content_id"](spark, folder).collect()}
    assert norm == {i: re.sub(r"\s+", " ", re.sub(r"https?://\S+", "", t)).strip().lower() for i, t in texts.items()}


def test_every_turn_is_checked(spark, folder):
    checks = [lambda t: len(t.split()) == 1, lambda t: "tion" in t.lower(), lambda t: t.upper().rstrip(".!").strip() in ("YES", "NO"), lambda t: len([x for x in t.split("\n") if x.strip()]) == 2,
              lambda t: 0 < len(t.split()) <= 30, lambda t: "x" not in t.lower(), lambda t: False]
    got = {r.conv_id: r.passed for r in registry.queries()["rule_checks"](spark, folder).collect()}
    assert got == {i: checks[i % 7](t.strip()) for i, t in enumerate(TURNS)}


def test_every_label_is_paired(spark, folder):
    rows = registry.queries()["mcnemar"](spark, folder).collect()
    pairs = [(i % 2 == 1, i % 3 % 2 == 0) for i in range(150)]
    assert (rows[0].fixed, rows[0].broken) == (sum(t and not b for b, t in pairs), sum(b and not t for b, t in pairs))
    assert registry.queries()["win_loss_tie"](spark, folder).count() == 150


def test_bootstrap_draws_ten_thousand_resamples(spark, folder):
    diffs = [(i % 3 % 2 == 0) - (i % 2 == 1) for i in range(150)]
    means = sorted(sum(diffs[int(hashlib.md5(f"0:{r}:{k // 4}".encode()).hexdigest()[8 * (k % 4) : 8 * (k % 4) + 8], 16) % 150] for k in range(150)) / 150 for r in range(10_000))
    got = registry.queries()["bootstrap_ci"](spark, folder).first()
    assert (got.delta, got.ci_low, got.ci_high) == pytest.approx((sum(diffs) / 150, means[250], means[9750]), abs=1e-9)

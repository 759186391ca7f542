"""Every registered query runs, and equals its SQL where it has one."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import oracle  # noqa: E402

from millrace.plans import registry  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="driver tables are absent")


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, oracle.FOLDER)
    sql = registry.oracles().get(name)
    if sql:
        oracle.assert_same(df, con, sql)
    else:
        assert df.count() >= 0


def test_greedy_equals_a_sequential_loop(spark):
    from millrace.plans import curation_queries as Q

    rows = Q.keyed(spark, oracle.FOLDER).orderBy("doc_id").collect()
    seen, repos, words, want = set(), {}, {}, {}
    for r in rows:
        reason = "duplicate" if r.hash in seen else "repo_quota" if repos.get(r.source, 0) >= 10 else "comment_quota" if words.get(r.first_word, 0) >= 3 else ""
        if not reason:
            seen.add(r.hash)
            repos[r.source] = repos.get(r.source, 0) + 1
            words[r.first_word] = words.get(r.first_word, 0) + 1
        want[r.doc_id] = reason
    assert dict(Q.quota_exact_greedy(spark, oracle.FOLDER).collect()) == want


def test_funnel_accounts_for_every_row(spark):
    from millrace.plans import curation_queries as Q

    counts = Q.funnel_reasons(spark, oracle.FOLDER).collect()
    assert sum(r.n for r in counts) == Q.documents(spark, oracle.FOLDER).count()

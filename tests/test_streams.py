"""Streams over the events equal the batch forms, whole windows included."""

import random

import oracle
import pytest

from millrace.operators import curation as C
from millrace.plans import run_queries as Q
from millrace.streaming import queries as SQ


def test_stream_windows_equal_the_last_batch_windows(spark):
    batch = {}
    last = {r.event_type: r.event_id for r in Q.events(spark, oracle.FOLDER).orderBy("ts", "event_id").select("event_type", "event_id").collect()}
    for r in Q.rolling_500(spark, oracle.FOLDER).collect():
        if last[r.event_type] == r.event_id:
            batch[r.event_type] = r
    got = {r.event_type: r for r in Q.stream_rolling(spark, oracle.FOLDER).collect()}
    assert set(got) == set(batch)
    for k, r in got.items():
        for c in ("window_count", "p50", "p95", "max_latency", "tokens_sum", "tokens_per_second"):
            assert r[c] == pytest.approx(batch[k][c], abs=1e-6), (k, c)


def test_stream_stops_as_a_loop_does(spark):
    best, bad, stop = {}, {}, {}
    for r in Q.events(spark, oracle.FOLDER).orderBy("ts", "event_id").select("event_type", "value").collect():
        k, x = r
        good = k not in best or best[k] - x > 1e-4
        bad[k] = 0 if good else bad[k] + 1
        best[k] = min(best.get(k, x), x)
        stop[k] = stop.get(k, False) or bad[k] >= 3
    assert {r.event_type: (r.best, r.stop) for r in Q.stream_early_stop(spark, oracle.FOLDER).collect()} == {k: (best[k], stop[k]) for k in best}


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = spark.range(30).selectExpr("id", "concat('r', id % 3) as repo")
    rows.filter("id < 15").coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: SQ.run_available(SQ.quota_stream(SQ.read_stream(spark, str(tmp_path / "in"), rows.schema), "repo", {"repo": 7}, "id"), "append", str(tmp_path / "out"))
    assert run().filter("verdict = 'kept'").count() == 15
    rows.filter("id >= 15").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run()
    assert got.count() == 30 and got.filter("verdict = 'kept'").count() == 21 and {r.verdict for r in got.filter("id > 20").collect()} == {"repo"}


QUOTAS = [("duplicate", ["hash"], 1), ("repo_quota", ["repo"], 5), ("comment_quota", ["comment"], 3)]


def test_quotas_over_several_columns_equal_the_cascade_batch_by_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, f"h{rng.randrange(90)}", rng.choice(["hot", "hot", None, "a", "b", "c", "d"]), f"c{rng.randrange(9)}") for i in range(240)]
    df = spark.createDataFrame(rows, "id long, hash string, repo string, comment string")
    path, seen = str(tmp_path / "in"), 0
    for upto in (80, 81, 200, 240):
        df.filter(f"id >= {seen} and id < {upto}").repartition(2).write.mode("append").parquet(path)
        seen = upto
        with SQ.state_on_disk(spark):
            got = SQ.run_available(SQ.quotas_stream(SQ.read_stream(spark, path, df.schema), QUOTAS, "id"), "append", str(tmp_path / "out"))
        batch = C.cascade_verdicts(df.filter(f"id < {upto}").selectExpr("*", "cast(null as string) as reject_reason"), hash_keys=["hash"], repo_keys=["repo"], comment_keys=["comment"], order=["id"], per_repo=5, per_comment=3)
        want = {r.id: r.reject_reason for r in batch.collect()}
        assert {r.id: r.verdict for r in got.collect()} == want and len(want) == upto
    assert set(want.values()) == {None, "duplicate", "repo_quota", "comment_quota"}


def test_a_quota_holds_no_more_rows_than_its_limit():
    import pandas as pd

    class Handle:
        def __init__(self):
            self.n = {}

        def getMapState(self, *_):  # noqa: N802
            handle = self

            class State:
                containsKey = staticmethod(lambda k: k in handle.n)  # noqa: N815
                getValue = staticmethod(lambda k: handle.n[k])  # noqa: N815
                updateValue = staticmethod(lambda k, v: handle.n.update({k: v}))  # noqa: N815

            return State

    quota, handle = SQ.Quota("full", 3, "id", "verdict"), Handle()
    quota.init(handle)
    batches = [pd.DataFrame({"id": [9, 4, 7], "verdict": [None, None, "before"]}), pd.DataFrame({"id": [1, 8, 2], "verdict": [None] * 3})]
    out = pd.concat(list(quota.handleInputRows(("k",), iter(batches), None)))
    assert dict(zip(out["id"], out["verdict"].where(out["verdict"].notna(), None), strict=True)) == {1: None, 2: None, 4: None, 7: "before", 8: "full", 9: "full"}
    assert handle.n == {("full",): (3,)}
    assert list(pd.concat(list(quota.handleInputRows(("k",), iter(batches[1:]), None)))["verdict"]) == ["full"] * 3


def test_quotas_call_python_by_the_bucket():
    """Many keys of one bucket in one call, over two batches and on top of earlier counts."""
    import pandas as pd

    n = {("a",): (1,)}
    quota = SQ.BucketQuota("full", 2, "id", "verdict", ["id", "verdict"])
    quota.count = type("State", (), {"containsKey": staticmethod(lambda k: k in n), "getValue": staticmethod(lambda k: n[k]), "updateValue": staticmethod(lambda k, v: n.update({k: v}))})
    batches = [pd.DataFrame({"id": [9, 4, 7, 5], "verdict": [None, None, "before", None], SQ.KEY: ["a", "b", "a", "b"]}), pd.DataFrame({"id": [6], "verdict": ["before"], SQ.KEY: ["c"]}), pd.DataFrame({"id": [1, 8, 2], "verdict": [None] * 3, SQ.KEY: ["a", "c", "b"]})]
    out = pd.concat(list(quota.handleInputRows((0,), iter(batches), None)))
    assert list(out.columns) == ["id", "verdict"]
    assert dict(zip(out["id"], out["verdict"].where(out["verdict"].notna(), None), strict=True)) == {1: None, 9: "full", 2: None, 4: None, 5: "full", 6: "before", 7: "before", 8: None}
    assert n == {("a",): (2,), ("b",): (2,), ("c",): (1,)}

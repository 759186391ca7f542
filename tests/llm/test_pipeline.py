"""The pipeline's stages, each held against brute force on what the stage before kept; and the queries that have SQL."""

from __future__ import annotations

import os
import sys
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
import oracle  # noqa: E402
from helpers import SCHEMA, awkward_rows, near_components  # noqa: E402

import corpus_pipeline  # noqa: E402
from millrace.llm import mixing, packing, quality, registry  # noqa: E402
from millrace.llm.common import materialize  # noqa: E402

there = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="driver tables are absent")


def test_stages(spark):
    prose = "the cat and the dog of a house went to it in that year for a walk is number "
    rows = awkward_rows() + [(200 + i, prose + f"x{i % 9} y{i % 9}. " + "and of the in to " * 3 + f"z{i % 9}", "en", f"s{i % 3}", 0) for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "MinHash near-dedup", "mixing sources to target weights", "best-fit packing"]

    kept = materialize(stages["quality rules"](spark, docs, ""), "t")
    want = quality.quality_report(docs).filter("kept").select("doc_id").collect()
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in want) and 0 < kept.count() < len(rows)

    once = materialize(stages["exact dedup"](spark, kept, ""), "t")
    last = {}
    for r in kept.collect():
        if r.text not in last or (r.doc_id is not None and (last[r.text] is None or r.doc_id > last[r.text])):
            last[r.text] = r.doc_id
    assert Counter((r.doc_id, r.text) for r in once.collect()) == Counter((i, t) for t, i in last.items())

    far = materialize(stages["MinHash near-dedup"](spark, once, ""), "t")
    held = [tuple(r) for r in once.collect()]
    least = [min((held[i] for i in c), key=lambda r: (r[0] is None, r[0] or 0)) for c in near_components(held)]
    assert Counter(r.doc_id for r in far.collect()) == Counter(r[0] for r in least)

    mixed = materialize(stages["mixing sources to target weights"](spark, far, ""), "t")
    times = {r.doc_id: r.taken // r.size for r in mixing.mix_report(far).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in times.items() if n})
    for df in (kept, once, far, mixed):
        assert df.columns == docs.columns

    packed = stages["best-fit packing"](spark, mixed, "").collect()
    encoder = packing.Encoder(*packing.tokenizer_files())
    pieces = Counter()
    for r in mixed.collect():
        ids = encoder.whole(r.text or "") + b"\0\0\0\0"
        pieces.update((r.doc_id, k, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(packing.cuts(len(ids) // 4, 2048)))
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed) == pieces


@there
def test_run(spark):
    df = corpus_pipeline.run(spark, oracle.FOLDER)
    total, bins = df.agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert -(-total // 2048) <= bins <= -(-total // 2048) + 2
    assert df.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).filter("n <> end or n > 2048").count() == 0


@there
@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_its_sql(spark, name):
    oracle.assert_same(registry.queries()[name](spark, oracle.FOLDER), oracle.connect(), registry.oracles()[name])


@there
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_query_covers_its_table(spark, name):
    table, key = ("pages", "page_id") if name.startswith("op7") else ("documents", "doc_id")
    df = registry.queries()[name](spark, oracle.FOLDER)
    assert df.select(key).distinct().count() == spark.read.parquet(f"{oracle.FOLDER}/{table}.parquet").count()

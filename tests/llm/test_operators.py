"""Each operator against a brute-force version, over rows with nulls, blanks, ties, repeats and clashing column names."""

from __future__ import annotations

import hashlib
import os
import sys
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from helpers import SCHEMA, awkward_rows, covered_words, near_components, shingle_set, words_of  # noqa: E402

from millrace.llm import chat, exact_dedup, html, licenses, minhash, mixing, packing, quality, sharding, substrings  # noqa: E402


@pytest.fixture(scope="module")
def rows():
    return awkward_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names operators use inside."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("size", "_key", "_row", "_hash", "rank", "text_crc32", "n", "_w", "kept")}).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(items):
    return Counter(items)


def test_every_operator_takes_an_empty_table(spark, empty):
    assert sharding.shard_interleaved(empty).count() == 0
    assert mixing.mix_report(empty).count() == 0
    assert mixing.mix_documents(empty).columns == empty.columns
    assert quality.quality_report(empty).count() == 0
    assert quality.quality_filter(empty).count() == 0
    assert exact_dedup.dedup_report(empty).count() == 0
    assert exact_dedup.dedup_documents(empty).count() == 0
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.near_dedup_documents(empty).count() == 0
    assert substrings.dedup_substrings(empty).count() == 0
    assert licenses.scan_licenses(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert chat.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_shards_match_the_mixture(docs, rows):
    got = sharding.shard_interleaved(docs).collect()
    assert bag((r.doc_id, r.size, r.text_crc32) for r in got) == bag((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts[s] for s in range(16)) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))


def test_shards_hold_every_source_in_proportion(spark):
    df = spark.range(3200).selectExpr("id as doc_id", "'x' as text", "case when id % 4 = 0 then 'a' else 'b' end as source")
    got = sharding.shard_interleaved(df).join(df.select("doc_id", "source"), "doc_id").groupBy("shard", "source").count().collect()
    assert all(abs(r["count"] - (50 if r.source == "a" else 150)) <= 1 for r in got)
    again = sharding.shard_interleaved(df.repartition(7))
    assert bag(again.collect()) == bag(sharding.shard_interleaved(df).collect())


def test_shards_of_small_sources_are_spread(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "'x' as text", "case when id < 3200 then 'big' else concat('s', id) end as source")
    got = Counter(r.shard for r in sharding.shard_interleaved(df).filter("doc_id >= 3200").collect())
    assert len(got) == 16 and max(got.values()) - min(got.values()) <= 1


def test_shards_equal_their_sql(docs):
    import duckdb
    import oracle

    con = duckdb.connect()
    documents = docs.select("doc_id", "text", "source").toPandas()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM documents")
    oracle.assert_same(sharding.shard_interleaved(docs), con, sharding.OP5_SQL)


def water_fill(sizes: dict, weights, share, cap):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, capped = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in capped]
        left = budget - sum(capped.values())
        target = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if target[s] > cap * sizes[s]]
        if not over:
            return capped | target
        capped |= {s: cap * sizes[s] for s in over}


def test_mix_meets_targets(docs, rows):
    got = mixing.mix_report(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    want = water_fill(sizes, mixing.WEIGHTS, mixing.SHARE, mixing.CAP)
    by_size = {v: k for k, v in sizes.items()}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        source = by_size[r.source_size]
        assert abs(r.target - want[source]) < 1e-6 * max(1, want[source])
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size
        taken[source] += r.taken
        largest[source] = max(largest[source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] == sum(taken.values())


def test_thresholds_are_nested(spark):
    df = spark.range(300).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 5 as int)) as text", "'one' as source")
    taken = [{r.doc_id for r in mixing.mix_report(df, share=share).collect() if r.taken} for share in (0.3, 0.6, 1.0)]
    assert taken[0] < taken[1] < taken[2] == set(range(300))


def base_quality(text):
    text = text or ""
    w = words_of(text)
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if words_of(x)]
    n, rep = len(w), len(covered)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), rep, n < 10 or 100 * rep > 20 * n)


def test_quality_base_columns(docs, rows):
    got = quality.quality_report(docs).collect()
    assert bag((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == bag((r[0], *base_quality(r[1])) for r in rows)
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_rejects_what_diverges(spark):
    clean = [(i, " ".join(["the cat and the dog of a house went to it in that year for a walk is number"] * 1) + f" word{i} extra{i * 7} thing{i} other{i}. " + "Some more prose of the kind that people write, and it is long enough to be judged by its letters, as it has to be for that.", "en", "s", 0) for i in range(40)]
    odd = [(100, " ".join(f"%%{i}&&$#{i * 37}|" for i in range(60)), "en", "s", 0)]
    df = spark.createDataFrame(clean + odd, SCHEMA)
    kept = {r.doc_id for r in quality.quality_report(df).filter("kept").collect()}
    assert kept == set(range(40))
    left = quality.quality_filter(df)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == kept


def test_junk_does_not_shift_the_quality_references(spark):
    prose = "It was said that the cat and the dog of the house went to it in that year for a walk, and this is as it is with all of them. "
    clean = [(i, prose * 1 + " ".join(f"word{i}x{k}, and of the thing{k}" for k in range(30)), None, "s", 0) for i in range(5)]
    junk = [(100 + i, " ".join(f"zq{i}v{k * 7}" for k in range(150)), "en", "s", 0) for i in range(200)]
    coined = [f"{a}oi{b}eu{c}r" for a in "bcdfg" for b in "lmnpr" for c in "st"]
    french = [(900, " ".join(f"{x} {'de la et les le un des en du une'.split()[k % 10]} {x}ie, {x}ment." for k, x in enumerate(coined)), "en", "s", 0)]
    df = spark.createDataFrame(clean + junk + french, SCHEMA)
    assert {r.doc_id for r in quality.quality_report(df).filter("kept").collect()} == {0, 1, 2, 3, 4, 900}
    assert quality.quality_report(df, references={}).filter("kept").count() == 206


def test_exact_dedup(docs, rows):
    got = exact_dedup.dedup_report(docs, files_per_trigger=1).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    want = bag(
        (i, max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(text.encode()).hexdigest()) for text, ids in groups.items() for i in ids
    )
    assert bag((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    stay = exact_dedup.dedup_documents(docs)
    assert stay.columns == docs.columns and bag((r.text or "") for r in stay.collect()) == bag(list(groups))


def test_exact_dedup_checks_bytes_behind_equal_digests(spark):
    df = spark.createDataFrame([(i, f"text {i % 7}", "en", "s", 0) for i in range(40)], SCHEMA)
    got = exact_dedup.dedup_report(df, digest=lambda text: F.substring(F.md5(text), 1, 0)).collect()  # every digest collides
    assert {r.doc_id for r in got if r.kept} == set(range(33, 40))
    assert all(r.keep_id % 7 == r.doc_id % 7 for r in got)


def test_exact_dedup_state_goes_on_from_its_checkpoint(spark):
    df = spark.createDataFrame([(i, f"t{i % 3}", "en", "s", 0) for i in range(9)], SCHEMA)
    landed, path = exact_dedup.land(df, "doc_id", "text", exact_dedup.sha256)
    first = exact_dedup.stream_state(spark, landed, path, 1)
    assert {r.group_size for r in first.collect()} == {3}
    landed.withColumn("_id", F.col("_id") + 100).write.mode("append").parquet(path)
    second = exact_dedup.stream_state(spark, landed, path, 1).collect()
    assert {r.group_size for r in second} == {6} and {r._keep_id for r in second} == {106, 107, 108}


def test_near_duplicates(docs, rows):
    got = minhash.near_duplicates(docs).collect()
    want = []
    for comp in near_components(rows):
        ids = [rows[i][0] for i in comp]
        least = min((x for x in ids if x is not None), default=None)
        want += [(rows[i][0], len(shingle_set(rows[i][1])), least if shingle_set(rows[i][1]) else rows[i][0]) for i in comp]
    assert bag((r.doc_id, r.n_shingles, r.component_id) for r in got) == bag(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    stay = minhash.near_dedup_documents(docs)
    assert stay.columns == docs.columns and stay.count() == len(near_components(rows))


def test_large_buckets_and_components_give_the_same(docs, rows, monkeypatch):
    want = bag(minhash.near_duplicates(docs).collect())
    monkeypatch.setattr(minhash, "PART", 2)
    monkeypatch.setattr(minhash, "MAX_SHINGLES", 500)
    assert bag(minhash.near_duplicates(docs).collect()) == want


def test_super_minhash_estimates_and_stops_early():
    import numpy as np

    rng = np.random.default_rng(3)
    shared, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (600, 100, 100))
    x, y = np.concatenate([shared, a]), np.concatenate([shared, b])
    together = minhash.super_minhash([x, y, x[:3]])
    assert (together[0] == minhash.super_minhash([x])[0]).all() and (together[2] == minhash.super_minhash([x[:3]])[0]).all()
    assert abs((together[0] == together[1]).mean() - 600 / 800) < 0.15


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).selectExpr("id + 1 as a", "id as b").union(spark.range(3).selectExpr("id + 1000 as a", "999 as b"))
    found = dict(minhash.components(edges).collect())
    assert found == {**{i: 0 for i in range(1, 201)}, **{1000: 999, 1001: 999, 1002: 999}}


def test_substrings(docs, rows):
    got = substrings.dedup_substrings(docs).collect()
    want = []
    for r, marks in zip(rows, covered_words([r[1] for r in rows]), strict=True):
        w = words_of(r[1])
        kept = " ".join(x for x, m in zip(w, marks, strict=True) if not m)
        want.append((r[0], len(w), sum(marks), hashlib.sha256(kept.encode()).hexdigest()))
    assert bag(tuple(r) for r in got) == bag(want)


@pytest.mark.parametrize("window", [2, 7, 36])
def test_substrings_of_other_windows(docs, rows, window):
    got = substrings.dedup_substrings(docs, window=window).collect()
    want = [(r[0], len(m), sum(m)) for r, m in zip(rows, covered_words([r[1] for r in rows], window), strict=True)]
    assert bag(tuple(r)[:3] for r in got) == bag(want)


def test_licenses(spark):
    texts = [
        (1, "Licensed under the Apache License, Version 2.0. Apache License"),
        (2, "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy"),
        (3, "the GNU General Public License version 3 or any later version, a General-Public License"),
        (4, None),
        (5, " "),
        (6, "nothing of the kind, émit license"),
        (7, "mit licenses are not it"),
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels) == (10, 2, 3, 8, "apache", "apache,apache-2.0")
    assert got[2].labels == "mit" and got[2].score == 0.94
    assert got[3].n_base == 2 and "gpl-3.0" in got[3].labels and got[3].base_labels == "gpl"
    assert got[4].n_words == 0 and got[4].first_word is None and got[4].labels == "" and got[4].score == 0.0
    assert got[6].n_base == 0 and got[7].n_base == 0
    spans = [(d.first, d.end) for d in got[1].detections]
    assert not any(a != b and a[0] <= b[0] and b[1] <= a[1] for a in spans for b in spans)


def test_packing(docs, rows):
    encoder = packing.Encoder(*packing.tokenizer_files())
    got = packing.pack(docs).collect()
    want = []
    for r in rows:
        ids = encoder.whole(r[1] or "") + b"\0\0\0\0"
        want += [(r[0], k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(packing.cuts(len(ids) // 4, 2048))]
    assert bag((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == bag(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        end = 0
        for offset, n in sorted(items):
            assert offset == end
            end += n
        assert end <= 2048
    assert len(bins) <= -(-sum(w[3] for w in want) // 2048) + 1


def test_encoder_agrees_with_the_tokenizer():
    e = packing.Encoder(*packing.tokenizer_files())
    odd = ["", " ", " lead", "trail ", "a  b", "a\n\nb\n", "x \n y", "\n", "a\tb\x1cc", "don't we'll 's", "<|endoftext|>", "日本 語 é ñ×÷", "½²٣", "x" * 3000, "a b　c", "tab\t ", "Öl, für. Wörter; 12,5"]
    for text in [*odd, *[r[1] or "" for r in awkward_rows()]]:
        assert e.encode(text) == e.whole(text)


def test_local_search_raises_fill_and_empties_bins():
    start = [(((1200, 1),), 1), (((700, 1),), 1), (((400, 1), (100, 1)), 1), (((1000, 1), (600, 1)), 1)]
    found = packing.local_search(start, 2000)
    assert Counter({k: sum(b * dict(p).get(k, 0) for p, b in found) for k in (1200, 700, 400, 100, 1000, 600)}) == Counter(dict.fromkeys((1200, 700, 400, 100, 1000, 600), 1))
    assert sum(b for _, b in found) < 4 and all(packing.fill(p) <= 2000 for p, _ in found)


def test_pages(spark):
    shell = "<html><head><title>{t}</title><script>var a='</p>';</script></head><body><nav><ul><li>x</ul></nav><div class='promo-box'>buy</div><article><h1>{t}</h1>{a}<div class='c'><i>Join us</i> today</div></article><div>site words</div><footer>f</footer></body></html>"
    pages = [(i, f"http://h.example/{i}", shell.format(t=f"T{i}", a=f"<p>A &amp;amp; b{i}<br>c<p>shared passage")) for i in range(30)]
    pages += [(100, "http://h.example/x", "<body><p>no  article<p>site words<div>site words</div>"), (101, None, None), (102, "http://h.example/y", "<article><p>open <b>end")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract_pages(df).collect()}
    joined = {r.page_id: r.text for r in html.extract_pages(df, max_broadcast=0).collect()}
    assert got == joined
    assert got[3] == "T3\n\nA &amp; b3 c\n\nshared passage"  # the box at the article's end recurs, the passage is prose
    assert got[100] == "no article\n\nsite words" and got[101] == "" and got[102] == "open end"


def test_copies_of_a_page_are_no_template(spark):
    page = "<article><h1>One</h1><section><p>text of it</p></section></article>"
    df = spark.createDataFrame([(i, "http://h.example/p", page) for i in range(50)], "page_id long, url string, html string")
    assert {r.text for r in html.extract_pages(df).collect()} == {"One\n\ntext of it"}


def test_perspectives(spark):
    turns = [(1, 0, "system", "be good"), (1, 1, "ann", "hi"), (1, 2, "bob", "<|im_end|>"), (1, 3, "ann", None), (2, None, None, "x"), (2, 1, "", "y"), (None, 5, "ann", "z"), (None, 5, "ann", "z"), (3, 0, "system", "alone")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("start", F.lit(9))
    got = chat.rotate_perspectives(df).collect()
    views = defaultdict(list)
    for r in got:
        views[r.conv_id, r.perspective].append(r)
    assert set(views) == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "ann")}
    for (_, who), rs in views.items():
        rs.sort(key=lambda r: r.position)
        assert [r.position for r in rs] == list(range(len(rs)))
        text = "".join(r.rendered for r in rs)
        assert [r.start for r in rs] == [text.index(r.rendered, r.start) for r in rs]
        masked = [text[r.mask_start : r.mask_end] for r in rs if r.mask_start is not None]
        assert all(m.endswith("<|im_end|>") for m in masked) and bool(masked)
        assert all((r.chat_role == "assistant") == (r.mask_start is not None) for r in rs)
    ann = "".join(r.rendered for r in views[1, "ann"])
    assert ann == "<|im_start|>system\nbe good<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<| im_end |><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert len(views[None, "ann"]) == 2 and [r.turn for r in views[2, "unknown"]] == [1, None]


def test_a_very_long_turn_and_clashing_columns(spark):
    turns = [(1, 0, "ann", "word " * 100_000), (1, 1, "bob", ""), (1, 1, "bob", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as _row", "2 as perspective", "3 as speaker", "4 as n_chars", "5 as position")
    got = [r for r in chat.rotate_perspectives(df).collect() if r.perspective == "ann"]
    assert sorted(r.position for r in got) == [0, 1, 2]
    assert max(r.n_chars for r in got) == 500_000 + len("<|im_start|>assistant\n<|im_end|>\n")


def test_a_component_of_many_blocks_with_texts_beside_its_main_group(spark, monkeypatch):
    import random

    rng = random.Random(6)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(60):  # copies with few edits, chains of revisions that drift away, and a second family half alike
        words = list(base)
        words[rng.randrange(60)] = f"e{i}"
        rows.append((i, " ".join(words), "en", "s", 0))
    drifting = list(base)
    for i in range(60, 100):
        at = rng.randrange(len(drifting))
        drifting[at] = f"d{i}"
        rows.append((i, " ".join(drifting), "en", "s", 0))
    for i in range(100, 130):
        words = base[:36] + [f"o{k}" for k in range(24)]
        words[rng.randrange(60)] = f"f{i}"
        rows.append((i, " ".join(words), "en", "s", 0))
    want = {i: min(rows[k][0] for k in c) for c in near_components(rows) for i in (rows[k][0] for k in c)}
    df = spark.createDataFrame(rows, SCHEMA)
    for most in (6_000_000, 900, 300):
        monkeypatch.setattr(minhash, "MAX_SHINGLES", most)
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == want


def test_prose_in_languages_without_a_reference_is_kept(spark):
    """Sentences made of words of languages that no reference lists; junk with the same words is rejected."""
    import random

    rng = random.Random(7)
    said = {
        "fi": "ja on ei se että hän oli mutta kun niin kuin myös sitten talvella järven rannalla vanha kalastaja katseli hiljaista vettä aamulla lapset juoksivat pihalla äiti keitti kahvia keittiössä metsässä lumi peitti polun illalla kaikki istuivat pöydän ääressä kertoivat tarinoita menneistä vuosista",
        "tr": "ve bir bu için çok ama gibi daha sonra kadar eski şehrin sokaklarında yürürken denizin kokusunu duydum annem mutfakta çay hazırlıyordu çocuklar bahçede oynuyorlardı akşam olunca herkes masanın etrafında oturdu geçmiş yıllardan hikayeler anlattılar güneş dağların arkasında yavaşça battı",
        "ru": "и в не на что он как это но когда потом старый рыбак смотрел на тихую воду утром дети бегали во дворе мать варила кофе на кухне зимой снег покрыл дорогу в лесу вечером все сидели за столом и рассказывали истории о прошлых годах",
        "el": "και το να είναι που στο για με από ο παλιός ψαράς κοίταζε το ήσυχο νερό το πρωί τα παιδιά έτρεχαν στην αυλή η μητέρα έφτιαχνε καφέ στην κουζίνα το βράδυ όλοι κάθονταν γύρω από το τραπέζι",
        "ko": "그리고 나는 그는 오래된 어부가 조용한 물을 바라보았다 아침에 아이들이 마당에서 뛰어놀았다 어머니는 부엌에서 커피를 끓였다 저녁에 모두가 식탁에 앉아 지난 이야기를 했다 겨울에는 눈이 숲길을 덮었다",
    }
    rows = []
    for k, words in said.items():
        for n in (30, 120, 400):
            text = " ".join(rng.choice(words.split()) + rng.choice(["", "", "", "", "", "", ",", "."]) for _ in range(n))
            rows += [(f"{k}{n}", text), (f"junk {k}{n}", " ".join(w + rng.choice(["%%%", "###", "$$$"]) for w in text.split()))]
    rows.append(("zh", " ".join("".join(chr(rng.randrange(0x4E00, 0x5200)) for _ in range(12)) + "。" for _ in range(120))))
    got = {r.doc_id: r for r in quality.quality_report(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert not any(r.base_failed for r in got.values())
    for k, r in got.items():
        if not k.startswith("junk"):
            assert r.kept, r
        elif not k.endswith("30"):
            assert not r.kept, r


def test_common_boilerplate_makes_no_work():
    """20,000 texts that share 60 per cent and have no group: their rarest shingles are their own, so time grows with their number."""
    import time

    import numpy as np

    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 180).astype(np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 2**63, 120).astype(np.uint64)])) for _ in range(20_000)]
    sets[19_999] = np.unique(np.append(sets[7][:-3], np.uint64(5)))
    began = time.process_time()
    got = minhash.linked_groups(sets)
    assert time.process_time() - began < 40
    assert got[19_999] == 7 and (got[:19_999] == np.arange(19_999)).all()


def test_linked_groups_by_rarest_shingles_are_those_of_full_sets():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(15):
        sets = [np.unique(rng.integers(0, 300, rng.integers(1, 60)).astype(np.uint64)) for _ in range(25)]
        for s in sets[:]:
            for _ in range(rng.integers(0, 5)):
                kept = rng.permutation(s)[rng.integers(0, len(s) // 4 + 1) :]
                if len(kept):
                    sets.append(np.unique(np.concatenate([kept, rng.integers(1000, 2000, rng.integers(0, len(s) // 6 + 1)).astype(np.uint64)])))
        assert len(sets) >= minhash.COMPARED_AT_ONCE and (minhash.linked_groups(sets) == minhash.reached_groups(sets)).all()


def test_large_components_of_boilerplate_equal_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(5)
    common = " ".join(f"c{i}" for i in range(70))
    rows = []
    for i in range(120):
        own = [f"o{i}x{k}" for k in range(45 if i % 3 else 20)]
        rows.append((i, f"{common} {' '.join(own)}", None, None, None))
        if i % 4 == 0:  # a chain of near copies, in another order of ids
            for step in range(rng.randrange(1, 4)):
                own[rng.randrange(len(own))] = f"e{i}y{step}"
                rows.append((1000 - i * 4 - step, f"{common} {' '.join(own)}", None, None, None))
    rng.shuffle(rows)
    monkeypatch.setattr(minhash, "MAX_SHINGLES", 1500)
    monkeypatch.setattr(minhash, "PART", 8)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {}
    for comp in near_components(rows):
        want |= {rows[i][0]: min(rows[j][0] for j in comp) for i in comp}
    assert got == want and len(set(want.values())) < len(rows)

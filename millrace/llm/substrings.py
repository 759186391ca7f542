"""Substring deduplication by level-wise doubling.

A window of 35 words can recur only if the shorter runs in it recur. At each
length (9, 18, then 35 words) every window that is still alive is stood for by
one run of that length, the one with the least hash; runs are counted over the
corpus, and only windows whose run recurs are extended to twice the length. Equal
windows choose the same run, so none that recurs is lost; and neighbouring
windows mostly share one, so the first lengths ship a few per cent of all
positions. At the last length the run is the window itself, and no longer one is
tried, as it could cover no more words. There two hashes of 64 bits
tell windows of different texts apart.

Copies of one text are collapsed first: every window of a text that occurs twice
recurs. Runs are counted with partial sums; only runs of documents still alive
travel, as pairs (hash, text key).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import flag_maybe_in, free_shuffles, materialize, maybe_in, read_table, ship_by_value, words
from millrace.llm.grams import gram_hashes, other_hashes, word_hashes

WINDOW = 35
#: Bits of the bitmap of recurring runs that spares shuffling the others.
RUN_BITS = 24


def lengths(window: int) -> tuple[int, ...]:
    """The window's length and its halves, shortest first: 35 gives 9, 18, 35."""
    half = -(-window // 2)
    return tuple(dict.fromkeys((-(-half // 2), half, window)))


def text_key(text: Column) -> Column:
    """96 bits of the text's md5, which stand for it in shuffles."""
    return F.unhex(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 24))


def chosen(h: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places): hashes of all runs, and for each window the place of the run that stands for it."""
    runs = gram_hashes(h, length)
    wide = window - length + 1
    if len(runs) < wide:
        return runs, np.empty(0, np.int64)
    at = np.lib.stride_tricks.sliding_window_view(runs, wide).argmin(axis=1) if wide > 1 else 0
    return runs, at + np.arange(len(runs) - wide + 1)


def alive(h: np.ndarray, length: int, window: int, recurring: np.ndarray) -> np.ndarray:
    """For each window, whether its run of this length is among the recurring."""
    runs, at = chosen(h, length, window)
    return np.isin(runs[at], recurring)


def _runs(level: int, sizes: tuple[int, ...]):
    """Batches of _key, text and, from the second level on, the recurring runs of the level before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, last = sizes[-1], level == len(sizes) - 1
        for batch in batches:
            which, hashes, others, times = [], [], [], []
            before = batch.column(2) if level else None
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                h = word_hashes((text or b"").split())
                if len(h) < window:
                    continue
                runs, at = chosen(h, sizes[level], window)
                if before is not None:
                    at = at[alive(h, sizes[level - 1], window, before[i].values.to_numpy().view(np.uint64))]
                places = np.unique(at)
                found, first, n = np.unique(runs[places], return_index=True, return_counts=True)
                which.append(np.full(len(found), i))
                hashes.append(found.view(np.int64))
                if last:
                    others.append((gram_hashes(other_hashes(h), window)[places[first]] if len(first) else found).view(np.int64))
                times.append(np.minimum(n, 2))
            rows = np.concatenate(which) if which else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(hashes) if which else rows, pa.int64()),
                    pa.array(np.concatenate(others) if others else np.zeros(len(rows), np.int64), pa.int64()),
                    pa.array(np.concatenate(times) if which else rows, pa.int64()),
                    batch.column(0).take(pa.array(rows)),
                ],
                ["hash", "other", "n", "_key"],
            )

    return run


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, texts = [], [], []
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                tokens = (text or b"").split()
                h = word_hashes(tokens)
                starts = alive(h, window, window, batch.column(2)[i].values.to_numpy().view(np.uint64))
                edges = np.zeros(len(tokens) + 1, np.int64)
                at = np.flatnonzero(starts)
                np.add.at(edges, at, 1)
                np.add.at(edges, at + window, -1)
                covered = np.cumsum(edges[:-1]) > 0
                kept = b" ".join(t for t, c in zip(tokens, covered.tolist(), strict=True) if not c)
                removed.append(int(covered.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], ["_key", "_removed", "_sha", "_kept"]
            )

    return run


def recurring(runs: DataFrame) -> DataFrame:
    """_key and the list of its runs that start at two places or more of the corpus."""
    again = materialize(runs.groupBy("hash", "other").agg(F.sum("n").alias("n")).filter("n > 1").select(F.col("hash").alias("_again"), F.col("other").alias("_too")), "substring-again")
    rows = maybe_in(runs, F.col("hash"), again, F.col("_again"), RUN_BITS)
    found = rows.join(again, (F.col("hash") == F.col("_again")) & (F.col("other") == F.col("_too"))).groupBy("_key").agg(F.collect_list("hash").alias("_runs"))
    return materialize(found, "substring-lists")


def distinct_texts(keyed: DataFrame, copied: DataFrame) -> DataFrame:
    """One row for each text; only rows that may have a copy are shuffled."""
    flagged = flag_maybe_in(keyed, F.col("_key"), copied, F.col("_copied"))
    once = flagged.filter("_maybe").groupBy("_key").agg(F.first("_text").alias("_text"))
    return flagged.filter("not _maybe").select("_key", "_text").unionByName(once)


def repeated_words(docs: DataFrame, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(lost, copied): _key, _removed, _sha and _kept (the words that stay) of each text that loses words; keys of texts with copies."""
    spark = docs.sparkSession
    keyed = docs.select(text_key(F.col(text_col)).alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    copied = materialize(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("_key").alias("_copied")), "substring-copied")
    sizes = lengths(window)
    texts, lists = distinct_texts(keyed, copied), None
    for level in range(len(sizes)):
        rows = texts if lists is None else texts.join(lists, "_key")
        runs = materialize(rows.mapInArrow(_runs(level, sizes), "hash long, other long, n long, _key binary"), f"substring-runs-{sizes[level]}")
        free_shuffles(spark)
        lists = recurring(runs)
        free_shuffles(spark)
        if level == 0:
            alive_keys = lists.select("_key")
            texts = materialize(maybe_in(keyed, F.col("_key"), alive_keys, F.col("_key")).groupBy("_key").agg(F.first("_text").alias("_text")).join(alive_keys, "_key", "left_semi"), "substring-texts")
            free_shuffles(spark)
    lost = texts.join(lists, "_key").mapInArrow(_remove(window), "_key binary, _removed long, _sha string, _kept string")
    return lost, copied


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: words, words removed, and the digest of the words kept, joined by one space.

    Windows are judged on the input: a window goes if its words also start
    anywhere else, overlapping places and repeated rows included. Texts with
    fewer words than a window lose nothing; null and blank texts have no words.
    Null and repeated ids are kept as they are; very long texts are read whole.
    Extra columns are ignored, whatever their names; an empty table gives an empty
    result. Equal texts are found by 96 bits of md5. Windows are told apart by 128
    bits between texts and by 64 within one, so among w windows of texts of n words
    one that doesn't recur is taken for one that does with a probability of
    w / 2**128 + n / 2**64. Both hashes are over 64-bit hashes of words: two words
    that share one matter only where windows agree in all others.
    """
    w = words(F.col(text_col))
    base = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("_key"), w.alias("_w")).select(
        "doc_id", "_key", F.size("_w").cast("long").alias("n_words"), F.sha2(F.array_join("_w", " ").cast("binary"), 256).alias("_all")
    )
    base = materialize(base, "substring-base")
    lost, copied = repeated_words(docs, text_col, window)
    lost = materialize(lost.select("_key", "_removed", "_sha"), "substring-lost").withColumnRenamed("_key", "_k")
    joined = base.join(lost, F.col("_key") == F.col("_k"), "left").join(copied, F.col("_key") == F.col("_copied"), "left")
    whole = F.col("_copied").isNotNull() & (F.col("n_words") >= window)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return joined.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, nothing).otherwise(F.coalesce("_sha", "_all")).alias("kept_sha256"),
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read_table(spark, sf_dir, "documents"))


ship_by_value(__name__)

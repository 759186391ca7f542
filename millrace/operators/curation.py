"""The curation funnel: ordered reject reasons, dedup and quotas, with every row accounted for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.taxonomy import classify
from millrace.operators.ranges import ranked
from millrace.session import written


@dataclass(frozen=True)
class Limits:
    """Thresholds of the funnel. The defaults."""

    old_lines: tuple[int, int] = (2, 18)
    changed_lines: int = 8
    comment_chars: tuple[int, int] = (20, 400)
    ascii_ratio: float = 0.95
    grounding: float = 0.10
    per_repo: int = 40
    per_comment: int = 3
    languages: tuple[str, ...] = ("py", "java", "go", "js", "php", "rb", "c", "cpp", ".cs")


def comment_reasons(trimmed: Column, lang: Column, limits: Limits, small: Column | None = None) -> list[tuple[str, Column]]:
    """The rules on a stripped comment alone, in order; `small` is the comment in small letters."""
    low, high = limits.comment_chars
    return [
        ("language_not_selected", ~F.coalesce(lang, F.lit("")).isin(list(limits.languages))),
        ("empty_comment", F.length(trimmed) == 0),
        ("comment_non_actionable", trimmed.rlike("(?iuU)" + T.NON_ACTIONABLE)),
        ("comment_references_outside_context", T.outside_context(trimmed, small)),
        ("comment_length", ~F.length(trimmed).between(low, high)),
        ("comment_not_ascii", T.ascii_ratio(trimmed) < limits.ascii_ratio),
    ]


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """The first reason that holds; null if none does."""
    found = None
    for name, holds in reasons:
        found = F.when(holds, name) if found is None else found.when(holds, name)
    return found


def with_reject_reason(raw: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """raw (old, new, comment, lang, repo) -> the example columns and reject_reason (null for survivors of the row-wise rules)."""
    texts = raw.select(
        "*",
        T.pytrim(F.coalesce("comment", F.lit(""))).alias("_comment"),
        T.strip_markers(F.coalesce("old", F.lit("")), "old").alias("old_code"),
        T.strip_markers(F.coalesce("new", F.lit("")), "new").alias("new_code"),
        T.changed_line_count(F.coalesce("old", F.lit("")), F.coalesce("new", F.lit(""))).alias("n_changed_lines"),
    )
    texts = texts.select("*", F.lower("_comment").alias("_low"), F.size(T.lines_of(F.col("old_code"))).alias("n_old_lines"), T.grounding(F.col("_comment"), F.col("old_code"), F.col("new_code")).alias("grounding"))
    low, high = limits.old_lines
    reasons = comment_reasons(F.col("_comment"), F.col("lang"), limits, F.col("_low")) + [
        ("no_actual_change", F.col("old_code") == F.col("new_code")),
        ("empty_side", (T.pytrim(F.col("old_code")) == "") | (T.pytrim(F.col("new_code")) == "")),
        ("hunk_length", ~F.col("n_old_lines").between(low, high)),
        ("change_too_large", ~F.col("n_changed_lines").between(1, limits.changed_lines)),
        ("ungrounded_change", F.col("grounding") < limits.grounding),
    ]
    digest = T.content_hash(F.col("old_code"), F.col("_comment"))
    return texts.select(
        "*", first_reason(reasons).alias("reject_reason"), digest.alias("hash"), T.norm_comment(F.col("_comment")).alias("comment_norm"), classify(F.col("_comment"), small=F.col("_low")).alias("category")
    )


def first_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; Spark trims each partition to one row a key before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_rank = 1").drop("_rank")


def within_quota(df: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= limit).drop("_rank")


def cascade(df: DataFrame, *, hash_col: str, repo_col: str, comment_col: str, order: list[str], per_repo: int, per_comment: int) -> DataFrame:
    """Dedup, then the quota per repository, then per comment, each as a window: the scalable form."""
    return within_quota(within_quota(first_wins(df, hash_col, order), [repo_col], order, per_repo), [comment_col], order, per_comment)


def cascade_verdicts(judged: DataFrame, *, hash_keys: list[str], repo_keys: list[str], comment_keys: list[str], order: list[str], per_repo: int, per_comment: int, reason: str = "reject_reason") -> DataFrame:
    """The cascade's verdict on every row: `reason` is filled with duplicate, repo_quota or comment_quota where it is null; survivors keep null."""
    rows = judged
    for keys, limit, name in ((hash_keys, 1, "duplicate"), (repo_keys, per_repo, "repo_quota"), (comment_keys, per_comment, "comment_quota")):
        rank = F.row_number().over(Window.partitionBy(F.col(reason).isNull(), *keys).orderBy(*order))
        rows = rows.withColumn("_rank", rank).withColumn(reason, F.when(F.col(reason).isNull() & (F.col("_rank") > limit), name).otherwise(F.col(reason))).drop("_rank")
    return rows


def top_rows(alive: DataFrame, key: str, limit: int) -> DataFrame:
    """at of the first `limit` rows of each key; Spark trims each partition to as many a key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("at"))
    return alive.select(key, "at").withColumn("_rank", rank).filter(F.col("_rank") <= limit).select("at")


def settled(waiting: DataFrame, kept: DataFrame, limits: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(newly kept, still waiting): one round over rows (at and the keys of `limits`).

    A row stays for sure if, for every key, it is among the first `limit` of the rows
    that are kept or waiting; whatever becomes of those before it, its key has room.
    A row goes for sure if a key has as many kept rows as its limit. The first
    waiting row is always one or the other.
    """
    tops = None
    for key, limit in limits.items():
        top = top_rows(kept.unionByName(waiting), key, limit)
        tops = top if tops is None else tops.unionByName(top)
    clear = tops.groupBy(F.col("at").alias("_at")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(limits)).select("_at")
    judged = written(waiting.join(clear, F.col("at") == F.col("_at"), "left").withColumn("stays", F.col("_at").isNotNull()).drop("_at"), "greedy-judged")
    stay = judged.filter("stays").drop("stays")
    now, left = kept.unionByName(stay), judged.filter("not stays").drop("stays")
    for key, limit in limits.items():
        full = now.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= limit).select("_k")
        left = left.join(full, F.col(key).eqNullSafe(F.col("_k")), "left_anti")
    return stay, left


def greedy(df: DataFrame, *, hash_col: str, repo_col: str, comment_col: str, order_col: str, per_repo: int, per_comment: int) -> DataFrame:
    """(order_key, verdict) of the exact sequential form: a row that one rule refuses uses up no other quota and claims no hash.

    The fold over all rows in order is worked out in rounds: each settles, in
    parallel, every row whose fate no waiting row can change, until none waits. A
    key's group is trimmed to its limit before it is shuffled, so a repository with
    a third of all rows is no task of its own. The number of rounds is that of the
    longest chain of rows that wait for each other, and no more than the rows. The
    rule that refused a row then follows from the rows that stay: the first whose
    limit they had reached before it. Order keys must differ; a null hash, repository
    or comment is a key like any other, and no rows give no rows.
    """
    limits = {"h": 1, "repo": per_repo, "comment": per_comment}
    names = {"h": "duplicate", "repo": "repo_quota", "comment": "comment_quota"}
    rows = written(df.select(F.col(order_col).cast("long").alias("at"), F.col(hash_col).alias("h"), F.col(repo_col).alias("repo"), F.col(comment_col).alias("comment")), "greedy-rows")
    if min(limits.values()) <= 0:
        first = next(k for k in limits if limits[k] <= 0)
        kept, before = rows.limit(0), names[first]
    else:
        kept, waiting, before = rows.limit(0), rows, None
        while not waiting.isEmpty():
            stay, left = settled(waiting, kept, limits)
            waiting = written(left, "greedy-waiting")
            kept = kept.unionByName(stay)
    told = rows
    for key, limit in limits.items():
        rank = F.row_number().over(Window.partitionBy(key).orderBy("at"))
        reached = kept.select(F.col(key).alias(f"_k_{key}"), F.col("at").alias(f"_at_{key}"), rank.alias("_rank")).filter(F.col("_rank") == limit).drop("_rank")
        told = told.join(reached, F.col(key).eqNullSafe(F.col(f"_k_{key}")), "left")
    reason = F.when(F.lit(before is not None), F.lit(before))
    for key in limits:
        reason = reason.when(F.col(f"_at_{key}") < F.col("at"), names[key])
    return told.select(F.col("at").alias("order_key"), reason.otherwise("").alias("verdict"))


def funnel_counts(df: DataFrame, keys: list[str], reason_col: str = "reject_reason") -> DataFrame:
    """Rows by reason and by each of `keys`, in one pass over grouping sets; `slice` says which."""
    columns = [reason_col, *keys]
    kept = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("kept" if c == reason_col else "unknown")).alias(c) for c in columns])
    sets = [[F.col(c)] for c in columns]
    grouped = kept.groupingSets(sets, *columns).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    # Bit i of the grouping id, from the left, is 0 for the column that was grouped by.
    ids = {(1 << len(columns)) - 1 - (1 << (len(columns) - 1 - i)): c for i, c in enumerate(columns)}
    named = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    return grouped.select(named[F.col("_g").cast("int")].alias("slice"), F.coalesce(*columns).alias("value"), "n")


def most_common(df: DataFrame, column: str, order: str) -> DataFrame:
    """value, n and rank by count, ties by first occurrence."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    return ranked(counts, "n", ["_first"], "rank", descending=True).select("value", "n", "rank")

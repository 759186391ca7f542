"""Scores of an edit against its gold revision, and the statistics over pairs."""

from __future__ import annotations

import ast
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from millrace.functions.text import code_tokens, lines_of, normalize_code

EPSILON = 1e-9


def edit_distance(a: str, b: str) -> int:
    """Exact Levenshtein distance in linear memory.

    While it is small against the texts, by the furthest place on each diagonal
    (Ukkonen 1985); beyond, by columns of the table as bit vectors (Hyyro 2003).
    """
    x, y = sorted((np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in (a, b)), key=len)
    n, m = len(x), len(y)
    # Ends that equal no character and not each other stop every run.
    xs, ys = np.append(x, np.uint32(2**32 - 1)), np.append(y, np.uint32(2**32 - 2))
    far = np.zeros(1, dtype=np.int64)
    for e in range(n // 8 + 2):
        low, high = max(-e, -n), min(e, m)
        if e:
            was = np.full(high - low + 3, -(n + m), dtype=np.int64)
            was[old_low - low + 1 : old_low - low + 1 + len(far)] = far
            far = np.maximum(np.maximum(was[1:-1], was[2:]) + 1, was[:-2])
        k = np.arange(low, high + 1)
        np.minimum(far, np.minimum(n, m - k), out=far)
        run = np.arange(len(far))
        for _ in range(8):
            run = run[xs[far[run]] == ys[far[run] + k[run]]]
            if not len(run):
                break
            far[run] += 1
        for r in run.tolist():
            shift, i, size = low + r, int(far[r]), 64
            end = min(n, m - shift)
            while i < end:
                differ = xs[i : min(i + size, end)] != ys[i + shift : min(i + size, end) + shift]
                if differ.any():
                    i += int(differ.argmax())
                    break
                i, size = i + len(differ), size * 2
            far[r] = i
        if low <= m - n <= high and far[m - n - low] >= n:
            return e
        old_low = low
    return bit_distance(x, y)


def bit_distance(x: np.ndarray, y: np.ndarray) -> int:
    m = len(x)
    if not m:
        return len(y)
    at = {int(c): int.from_bytes(np.packbits(x == c, bitorder="little").tobytes(), "little") for c in np.unique(x)}
    full, last = (1 << m) - 1, m - 1
    up, down, score = full, 0, m
    for c in y.tolist():
        equal = at.get(c, 0)
        diagonal = ((((equal & up) + up) ^ up) | equal | down) & full
        right_up = down | (full ^ (diagonal | up))
        right_down = diagonal & up
        score += (right_up >> last) - (right_down >> last)
        right_up = ((right_up << 1) | 1) & full
        up = ((right_down << 1) & full) | (full ^ (diagonal | right_up))
        down = right_up & diagonal
    return score


COUNTED = StructType([StructField(k, IntegerType()) for k in ("pred_gold", "old_gold", "overlap")])


@F.arrow_udf(COUNTED)
def counted(pred: pa.Array, gold: pa.Array, old: pa.Array, pred_tokens: pa.Array, gold_tokens: pa.Array) -> pa.Array:
    """Both distances and the tokens in common; the built-in forms take quadratic time and are for snippets.

    Tokens come as one text, a space between two. Texts stay in Arrow's memory and
    become Python's a row at a time, so that a batch takes the bytes of its texts.
    """

    def row(p: str | None, g: str | None, o: str | None, s: str | None, t: str | None) -> tuple[int | None, int | None, int | None]:
        known = p is not None and g is not None
        bags = (Counter(x.split(" ") if x else ()) for x in (s, t))
        return edit_distance(p, g) if known else None, edit_distance(o, g) if o is not None and g is not None else None, (next(bags) & next(bags)).total() if known else None

    rows = [row(*[x.as_py() for x in texts]) for texts in zip(pred, gold, old, pred_tokens, gold_tokens, strict=True)]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int32()) for i in range(3)], names=["pred_gold", "old_gold", "overlap"])


def norm_distance(a: Column, b: Column, distance: Column | None = None) -> Column:
    """Levenshtein distance over the longer length; two empty texts are equal."""
    return (F.levenshtein(a, b) if distance is None else distance) / F.greatest(F.length(a), F.length(b), F.lit(1))


def bag_overlap(p: Column, g: Column) -> Column:
    """Size of the multiset intersection of two arrays.

    Both are sorted, and each value counts as often as the rarer side has it.
    """
    common = F.array_intersect(p, g)
    return F.aggregate(common, F.lit(0), lambda n, x: n + F.least(F.size(p) - F.size(F.array_remove(p, x)), F.size(g) - F.size(F.array_remove(g, x))))


def f1(hit: Column, n_pred: Column, n_gold: Column) -> Column:
    precision, recall = hit / F.greatest(n_pred, F.lit(1)), hit / F.greatest(n_gold, F.lit(1))
    return F.when(hit == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def token_f1(pred_tokens: Column, gold_tokens: Column) -> Column:
    """F1 of two arrays of tokens; give them as columns, so that the overlap's lambda doesn't tokenize again for each element."""
    return f1(bag_overlap(pred_tokens, gold_tokens), F.size(pred_tokens), F.size(gold_tokens))


def line_edit_f1(old: Column, pred: Column, gold: Column) -> Column:
    """F1 over the lines that the gold revision and the prediction add or remove."""
    o, p, g = (F.array_distinct(lines_of(c)) for c in (old, pred, gold))
    gold_edit, pred_edit = (F.concat(F.array_except(x, o), F.array_except(o, x)) for x in (g, p))
    hit = F.size(F.array_intersect(gold_edit, pred_edit))
    return F.when(F.size(gold_edit) == 0, F.when(F.size(pred_edit) == 0, 1.0).otherwise(0.0)).otherwise(f1(hit, F.size(pred_edit), F.size(gold_edit)))


@F.arrow_udf(BooleanType())
def parses(codes: pa.Array) -> pa.Array:
    """Whether a text parses as Python; no built-in function can tell."""

    def ok(code: str | None) -> bool:
        try:
            ast.parse(code or "")
            return True
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            return False

    return pa.array([ok(code.as_py()) for code in codes], pa.bool_())


def syntax_ok(old: Column, pred: Column, lang: Column) -> Column:
    """Null unless the language is Python and the original parsed; texts of other languages are not given to the parser."""
    python = lang == "py"
    return F.when(python & parses(F.when(python, old)), parses(F.when(python, pred)))


def score_columns(pred: Column, gold: Column, old: Column, to_gold: Column, from_old: Column, tokens: Column, syntax: Column) -> dict[str, Column]:
    """The eleven scores over normalised texts, from columns that hold the distances, the F1 of tokens and the syntax flag."""
    return {
        "exact_match": pred == gold,
        "token_f1": tokens,
        "edit_sim": 1.0 - to_gold,
        "dist_pred_gold": to_gold,
        "dist_old_gold": from_old,
        "delta_to_gold": from_old - to_gold,
        "improved": to_gold < from_old - F.lit(EPSILON),
        "regressed": to_gold > from_old + F.lit(EPSILON),
        "copied": pred == old,
        "syntax_ok": syntax,
        "changed_right_lines": line_edit_f1(old, pred, gold),
    }


def with_scores(df: DataFrame, pred: str = "prediction", gold: str = "gold", old: str = "old_code", lang: str = "lang") -> DataFrame:
    """Adds the score columns to a DataFrame of predictions; each distance is computed once for a row."""
    texts = df.select("*", *[normalize_code(F.col(c)).alias(k) for c, k in ((pred, "_p"), (gold, "_g"), (old, "_o"))])
    # Tokens are columns, so that the overlap's lambda reads them instead of matching the pattern for every element.
    texts = texts.select("*", code_tokens(F.col("_p")).alias("_tp"), code_tokens(F.col("_g")).alias("_tg"))
    # All that Python finds out is in one projection, so that one process does it for a task.
    found = syntax_ok(F.col("_o"), F.col("_p"), F.coalesce(F.col(lang), F.lit("")) if lang in df.columns else F.lit(""))
    texts = texts.select("*", counted("_p", "_g", "_o", F.array_join("_tp", " "), F.array_join("_tg", " ")).alias("_c"), found.alias("_ok"))
    texts = texts.select(
        "*",
        norm_distance(F.col("_p"), F.col("_g"), F.col("_c.pred_gold")).alias("_pg"),
        norm_distance(F.col("_o"), F.col("_g"), F.col("_c.old_gold")).alias("_og"),
        f1(F.col("_c.overlap"), F.size("_tp"), F.size("_tg")).alias("_f1"),
    )
    scores = score_columns(*[F.col(c) for c in ("_p", "_g", "_o", "_pg", "_og", "_f1", "_ok")])
    return texts.select(*df.columns, *[c.alias(k) for k, c in scores.items()])


def attach_scores(df: DataFrame, **names: str) -> DataFrame:
    """Adds `scores`, the struct of nine scores that a table of predictions carries, similarities to 4 places."""
    scored = with_scores(df, **names)
    plain, rounded = ("exact_match", "improved", "regressed", "copied"), {"edit_sim": "edit_sim", "delta_to_gold": "delta_to_gold", "edit_line_f1": "changed_right_lines", "token_f1": "token_f1"}
    fields = [F.col(c) for c in plain] + [F.round(c, 4).alias(k) for k, c in rounded.items()] + [F.col("syntax_ok")]
    return scored.select(*df.columns, F.struct(*fields).alias("scores"))


def mcnemar_p(fixed: Column, broken: Column) -> Column:
    """Exact two-sided p of discordant counts: twice the binomial tail at a half, at most 1.

    The terms follow from each other; where 0.5 ** n would underflow they are
    summed as exponentials of log terms instead.
    """
    n = (fixed + broken).cast("int")
    k = F.least(fixed, broken).cast("int")
    zero = F.struct(F.pow(F.lit(0.5), n).alias("term"), F.lit(0.0).alias("sum"))
    direct = F.aggregate(F.sequence(F.lit(0), k), zero, lambda a, i: F.struct((a["term"] * (n - i) / (i + 1)).alias("term"), (a["sum"] + a["term"]).alias("sum")))["sum"]
    log0 = F.struct((n * F.log(F.lit(0.5))).alias("term"), F.lit(0.0).alias("sum"))
    logs = F.aggregate(
        F.sequence(F.lit(0), k), log0, lambda a, i: F.struct((a["term"] + F.when(i < n, F.log((n - i) / (i + 1))).otherwise(0.0)).alias("term"), (a["sum"] + F.exp(a["term"])).alias("sum"))
    )["sum"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * F.when(n <= 1000, direct).otherwise(logs)))


def outcome(base_exact: Column, tuned_exact: Column, delta_sim: Column, band: float = 0.02) -> Column:
    """win, loss or tie: a flip of the exact match first, then the similarity beyond the band."""
    return (
        F.when(tuned_exact & ~base_exact, "win").when(base_exact & ~tuned_exact, "loss").when(delta_sim > band, "win").when(delta_sim < -band, "loss").otherwise("tie")
    )

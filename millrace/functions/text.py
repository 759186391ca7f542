"""Text functions, Column to Column, with the semantics of Unicode-aware string processing.

Java's regular expressions need flags for that: (?U) for Unicode classes and word
borders, (?iu) for caseless matching beyond ASCII, \\z for the very end.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and fence tags of languages by extension.
LANG_NAMES = {"py": "Python", "java": "Java", "go": "Go", "js": "JavaScript", "php": "PHP", "rb": "Ruby", "c": "C", "cpp": "C++", ".cs": "C#", "cs": "C#"}
LANG_FENCES = {"py": "python", "java": "java", "go": "go", "js": "javascript", "php": "php", "rb": "ruby", "c": "c", "cpp": "cpp", ".cs": "csharp", "cs": "csharp"}
# Patterns of comments that ask for nothing, or point outside the snippet.
NON_ACTIONABLE = r"^\s*(lgtm|nice|thanks?|thx|ok(ay)?|done|\+1|good catch|agreed|sgtm|ack|👍|:\+1:)[\s.!]*$"
OUTSIDE_CONTEXT = (
    r"\bas discussed\b|\bas (we|you) (said|mentioned|agreed)\b|\bsee (above|below|the )"
    r"|\bditto\b|\bsame (as|here|comment)\b|\bper (our|the) (chat|discussion|convo)"
    r"|\boffline\b|\bsee #\d+|\bthis pr\b|\bprevious (comment|review)\b|\brefer to\b"
    r"|\bmentioned (above|earlier|before)\b"
)
# Words that every match of the pattern above holds one of, in small letters, and characters whose small
# letters are no ASCII although they match one.
OUTSIDE_KEYWORDS = ("as discussed", "as we ", "as you ", "see above", "see below", "see the ", "see #", "ditto", "same as", "same here", "same comment", "per our ", "per the ", "offline", "this pr", "previous comment", "previous review", "refer to", "mentioned ")
FOLDED = ("\u017f", "\u212a", "\u0130", "\u0131")
# Unicode's white space, the separators of ASCII among it.
STRIPPED = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# What a token, a name, a fenced block and a preamble are; results depend on them.
CODE_TOKEN = r"[A-Za-z_]\w*|\d+\.\d+|\d+|[^\sA-Za-z0-9_]"
NAME_TOKEN = r"[A-Za-z_][A-Za-z0-9_]{2,}"
FENCED = r"(?ds)```[a-zA-Z0-9_+#.-]*\n(.*?)(?:\n```|\z)"
PREAMBLE = r"(?iuU)^\s*(here(?:'s| is)[^\n:]*:|revised code:|sure[,!][^\n]*|certainly[,!][^\n]*)\s*"


def pytrim(c: Column) -> Column:
    """Strip Unicode white space at both ends."""
    return F.btrim(c, F.lit(STRIPPED))


def outside_context(c: Column, low: Column | None = None) -> Column:
    """Whether a comment points outside its snippet; the pattern is tried only where one of its keywords stands. `low` is the comment in small letters."""
    low = F.lower(c) if low is None else low
    may = reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in OUTSIDE_KEYWORDS] + [F.contains(c, F.lit(x)) for x in FOLDED])
    return F.when(may, c.rlike("(?iuU)" + OUTSIDE_CONTEXT)).otherwise(F.when(c.isNotNull(), False))


def lines_of(c: Column) -> Column:
    return F.split(c, "\n", -1)


def ascii_ratio(c: Column) -> Column:
    """Share of code points below 128; 0 for an empty text."""
    n = F.length(c)
    return F.when(n > 0, F.length(F.regexp_replace(c, r"[^\x00-\x7F]", "")) / n).otherwise(0.0)


def norm_comment(c: Column) -> Column:
    """Without addresses, white space collapsed and stripped, lower case."""
    return F.lower(pytrim(F.regexp_replace(F.regexp_replace(c, r"(?U)https?://\S+", ""), r"(?U)\s+", " ")))


def content_hash(code: Column, comment: Column) -> Column:
    """sha1 of the code with white space collapsed, a double pipe, and the normalised comment."""
    return F.sha1(F.concat(F.regexp_replace(code, r"(?U)\s+", " "), F.lit("||"), norm_comment(comment)))


def short_id(digest: Column) -> Column:
    return F.substring(digest, 1, 16)


def strip_markers(diff: Column, side: str) -> Column:
    """One side of a unified hunk: markers of that side go, lines of the other side and pseudo-lines too."""
    other = "+" if side == "old" else "-"
    kept = F.filter(lines_of(diff), lambda line: ~line.startswith("\\") & ~line.startswith(other))
    own = "-" if side == "old" else "+"
    return F.array_join(F.transform(kept, lambda line: F.when(line.startswith(" ") | line.startswith(own), F.substr(line, F.lit(2))).otherwise(line)), "\n")


def changed_line_count(old_raw: Column, new_raw: Column) -> Column:
    return F.size(F.filter(lines_of(old_raw), lambda line: line.startswith("-"))) + F.size(F.filter(lines_of(new_raw), lambda line: line.startswith("+")))


def names_in(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(NAME_TOKEN), 0))


def grounding(comment: Column, old: Column, new: Column) -> Column:
    """How well a comment predicts the change, 0 to 1: names in backticks, and overlap with added and removed names."""
    old_names, new_names, said = names_in(old), names_in(new), names_in(comment)
    spans = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(comment, F.lit("`([^`]+)`"), 1), lambda s: F.regexp_extract_all(s, F.lit(NAME_TOKEN), 0))))
    added, removed = F.array_except(new_names, old_names), F.array_except(old_names, new_names)

    def share(found: Column) -> Column:
        return F.size(F.array_intersect(said, found)) / F.greatest(F.lit(1), F.least(F.size(found), F.lit(8)))

    span = F.when(F.arrays_overlap(spans, added), 1.0).when(F.arrays_overlap(spans, F.concat(added, removed)), 0.5).otherwise(0.0)
    return F.least(F.lit(1.0), F.lit(0.5) * span + F.lit(0.35) * F.least(F.lit(1.0), share(added)) + F.lit(0.15) * F.least(F.lit(1.0), share(removed)))


def normalize_code(c: Column) -> Column:
    """Line ends to \\n, right-stripped lines, no blank lines at the edges; indentation stays."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"(?dmU)[^\S\n]+$", "")
    return F.regexp_replace(F.regexp_replace(c, r"\A\n+", ""), r"\n+\z", "")


def strip_blank_edges(c: Column) -> Column:
    """Without wholly blank lines at the edges; nothing inside a line changes."""
    head = F.regexp_replace(c, r"(?dU)\A(?:[^\S\n]*\n)+", "")
    return F.when(pytrim(c) == "", "").otherwise(F.regexp_replace(head, r"(?dU)(?:\n[^\S\n]*)+\z", ""))


def code_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?U)" + CODE_TOKEN), 0)


def token_text(c: Column) -> Column:
    return F.array_join(code_tokens(c), " ")


def parse_generation(c: Column) -> Column:
    """struct(code, how): the first fenced block, else the text without a preamble."""
    bare = strip_blank_edges(F.regexp_replace(c, PREAMBLE, ""))
    fenced = c.rlike(FENCED)
    closed = F.regexp_extract(c, FENCED, 0).rlike(r"(?U)```\s*\z")
    blank = c.isNull() | (c == "") | (~fenced & (pytrim(bare) == ""))
    code = F.when(blank, "").when(fenced, strip_blank_edges(F.regexp_extract(c, FENCED, 1))).otherwise(bare)
    how = F.when(blank, "empty").when(fenced & closed, "fenced").when(fenced, "fenced_unterminated").otherwise("raw")
    return F.struct(code.alias("code"), how.alias("how"))


def strip_fence(c: Column) -> Column:
    body = r"(?ds)```[a-zA-Z]*\n(.*?)```"
    return F.when(c.rlike(body), pytrim(F.regexp_extract(c, body, 1))).otherwise(c)


def _looked_up(table: dict[str, str], key: Column, default: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for x in chain(*table.items())])[key], default)


def lang_name(c: Column) -> Column:
    return _looked_up(LANG_NAMES, c, c)


def lang_fence(c: Column) -> Column:
    return _looked_up(LANG_FENCES, c, F.lit(""))


#: The system turn of training and evaluation.
SYSTEM = "You apply review comments to code."


def user_prompt(old: Column, comment: Column, lang: Column) -> Column:
    fence = lang_fence(lang)
    return F.concat(F.lit("A reviewer left this note on "), lang_name(lang), F.lit(" code:\n> "), pytrim(comment), F.lit("\n\nSnippet:\n```"), fence, F.lit("\n"), old, F.lit("\n```\n\nRewrite the snippet so that it does what the note asks."))


def target_turn(new: Column, lang: Column) -> Column:
    return F.concat(F.lit("```"), lang_fence(lang), F.lit("\n"), new, F.lit("\n```"))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def training_messages(system: str, old: Column, comment: Column, new: Column, lang: Column) -> Column:
    return F.array(message("system", F.lit(system)), message("user", user_prompt(old, comment, lang)), message("assistant", target_turn(new, lang)))


def fold_system(messages: Column) -> Column:
    """For templates without a system role: its text goes before the first user turn."""
    system = F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: m["content"]), "\n\n")
    rest = F.filter(messages, lambda m: m["role"] != "system")
    first = F.array_position(F.transform(rest, lambda m: m["role"]), "user") - 1
    return F.transform(rest, lambda m, i: F.when((i == first) & (system != ""), F.struct(m["role"].alias("role"), F.concat(system, F.lit("\n\n"), m["content"]).alias("content"))).otherwise(m))


def changed_input(old: Column, new: Column) -> Column:
    """Whether an answer differs from what it was given, but for white space at the ends."""
    return pytrim(old) != pytrim(new)


def variant_of(model: Column) -> Column:
    """base or tuned, by whether a model's name says base."""
    return F.when(F.contains(F.lower(model), F.lit("base")), "base").otherwise("tuned")


def contains_run(ids: Column, run: Column) -> Column:
    """Whether an array holds another as a contiguous run."""
    m = F.size(run)
    return (m == 0) | ((F.size(ids) >= m) & F.exists(F.sequence(F.lit(1), F.greatest(F.size(ids) - m + 1, F.lit(1))), lambda i: F.slice(ids, i, m) == run))


def response_template(rendered: Column, answer: str, question: str) -> Column:
    """What stands between the user's text and the answer in a rendered probe, right-stripped."""
    before = F.substring_index(rendered, answer, 1)
    return F.regexp_replace(F.substring_index(before, question, -1), r"(?U)\s+\z", "")

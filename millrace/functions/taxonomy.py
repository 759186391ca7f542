"""Review-comment categories: an ordered rule table turned into one CASE expression."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (label, pattern), first match wins; the order is part of the meaning.
RULES = [
    ("suggested_edit", r"```suggestion"),
    ("typo_or_docs", r"\btypos?\b|\bspell(ing|ed)?\b|\bgrammar\b|\bmisspell|\bcomment (here|says|should)|\bdocstring\b|\bjavadoc\b|\bdocs?\b\s|\bwording\b|\bcapitali[sz]"),
    ("null_check", r"\bnull\b|\bnil\b|\bNone\b|\bnullptr\b|\bnpe\b|null[- ]?check|\bisset\b|\bundefined\b|\bexists?\b.*\bcheck\b|\bcheck\b.*\bexists?\b"),
    ("error_handling", r"\berror\b|\bexception\b|\bexcept\b|\braise\b|\bthrow(s|n)?\b|\bpanic\b|\btry\b|\bcatch\b|\bfail(ure|s)?\b|\bhandle\b.*\berr|\berr\b|\blog\b.*\berror"),
    (
        "naming",
        r"\bnam(e|ing|ed)\b|\brename\b|\bcall(ed|ing) it\b|\bbetter name\b|\bvariable name\b|\bmethod name\b|\bfunction name\b|\bmisleading name\b|\bcamel[ -]?case\b|\bsnake[ -]?case\b",
    ),
    (
        "simplification",
        r"\bsimplif|\bredundant\b|\bunnecessary\b|\bnot needed\b|\bremove\b|\bdead code\b|\bduplicat|\bextract\b|\brefactor\b|\binline\b|\bcan be\b.*\bshorter\b|\bone[- ]liner\b|\bdrop\b.*\bthis\b|\bno need\b",
    ),
    ("api_usage", r"\buse\b|\bprefer\b|\binstead of\b|\bshould (be|use|call)\b|\breplace\b|\bswitch to\b|\bthere('s| is) (a|an)\b.*\b(helper|method|function|util)|\bdeprecat"),
    (
        "logic_bug",
        r"\boff[- ]by[- ]one\b|\bshould be\b.*[<>=]|\bwrong\b|\bincorrect\b|\bbug\b|\bbroken\b|\bcondition\b|\bboundary\b|\bedge case\b|\brace\b|\bdeadlock\b|\bleak\b|\b(>=|<=|!=|==)\b|\breversed\b|\binverted\b",
    ),
    ("performance", r"\bperformance\b|\bslow\b|\befficien|\bO\(n|\bcache\b|\ballocat|\bcopy\b.*\bavoid|\bexpensive\b|\bloop\b.*\bevery\b|\bn\+1\b"),
    ("security", r"\bsecurity\b|\binjection\b|\bsanitiz|\bescape\b|\bxss\b|\bcsrf\b|\bauth\b|\bsecret\b|\bpassword\b|\btoken\b.*\blog|\bvalidate\b.*\binput\b|\bpermission\b"),
    ("testing", r"\btests?\b|\bunit test\b|\bassert\b|\bmock\b|\bcoverage\b|\bfixture\b"),
    ("style_format", r"\bstyle\b|\bformat(ting)?\b|\bindent|\bwhitespace\b|\bblank line\b|\bnewline\b|\blint\b|\bspaces?\b|\btabs?\b|\bbrace\b|\bsemicolon\b|\bimport order\b|\bnit\b"),
    (
        "design_question",
        r"^\s*(why|what|how|should(n't)?|shouldn|could|can|would|do|does|did|is|are|any reason)\b|\?\s*$|\bi wonder\b|\bwondering\b|\bthoughts\?|\bwdyt\b",
    ),
]
OTHER = "other"
HARD = ("design_question", "logic_bug", "performance", "security", "other")
_FLAGS = "(?iuUd)"


# By label, words in small letters of which every match of the rule of RULES holds one; before a word stands no
# letter, digit or underscore, and after a word with `|` neither.
KEYWORDS = {
    "suggested_edit": (),
    "typo_or_docs": ("typo", "spell|", "spelling|", "spelled|", "grammar|", "misspell", "comment here", "comment says", "comment should", "docstring|", "javadoc|", "doc|", "docs|", "wording|", "capitalis", "capitaliz"),
    "null_check": ("null|", "nil|", "none|", "nullptr|", "npe|", "isset|", "undefined|", "check|"),
    "error_handling": ("error|", "exception|", "except|", "raise|", "throw|", "throws|", "thrown|", "panic|", "try|", "catch|", "fail|", "fails|", "failure|", "handle|", "err|", "log|"),
    "naming": ("name|", "naming|", "named|", "rename|", "call it|", "called it|", "calling it|", "better name|", "variable name|", "method name|", "function name|", "misleading name|", "camel", "snake"),
    "simplification": ("simplif", "redundant|", "unnecessary|", "not needed|", "remove|", "dead code|", "duplicat", "extract|", "refactor|", "inline|", "shorter|", "one-liner|", "one liner|", "drop|", "no need|"),
    "api_usage": ("use|", "prefer|", "instead of|", "should be|", "should use|", "should call|", "replace|", "switch to|", "there's a", "there is a", "deprecat"),
    "logic_bug": ("off-by", "off by", "should be|", "wrong|", "incorrect|", "bug|", "broken|", "condition|", "boundary|", "edge case|", "race|", "deadlock|", "leak|", "reversed|", "inverted|"),
    "performance": ("performance|", "slow|", "efficien", "o(n", "cache|", "allocat", "copy|", "expensive|", "loop|", "n+1|"),
    "security": ("security|", "injection|", "sanitiz", "escape|", "xss|", "csrf|", "auth|", "secret|", "password|", "token|", "validate|", "permission|"),
    "testing": ("test|", "tests|", "unit test|", "assert|", "mock|", "coverage|", "fixture|"),
    "style_format": ("style|", "format|", "formatting|", "indent", "whitespace|", "blank line|", "newline|", "lint|", "space|", "spaces|", "tab|", "tabs|", "brace|", "semicolon|", "import order|", "nit|"),
    "design_question": ("i wonder|", "wondering|", "thoughts?", "wdyt|"),
}
#: The same, wherever they stand; and how a match can begin a comment.
ANYWHERE = {"suggested_edit": ("```suggestion",), "null_check": ("nullcheck", "null-check", "null check"), "logic_bug": (">=", "<=", "!=", "=="), "design_question": ("?",)}
BEGINNING = {"design_question": RULES[-1][1].partition(r"\b")[0] + r"\b"}
#: In a text in small letters: characters of FOLDED, or what they become, that match a letter of ASCII.
ODD = "[\u017f\u0131\u0307]"


def _one_of(words: Iterable[str]) -> str:
    """A pattern of any of the words, as a tree of letters, so that a place is tried letter by letter and not word by word."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:])
    tails = {h: "" if "" in rest else _one_of(rest) for h, rest in heads.items()}  # a word that ends here stands for the longer ones
    return "(?:" + "|".join(("(?![a-z0-9_])" if h == "|" else re.escape(h)) + tails[h] for h in sorted(heads)) + ")"


def _may(comment: Column, low: Column, labels: Iterable[str]) -> Column:
    """Whether one of the rules of RULES can match: far cheaper than they are, and true wherever one does."""
    words, marks = ([w for k in labels for w in of.get(k, ())] for of in (KEYWORDS, ANYWHERE))
    tried = (["(?<![a-z0-9_])" + _one_of(words)] if words else []) + ([_one_of(marks)] if marks else []) + [ODD]
    found = low.rlike("|".join(tried))
    for k in labels:
        found = found | comment.rlike(_FLAGS + BEGINNING[k]) if k in BEGINNING else found
    return found


def classify(comment: Column, rules: list[tuple[str, str]] | None = None, small: Column | None = None) -> Column:
    """The label of the first rule that matches, else `other`; `small` is the comment in small letters, as a column that is computed once."""
    low, found = F.lower(comment) if small is None else small, None
    for label, pattern in rules or RULES:
        hit = comment.rlike(_FLAGS + pattern)
        hit = hit if rules else _may(comment, low, [label]) & hit
        found = F.when(hit, label) if found is None else found.when(hit, label)
    found = found.otherwise(OTHER)
    return found if rules else F.when(_may(comment, low, list(KEYWORDS)), found).otherwise(OTHER)


def classify_all(comment: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """Labels of all rules that match, else [other]."""
    hits = F.array_compact(F.array(*[F.when(comment.rlike(_FLAGS + p), label) for label, p in rules or RULES]))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(OTHER)))


def hardness(grounding: Column, changed: Column, category: Column) -> Column:
    """0.5 for weak grounding, 0.2 for size, 0.3 for categories whose comments imply the change."""
    size = F.least(F.lit(1.0), F.coalesce(F.when(changed != 0, changed), F.lit(1)) / F.lit(6.0))
    weak = F.coalesce(1.0 - grounding, F.lit(0.5))
    return F.lit(0.5) * weak + F.lit(0.2) * size + F.when(category.isin(list(HARD)), 0.3).otherwise(0.0)

"""License rules: gates, spellings, base columns and containment against brute force."""

import random
import re
import re._parser as parser
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from helpers import SCHEMA, awkward_rows  # noqa: E402

from millrace.llm import licenses  # noqa: E402


def sample(rng: random.Random, tree) -> str:
    """A text that the parsed pattern matches, with chance choices."""
    out = []
    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            out.append(chr(value))
        elif name == "NOT_LITERAL":
            out.append("q")
        elif name == "IN":
            kind, x = rng.choice([v for v in value if str(v[0]) == "LITERAL"] or [("", ord("q"))])
            out.append("q" if str(value[0][0]) == "NEGATE" else chr(x))
        elif name == "BRANCH":
            out.append(sample(rng, rng.choice(value[1])))
        elif name == "SUBPATTERN":
            out.append(sample(rng, value[3]))
        elif name == "MAX_REPEAT":
            low, high, inner = value
            out += [sample(rng, inner) for _ in range(rng.randint(low, min(high, low + 3)))]
        else:
            raise AssertionError(name)
    return "".join(out)


def test_gates_admit_every_spelling_of_their_pattern():
    rng = random.Random(3)
    for _, label, gate, pattern in licenses.RULES:
        for _ in range(60):
            text = sample(rng, parser.parse(pattern))
            assert re.fullmatch(pattern, text) and gate in text, (label, gate, text)
            assert len(text.split()) < licenses.LONGEST


def found(text: str) -> set[str]:
    gated: dict[bytes, list] = {}
    for rule in licenses.rules():
        gated.setdefault(rule[3], []).append(rule)
    return set(licenses.scan(text.encode(), gated)[5].split(",")) - {""}


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("BSD 3-Clause License", {"bsd-3-clause"}),
        ("the 2-clause BSD license", {"bsd-2-clause"}),
        ("GNU GPL v3", {"gpl-3.0"}),
        ("GPLv2", {"gpl-2.0"}),
        ("Creative Commons Attribution Share Alike 4.0", {"cc-by-sa"}),
        ("Creative Commons Attribution-ShareAlike", {"cc-by-sa"}),
        ("Creative Commons Attribution Non-Commercial", {"cc-by-nc"}),
        ("CC BY-NC-SA 4.0", {"cc-by-nc-sa"}),
        ("Creative Commons Attribution 4.0", {"cc-by-4.0"}),
        ("SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2.0-or-later"}),
        ("GNU Lesser General Public License, version 2.1", {"lgpl-2.1", "gpl"}),
        ("https://www.apache.org/licenses/LICENSE-2.0", {"apache-2.0"}),
        ("released under the MIT License", {"mit"}),
        ("see https://opensource.org/licenses/MIT", {"mit"}),
        ("Mozilla Public License 2.0", {"mpl-2.0"}),
        ("GNU Lesser General Public License v2.1", {"lgpl-2.1", "gpl"}),
        ("GNU Lesser General Public License v3 or later", {"lgpl-3.0-or-later", "gpl"}),
        ("GNU Affero General Public License v3", {"agpl-3.0", "gpl"}),
        ("distributed under the MIT campus rules", set()),
        ("licensed under MIT.", {"mit"}),
        ("Apache-2.0", {"apache-2.0"}),
        ("GPL-2.0-only", {"gpl-2.0-only"}),
        ("GPL-3.0+", {"gpl-3.0"}),
        ("LGPL-2.1-or-later", {"lgpl-2.1-or-later"}),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", {"mit", "apache-2.0"}),
        ("SPDX-License-Identifier: Apache-2.0 OR MIT", {"mit", "apache-2.0"}),
        ("SPDX-License-Identifier: GPL-2.0-only AND MIT", {"mit", "gpl-2.0-only"}),
        ("(Apache-2.0 OR MIT)", {"mit", "apache-2.0"}),
        ("a general public with no license, an apache helicopter, and a summit", set()),
    ],
)
def test_spellings(text, labels):
    assert found(text) == labels


def test_base_columns_and_containment(spark):
    rng = random.Random(8)
    parts = ["MIT", "license", "Apache License", "general public license", "GPL v3", "x", "émit license", "BSD 3-Clause License", "the", "all rights reserved", "SPDX-License-Identifier: MIT", "mit-license"]
    rows = awkward_rows() + [(1000 + i, " ".join(rng.choice(parts) for _ in range(rng.randrange(40))), "en", "s", 0) for i in range(60)] + [(2000, "mit license " * 5000, "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as labels", "2 as score", "3 as n_words")
    got = licenses.scan_licenses(df).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r[1] for r in rows}
    single = {r[0] for r in rows if sum(x[0] == r[0] for x in rows) == 1}
    for r in got:
        if r.doc_id not in single:
            continue
        lowered = (by_id[r.doc_id] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        starts, labels = [], set()
        for phrase, label in licenses.BASE_PHRASES:
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            starts += at
            labels |= {label} if at else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(starts), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(","))
        # Containment by brute force: a detection stays unless one before it in order holds it.
        norm = " " + " ".join(words) + " "
        all_found = []
        for order, (priority, label, _, pattern) in enumerate(licenses.RULES):
            for m in re.finditer(f" (?:{pattern})(?= )", norm):
                first = norm[: m.start()].count(" ")
                all_found.append((-priority, -len(m.group().encode()), order, first, first + m.group().count(" "), label))
        kept = []
        for p, _, _, first, end, label in sorted(all_found):
            if not any(a <= first and end <= b for a, b, _, _ in kept):
                kept.append((first, end, label, -p))
        if r.doc_id != 2000:
            assert [(d.first, d.end, d.label, d.priority) for d in r.detections] == kept


FAMILIES = ("lgpl", "agpl", "gpl")


def test_a_longer_name_is_not_taken_for_the_shorter_one_in_it():
    """Names with every version: what names a lesser or Affero licence gives no label of the plain one but the base phrase's."""
    for name, family in (("Lesser General Public License", "lgpl"), ("Library General Public License", "lgpl"), ("Affero General Public License", "agpl"), ("LGPL", "lgpl"), ("AGPL", "agpl")):
        for version in ("", " v3", " v3.0", " version 3", ", version 3.0", " 3.0 or later", "-3.0-only", " v2", " v2.1", " version 2.1", " 2.1 or any later version"):
            if (family == "agpl" and "2" in version) or (name.startswith("Library") and version and "2" not in version):
                continue
            labels = found(f"This is under the GNU {name}{version} of the foundation")
            own = {x for x in labels if x.startswith(family)}
            assert own, (name, version)
            assert labels - own <= ({"gpl"} if "General" in name else set()), (name, version, labels)


def test_names_of_rules_inside_longer_names():
    """Where one rule's spelling holds another's, and stands above it, its own label is there and the other's is not, but for base phrases."""
    rng = random.Random(12)
    texts = [(p, label, sample(rng, parser.parse(pattern))) for p, label, _, pattern in licenses.RULES for _ in range(4)]
    base = dict(licenses.BASE_PHRASES)
    for p, label, text in texts:
        labels = found(text)
        held = {b for phrase, b in base.items() if phrase in text}
        inside = {other for q, other, short in texts if q < p and f" {short} " in f" {text} "}
        assert label in labels or any(q > p for q, _, t in texts if f" {t} " in f" {text} "), (label, text, labels)
        assert not (inside - {label} - held) & labels or any(q >= p and t != text and f" {t} " in f" {text} " for q, _, t in texts), (label, text, labels)

"""License rules: base phrases against a plain word loop, suppression, edges."""

import itertools
import re

import pytest

from provider_analytics.llm import licenses

RULES = licenses.signature_rules()
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    places = [(i, label) for phrase, label in licenses.BASE_PHRASES for p in [phrase.split()]
              for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), sorted({label for _, label in places})


TEXTS = [None, "", " ", "Under the MIT License", "x" * 100_000, "Ünder the mit license é CC-BY--NC 4.0, Apache License, Version 2.0!",
         "CC BY NC " * 500, "apache license version 20", "under the\nmit\tlicense under the mit licenses", "cc\x00by\x7fnc", "ＣＣ by nc", "cc byé nc"]


def test_base_and_edges(spark):
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(TEXTS + TEXTS)], "doc_id bigint, text string, score int, labels string")
    rows = licenses.scan_licenses(df).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        n, hits, first, last, labels = plain(TEXTS[r.doc_id % len(TEXTS)])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, hits, first, last, labels)
        assert set(labels) <= set(r.labels) and 0 <= r.score <= 1 and r.labels == sorted(set(r.labels))
        assert all(0 <= d.start_word < d.end_word <= n for d in r.detections)
    assert licenses.scan_licenses(df.limit(0)).collect() == []


@pytest.mark.parametrize("text, labels", [
    ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3"]),
    ("under the terms of the GNU Lesser General Public License, version 2.1 or later", ["lgpl-2.1"]),
    ("SPDX-License-Identifier: MPL-2.0", ["mpl-2"]),
    ("Licensed under CC BY-NC-SA 4.0", ["cc-by-nc", "cc-by-nc-sa"]),
    ("released under the BSD license", ["bsd"]),
    ("Distributed under the Boost Software License, Version 1.0.", ["boost-1"]),
    ("the author was licensed to drive and provided lunch under a tree", []),
    ("an artistic cover available in ruby red, mit allem", []),
    ("the code is in the public domain", []),
])
def test_labels(text, labels):
    assert licenses.scan_text(text.encode(), RULES)["labels"] == labels


def test_rules_are_many_and_gated():
    assert 200 <= len(RULES) and [r.priority for r in RULES] == sorted(r.priority for r in RULES)
    # What a rule matches always holds one of its keywords and an anchor, so the prefilter loses nothing.
    for label, name, keywords, _ in licenses._NAMES:
        sample = name
        for pattern in (r"\(\?:([^()|]*)[^()]*\)\??", r"\[(.)[^\]]*\]"):
            while re.search(pattern, sample):
                sample = re.sub(pattern, r"\1", sample)
        sample = re.sub(r" \?", " ", sample).replace("?", "")
        text = f" licensed under the {' '.join(sample.split())} license ".encode()
        found = licenses.detections(text, RULES)
        assert found, (label, text)


def test_contained_detection_is_suppressed():
    kept = licenses.detections(b" licensed under the gnu lesser general public license version 3 ", RULES)
    assert [r.label for _, _, r in kept] == ["lgpl-3"]


def least_matches(parsed):
    """What a parsed pattern matches at least, for every branch and sign it may choose; optional parts are left out."""
    parts = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(arg)])
        elif name == "IN":
            parts.append([chr(c) if str(kind) == "LITERAL" else "w" for kind, c in arg])
        elif name == "BRANCH":
            parts.append([m for branch in arg[1] for m in least_matches(branch)])
        elif name == "SUBPATTERN":
            parts.append(least_matches(arg[3]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            parts.append(["".join(m) for m in itertools.product(least_matches(arg[2]), repeat=arg[0])])
        else:
            assert name == "ASSERT_NOT", name
    return ["".join(p) for p in itertools.product(*parts)]


def test_gates_let_every_branch_through():
    for rule in RULES:
        for text in least_matches(re._parser.parse(rule.pattern.pattern.decode())):
            joined = f" {text} ".encode()
            assert rule.pattern.search(joined), (rule, text)
            assert any(k in joined for k in rule.keywords), (rule, text)
            assert any(a in joined for a in licenses._ANCHORS), (rule, text)
    assert licenses.scan_text(b"MIT-0", RULES)["labels"] == ["mit-0"]
    assert licenses.scan_text(b"CC Attribution ShareAlike", RULES)["labels"] == ["cc-by-sa"]


def test_a_long_text_takes_its_length():
    """Positions and suppression against plain loops on a short text; a text of megabytes ends soon."""
    import time

    rules = licenses.signature_rules()
    text = b"under the mit license or the gnu lesser general public license version 3 and gpl v2 " * 12
    joined = b" " + b" ".join(licenses.words_of(text)) + b" "
    found = []
    for order, rule in enumerate(rules):
        found += [(rule.priority, -(m.end() - m.start()), m.start(), order, m.end(), rule) for m in rule.pattern.finditer(joined)]
    kept = []
    for _, _, start, _, end, rule in sorted(found, key=lambda x: x[:4]):
        if not any(a <= start and end <= b for a, b, _ in kept):
            kept.append((start, end, rule))
    assert licenses.detections(joined, rules) == sorted(kept, key=lambda x: x[:2])
    row = licenses.scan_text(text, rules)
    assert [(d["start_word"], d["end_word"]) for d in row["detections"]] == [
        (joined.count(b" ", 0, a) - 1, joined.count(b" ", 0, b)) for a, b, _ in sorted(kept, key=lambda x: x[:2])]
    began = time.process_time()
    assert licenses.scan_text(b"under the mit license " * 100_000, rules)["n_base"] == 100_000
    assert time.process_time() - began < 20

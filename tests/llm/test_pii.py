"""Personal data: strict formats against the plain patterns, added spans, trees, edges."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from provider_analytics.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text or ""):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
                if not 16 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def noise(seed, n=4000):
    rnd = random.Random(seed)
    bits = ["a", ".", "@", "-", "1", "+", "2 ", "9", " ", "(", ")", "é", "255", "256", "4111111111111111", "+1 (017) 555-7713", "x@y.z", "10.0.0.1"]
    return ["".join(rnd.choices(bits, k=rnd.randint(0, 14))) for _ in range(n)]


def test_strict_formats():
    for text in noise(1):
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_are_linear():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1 " * 100_000, "a@" * 100_000, "1-" * 150_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def fitted(spark):
    return pii.fit_pii(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text"))


def test_query_on_data(spark):
    from provider_analytics.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op9_personal_data"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain(texts[r.doc_id])
        marks = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(marks.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in spans) for kind in pii.BASE_KINDS]
        assert set(filter(None, marks.split(","))) <= set(r.spans.split(","))


def test_added_spans_touch_none_and_clean_texts_have_none(fitted):
    for text in noise(2, 500):
        found = pii.select_spans(text, fitted)
        strict = [s[:3] for s in found if s[3]]
        assert strict == plain(text)
        for kind, a, b, is_strict, score in found:
            assert 0 <= score <= 1
            if not is_strict:
                assert not any(x < b and a < y for k, x, y, *_ in found if (k, x, y) != (kind, a, b))
    assert pii.select_spans("Version 2.0 of 1999, 3 apples and 12 pears. See 4.5.", fitted) == []
    # A number that runs into the next one is no strict phone number, but looks like one.
    both = pii.select_spans("call at once +1 (269) 555-3296 4524132264652897 then", fitted)
    assert any(s[0] in ("phone", "card") for s in both)


def test_trees_add_what_strict_formats_miss(fitted):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    assert "key" in fitted.thresholds
    found = pii.select_spans(f'there and token = "{key}" then', fitted)
    assert [s[:4] for s in found] == [("key", 19, 59, False)]
    assert pii.select_spans(f"there and {key} then", fitted) == []
    assert [s[0] for s in pii.select_spans("there and 1 (269) 555-3296 then", fitted)] == ["phone"]


def test_planted_spans_are_loose_candidates():
    text = "to a@b.cd or +1 (017) 555-7713. Then 4111111111111111 and so on"
    seen = set()
    for number in range(200):
        for copy, span, good in pii.planted(text, number):
            assert span in pii.candidates(copy) and span not in pii.base_spans(copy)
            assert good or not pii.hinted(copy, span)
            seen.add((span[0], good))
    assert seen == {("email", True), ("phone", True), ("card", True), ("key", True), ("key", False)}


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.7)).astype(float)
    trees = pii.fit_trees(x[:2000], y[:2000])
    margin = trees.margin(x[2000:])
    assert ((margin > 0) == y[2000:]).mean() > 0.98
    steps, precision = pii._isotonic(margin, y[2000:])
    assert (np.diff(steps) >= 0).all() and (np.diff(precision) >= 0).all() and precision.max() < 1
    assert pii.train(x[:10], y[:10], np.arange(10) % 3 == 0, 0.98).trees is None


def test_edges(spark, fitted):
    rows = [(1, None), (2, ""), (3, "no data"), (4, "mail a.b@c.de now"), (4, "mail a.b@c.de now"), (None, "é 10.0.0.1")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS spans", "'x' AS id")
    found = sorted(((r.doc_id or 0, [(s.kind, s.start, s.end) for s in r.spans]) for r in pii.find_pii(df, fitted).collect()))
    assert found == [(0, [("ip", 2, 10)]), (1, []), (2, []), (3, []), (4, [("email", 5, 13)]), (4, [("email", 5, 13)])]
    assert pii.find_pii(df.limit(0), fitted).collect() == []
    empty = pii.fit_pii(df.limit(0))
    assert empty.trees is None and len(pii.find_pii(df, empty).collect()) == 6


def test_redaction(spark, fitted):
    assert pii.redact("a 12 b 345", [("x", 2, 4), ("y", 7, 10), ("z", 3, 5)]) == "a [X]b [Y]"
    df = spark.createDataFrame([(1, "to a@b.cd, +1 (017) 555-7713."), (2, None), (3, "plain")], "doc_id int, text string")
    found = [r.t for r in df.select("doc_id", pii.redact_column(F.col("text"), fitted).alias("t")).orderBy("doc_id").collect()]
    assert found == ["to [EMAIL], [PHONE].", None, "plain"]


def test_leading_zeros_of_an_address():
    long = "0" * 5000
    assert pii.base_spans(f"{long}1.2.3.4 {long}256.1.1.1 000.0.0.0") == [("ip", 0, 5007), ("ip", 10018, 10027)]

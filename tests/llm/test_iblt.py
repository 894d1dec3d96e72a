"""Lookup sketches: differences against set arithmetic, successors and edits against plain Python, a native plan."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from provider_analytics.llm import iblt


@pytest.mark.parametrize("cells", [3, 24, 96])
def test_differences_are_recovered_in_full(spark, cells):
    rnd = random.Random(cells)
    rows = []
    for key in range(40):
        both = [rnd.getrandbits(63) for _ in range(rnd.choice([0, 1, 5, 400]))]
        left, right = ([rnd.getrandbits(63) - 2**62 for _ in range(rnd.choice([0, 0, 1, 3, 12, 60, 700]))] for _ in range(2))
        rows.append((key, "p", both + left, both + right))
    df = spark.createDataFrame(rows, "key bigint, pair string, left array<bigint>, right array<bigint>")
    found = {r.key: (set(r.only_left), set(r.only_right)) for r in iblt.differing(df, cells).collect()}
    assert found == {k: (set(a) - set(b), set(b) - set(a)) for k, _, a, b in rows}
    assert iblt.differing(df.limit(0), cells).collect() == []


def plain(docs):
    """doc_id, text in ascending order -> n_chars, edited sha, likenesses."""
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, (d[1] or "").encode()))
    out = []
    for (doc, text), (_, following) in zip(docs, docs[1:] + docs[:1], strict=True):
        text, following = text or "", following or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        lines = [{p for p in t.split("\n") if p.strip(" ")} for t in (text, edited, following)]
        near = [len(lines[0] & x) / len(lines[0] | x) if lines[0] | x else 1.0 for x in lines[1:]]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), *[round(x, 9) for x in near]))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()), key=str)


DOCS = [(5, "a\nb\nc"), (7, None), (9, ""), (12, "a\nb\nc"), (-3, "é🙂\n\n \nx" * 30), (40, "\n".join(map(str, range(3000)))), (41, "one"), (10**12, "\n\n")]


@pytest.mark.parametrize("docs", [DOCS, DOCS + [(None, "null id"), (None, "another")], DOCS + [(7, "again"), (7, None)], [(1, "alone\nhere")], []])
def test_edges(spark, docs):
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).selectExpr("*", "1 AS key", "'x' AS range", "2 AS next_text")
    assert rows_of(iblt.fingerprint_documents(df)) == plain(docs)


def test_equal_texts_have_equal_fingerprints(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a\nb", "x", "a\nb", "b\na", "", None])], "doc_id bigint, text string")
    marks = {r.doc_id: r.fingerprint for r in iblt.fingerprint_documents(df).collect()}
    assert marks[0] == marks[2] == marks[3] != marks[1] and marks[4] == marks[5] == ""


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows_of(iblt.fingerprint_documents(docs)) == plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_plans_hold_no_python(spark):
    df = iblt.fingerprint_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_every_range_sees_its_successor(spark):
    ids = random.Random(1).sample(range(10**9), 500)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id bigint, text string").repartition(5)
    found = {r.id: r.next_text for r in iblt.with_next(df).collect()}
    order = sorted(ids)
    assert found == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert df.select(F.count("*")).first()[0] == len(found)

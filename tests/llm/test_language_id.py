"""Segmentation-marginalised unigrams: the forward sum against all segmentations, expectations, accuracy."""

import itertools
import math
import random
from collections import Counter

import numpy as np

from provider_analytics.llm import language_id as li

VOCABULARY = ["▁a", "▁ab", "ab", "ba", "b", "aba", "▁", "c", "ca"]


def small_model():
    rnd = random.Random(2)
    words = {"x": Counter({"ab": 5, "abba": 3, "cab": 2}), "y": Counter({"ba": 4, "bac": 4, "aaa": 1})}
    return li.fit_unigrams(words, VOCABULARY, rounds=3), rnd, words


def pieces_of(model):
    """Piece -> probabilities with their scale, read off the trie."""
    out, todo = {}, [(1, "")]
    while todo:
        state, text = todo.pop()
        if model.prob[state].any():
            out[text] = model.prob[state]
        for i, c in enumerate(model.alphabet):
            if model.table[state, i + 1]:
                todo.append((model.table[state, i + 1], text + c))
    return out


def test_forward_sums_all_segmentations():
    model, rnd, _ = small_model()
    pieces = pieces_of(model)
    words = ["".join(rnd.choices("abc", k=rnd.randint(1, 9))) for _ in range(60)] + ["a", "zab", "azb"]
    found = model.forward(words)
    for word, row in zip(words, found, strict=True):
        text = "▁" + word
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            parts, start = [], 0
            for i, c in enumerate(cuts):
                if c:
                    parts.append(text[start:i + 1])
                    start = i + 1
            parts.append(text[start:])
            value = np.ones(2)
            for p in parts:
                value = value * (pieces[p] if p in pieces else model.other if len(p) == 1 and p not in model.alphabet else 0.0)
            total += value
        assert np.allclose(row, np.log(total)), word


def test_probabilities_sum_to_one_and_fit_their_words():
    model, _, words = small_model()
    scale = {p: li._SCALE ** len(p) for p in pieces_of(model)}
    sums = sum(v / scale[p] for p, v in pieces_of(model).items())
    assert (sums <= 1 + 1e-9).all() and (sums > 0.5).all()
    for k, language in enumerate(model.languages):
        best = model.forward(list(words[language]))[:, k]
        assert (best >= model.forward(list(words[language]))[:, 1 - k]).all()


def test_long_words_agree_with_sums_of_logs():
    model, rnd, _ = small_model()
    pieces = {p: np.log(np.maximum(v, 1e-300)) for p, v in pieces_of(model).items()}
    words = ["ab" * 1500, "".join(rnd.choices("abc", k=700)), "q" * 300]
    for word, row in zip(words, model.forward(words), strict=True):
        text = "▁" + word
        sums = np.full((len(text) + 1, 2), -np.inf)
        sums[0] = 0.0
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - 4), end):
                piece = text[start:end]
                if piece in pieces:
                    sums[end] = np.logaddexp(sums[end], sums[start] + pieces[piece])
                elif end - start == 1 and piece not in model.alphabet:
                    sums[end] = np.logaddexp(sums[end], sums[start] + np.log(model.other))
        assert np.allclose(row, sums[-1]), word[:20]


def test_edges(spark):
    rows = [(1, "ab abba cab", "x"), (2, "ba bac aaa", "y"), (3, None, "x"), (4, "", None), (5, "12 3.4 ²", "y"), (6, "AB ABBA", None), (None, "bac", "y")]
    df = spark.createDataFrame(rows * 3, "doc_id bigint, text string, lang string").selectExpr("*", "'s' AS score", "1 AS lang_pred")
    model = li.fit_languages(df, VOCABULARY)
    assert model.languages == ["x", "y"]
    found = {(r.doc_id, r.lang_pred, round(r.score, 3)) for r in li.predict_languages(df, model).collect()}
    assert {(d, p) for d, p, _ in found} == {(1, "x"), (2, "y"), (3, "und"), (4, "und"), (5, "und"), (6, "x"), (None, "y")}
    assert all((s == 0) == (p == "und") and 0 <= s <= 1 for _, p, s in found)
    assert li.predict_languages(df.limit(0), model).collect() == []
    none = li.fit_languages(df.limit(0), VOCABULARY)
    assert {r.lang_pred for r in li.predict_languages(df, none).collect()} == {"und"}


def test_column_agrees_with_rows(spark):
    from pyspark.sql import functions as F

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = li.fit_languages(df)
    rows = li.predict_languages(df, model).orderBy("doc_id").collect()
    column = df.select("doc_id", li.language_column(F.col("text"), model).alias("p")).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows] == [r.p.lang_pred for r in column]
    assert all(math.isclose(a.score, b.p.score) for a, b in zip(rows, column, strict=True))


def test_held_out_accuracy(spark):
    from provider_analytics.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in QUERIES["op7_language_id"](spark, folder).collect() if r.held_out]
    assert len(held) > 150 and sum(r.lang_pred == labels[r.doc_id] for r in held) >= 0.96 * len(held)

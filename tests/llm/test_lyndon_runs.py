"""Runs of repeated words: Lyndon arrays, all runs, and the query, against plain loops."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from provider_analytics.llm import lyndon_runs as lr
from provider_analytics.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, runs string, collapsed int, id int"


def plain_lyndon(c):
    out = []
    for i in range(len(c)):
        j = i + 1
        while j < len(c) and c[j:] > c[i:]:
            j += 1
        out.append(j - i)
    return out


def plain_runs(c, min_length=2, min_periods=2):
    out = set()
    for p in range(1, len(c) // min_periods + 1):
        i = 0
        while i + p < len(c):
            s = i
            while i + p < len(c) and c[i] == c[i + p]:
                i += 1
            size = i - s + p
            w = c[s:s + size]
            if i > s and size >= max(min_length, min_periods * p) and all(w[q:] != w[:-q] for q in range(1, p)):
                out.add((s, size, p))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_codes(rng):
    c = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 50))]
    if c and rng.random() < 0.5:
        a, p = rng.randrange(len(c)), rng.randint(1, 6)
        c = [x if i < a else c[a + (i - a) % min(p, len(c) - a)] for i, x in enumerate(c)]
    return c


def test_equal_to_plain_loops():
    rng = random.Random(3)
    for _ in range(1500):
        c = random_codes(rng)
        assert lr.lyndon_array(c) == plain_lyndon(c)
        assert lr.runs_of(np.array(c, np.int64)) == plain_runs(c)
        assert lr.text_runs([b"%d" % x for x in c]) == plain_runs(c, 6, 4)


def test_long_and_many_runs():
    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    found = lr.runs_of(np.array(b))
    assert len(found) == len(set(found)) and 0.7 * len(b) < len(found) < len(b)
    assert lr.text_runs([b"x"] * 300_000) == [(0, 300_000, 1)]
    rng = random.Random(1)
    words = [b"w%d" % rng.randrange(10**6) for _ in range(5000)]
    assert lr.text_runs(words * 4 + words[:17]) == [(0, 20_017, 5000)]
    assert lr.text_runs(words * 3 + words[:4999]) == []


def test_a_wrong_hash_is_noticed(monkeypatch):
    """Where hashes of different words are equal, the comparison by word finds out and the next base is taken."""
    tried = []

    class Weak(lr._Extensions):
        def __init__(self, codes, seed):
            super().__init__(codes, seed)
            self.seed = seed
            tried.append(seed)

        def same(self, i, j, size):
            return super().same(i, j, size) | (self.seed < 2)

    monkeypatch.setattr(lr, "_Extensions", Weak)
    rng = random.Random(9)
    c = [rng.randrange(3) for _ in range(200)]
    assert lr.runs_of(np.array(c)) == plain_runs(c)
    assert tried == [0, 1, 2]


def expected(doc_id, text):
    """The query's row by plain loops."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words, 6, 4)
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{size},{p}\n" for s, size, p in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = [None, "", " \t\n ", "one", "é " * 6, "a b " * 4, "a\x0bb\x0cc\rd " * 5, "x y z " * 9, "\x1c \x1d " * 7]
    texts += [" ".join(f"w{c}" for c in random_codes(rng)) for _ in range(400)]
    texts += [" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(1, 300))) for _ in range(60)]
    return [(i, t, "x", 1, 2) for i, t in enumerate(texts)] + [(None, "no no no no no no no", "x", 1, 2), (7, "b " * 9, "x", 1, 2), (7, "b " * 9, "x", 1, 2)]


def test_query(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["op11_lyndon_runs"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is not None, x or 0) for x in r[:2]) + r[-2:]
    got = sorted((tuple(r) for r in found.collect()), key=key)
    assert got == sorted((expected(i, t) for i, t, *_ in rows), key=key)


def test_operator(spark, rows):
    found = lr.detect_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert by[0].runs == [] and by[0].collapsed == "" and by[None].collapsed == "no"
    assert [tuple(r) for r in by[5].runs] == [(0, 8, 2)] and by[5].collapsed == "a b"
    assert lr.detect_runs(spark.createDataFrame([], SCHEMA)).collect() == []

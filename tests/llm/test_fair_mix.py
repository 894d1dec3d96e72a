"""Weighted fair queueing against a plain queue."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from provider_analytics.llm import fair_mix

SCHEMA = "doc_id bigint, text string, source string, size string, row string, target int"


def plain_targets(sizes, weights, share, repeats):
    """Deal the budget out by weight again and again until no target is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, fixed = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        rest = budget - sum(fixed.values())
        shares = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if shares[s] > repeats * sizes[s]]
        if not above:
            return fixed | shares
        fixed |= {s: repeats * sizes[s] for s in above}


def mixed(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "9", "x", 1) for r in rows], SCHEMA).repartition(3)
    return fair_mix.mix_sources(df, fair_mix.word_count(F.col("text")), **kw).collect()


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rnd = random.Random(seed)
    sizes = {f"s{i}": rnd.choice([0, 1, 10, 1000, 10**6]) for i in range(rnd.randint(1, 12))} | ({None: 50} if seed % 2 else {})
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    found = {r.source: r.target for r in fair_mix.source_targets(df, (5, 2, 1), 1.5, 2).collect()}
    wanted = plain_targets(sizes, (5, 2, 1), 1.5, 2)
    assert found.keys() == wanted.keys()
    assert all(abs(found[s] - wanted[s]) <= 1e-6 * max(1, wanted[s]) for s in wanted)


def test_queue(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(["w"] * rnd.choice([1, 3, 40])), rnd.choice(["a", "a", "a", "b", "ä", None])) for i in range(400)]
    rows += [(900, None, "a"), (901, " \t\n", "b"), (902, "", "empty"), (903, "x\u00a0y\x0bz", "b")]
    found = mixed(spark, rows, seed=4)
    size = {d: len((t or "").encode().split()) for d, t, _ in rows}
    by = {}
    for d, _, s in rows:
        by.setdefault(s, []).append(d)
    targets = plain_targets({s: sum(size[d] for d in ds) for s, ds in by.items()}, (5, 2, 1), 1.5, 2)
    queue = []
    for s, ds in by.items():
        total = 0
        for epoch in (0, 1):
            for key, d in sorted((hashlib.md5(f"4:{epoch}:{d}".encode()).hexdigest(), d) for d in ds if size[d]):
                total += size[d]
                queue.append((round(total / targets[s], 9), s is None, (s or "").encode(), epoch, key, d))
    used, copies, budget = 0, dict.fromkeys(size, 0), 1.5 * sum(size.values())
    for *_, d in sorted(queue):
        used += size[d]
        copies[d] += used <= budget
    assert {r.doc_id: (r.size, r.copies, r.taken) for r in found} == {d: (size[d], copies[d], copies[d] * size[d]) for d in size}
    taken = {}
    for r in found:
        assert r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - targets[s]) <= 45 for s in targets)


def test_reruns_agree_and_repeated_rows(spark):
    rows = [(i % 7, "a b c", "s" if i % 3 else "t") for i in range(60)]
    first = sorted((r.doc_id, r.source, r.taken) for r in mixed(spark, rows))
    assert first == sorted((r.doc_id, r.source, r.taken) for r in mixed(spark, rows)) and len(first) == 60


def test_empty_and_wordless(spark):
    assert mixed(spark, []) == []
    assert [(r.size, r.target, r.taken) for r in mixed(spark, [(1, None, None), (2, "", "a")])] == [(0, 0.0, 0)] * 2


def test_documents_of_the_mix(spark):
    df = spark.createDataFrame([(i, "a b", "s" if i % 4 else "t", "9", "x", 1) for i in range(40)], SCHEMA)
    out = fair_mix.mixed_documents(df)
    assert out.columns == df.columns
    counts = [r["count"] for r in out.groupBy("doc_id").count().collect()]
    assert max(counts) <= 2 and abs(2 * sum(counts) - 120) <= 4

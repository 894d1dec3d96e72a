"""Sharding: a permutation, near-equal shards, gapless slots, computable both ways."""

import zlib

import numpy as np
import pytest

from provider_analytics.llm import feistel

SCHEMA = "doc_id bigint, text string, row int, shard string"


@pytest.mark.parametrize("size", [0, 1, 2, 3, 17, 64, 65, 1000, 4097])
def test_permutation(size):
    p = feistel.FeistelPermutation(size, seed=9)
    places = p.place(np.arange(size))
    assert sorted(places.tolist()) == list(range(size))
    assert p.row(places).tolist() == list(range(size))
    if size > 60:
        assert places.tolist() != list(range(size))
        assert places.tolist() != feistel.FeistelPermutation(size, seed=10).place(np.arange(size)).tolist()


def test_row_outside():
    with pytest.raises(ValueError):
        feistel.FeistelPermutation(5, 1).place(np.array([5]))


def placed(spark, rows, shards=4, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return feistel.shard_documents(df, shards, seed=3).collect()


def test_law(spark):
    rows = [(i * 7 % 301, "é" * (i % 5), 0, "s") for i in range(301)] + [(None, None, 0, "s")] * 3 + [(5, "same", 0, "s")] * 40
    found = placed(spark, rows)
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sorted(r.row for r in found) == list(range(len(rows)))
    assert all(feistel.row_at(r.shard, r.slot, len(rows), 4, seed=3) == r.row for r in found[::17])
    ordered = sorted(found, key=lambda r: r.row)
    assert [r.doc_id for r in ordered] == sorted([r[0] for r in rows], key=lambda d: (d is not None, d or 0))
    assert {(r.doc_id, r.size, r.text_crc32) for r in found} == {
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows}


def test_same_whatever_the_partitions(spark):
    rows = [(i, str(i), 0, "s") for i in range(200)]
    assert sorted(placed(spark, rows, parts=2)) == sorted(placed(spark, rows, parts=7))


def test_empty_and_bad(spark):
    assert placed(spark, []) == []
    with pytest.raises(ValueError):
        placed(spark, [], shards=0)

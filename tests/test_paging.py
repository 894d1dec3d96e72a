"""Pages asked for in a frame against a plain loop: early, late, beyond the end, several per group."""

import pytest
from pyspark.sql import functions as F

from provider_analytics.operators import ranking


@pytest.mark.parametrize("wanted", [[1], [1, 2, 4], [0, -3, 2], [1, 40, 99], [70, 10_000], []])
@pytest.mark.parametrize("size", [1, 7, 30])
def test_paginate_by(spark, monkeypatch, wanted, size):
    monkeypatch.setattr(ranking, "CUT_RANK", 60)
    held = {"a": 300, "b": 8, "c": 1, "d": 59}
    rows = [(g, i, (i * 37) % 101) for g, n in held.items() for i in range(n)]
    df = spark.createDataFrame(rows, "g string, id int, score int")
    asked = [(g, w) for g in [*held, "none"] for w in wanted]
    order = [F.col("score").desc(), F.col("id")]
    got = ranking.paginate_by(df, ["g"], order, spark.createDataFrame(asked, "g string, asked_page int"), size).collect()
    want = set()
    for g, page in asked:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        if mine:
            total = -(-len(mine) // size)
            at = min(max(1, page), total)
            want |= {(g, page, at, total, place, r[1]) for place, r in enumerate(mine, 1) if (at - 1) * size < place <= at * size}
    found = [(r.g, r.asked_page, r.page, r.total_pages, r.place, r.id) for r in got]
    assert set(found) == want and len(found) == len(want)

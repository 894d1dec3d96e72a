"""Containment by windows against plain loops, and how many rows it takes."""

import random

from pyspark.sql import functions as F

from provider_analytics.operators import crawl
from provider_analytics.operators.windows import with_windows


def test_containment_of_random_and_long_texts(spark):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("ab c") for _ in range(n))
    texts = [make(rng.randint(0, 12)) for _ in range(60)] + [make(10_000), "", "città nuova", None]
    parts = [make(n) for n in (1, 2, 5, 5, 9)] + ["", "tà n", "x" * 20_000, None]
    held = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    sought = spark.createDataFrame([(p,) for p in set(parts)], "part string")
    windows = with_windows(held, "text", sought, "part")
    lengths = {len(p) for p in parts if p}
    per_text = {r["id"]: r["n"] for r in windows.groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert all(n <= len(texts[i]) * len(lengths) for i, n in per_text.items())
    got = [(r["id"], r["part"]) for r in windows.join(sought, "part").collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, p) for i, t in enumerate(texts) for p in parts if t is not None and p and p in t}


def test_empty_sides(spark):
    none, some = spark.createDataFrame([], "text string"), spark.createDataFrame([("abc",)], "text string")
    parts = lambda df: df.withColumnRenamed("text", "part")
    assert with_windows(none, "text", parts(some), "part").count() == 0
    assert with_windows(some, "text", parts(none), "part").count() == 0


def test_province_in_a_long_text(spark):
    cities = spark.createDataFrame([("Paese", "x " * 4000 + "Reggio Calabria " + "y " * 1000), ("Altro", "z" * 10_000)], "comune string, district string")
    got = {r["comune"]: r["province"] for r in crawl.infer_province(cities, crawl.capitals_frame(spark), crawl.extras_frame(spark)).collect()}
    assert got == {"Paese": "RC", "Altro": None}

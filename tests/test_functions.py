import difflib
import random

import pytest
from pyspark.sql import functions as F

from provider_analytics.functions import geo, phones, records, text
from provider_analytics.operators import linkage, search


def one(spark, build, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw, expected", [
    ("Società dell’Eredità!", "societa dell eredita"),
    ("  CAFÉ–bar ½ ", "cafe bar 1 2"),
    ("ﬁne Ⅳ", "fine iv"),
    (None, ""),
    ("ß", ""),
])
def test_normalize_query(spark, raw, expected):
    assert one(spark, text.normalize_query, raw) == expected
    text.register_sql_functions(spark)


@pytest.mark.parametrize("raw, expected", [
    ("02/1234567", ["02/1234567"]),
    ("02/1234567 - 3", ["02/1234567 - 3"]),
    ("06 123456; 0039 06 123456, 333 1234567", ["06 123456", "333 1234567"]),
    ("02 1234567 02/7654321", ["02 1234567", "02/7654321"]),
    ("02 1234567 347 1234567", ["02 1234567", "347 1234567"]),
    ("123, 123456789012", []),
    ("", []),
])
def test_phone_split(spark, raw, expected):
    assert one(spark, phones.phone_split, raw) == expected


def test_phone_forms(spark):
    assert one(spark, phones.phone_e164, "0039 06 12345678") == "+390612345678"
    assert one(spark, phones.phone_tokens, "0039 39 02 1234567 / 06-1234567") == ["021234567", "061234567"]
    assert one(spark, phones.street_number, "Via Roma 12/b") == "12"


def test_mojibake(spark):
    broken = "SocietÃ  perchÃ© lâ\u0080\u0099atto"
    assert one(spark, text.fix_mojibake, broken) == "Società perché l’atto"
    assert one(spark, text.fix_mojibake, "già corretto") == "già corretto"


def test_titles_names_dates(spark):
    assert one(spark, text.title_case, "san DONÀ-di piave") == "San Donà-Di Piave"
    assert one(spark, text.slugify, " Reggio nell'Emilia ") == "reggio-nell-emilia"
    assert one(spark, lambda c: text.split_name(c)[0], "Anna Maria  Bianchi") == "Anna Maria"
    assert one(spark, lambda c: text.split_name(c)[1], "Bianchi") is None
    assert one(spark, text.parse_iso_date, "2024-02-30") is None
    assert str(one(spark, text.parse_iso_date, " 2024-02-29 ")) == "2024-02-29"


def test_coordinates(spark):
    assert one(spark, geo.as_coord, " 45,5 ") == 45.5
    assert one(spark, geo.as_coord, "NaN") is None
    assert one(spark, lambda c: geo.parse_radius(c, 30), "15") == 30
    km = one(spark, lambda c: geo.distance_km(c, F.lit(9.19), F.lit(41.9), F.lit(12.5)), 45.46, "double")
    assert 476 < km < 478


def test_opening_hours(spark):
    row = spark.sql("""SELECT array(named_struct('open_day', 1, 'open_hhmm', '0900', 'close_day', 1, 'close_hhmm', '1300'),
        named_struct('open_day', 2, 'open_hhmm', '0900', 'close_day', 2, 'close_hhmm', cast(null as string))) AS p,
        timestamp '2024-07-01 07:30:00' AS morning, timestamp '2024-07-01 11:00:00' AS noon""")
    out = row.select(records.open_now(F.col("p"), F.col("morning")).alias("a"), records.open_now(F.col("p"), F.col("noon")).alias("b"),
                     records.opening_spec(F.col("p")).alias("s")).first()
    assert out["a"] is True and out["b"] is False  # 9:30 and 13:00 in summer time
    assert [tuple(x) for x in out["s"]] == [("Monday", "09:00", "13:00")]


def osa(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_typo_blocking_finds_every_close_pair(spark):
    rng = random.Random(7)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(4, 11))) for _ in range(160)}
    left, right = sorted(words)[::2], sorted(words)[1::2]
    budget = lambda w: 0 if len(w) < 5 else 1 if len(w) < 9 else 2
    expected = {(a, b, osa(a, b)) for a in left for b in right
                if a != b and 0 < min(budget(a), budget(b)) and osa(a, b) <= min(budget(a), budget(b))}
    frame = lambda ws: spark.createDataFrame([(w,) for w in ws], "token string")
    got = {tuple(r) for r in search.similar_tokens(frame(left), frame(right)).collect()}
    assert got == expected and expected
    assert osa("ca", "abc") == 3


def test_sequence_ratio(spark):
    df = spark.createDataFrame([("mario rossi", "rossi mario"), ("anna", "")], "a string, b string")
    got = [r["x"] for r in df.select(linkage.sequence_ratio("a", "b").alias("x")).collect()]
    assert got == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in [("mario rossi", "rossi mario"), ("anna", "")]]

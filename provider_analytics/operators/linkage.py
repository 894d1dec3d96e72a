"""Matching register rows with outside listings, and merging what matched."""

from __future__ import annotations

import difflib
import math
import sys
import unicodedata

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.geo import EARTH_KM, GEOCODE_BOX, in_bbox
from ..functions.phones import phone_digits, phone_split, phone_tokens, street_number
from ..functions.text import address_tokens, name_tokens, normalize_accents, normalize_query, url_last_segment, words
from .skew import place_in_group, settle, top_per_group

# Executors get the helpers below with the task; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Words that mark a listing as one of the profession.
TRADE_TERMS = ["notaio", "notai", "notarile", "notarili", "studio notarile", "studi notarili"]
# Service slugs and the phrases that show a text offers them, in test order.
SERVICE_PHRASES = {
    "atto-di-donazione": ["atto di donazione", "atti di donazione", "donazione", "donazioni"],
    "pratica-di-successione": ["pratica di successione", "pratiche di successione", "successione", "successioni"],
    "testamento": ["testamento", "testamenti", "pratiche testamentarie", "mortis causa"],
    "convenzioni-matrimoniali": ["convenzioni matrimoniali", "convenzione matrimoniale"],
    "eredita": ["eredita", "eredità", "ereditario"],
    "separazione-dei-beni": ["separazione dei beni"],
    "diritto-di-famiglia": ["diritto di famiglia"],
    "compravendita-immobiliare": ["trasferimenti immobiliari", "compravendita", "atti di compravendita", "prima casa"],
    "mutuo": ["mutuo", "mutui", "stipulazione dei mutui", "atti ipotecari", "garanzia ipotecaria"],
    "diritto-societario": [
        "diritto societario", "atti societari", "costituzione", "cessazioni di aziende", "modifiche societarie",
    ],
    "procura": ["procura", "procure"],
    "consulenza-notarile": ["consulenza", "consulenze", "consulenza professionale"],
    "certificazioni-notarili": ["certificazioni notarili", "certificazione notarile"],
    "atti-di-divisione": ["atti di divisione", "atto di divisione", "divisione"],
    "prima-casa": ["prima casa", "atti per la prima casa"],
    "estratti-autentici-documenti": ["estratti autentici", "estratti autentici di documenti"],
    "servizi-notarili-casa": ["servizi notarili per la casa"],
}
# The second list, for records of the other kind of directory, in test order.
RECORD_PHRASES = {
    "atto-di-donazione": ["atto di donazione", "donazione"],
    "pratica-di-successione": ["pratica di successione", "successione", "successioni"],
    "testamento": ["testamento", "testamenti", "mortis causa"],
    "convenzioni-matrimoniali": ["convenzioni matrimoniali", "convenzione matrimoniale"],
    "eredita": ["eredita", "eredità", "ereditario"],
    "separazione-dei-beni": ["separazione dei beni"],
    "diritto-di-famiglia": ["diritto di famiglia"],
    "compravendita-immobiliare": [
        "trasferimenti immobiliari", "diritto immobiliare", "compravendita", "vendita casa", "acquisto casa",
    ],
    "mutuo": ["mutuo", "mutui", "atti ipotecari", "garanzia"],
    "diritto-societario": [
        "diritto societario", "societario", "operazioni straordinarie", "costituzione societa", "costituzione società",
    ],
    "procura": ["procura", "procure"],
    "consulenza-notarile": ["consulenza", "consulenze"],
}
THRESHOLD = 70
_SIMILAR = 0.72  # of names


_LETTERS = 63  # of a string whose places are the bits of one number


def _letters(strings: list[str], pad: int) -> np.ndarray:
    """Code points, a row a string, filled up with `pad`."""
    codes = np.array(strings, dtype=f"U{max(1, max(map(len, strings)))}").view(np.uint32).reshape(len(strings), -1)
    return np.where(codes == 0, np.uint32(pad), codes)


def _matched(left: np.ndarray, right: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Letters in the common blocks of strings, a row a pair, as difflib finds them: the longest block, the first of equal
    ones, then the same on either side of it. Pairs that cannot have as many as `need` are left off on the way.

    Bit j of number i tells whether letter i of the left is letter j of the right. A block takes away what does not lie wholly
    before or behind it, so the longest of all that is left is the longest of its own part, and parts need no list."""
    if max(left.max(), right.max()) < 256:
        left, right = left.astype(np.uint8), right.astype(np.uint8)
    packed = np.packbits(left[:, :, None] == right[:, None, :], axis=2, bitorder="little")
    bits = np.zeros((*left.shape, 8), dtype=np.uint8)
    bits[:, :, :packed.shape[2]] = packed
    grid, found, at, places = bits.view("<u8")[:, :, 0], np.zeros(len(left), dtype=np.int64), np.arange(len(left)), np.arange(left.shape[1])
    one = np.uint64(1)
    while True:
        rows = np.count_nonzero(grid, axis=1)
        open_ = (rows > 0) & (found[at] + rows >= need[at])
        at, grid = at[open_], grid[open_]
        if not len(at):
            return found
        size, start, low = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.uint64)
        # Bit j of number i of `runs`: a run of k letters begins there.
        live, own, runs, k = np.arange(len(at)), grid, grid, 1
        while len(live):
            longer = own[:, :runs.shape[1] - 1] & (runs[:, 1:] >> one)
            goes_on = longer.any(axis=1)
            over = ~goes_on
            ended, last = live[over], runs[over]
            first = (last != 0).argmax(axis=1)
            bit = last[np.arange(len(last)), first]
            size[ended], start[ended], low[ended] = k, first, bit & (~bit + one)
            live, own, runs, k = live[goes_on], own[goes_on], longer[goes_on], k + 1
        found[at] += size
        before, behind = low - one, ~((low << size.astype(np.uint64)) - one)
        grid = np.where(places < start[:, None], grid & before[:, None], np.where(
            places >= (start + size)[:, None], grid & behind[:, None], np.uint64(0)))


def _ratios_of(left: list[str], right: list[str], at_least: float) -> np.ndarray:
    total = np.array([len(a) + len(b) for a, b in zip(left, right)], dtype=np.float64)
    ratios = np.ones(len(total))
    short = np.array([0 < len(a) <= _LETTERS and 0 < len(b) <= _LETTERS and "\0" not in a and "\0" not in b for a, b in zip(left, right)], dtype=bool)
    for i in np.flatnonzero(~short):
        ratios[i] = difflib.SequenceMatcher(None, left[i], right[i]).ratio()
    chosen = np.flatnonzero(short)
    need = np.floor(at_least * total / 2 - 1e-6)
    for some in np.array_split(chosen, len(chosen) // 2048 + 1):
        if len(some):
            codes = _letters([left[i] for i in some], 0xFE), _letters([right[i] for i in some], 0xFF)
            ratios[some] = 2.0 * _matched(*codes, need[some]) / total[some]
    return np.where(ratios >= at_least, ratios, 0.0)


@F.pandas_udf(DoubleType())
def _ratios(left: pd.Series, right: pd.Series, at_least: pd.Series) -> pd.Series:
    out = pd.Series(np.nan, index=left.index, dtype="float64")
    known = left.notna() & right.notna()
    if known.any():
        out[known] = _ratios_of(list(left[known]), list(right[known]), float(at_least.iloc[0]))
    return out


def sequence_ratio(left: Column | str, right: Column | str, at_least: float = 0.0) -> Column:
    """Similarity of two strings by their longest common blocks, 0 to 1; null where either is null. A similarity
    below `at_least` is given as 0, as it need not be worked out to its end."""
    return _ratios(left, right, F.lit(float(at_least)))


def token_intersection(left: Column, right: Column) -> Column:
    return F.size(F.array_intersect(left, right))


# Candidate pairs

#: What normalize_query leaves, in numbers of 64 bits that have four for each.
_ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz "
_SKETCH = [_ALPHABET[i:i + 16] for i in range(0, len(_ALPHABET), 16)]


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place.cast("int"))


def _bits(words_: Column) -> Column:
    """One bit a word: where two sides have no bit in common, they have no word in common."""
    return F.aggregate(words_, F.lit(0).cast("bigint"), lambda bits, w: bits.bitwiseOR(_bit(F.pmod(F.xxhash64(w), F.lit(64)))))


def _counts(text: Column, letters: str) -> Column:
    """How often letters occur in a text, up to four times, as that many bits each. Two texts have at least as many letters
    that are not matched by the other as these numbers differ in bits."""
    often = lambda c: F.least(F.length(text) - F.length(F.replace(text, c, F.lit(""))), F.lit(4))
    return F.aggregate(F.array(*map(F.lit, letters)), F.lit(0).cast("bigint"), lambda bits, c: F.call_function(
        "shiftleft", bits, F.lit(4)).bitwiseOR(_bit(often(c)) - 1))


def prepare(df: DataFrame, key: str) -> DataFrame:
    """What scoring needs of a register row or a listing, computed once per row. Expects name, phone,
    address, comune, lat, lng; `sig` is equal for rows that no score can tell apart."""
    plain = {f"{c}_norm": normalize_query(F.col(c)) for c in ("name", "address", "comune")}  # once, which is most of the work
    ready = df.select(
        key, *[c.alias(n) for n, c in plain.items()], F.transform(phone_split(F.col("phone")), phone_digits).alias("phones"),
        F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"),
    ).withColumns({
        "name_tokens": name_tokens(F.col("name_norm"), normal=True), "street": address_tokens(F.col("address_norm"), normal=True),
        "number": street_number(F.col("address_norm"), normal=True), "surname": F.element_at(F.split("name_norm", " "), -1), "cos": F.cos(F.radians("lat")),
        "name_size": F.length("name_norm").cast("double"), **{f"letters_{i}": _counts(F.col("name_norm"), letters) for i, letters in enumerate(_SKETCH)},
    }).withColumn("plain", F.filter("street", lambda t: ~t.rlike("^[0-9]+$")))
    ready = ready.withColumns({
        "surname_bit": _bits(F.array("surname")),
        "name_bits": _bits(F.col("name_tokens")), "phone_bits": _bits(F.col("phones")), "plain_bits": _bits(F.col("plain")),
    })
    parts = ["name_norm", "address_norm", "comune_norm", "lat", "lng"]
    return ready.withColumn("sig", F.sha2(F.concat_ws(
        "|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts], F.array_join("phones", ",")
    ), 256))


def signatures(prepared: DataFrame, key: str) -> DataFrame:
    """One row per signature with its number of copies and lowest key; copies meet in a partial aggregate,
    so any number of them is cheap."""
    columns = [c for c in prepared.columns if c not in (key, "sig")]
    return prepared.groupBy("sig").agg(
        *[F.any_value(c).alias(c) for c in columns], F.count("*").alias("copies"), F.min(key).alias("first_key")
    )


_CELL = 0.02  # degrees
_NEAR_KM, _HOME_KM = 2.0, 0.5
_KM_PER_DEGREE = 111.19


#: What a pair without a common phone can score at most: surname, name, house number, street, comune, distance.
_WITHOUT_PHONE = 24 + 18 + 18 + 16 + 14 + 15
#: The same without the surname.
_WITHOUT_SURNAME = _WITHOUT_PHONE - 24


def _cell_of(c: Column) -> Column:
    return F.floor(c / _CELL).cast("bigint")


def _cells_around(km: float) -> Column:
    """Cells that are at most so far away; those next to a pole are not left out by their corners."""
    box, cell = km * 1.01 / _KM_PER_DEGREE, F.lit(_CELL)
    high = int(box / _CELL) + 1
    wide = F.ceil(F.lit(box / _CELL) / F.greatest(F.col("cos"), F.lit(0.005))).cast("int")
    least_cos = F.cos(F.radians(F.least(F.abs("lat") + box, F.lit(90.0))))
    gap = lambda c, at: F.greatest(F.lit(0.0), at * cell - F.col(c), F.col(c) - (at + 1) * cell)
    cells = F.flatten(F.transform(F.sequence(F.lit(-high), F.lit(high)), lambda dy: F.transform(F.sequence(-wide, wide), lambda dx: F.struct(
        (_cell_of(F.col("lat")) + dy).alias("y"), (_cell_of(F.col("lng")) + dx).alias("x")))))

    def reached(c: Column) -> Column:
        up, aside = gap("lat", c["y"]), gap("lng", c["x"]) * least_cos
        return (F.col("cos") < 0.1) | (up * up + aside * aside <= box * box)

    return F.filter(cells, reached)


# Kinds of blocking keys, in the order in which a pair is taken at them.
_PHONE, _SURNAME_WORD, _SURNAME_STREET, _SURNAME_NUMBER, _SURNAME_HOME, _PLACE = range(6)


def _keys(side: str, phones_only: bool = False, places: bool = True) -> Column:
    """Blocking keys: kind, number of the word it is made from, and a number that stands for its text. Without an equal phone a score
    of 70 needs the surname with another name word, with the house number or with a street word; or, for a name of one
    word, that word within half a kilometre; or, without the surname, house number, street word and a distance of at most
    two kilometres, which are the places. A pair that shares no key cannot reach the threshold."""
    def key(kind: int, nth: Column, *parts: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), nth.cast("int").alias("nth"), F.xxhash64(F.lit(kind), *parts).alias("key"))

    register, zero = side == "register", F.lit(0)
    by_phone = F.transform("phones", lambda p, i: key(_PHONE, i if register else zero, p))
    if phones_only:
        return F.array_distinct(by_phone)
    names, street, number = F.col("name_tokens"), F.col("plain"), F.col("number")
    none = F.filter(F.array(key(_PHONE, zero, zero)), lambda _: F.lit(False))
    located = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    here = F.array(F.struct(_cell_of(F.col("lat")).alias("y"), _cell_of(F.col("lng")).alias("x")))
    # The side that has fewer rows with a kind of key looks around, the other stays in its cell. A listing has its surname anywhere.
    if register:
        surnames, alone, at_place, at_home = F.array("surname"), F.when(F.size(names) <= 1, F.array("surname")), here, _cells_around(_HOME_KM)
    else:
        surnames, alone, at_place, at_home = names, names, _cells_around(_NEAR_KM), here
    nth = lambda i: i if register else zero
    with_all = lambda f: F.flatten(F.transform(surnames, f))
    kinds = [
        by_phone,
        with_all(lambda s: F.transform(F.filter(names, lambda u: u != s), lambda u, i: key(_SURNAME_WORD, nth(i), s, u))),
        with_all(lambda s: F.transform(street, lambda w, i: key(_SURNAME_STREET, nth(i), s, w))),
        F.when(number != "", F.transform(surnames, lambda s: key(_SURNAME_NUMBER, zero, s, number))),
        F.when(located, F.flatten(F.transform(alone, lambda s: F.transform(at_home, lambda c: key(_SURNAME_HOME, zero, s, c["y"], c["x"]))))),
    ]
    if places:
        kinds.append(F.when(located & (number != ""), F.flatten(F.transform(street, lambda w, i: F.transform(
            at_place, lambda c: key(_PLACE, nth(i), w, number, c["y"], c["x"]))))))
    return F.array_distinct(F.concat(*[F.coalesce(k, none) for k in kinds]))


def _within(km: float) -> Column:
    """Whether a pair is at most so far apart, to half a millimetre: the square of the sine of half the angle says it without the angle."""
    half_lat, half_lng = F.sin(F.radians(F.col("p_lat") - F.col("l_lat")) / 2), F.sin(F.radians(F.col("p_lng") - F.col("l_lng")) / 2)
    square = half_lat * half_lat + F.col("p_cos") * F.col("l_cos") * half_lng * half_lng
    return square.between(0.0, math.sin((km + 5e-7) / (2 * EARTH_KM)) ** 2)


def _near(km: float) -> Column:
    """What a pair needs that has neither a phone nor a surname with something else in common: the comune in the address,
    and the distance. Degrees are compared before the distance is worked out."""
    dlat, dlng = F.abs(F.col("p_lat") - F.col("l_lat")), F.abs(F.col("p_lng") - F.col("l_lng"))
    box = km * 1.01 / _KM_PER_DEGREE
    # Beyond a pole the cosine has no meaning as a width; such rows are held to be at it.
    polewards = F.when(F.greatest(F.abs("p_lat"), F.abs("l_lat")) > 90, F.cos(F.radians(F.lit(90.0)))).otherwise(F.least("p_cos", "l_cos"))
    return (
        (dlat <= box) & (dlng * polewards <= box) & (F.col("p_comune_norm") != "")
        & F.contains("l_address_norm", F.col("p_comune_norm")) & _within(km)
    )


def _share(column: str, bits: str) -> Column:
    """Whether both sides have a word in common; most that have none are told by one number."""
    return (F.col(f"p_{bits}").bitwiseAND(F.col(f"l_{bits}")) != 0) & F.arrays_overlap(f"p_{column}", f"l_{column}")


def shares_phone() -> Column:
    return _share("phones", "phone_bits")


def shares_surname() -> Column:
    return (F.col("p_surname_bit").bitwiseAND(F.col("l_name_bits")) != 0) & F.array_contains("l_name_tokens", F.col("p_surname"))


def shares_names(least: Column) -> Column:
    """Whether so many name words are common. Words of the register row whose bit the listing lacks are not."""
    lacking = F.bit_count(F.col("p_name_bits").bitwiseAND(F.bitwise_not("l_name_bits")))
    return (F.size("p_name_tokens").cast("double") - lacking >= least) & (token_intersection(F.col("p_name_tokens"), F.col("l_name_tokens")) >= least)


def _first_of(mine: Column, theirs: str) -> Column:
    """Whether the word the key is made from is the first that is common."""
    earlier = F.exists(F.slice(mine, F.lit(1), F.col("_nth")), lambda w: F.array_contains(theirs, w))
    return F.array_contains(theirs, F.get(mine, F.col("_nth"))) & ((F.col("_nth") == 0) | ~earlier)


def _at_first_key() -> Column:
    """Whether a pair, met at a key, is taken there: at the first of its common keys, and nowhere where it has none, or only places
    too far apart to score. What is told by numbers comes first.

    Functions with a lambda keep the join out of whole-stage code. There the condition would be one method, too long to be
    compiled to machine code, and every column of it read for every pair; outside it is cut into methods."""
    same_number = (F.col("p_number") != "") & (F.col("p_number") == F.col("l_number"))
    others = F.filter("p_name_tokens", lambda t: t != F.col("p_surname"))
    no_word, no_street = ~F.arrays_overlap(others, "l_name_tokens"), ~_share("plain", "plain_bits")
    kind, plain, phones = F.col("_kind"), F.col("p_plain"), F.col("p_phones")
    return F.when(kind == _PLACE, _near(_NEAR_KM) & ~shares_phone() & ~shares_surname() & same_number & _first_of(plain, "l_plain")).when(
        kind == _PHONE, _first_of(phones, "l_phones"),
    ).otherwise(~shares_phone() & shares_surname() & F.when(kind == _SURNAME_WORD, _first_of(others, "l_name_tokens")).otherwise(
        no_word & F.when(kind == _SURNAME_STREET, _first_of(plain, "l_plain")).otherwise(
            no_street & F.when(kind == _SURNAME_NUMBER, same_number).otherwise(
                ~same_number & (F.size("p_name_tokens") <= 1) & _near(_HOME_KM)))))


def candidate_pairs(register: DataFrame, listings: DataFrame, phones_only: bool = False, places: bool = True) -> DataFrame:
    """Signature pairs (p_*, l_*) that share a blocking key, those that share only a place with what the score then
    needs besides. Inputs are `signatures` of both sides. With `phones_only` those with a common phone, which are all
    that can score more than _WITHOUT_PHONE; without `places` those with a common phone or surname, which are all that can
    score more than _WITHOUT_SURNAME.

    A pair is taken at the first of its common keys, told from the pair itself, so pairs are neither sorted out nor
    looked up again: what is shuffled are the rows of both sides, once a key. A crowded key is split by adaptive
    execution on either side of the join."""
    prefix = lambda df, mark: [F.col(c).alias(f"{mark}_{c}") for c in df.columns]
    spread = lambda df, side: df.select("*", F.explode(_keys(side, phones_only, places)).alias("_at"))
    left = spread(register, "register").select(*prefix(register, "p"), F.col("_at.kind").alias("_kind"), F.col("_at.nth").alias("_nth"), F.col("_at.key").alias("_key"))
    right = spread(listings, "listing").select(*prefix(listings, "l"), F.col("_at.kind").alias("_kind"), F.col("_at.key").alias("_key"))
    return left.join(right, ["_key", "_kind"]).filter(_at_first_key()).drop("_key", "_kind", "_nth")


# Scores

def _sum_with_reasons(df: DataFrame, parts: list[tuple[Column, int, str]]) -> DataFrame:
    score = sum((F.when(F.coalesce(hit, F.lit(False)), points).otherwise(0) for hit, points, _ in parts), F.lit(0))
    reasons = F.array_compact(F.array(*[
        F.when(F.coalesce(hit, F.lit(False)), F.lit(f"{name} {points:+d}")) for hit, points, name in parts
    ]))
    return df.withColumn("score", score.cast("int")).withColumn("reasons", reasons)


def match_score_places(pairs: DataFrame, at_least: int = 0) -> DataFrame:
    """Score of a register row against a map listing: phone 55, surname 24, name 18 or 12, house number 18,
    street 16, comune 14, distance 15, 10 or -35. Pairs below `at_least` are left out; whatever cannot get
    there even with a similar name is dropped before the Python name measure runs."""
    # Sums are of doubles, as every sum of whole numbers that is checked for its size makes an object. Unmatched letters of both names are at least as many as the bits in which their counts differ.
    total = F.col("p_name_size") + F.col("l_name_size")
    unmatched = sum((F.bit_count(F.col(f"p_letters_{i}").bitwiseXOR(F.col(f"l_letters_{i}"))) for i in range(len(_SKETCH))), F.lit(0.0))
    parts = [
        (shares_phone(), 55, "phone"),
        ((F.col("p_surname") != "") & shares_surname(), 24, "surname"),
        ((F.size("p_name_tokens") > 0) & shares_names(F.least(F.lit(2), F.size("p_name_tokens"))), 18, "name"),
        ((F.col("p_number") != "") & (F.col("p_number") == F.col("l_number")), 18, "house number"),
        (_share("plain", "plain_bits"), 16, "street"),
        ((F.col("p_comune_norm") != "") & F.contains("l_address_norm", F.col("p_comune_norm")), 14, "comune"),
    ]
    by_distance = F.when(_within(0.5), 15.0).when(_within(2), 10.0).when(~_within(20), -35.0).otherwise(0.0)
    hits = [f"_hit_{i}" for i in range(len(parts))]
    # As a generated row, what was found is told once a pair, and not before it is known that the pair is one.
    known = pairs.select("*", F.inline(F.array(F.struct(
        *[F.coalesce(hit, F.lit(False)).alias(c) for c, (hit, _, _) in zip(hits, parts)], by_distance.alias("_distance")))))
    known = known.withColumn("score", sum((F.when(F.col(c), float(points)).otherwise(0.0) for c, (_, points, _) in zip(hits, parts)), F.col("_distance")))
    same_name, may_be_similar = F.col(hits[2]), total - unmatched >= _SIMILAR * total - 1e-6
    hopeful = known.filter(F.col("score") + F.when(~same_name & may_be_similar, 12.0).otherwise(0.0) >= at_least)
    # One pass over the pairs: names that agree by words, or cannot be similar, are handed to the measure as nulls, which cost it nothing.
    unlike = lambda c: F.when(~same_name & may_be_similar, F.col(c))
    told = hopeful.withColumn("_similar", F.coalesce(
        sequence_ratio(unlike("p_name_norm"), unlike("l_name_norm"), _SIMILAR) >= _SIMILAR, F.lit(False)))
    told = told.withColumn("score", (F.col("score") + F.when(F.col("_similar"), 12.0).otherwise(0.0)).cast("int")).filter(F.col("score") >= at_least)
    reasons = F.array_compact(F.array(
        *[F.when(F.col(c), F.lit(f"{name} {points:+d}")) for c, (_, points, name) in zip(hits, parts)],
        F.when(F.col("_distance") != 0, F.format_string("distance %+d", F.col("_distance").cast("int"))), F.when(F.col("_similar"), F.lit("similar name +12"))))
    return told.withColumn("reasons", reasons).drop("_similar", "_distance", *hits)


def _name_parts(left: Column, right: Column) -> list[tuple[Column, int, str]]:
    shared = token_intersection(words(left), words(right))
    return [(shared >= 2, 55, "name"), (shared == 1, 25, "part of name")]


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def match_score_directory(pairs: DataFrame, extra: str = "email") -> DataFrame:
    """Score against a directory page: name 55 or 25, comune 20, phone 35, trade word 10, site 5, and 5 for an
    email or a description. Expects raw p_name, p_comune, p_phone and l_name, l_city, l_address,
    l_description, l_phone, l_category, l_website, l_email."""
    place = normalize_accents(F.concat_ws(" ", "l_city", "l_address", "l_description"))
    comune = normalize_accents(F.col("p_comune"))
    trade = F.lit(False)
    for term in TRADE_TERMS:
        trade = trade | F.contains(normalize_accents(F.col("l_category")), F.lit(term)) | F.contains(
            normalize_accents(F.col("l_name")), F.lit(term))
    return _sum_with_reasons(pairs, [
        *_name_parts(F.col("p_name"), F.col("l_name")),
        ((comune != "") & F.contains(place, comune), 20, "comune"),
        (F.arrays_overlap(phone_tokens(F.col("p_phone")), phone_tokens(F.col("l_phone"))), 35, "phone"),
        (trade, 10, "trade"),
        (_filled("l_website"), 5, "site"),
        (_filled("l_email" if extra == "email" else "l_description"), 5, extra),
    ])


def match_score_profile(pairs: DataFrame) -> DataFrame:
    """Score against a profile page: name 55 or 25, phone 35, email 25, comune 20, services 5; accepted from 80."""
    email = normalize_accents(F.col("p_email"))
    comune = normalize_accents(F.col("p_comune"))
    return _sum_with_reasons(pairs, [
        *_name_parts(F.col("p_name"), F.concat_ws(" ", "l_name", "l_first_name", "l_last_name")),
        (F.arrays_overlap(phone_tokens(F.col("p_phone")), phone_tokens(F.col("l_phone"))), 35, "phone"),
        ((email != "") & (email == normalize_accents(F.col("l_email"))), 25, "email"),
        ((comune != "") & F.contains(normalize_accents(F.concat_ws(" ", "l_city", "l_province", "l_address")), comune), 20, "comune"),
        (F.col("l_services") > 0, 5, "services"),
    ])


# Picking

def pick_match(edges: DataFrame, threshold: int = THRESHOLD, name: str = "edges") -> DataFrame:
    """One-to-one assignment: the highest score wins; equal scores are ordered by the md5 of both first keys, which is
    as good as any order and, being spread at random, leaves no long chains.

    edges: p_sig, l_sig, p_copies, l_copies, p_first, l_first, score. In every round each edge that is the
    best of both its ends is taken for as many copies as both still have; rounds repeat until no edge is
    left, their number growing with the logarithm of the edges. Returns (p_sig, l_sig, score, p_from, l_from,
    taken): copies p_from.. of one side go to copies l_from.. of the other. Edges may have p_used and l_used, the copies
    that are gone already; they are written as `name`."""
    zero = F.lit(0).cast("bigint")
    used = {c: F.col(c) if c in edges.columns else zero for c in ("p_used", "l_used")}
    left = settle(edges.filter(F.col("score") >= threshold).withColumns({**used, "_tie": tie_break("p_first", "l_first")}), name)
    taken = None
    rank = F.struct((-F.col("score")).alias("s"), F.col("_tie").alias("t"), F.col("p_first").alias("p"), F.col("l_first").alias("l"))
    while not left.isEmpty():
        best_p = left.groupBy("p_sig").agg(F.min(rank).alias("_bp"))
        best_l = left.groupBy("l_sig").agg(F.min(rank).alias("_bl"))
        won = left.join(best_p, "p_sig").join(best_l, "l_sig").filter((F.col("_bp") == rank) & (F.col("_bl") == rank)).withColumn(
            "taken", F.least(F.col("p_copies") - F.col("p_used"), F.col("l_copies") - F.col("l_used"))
        )
        won = settle(won.select(
            "p_sig", "l_sig", "score", F.col("p_used").alias("p_from"), F.col("l_used").alias("l_from"), "taken"
        ), "taken")
        taken = won if taken is None else taken.unionByName(won)
        # A side takes part in one edge a round, so its use is at most one row.
        used_p, used_l = won.select("p_sig", F.col("taken").alias("_up")), won.select("l_sig", F.col("taken").alias("_ul"))
        left = settle(
            left.join(won.select("p_sig", "l_sig"), ["p_sig", "l_sig"], "left_anti").join(used_p, "p_sig", "left").join(used_l, "l_sig", "left")
            .withColumn("p_used", F.col("p_used") + F.coalesce("_up", zero)).withColumn("l_used", F.col("l_used") + F.coalesce("_ul", zero))
            .filter("p_used < p_copies AND l_used < l_copies").drop("_up", "_ul"),
            "open-edges",
        )
    if taken is None:
        return edges.select("p_sig", "l_sig", "score", zero.alias("p_from"), zero.alias("l_from"), zero.alias("taken")).limit(0)
    return taken


def tie_break(*keys: str) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))


def number_copies(prepared: DataFrame, key: str) -> DataFrame:
    """(key, sig, nth): position of each row among the copies of its signature in key order, from 0."""
    placed = place_in_group(prepared.select(key, "sig"), ["sig"], [F.col(key)], "place")
    return placed.select(key, "sig", (F.col("place") - 1).alias("nth"))


def _edges(mine: DataFrame, theirs: DataFrame, at_least: int, phones_only: bool = False, places: bool = True) -> DataFrame:
    scored = match_score_places(candidate_pairs(mine, theirs, phones_only, places), at_least)
    given = [F.col(f"{mark}_used") for mark in ("p", "l") if f"{mark}_used" in scored.columns]
    return scored.select(
        F.col("p_id").alias("p_sig"), F.col("l_id").alias("l_sig"), "score", "p_copies", "l_copies",
        F.col("p_first_key").alias("p_first"), F.col("l_first_key").alias("l_first"), *given,
    )


def _left_over(signed: DataFrame, taken: DataFrame, mark: str) -> DataFrame:
    """Signatures that have copies left, with the number of those that are gone."""
    gone = taken.groupBy(F.col(f"{mark}_sig").alias("id")).agg(F.max(F.col(f"{mark}_from") + F.col("taken")).alias("_gone"))
    before = F.col("used") if "used" in signed.columns else F.lit(0).cast("bigint")
    return signed.join(gone, "id", "left").withColumn("used", F.coalesce("_gone", before)).drop("_gone").filter("used < copies")


def link(register: DataFrame, listings: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Whole linkage: block, score, assign. register: provider_id, name, phone, address, comune, lat, lng;
    listings: listing_id and the same. Returns (provider_id, listing_id, score).

    Rows that look the same are scored once as a signature and told apart only in the assignment, so a block
    full of copies yields one pair, not all of them. As the highest score is taken first, pairs that score more than is
    possible without a common phone are assigned before the others are even looked for, among what is left; so are, after
    them, pairs that score more than is possible without the surname. Only what is left then meets at places."""
    p, l = settle(prepare(register, "provider_id"), "register"), settle(prepare(listings, "listing_id"), "listings")
    number = F.monotonically_increasing_id()  # stands for the signature on edges
    mine, theirs = settle(signatures(p, "provider_id").withColumn("id", number), "signatures"), settle(signatures(l, "listing_id").withColumn("id", number), "signatures")
    sure = pick_match(_edges(mine, theirs, max(threshold, _WITHOUT_PHONE + 1), phones_only=True), threshold)
    p_left, l_left = settle(_left_over(mine, sure, "p"), "left-over"), settle(_left_over(theirs, sure, "l"), "left-over")
    known = pick_match(_edges(p_left, l_left, max(threshold, _WITHOUT_SURNAME + 1), places=False), threshold, "edges-by-name")
    rest = _edges(_left_over(p_left, known, "p"), _left_over(l_left, known, "l"), threshold)
    named = lambda df, mark: df.select(F.col("id").alias(f"{mark}_id"), F.col("sig").alias(f"{mark}_sig"))
    won = sure.unionByName(known).unionByName(pick_match(rest, threshold)).withColumnsRenamed({"p_sig": "p_id", "l_sig": "l_id"})
    won = won.join(named(mine, "p"), "p_id").join(named(theirs, "l"), "l_id").drop("p_id", "l_id")
    spread = won.filter("taken > 0")
    of_register = number_copies(p, "provider_id").withColumnRenamed("sig", "p_sig").withColumnRenamed("nth", "p_nth")
    of_listings = number_copies(l, "listing_id").withColumnRenamed("sig", "l_sig").withColumnRenamed("nth", "l_nth")
    by_provider = of_register.join(spread, "p_sig").filter((F.col("p_nth") >= F.col("p_from")) & (F.col("p_nth") < F.col("p_from") + F.col("taken")))
    wanted = by_provider.withColumn("l_nth", F.col("p_nth") - F.col("p_from") + F.col("l_from"))
    return wanted.join(of_listings, ["l_sig", "l_nth"]).select("provider_id", "listing_id", "score")


def first_match_wins(scored: DataFrame, key: str, try_order: str, candidate: str, threshold: int = THRESHOLD) -> DataFrame:
    """The first candidate in try order that reaches the threshold."""
    return scored.filter(F.col("score") >= threshold).groupBy(key).agg(
        F.min_by(F.struct(candidate, "score"), F.struct(try_order, candidate)).alias("m")
    ).select(key, f"m.{candidate}", "m.score")


# After the match

def extract_services(texts: DataFrame, text: Column, phrases: dict[str, list[str]] | None = None) -> DataFrame:
    """(all columns, slug, evidence): services whose phrases occur in the normalised text, with the first
    phrase of the list that does. The list is a literal of the plan; each text is read once."""
    table = phrases or SERVICE_PHRASES
    plain = normalize_accents(text)

    def fold(s: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))

    def first(text_: Column, words_: list[str]) -> Column:
        out = F
        for w in words_:
            out = out.when(F.contains(text_, F.lit(fold(w))), F.lit(w))
        return out

    # The text is bound to a lambda variable, so it is normalised once per row.
    found = lambda t: F.array(*[
        F.struct(F.lit(slug).alias("slug"), first(t, words_).alias("evidence")) for slug, words_ in table.items()
    ])
    return texts.select("*", F.inline(F.filter(
        F.flatten(F.transform(F.array(plain), found)), lambda s: s["evidence"].isNotNull()
    )))


def service_evidence(matched: DataFrame, evidence: DataFrame, taxonomy: DataFrame, source: str) -> DataFrame:
    """Declared services of matched providers: canonical service, confidence from the match score up to .95."""
    canonical = taxonomy.select("slug", F.coalesce("canonical_id", "service_id").alias("service_id"))
    rows = matched.join(evidence, "listing_id").join(canonical, "slug").withColumn(
        "confidence", F.least(F.col("score") / 100, F.lit(0.95))
    )
    return top_per_group(
        rows.select("provider_id", "service_id", F.lit(source).alias("source"), "confidence", "evidence"),
        ["provider_id", "service_id", "source"], [F.col("confidence").desc(), F.col("evidence")], 1,
    )


def record_no_match(checked: DataFrame, matched: DataFrame, source: str, now: Column) -> DataFrame:
    """Observations for every provider checked: completed where matched, else no_match, with the time."""
    hit = matched.select("provider_id").distinct().withColumn("_hit", F.lit(True))
    return checked.select("provider_id").distinct().join(hit, "provider_id", "left").select(
        "provider_id", F.lit(source).alias("source"),
        F.when(F.col("_hit"), "completed").otherwise("no_match").alias("status"), now.alias("checked_at"),
    )


def geocode_apply(providers: DataFrame, gazetteer: DataFrame, country: str = "Italia") -> DataFrame:
    """Coordinates by exact address text. gazetteer: address, lat, lng (null for addresses known to be
    unknown). Adds geocode = present, completed, empty, outside or pending; only gaps are filled."""
    parts = [F.nullif(F.trim(c), F.lit("")) for c in ("address", "cap", "comune")]
    key = F.concat_ws(", ", *parts, F.lit(country))
    known = gazetteer.select(F.col("address").alias("_key"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), F.lit(True).alias("_known"))
    rows = providers.withColumn("_key", key).join(known, "_key", "left")
    missing = F.col("lat").isNull() | F.col("lng").isNull()
    good = in_bbox(F.col("_lat"), F.col("_lng"), GEOCODE_BOX)
    state = (
        F.when(~missing, "present").when(F.col("_known").isNull(), "pending")
        .when(F.col("_lat").isNull() | F.col("_lng").isNull(), "empty").when(good, "completed").otherwise("outside")
    )
    rows = rows.withColumn("geocode", state)
    use = F.col("geocode") == "completed"
    return rows.withColumns({
        "lat": F.when(use, F.coalesce("lat", "_lat")).otherwise(F.col("lat")),
        "lng": F.when(use, F.coalesce("lng", "_lng")).otherwise(F.col("lng")),
    }).drop("_key", "_lat", "_lng", "_known")


def lookup_by_slug(urls: DataFrame, providers: DataFrame, done: DataFrame, path_head: str) -> DataFrame:
    """Profile URLs whose last path part is a provider's slug, below a given path, not yet processed."""
    found = urls.filter(F.contains("url", F.lit(f"/{path_head}/"))).withColumn("slug", url_last_segment(F.col("url"))).filter("slug <> ''")
    return found.join(providers.select("provider_id", "slug"), "slug").join(done.select("provider_id").distinct(), "provider_id", "left_anti")

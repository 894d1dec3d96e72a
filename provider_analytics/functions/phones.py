"""Phone numbers of the national plan (country code 39) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: where one number ends and the next begins; a slash after the area code does not split.
_NUMBER_BREAK = (
    r"\s*(?:[,;|]|\r?\n)\s*|(?<=\d)\s+(?=(?:\+?39\s*)?(?:0\d{1,4}\s*[/.-]|3\d{2}\b))"
)


def phone_digits(value: Column) -> Column:
    """Digits only, without the country code."""
    digits = F.regexp_replace(F.coalesce(value, F.lit("")), r"\D", "")
    return (
        F.when(digits.startswith("0039"), digits.substr(F.lit(5), F.length(digits)))
        .when(digits.startswith("39") & (F.length(digits) > 10), digits.substr(F.lit(3), F.length(digits)))
        .otherwise(digits)
    )


def _first_per_digits(chunks: Column) -> Column:
    """Keep the first chunk for each digit string, in order."""
    keys = F.transform(chunks, phone_digits)
    return F.filter(chunks, lambda c, i: F.array_position(keys, phone_digits(c)) == i + 1)


def phone_split(value: Column) -> Column:
    """Separate numbers written in one field; 6 to 11 digits each, repeats dropped."""
    text = F.trim(F.regexp_replace(F.replace(F.coalesce(value, F.lit("")), F.lit(" "), F.lit(" ")), r"\s+", " "))
    chunks = F.transform(F.split(text, _NUMBER_BREAK), lambda c: F.trim(c))
    valid = F.filter(chunks, lambda c: F.length(phone_digits(c)).between(6, 11))
    return _first_per_digits(valid)


def phone_tokens(value: Column) -> Column:
    """The looser variant used by listing sites: digit strings of seven or more, as a set."""
    chunks = F.split(F.coalesce(value, F.lit("")), r"[;,/]|(?:\s+-\s+)")
    return F.array_distinct(
        F.filter(F.transform(chunks, _strip_both_prefixes), lambda d: F.length(d) >= 7)
    )


def _strip_both_prefixes(value: Column) -> Column:
    """Here both prefixes may be stripped one after the other."""
    digits = F.regexp_replace(value, r"\D", "")
    digits = F.when(digits.startswith("0039"), digits.substr(F.lit(5), F.length(digits))).otherwise(digits)
    return F.when(
        digits.startswith("39") & (F.length(digits) > 10), digits.substr(F.lit(3), F.length(digits))
    ).otherwise(digits)


def phone_e164(value: Column) -> Column:
    """International form of the first number in the field, null when there is none."""
    numbers = phone_split(value)
    first = F.when(F.size(numbers) > 0, F.get(numbers, F.lit(0))).otherwise(value)
    digits = phone_digits(first)
    return F.when(digits != "", F.concat(F.lit("+39"), digits))


def street_number(value: Column, normal: bool = False) -> Column:
    """First house number of one to five digits in normalised text, empty when there is none. With `normal` the text is
    normalised already."""
    from .text import normalize_query

    return F.regexp_extract(value if normal else normalize_query(value), r"\b(\d{1,5})(?:\s*[/\\-]?\s*[a-z])?\b", 1)

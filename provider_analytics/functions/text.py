"""Text normalisation as column expressions: no Python per row, everything stays in codegen."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Words that carry no meaning in a free-text service query.
SERVICE_STOP_WORDS = [
    "a", "al", "alla", "alle", "ai", "agli", "da", "dal", "dalla", "di", "del", "della",
    "dei", "delle", "e", "il", "la", "le", "lo", "i", "gli", "in", "l", "mio", "mia",
    "miei", "mie", "un", "una", "uno", "per", "con", "ma", "che", "come", "quanto",
    "costa", "vorrei", "voglio", "posso", "ancora",
]
# Words ignored when names are compared.
NAME_STOP_WORDS = [
    "notaio", "notai", "notarile", "studio", "dott", "dottore", "dr", "avv", "avvocato",
    "associato", "associati",
]
# Words ignored when street addresses are compared.
ADDRESS_STOP_WORDS = [
    "via", "viale", "piazza", "piazzale", "corso", "strada", "largo", "della", "delle",
    "degli", "dei", "del", "di", "italia",
]
# Queries made only of these name no person and no service.
GENERIC_TERMS = [
    "notaio", "notai", "notaro", "notari", "studio", "studi", "studio notarile",
    "studi notarili", "cerca", "ricerca",
]
# Words that never identify a person inside a URL or host name.
URL_NAME_STOP_WORDS = ["notaio", "notai", "studio", "notarile"]
# What is left when UTF-8 text was read as Latin-1, and what it stood for, in repair order.
MOJIBAKE = [
    ("\u00e2\u0080\u0099", "\u2019"),
    ("\u00c3\u00a0", "\u00e0"),
    ("\u00c3\u00a8", "\u00e8"),
    ("\u00c3\u00a9", "\u00e9"),
    ("\u00c3\u00ac", "\u00ec"),
    ("\u00c3\u00b2", "\u00f2"),
    ("\u00c3\u00b9", "\u00f9"),
    ("\u00c3\u0080", "\u00c0"),
    ("\u00c2", ""),
    ("\u00c3 ", "\u00e0 "),
    ("\u00c3\u0088", "\u00c8"),
]

_BLOCKS = [(0x00A0, 0x0250), (0x0370, 0x0530), (0x1E00, 0x2000), (0x2000, 0x2190), (0xFB00, 0xFB07),
           (0xFF01, 0xFF5F)]


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Compatibility decomposition without marks, worked out from the Unicode tables for the Latin,
    Greek, Cyrillic and punctuation blocks: one-to-one pairs for translate, the rest as replacements."""
    source, target, longer = [], [], []
    for start, end in _BLOCKS:
        for code in range(start, end):
            char = chr(code)
            folded = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
            if folded == char or not folded:
                continue
            if len(folded) == 1:
                source.append(char)
                target.append(folded)
            else:
                longer.append((char, folded))
    return "".join(source), "".join(target), tuple(longer)


def fold_accents(value: Column) -> Column:
    """Accents off, compatibility forms to their plain letters."""
    source, target, longer = _folding()
    folded = F.regexp_replace(F.translate(value, source, target), "[̀-ͯ]", "")
    # Letters that become several are rare; deleting them is a cheap way to see whether there are any. The
    # map is one folded literal, which keeps the expression small.
    rare = "".join(char for char, _ in longer)
    table = F.str_to_map(F.lit("\x01".join(f"{char}\x02{plain}" for char, plain in longer)), F.lit("\x01"), F.lit("\x02"))
    spelled = F.array_join(
        F.transform(F.split(folded, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), ""
    )
    return F.when(F.translate(folded, rare, "") == folded, folded).otherwise(spelled)


def normalize_query(value: Column) -> Column:
    """Lower-case letters and digits separated by single spaces; null becomes the empty string."""
    plain = F.lower(fold_accents(F.coalesce(value, F.lit(""))))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def normalize_accents(value: Column) -> Column:
    """The weaker form: accents off, lower case, white space squeezed; punctuation stays."""
    plain = F.lower(fold_accents(F.coalesce(value, F.lit(""))))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def slugify(value: Column) -> Column:
    plain = F.lower(fold_accents(F.coalesce(value, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-|-$", "")


def title_case(value: Column) -> Column:
    """First letter of each part upper case; spaces and hyphens kept as they are."""
    parts = F.regexp_extract_all(F.lower(value), F.lit(r"([\s-]+|[^\s-]+)"), 1)
    raised = F.transform(
        parts,
        lambda p: F.when(
            p.rlike("^[a-zàèéìòù]"), F.concat(F.upper(p.substr(1, 1)), p.substr(F.lit(2), F.length(p)))
        ).otherwise(p),
    )
    return F.array_join(raised, "")


def tokens(value: Column, stop_words: list[str], min_length: int, normal: bool = False) -> Column:
    """Words of the normalised text in order, repeats kept. With `normal` the text is normalised already."""
    stop = F.array(*[F.lit(w) for w in stop_words]) if stop_words else F.array().cast("array<string>")
    return F.filter(
        F.split(value if normal else normalize_query(value), " "),
        lambda t: (F.length(t) >= min_length) & ~F.array_contains(stop, t),
    )


def service_tokens(value: Column) -> Column:
    return tokens(value, SERVICE_STOP_WORDS, 2)


def name_tokens(value: Column, normal: bool = False) -> Column:
    return F.array_distinct(tokens(value, NAME_STOP_WORDS, 3, normal))


def address_tokens(value: Column, normal: bool = False) -> Column:
    return F.array_distinct(tokens(value, ADDRESS_STOP_WORDS, 3, normal))


def words(value: Column) -> Column:
    return F.array_distinct(tokens(value, [], 2))


def url_name_tokens(value: Column) -> Column:
    """Lower-case words of at least four letters (accented ones kept) that may occur in a URL."""
    found = F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit("([a-zàèéìòù]+)"), 1)
    stop = F.array(*[F.lit(w) for w in URL_NAME_STOP_WORDS])
    return F.filter(found, lambda t: (F.length(t) >= 4) & ~F.array_contains(stop, t))


def is_generic_query(value: Column) -> Column:
    """True for blank text and for text made only of generic words."""
    text = normalize_query(value)
    generic = F.array(*[F.lit(w) for w in GENERIC_TERMS])
    return (
        (text == "")
        | F.array_contains(generic, text)
        | F.forall(F.split(text, " "), lambda t: F.array_contains(generic, t))
    )


def meaningful_query(value: Column) -> Column:
    return F.when(is_generic_query(value), F.lit("")).otherwise(F.trim(value))


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def split_name(value: Column) -> tuple[Column, Column]:
    """(first names, last name); a single word is a first name."""
    clean = F.trim(F.regexp_replace(value, r"\s+", " "))
    parts = F.split(clean, " ")
    many = F.size(parts) >= 2
    first = F.when(many, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), " "))
    return F.coalesce(first, blank_to_null(clean)), F.when(many, F.element_at(parts, -1))


def parse_iso_date(value: Column) -> Column:
    text = F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def fix_mojibake(value: Column) -> Column:
    """Undo UTF-8 read as a one-byte code page; text without the tell-tale letters is not touched."""
    fixed = value
    for broken, right in MOJIBAKE:
        fixed = F.replace(fixed, F.lit(broken), F.lit(right))
    return F.when(value.rlike("[ÃÂâ]"), fixed).otherwise(value)


def website_url(value: Column) -> Column:
    raw = F.trim(value)
    return (
        F.when(raw.isNull() | (raw == ""), F.lit(None).cast("string"))
        .when(raw.rlike("(?i)^https?://"), raw)
        .when(raw.startswith("//"), F.concat(F.lit("https:"), raw))
        .otherwise(F.concat(F.lit("https://"), F.regexp_replace(raw, "^/+", "")))
    )


def url_host(value: Column) -> Column:
    """Host name in lower case without port and without a leading www."""
    host = F.lower(F.regexp_extract(value, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def url_path(value: Column) -> Column:
    path = F.regexp_extract(value, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(path, "/+$", "")


def url_last_segment(value: Column) -> Column:
    return F.lower(F.element_at(F.split(url_path(value), "/"), -1))


def indexable_url(value: Column) -> Column:
    """A URL with a query string is never indexable."""
    return ~F.contains(value, F.lit("?"))


def domain_matches_name(url: Column, name: Column, blocked: list[str] = ()) -> Column:
    """The host, letters and digits only, holds a name word of four letters or more."""
    host = url_host(url)
    compact = F.regexp_replace(host, "[^a-z0-9]", "")
    stop = F.array(*[F.lit(w) for w in URL_NAME_STOP_WORDS])
    useful = F.filter(words(name), lambda t: (F.length(t) >= 4) & ~F.array_contains(stop, t))
    bad = F.lit(False)
    for item in blocked:
        bad = bad | F.contains(host, F.lit(item))
    return (host != "") & ~bad & F.exists(useful, lambda t: F.contains(compact, t))


def sanitize_html(value: Column) -> Column:
    """Drop document scaffolding (doctype, html, head, body tags) and every script and iframe."""
    out = value
    for pattern in (
        r"(?i)<!doctype[^>]*>",
        r"(?i)</?html[^>]*>",
        r"(?is)<head[^>]*>.*?</head>",
        r"(?i)</?body[^>]*>",
        r"(?is)<script[^>]*>.*?</script>",
        r"(?is)<iframe[^>]*>.*?</iframe>",
    ):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(out)


def split_heading(value: Column) -> tuple[Column, Column]:
    """(markup of the first h1 or the empty string, the markup without it)."""
    heading = F.regexp_extract(value, r"(?is)(<h1\b[^>]*>.*?</h1>)", 1)
    at = F.position(heading, value)
    rest = F.concat(value.substr(F.lit(1), at - 1), value.substr(at + F.length(heading), F.length(value)))
    return heading, F.when(heading == "", value).otherwise(F.trim(rest))


def xml_escape(value: Column) -> Column:
    # The five predefined XML entities.
    out = value
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def register_sql_functions(spark: SparkSession) -> None:
    """The scalar SQL function of the data model, as a SQL UDF that Catalyst inlines."""
    source, target, longer = _folding()
    quote = lambda s: s.replace("\\", "\\\\").replace("'", "\\'")
    spelled = quote("\x01".join(f"{char}\x02{plain}" for char, plain in longer))
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION normalize_service_search_term(value STRING) RETURNS STRING
        RETURN trim(regexp_replace(lower(array_join(transform(split(regexp_replace(
            translate(coalesce(value, ''), '{quote(source)}', '{quote(target)}'), '[\\u0300-\\u036f]', ''), ''),
            c -> coalesce(try_element_at(str_to_map('{spelled}', '\x01', '\x02'), c), c)), '')), '[^a-z0-9]+', ' '))
    """)

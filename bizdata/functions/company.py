"""Columns over company names, places and dates."""

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .presence import as_col, blank_to_null


# --- names ------------------------------------------------------------------------------------

def company_key(c: Column | str) -> Column:
    v = F.regexp_replace(F.lower(as_col(c)), rules.LEGAL_WORDS_IN_KEYS, "")
    return F.regexp_replace(v, "[^a-z0-9]", "")


def company_slug(c: Column | str) -> Column:
    """Match key in profile-address spelling (a key, not a fact about the company)."""
    v = F.regexp_replace(F.lower(as_col(c)), rules.LEGAL_WORDS_IN_SLUGS, "")
    v = F.trim(F.regexp_replace(v, r"[^a-z0-9\s-]", ""))
    return F.regexp_replace(v, r"\s+", "-")


def registration_key(c: Column | str) -> Column:
    return F.translate(F.upper(as_col(c)), "- ", "")


def trading_name(c: Column | str) -> Column:
    v = as_col(c)
    for ending in rules.NAME_ENDINGS:
        v = F.regexp_replace(v, rf"(?i)\s+{ending}$", "")
    return F.trim(v)


def name_variants(c: Column | str) -> Column:
    """Distinct names a company may trade under: full, without legal form, first word, first two."""
    full = as_col(c)
    short = trading_name(full)
    words = F.split(short, r"\s+")
    several = F.size(words) >= 2
    made = F.array(
        full,
        short,
        F.when(several, F.get(words, F.lit(0))),
        F.when(several, F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1)))),
    )
    return F.filter(F.array_distinct(F.array_compact(made)), lambda n: F.length(n) >= 3)


def letters_only(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), "[^a-zA-Z]", "")


def spam_reasons(c: Column | str) -> Column:
    """Array of the reasons why a company name is refused, in clean-up order; empty when acceptable."""
    c = as_col(c)
    lower, n = F.lower(c), F.length(c)
    n_foreign = F.length(F.regexp_replace(c, r"\p{ASCII}", ""))
    few_letters = F.length(letters_only(c)) < 3
    phrase = (F.exists(F.array(*[F.lit(p) for p in rules.SPAM_PHRASES]), lambda p: F.contains(lower, p))
              | (F.contains(lower, F.lit("best ")) & F.contains(lower, F.lit(" 20"))))
    url = F.exists(F.array(*[F.lit(p) for p in rules.URL_PARTS]), lambda p: F.contains(c, p))
    return F.array_compact(F.array(
        F.when((n_foreign > 0) & (few_letters | (n_foreign > n * 0.3)), F.lit("non_english")),
        F.when(phrase, F.lit("spam_phrase")),
        F.when(c.isNull() | (n < 3) | (F.trim(c) == ""), F.lit("too_short")),
        F.when(n > 100, F.lit("too_long")),
        F.when(url, F.lit("url_in_name")),
        F.when(few_letters, F.lit("few_letters")),
    ))


def discoverable_name(c: Column | str) -> Column:
    """Name test applied to newly found companies before they are stored."""
    c = as_col(c)
    ok = F.length(c).between(2, 100) & c.rlike("[a-zA-Z]{2,}") & ~c.rlike(rules.DISCOVERY_SPAM)
    return F.coalesce(ok, F.lit(False))


def headline_name(c: Column | str, country: Column | str) -> Column:
    """Scraped headline, odd length or digits only; UK and country-less rows are never flagged."""
    c = as_col(c)
    lower = F.lower(c)
    phrase = F.exists(F.array(*[F.lit(p) for p in rules.HEADLINE_PHRASES]), lambda p: F.contains(lower, p))
    bad = phrase | ~F.length(c).between(3, 100) | c.rlike("^[0-9]+$")
    return F.coalesce(bad & (as_col(country) != "United Kingdom"), F.lit(False))


def gibberish(c: Column | str) -> Column:
    return F.coalesce(as_col(c).rlike(rules.GIBBERISH), F.lit(False))


def char_similarity(a: Column | str, b: Column | str) -> Column:
    """0..1: length ratio when one contains the other, else share of the longer covered by letters of the shorter."""
    a, b = as_col(a), as_col(b)
    longer = F.when(F.length(a) > F.length(b), a).otherwise(b)
    shorter = F.when(F.length(a) > F.length(b), b).otherwise(a)
    shared = F.size(F.filter(F.split(shorter, ""), lambda ch: (ch != "") & F.contains(longer, ch)))
    score = F.when(F.contains(longer, shorter), F.length(shorter) / F.length(longer)).otherwise(
        shared / F.length(longer))
    return F.when((a == "") | (b == "") | a.isNull() | b.isNull(), F.lit(0.0)).otherwise(score)


# --- places -----------------------------------------------------------------------------------

def is_uk(c: Column | str) -> Column:
    """True for a country text naming the UK or one of its nations (substring, any case)."""
    return F.coalesce(as_col(c).rlike("(?i)" + "|".join(rules.UK_COUNTRIES)), F.lit(False))


def norm_country(c: Column | str) -> Column:
    c = as_col(c)
    found = F.when(F.lit(False), c)
    for name in rules.HOME_NATIONS:
        found = found.when(F.lower(c) == name.lower(), F.lit(name))
    return found.otherwise(blank_to_null(c))


def split_location(c: Column | str) -> Column:
    """struct(city, country) of 'City, …, Country'; a single part is a country."""
    parts = F.filter(F.transform(F.split(as_col(c), ","), lambda p: F.trim(p)), lambda p: p != "")
    n = F.size(parts)
    return F.struct(
        F.when(n > 1, F.get(parts, F.lit(0))).alias("city"),
        F.when(n > 0, F.get(parts, n - 1)).alias("country"),
    )


def parse_address(c: Column | str) -> Column:
    parts = F.transform(F.split(blank_to_null(c), ","), lambda p: F.trim(p))
    n = F.size(parts)

    def part(i: Column) -> Column:
        return blank_to_null(F.get(parts, i))

    return F.struct(
        part(F.lit(0)).alias("line1"),
        part(n - 3).alias("locality"),
        part(n - 2).alias("region"),
        part(n - 1).alias("postal_code"),
    )


def full_address(*parts: Column | str) -> Column:
    return F.concat_ws(", ", *[blank_to_null(p) for p in parts])


def extract_address(c: Column | str) -> Column:
    """US street address in a text, else the text around the first UK postcode."""
    c = as_col(c)
    us = F.regexp_extract(c, rules.US_ADDRESS, 0)
    postcode = F.regexp_extract(c, rules.UK_POSTCODE, 0)
    at = F.instr(c, postcode)
    start = F.greatest(at - 100, F.lit(1))
    around = F.trim(F.substring(c, start, at + 50 - start))
    return F.when(us != "", us).when(postcode != "", around)


def extract_html_address(html: Column | str) -> Column:
    """UK address line that ends in the first postcode of a page."""
    html = as_col(html)
    postcode = F.regexp_extract(html, rules.UK_POSTCODE_LOOSE, 0)
    at = F.instr(html, postcode)
    start = F.greatest(at - 150, F.lit(1))
    context = F.substring(html, start, at + 20 - start)
    context = F.trim(F.regexp_replace(F.regexp_replace(context, "<[^>]*>", " "), r"\s+", " "))
    line = F.trim(F.regexp_extract(context, rules.UK_ADDRESS_LINE, 0))
    return F.when((postcode != "") & F.length(context).between(16, 199), blank_to_null(line))


def place_priority(place_type: Column | str, population: Column | str) -> Column:
    t, pop = as_col(place_type), F.coalesce(as_col(population), F.lit(0))
    return (F.when((t == "city") & (pop > 100000), 1)
            .when((t == "city") | ((t == "town") & (pop > 10000)), 2)
            .when(t.isin("town", "village"), 3)
            .when(t.isin("suburb", "neighbourhood"), 4)
            .otherwise(5))


def jurisdiction_country(j: Column | str, other: Column | None = None) -> Column:
    """'gb' and 'us_*' to country names ('_' is any one character); other codes to `other` or NULL."""
    j = as_col(j)
    named = F.when(j == "gb", F.lit("United Kingdom")).when(j.like("us_%"), F.lit("United States"))
    return named if other is None else named.otherwise(other)


def jurisdiction_state(j: Column | str, other: Column | None = None) -> Column:
    j = as_col(j)
    named = F.when(j == "us_ny", F.lit("New York")).when(j == "us_ca", F.lit("California"))
    return named if other is None else named.otherwise(other)


# --- dates ------------------------------------------------------------------------------------

def uk_date(c: Column | str) -> Column:
    return F.try_to_date(F.trim(as_col(c)), "d/M/yyyy")


def as_time(value: datetime | date | str | Column) -> Column:
    """An explicit point in time; nothing in this library reads the clock."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def before(as_of: datetime | str | Column, **duration: int) -> Column:
    """The moment `duration` (days=, hours=, minutes=) before as_of."""
    t = as_time(as_of)
    for unit, n in duration.items():
        t = t - F.expr(f"INTERVAL '{int(n)}' {unit.rstrip('s').upper()}")
    return t


def is_recent(ts: Column | str, days: int, as_of: datetime | str | Column) -> Column:
    return F.coalesce(as_col(ts) > before(as_of, days=days), F.lit(False))

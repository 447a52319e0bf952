"""Columns over person names and job titles."""

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .presence import as_col, blank_to_null


def parse_name(c: Column | str) -> Column:
    """struct(first, last, initial, last_initial) of a full name; a single word has last = ''."""
    text = F.regexp_replace(F.trim(F.lower(as_col(c))), r"[^a-z\s-]", "")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.size(words)
    first = F.get(words, F.lit(0))
    last = F.when(n > 1, F.get(words, n - 1)).when(n == 1, F.lit(""))
    return F.struct(
        first.alias("first"),
        last.alias("last"),
        F.left(first, F.lit(1)).alias("initial"),
        F.when(n > 1, F.left(last, F.lit(1))).alias("last_initial"),
    )


def clean_name(c: Column | str) -> Column:
    """Lead name without bullets, ordinals, tags and odd characters; see too_long."""
    v = F.trim(as_col(c))
    for pattern in rules.LEAD_NAME_NOISE:
        v = F.regexp_replace(v, pattern, "")
    return F.trim(F.regexp_replace(v, r"\s{2,}", " "))


def too_long(c: Column | str, most: int = 60) -> Column:
    """A lead name so long that it is hardly one name; the name itself is kept whole."""
    return F.length(clean_name(c)) > most


def first_word(c: Column | str) -> Column:
    return blank_to_null(F.regexp_extract(as_col(c), r"^(\S+)", 1))


def other_words(c: Column | str) -> Column:
    return blank_to_null(F.regexp_extract(as_col(c), r"^\S+\s+(.*)$", 1))


def officer_contact(name: Column | str, role: Column | str, resigned: Column | str) -> Column:
    """struct(first_name, last_name, job_title) of an active, non-secretary officer, else NULL."""
    parts = F.transform(F.split(as_col(name), ","), lambda p: F.trim(p))
    last = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    given = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    proper = F.concat(F.left(last, F.lit(1)), F.lower(F.substr(last, F.lit(2))))
    last = F.when((last == F.upper(last)) & (F.length(last) > 1), proper).otherwise(last)
    role = as_col(role)
    title = F.when(F.lit(False), F.lit(""))
    for key, value in rules.OFFICER_TITLES.items():
        title = title.when(role == key, F.lit(value))
    usable = as_col(resigned).isNull() & (F.coalesce(role, F.lit("")) != "secretary") & (F.length(given) >= 2)
    return F.when(usable, F.struct(
        F.split_part(given, F.lit(" "), F.lit(1)).alias("first_name"),
        last.alias("last_name"),
        title.otherwise(F.lit("Director")).alias("job_title"),
    ))


def _name_shape(first: Column, last: Column) -> Column:
    return (F.length(first).between(2, 15) & F.length(last).between(2, 25)
            & first.rlike(r"^[a-z'-]+$") & last.rlike(r"^[a-z'-]+$"))


def person_shape_ok(first: Column | str, last: Column | str) -> Column:
    """The dictionary-free part of the strict person-name rule."""
    f, l = F.lower(F.trim(as_col(first))), F.lower(F.trim(as_col(last)))
    ok = (_name_shape(f, l) & ~f.rlike(rules.WORD_ENDINGS_STRICT) & ~l.rlike(rules.WORD_ENDINGS_STRICT)
          & ~l.isin(*rules.NOT_A_SURNAME) & (f != l))
    return F.coalesce(ok, F.lit(False))


def plausible_first(c: Column | str) -> Column:
    """Lenient test of the shape of a first name; quality.plausible_first_names asks dictionaries as well."""
    name = F.lower(F.trim(as_col(c)))
    ok = F.length(name).between(4, 15) & name.rlike(r"^[a-z'-]+$") & ~name.rlike(rules.WORD_ENDINGS_LENIENT)
    return F.coalesce(ok, F.lit(False))


def plausible_person(first: Column | str, last: Column | str, known: Column | None = None,
                     blocked: Column | None = None) -> Column:
    """Person-name test of the contact clean-up.

    `known` / `blocked` say whether the first name is in a dictionary of first names, and whether
    either part is in a dictionary of words that are not names (both from joins; absent = no).
    """
    f, l = F.lower(F.trim(as_col(first))), F.lower(F.trim(as_col(last)))
    known = F.lit(False) if known is None else F.coalesce(known, F.lit(False))
    blocked = F.lit(False) if blocked is None else F.coalesce(blocked, F.lit(False))
    base = (~blocked & _name_shape(f, l) & ((F.length(f) <= 12) | known) & (F.length(l) <= 15)
            & ~f.rlike(rules.COMMON_LEADING_WORDS))
    unusual = (F.length(f) >= 3) & ~f.rlike(rules.WORD_ENDINGS_CLEANUP) & ~l.rlike(rules.WORD_ENDINGS_CLEANUP)
    return F.coalesce(base & (known | unusual), F.lit(False))


# --- job titles -------------------------------------------------------------------------------

def valid_title(c: Column | str) -> Column:
    t = F.trim(as_col(c))
    ok = (F.length(t).between(3, 60) & ~t.rlike(r"(?i)[a-z]{20,}") & ~t.rlike(r"[<>{}()\[\]|\\/]")
          & ~t.rlike(rules.TITLE_GARBAGE))
    return F.coalesce(ok, F.lit(False))


def has_role(c: Column | str) -> Column:
    c = as_col(c)
    ok = (F.length(F.trim(c)) >= 3) & F.lower(c).rlike("|".join(rules.ROLE_WORDS))
    return F.coalesce(ok, F.lit(False))


def seniority(c: Column | str) -> Column:
    t = F.lower(as_col(c))
    level = F.when(t.isNull() | (t == ""), F.lit("Unknown"))
    for name, pattern in rules.SENIORITY:
        level = level.when(t.rlike(pattern), F.lit(name))
    return level.otherwise(F.lit("Unknown"))


def may_match(c: Column, pattern: str) -> Column:
    """False only if no text that lacks the words of a pattern of plain words can match it: a search for fixed words costs a
    fraction of a regular expression.  Other patterns may always match."""
    alternatives = pattern.replace(r"\b", "").split("|")
    if not all(re.fullmatch(r"(?:[a-z &]|[/-]\??)+", a) and re.search("[a-z]", a) for a in alternatives):
        return F.lit(True)
    return reduce(or_, (c.contains(max(re.findall("[a-z &]+", a), key=len)) for a in alternatives))


def canonical_title(c: Column | str) -> Column:
    """struct(title, tier) of the first matching management title, else NULL."""
    t = F.lower(as_col(c))
    found = F.when(t.isNull() | ~F.length(t).between(2, 80), F.lit(None))
    for pattern, title, tier in rules.MANAGEMENT_TITLES:
        found = found.when(may_match(t, pattern) & t.rlike(pattern), F.struct(F.lit(title).alias("title"), F.lit(tier).alias("tier")))
    return found


# --- free text about a person -----------------------------------------------------------------

def parse_bullets(c: Column | str) -> Column:
    """struct of lead fields from 'Name · Title at Company · City, Country' text."""
    text = as_col(c)
    bits = F.transform(F.split(text, r"\s*[·•|]\s*"), lambda p: F.trim(p))
    bulleted = F.size(bits) >= 3
    none = F.lit(None).cast("string")

    def bit(i: int) -> Column:
        return F.get(bits, F.lit(i))

    named = bulleted & bit(0).rlike(r"^[A-Z]\S*\s+\S")
    role = bit(1)
    with_at = bulleted & role.rlike(r"^(?s).+ at ")
    free, place = rules.BULLET_FREE, rules.BULLET_PLACE
    free_title = blank_to_null(F.trim(F.regexp_extract(text, free, 1)))
    free_company = blank_to_null(F.trim(F.regexp_extract(text, free, 2)))
    place_bit = F.get(F.filter(F.slice(bits, F.lit(3), F.greatest(F.size(bits), F.lit(1))),
                               lambda b: b.rlike("^" + place + "$")), F.lit(0))
    company_bit = F.when(~bit(2).rlike(r"^[A-Z][a-z]+, [A-Z]"), blank_to_null(bit(2)))

    def place_part(group: int) -> Column:
        in_bits = F.regexp_extract(place_bit, place, group)
        in_text = F.when(free_company.isNull(), F.regexp_extract(text, place, group))
        return blank_to_null(F.trim(F.when(bulleted, in_bits).otherwise(in_text)))

    return F.struct(
        F.when(named, first_word(bit(0))).alias("first_name"),
        F.when(named, other_words(bit(0))).alias("last_name"),
        F.when(with_at, blank_to_null(F.trim(F.regexp_extract(role, r"(?s)^(.+) at ", 1))))
        .when(bulleted, blank_to_null(role)).otherwise(free_title).alias("job_title"),
        F.when(with_at, blank_to_null(F.trim(F.regexp_extract(role, r"(?s)^.+ at ([^·•\n]*)", 1))))
        .when(bulleted & (role != ""), company_bit).when(bulleted, none).otherwise(free_company).alias("company"),
        place_part(1).alias("city"),
        place_part(2).alias("country"),
        blank_to_null(F.lower(F.regexp_extract(text, rules.BULLET_EMAIL, 0)))
        .alias("email"),
        blank_to_null(F.trim(F.regexp_extract(text, rules.BULLET_PHONE, 0))).alias("phone"),
    )

"""Phone-number columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .presence import as_col


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def extract_phones(c: Column | str, limit: int | None = None) -> Column:
    """Distinct US-shaped numbers in order of appearance; `limit` keeps the first few only on request."""
    found = F.array_distinct(_all(as_col(c), rules.US_PHONE))
    return found if limit is None else F.slice(found, 1, limit)


def _uk_digits(m: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(m, r"[\s.-]", ""), r"^\+?44", "0")


def extract_uk_phones(c: Column | str) -> Column:
    c = as_col(c)
    raw = F.concat(*[_all(c, p) for p in rules.UK_PHONES])
    cleaned = F.transform(raw, _uk_digits)
    good = F.filter(cleaned, lambda p: F.length(p).between(10, 12) & p.rlike(r"^0[1-9]"))
    return F.array_distinct(good)


def is_uk_place(country: Column | str) -> Column:
    return F.lower(as_col(country)).rlike("|".join(rules.UK_PHONE_PLACES))


def format_uk_phone(phone: Column | str, country: Column | str) -> Column:
    """+44 display form; NULL when the length is wrong; numbers of other countries are unchanged."""
    phone = as_col(phone)
    digits = F.regexp_replace(phone, r"\D", "")
    digits = F.regexp_replace(F.regexp_replace(digits, "^0", ""), "^44", "")

    def part(start: int, size: int) -> Column:
        return F.substring(digits, start, size)

    space = F.lit(" ")
    ten = F.concat(F.lit("+44 "), part(1, 4), space, part(5, 3), space, part(8, 9))
    eleven = F.concat(F.lit("+44 "), part(1, 3), space, part(4, 4), space, part(8, 9))
    uk = F.when(F.length(digits) == 10, ten).when(F.length(digits) == 11, eleven)
    return F.when(F.coalesce(is_uk_place(country), F.lit(False)), uk).otherwise(phone)


def uk_phone_valid(c: Column | str) -> Column:
    return F.coalesce(F.regexp_replace(as_col(c), r"[\s.-]", "").rlike(r"^0[1-9]\d{8,10}$"), F.lit(False))


def phone_problem(c: Column | str) -> Column:
    """Why a number of any country is refused, or NULL when it is acceptable."""
    c = as_col(c)
    digits = F.regexp_replace(c, r"\D", "")
    return (F.when(c.isNull() | (F.length(F.trim(c)) < 7), F.lit("too short"))
            .when(~F.length(digits).between(7, 15), F.lit("wrong digit count"))
            .when(digits.rlike(r"^(.)\1{6,}$"), F.lit("repeated digits"))
            .when(F.substring(digits, 1, 10).isin(*rules.PLACEHOLDER_NUMBERS),
                  F.lit("sequential/repeating digits")))


def phone_valid(c: Column | str) -> Column:
    return phone_problem(c).isNull()


def choose_phone(phones: Column | str) -> Column:
    """First number with a country code, else the first number."""
    phones = as_col(phones)
    return F.coalesce(F.get(F.filter(phones, lambda p: F.startswith(p, F.lit("+"))), F.lit(0)),
                      F.get(phones, F.lit(0)))


def _number_around(text: Column, name: Column) -> Column:
    at = F.instr(F.lower(text), F.lower(name))
    start = F.greatest(at - 200, F.lit(1))
    window = F.substring(text, start, at + 300 - start)
    found = F.concat(*[_all(window, p) for p in rules.UK_PHONES_NEAR_NAME])
    good = F.filter(F.transform(found, _uk_digits), lambda p: p.rlike(r"^0[1-9]\d{8,10}$"))
    return F.when(at > 0, F.get(good, F.lit(0)))


def phone_near(text: Column | str, first: Column | str, last: Column | str) -> Column:
    """UK number printed close to a person's name: the full name first, then the first name."""
    text, first = as_col(text), as_col(first)
    full = F.trim(F.concat_ws(" ", first, as_col(last)))
    return F.coalesce(_number_around(text, full), _number_around(text, first))

"""Rules for "has a value".  Two rules are in use and each operator states which one it follows."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c: Column | str) -> Column:
    """Not NULL and not the empty string; never NULL itself."""
    c = as_col(c)
    return c.isNotNull() & (c != "")


def missing(c: Column | str) -> Column:
    c = as_col(c)
    return c.isNull() | (c == "")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(as_col(c), F.lit(""))


def keep_old(new: Column | str, old: Column | str) -> Column:
    """A non-empty new value wins, otherwise the old value stays."""
    return F.coalesce(blank_to_null(new), as_col(old))


def fill(old: Column | str, new: Column | str) -> Column:
    """The old value wins unless it is empty."""
    return F.coalesce(blank_to_null(old), as_col(new))


def flag(cond: Column) -> Column:
    """1 when the condition is true, 0 when it is false or NULL."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def count_present(c: Column | str) -> Column:
    return F.count_if(present(c))


def icontains(c: Column | str, text: str) -> Column:
    """Case-insensitive substring test; the text is taken literally, not as a LIKE pattern."""
    return F.contains(F.lower(as_col(c)), F.lit(text.lower()))

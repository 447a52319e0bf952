"""Row scores over account columns."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .presence import flag, present


def weighted(weights: Sequence[tuple[str, int]]) -> Column:
    """Sum of the weights of the columns that hold a value."""
    total = F.lit(0)
    for name, weight in weights:
        total = total + F.when(present(name), weight).otherwise(0)
    return total


def enrichment_score() -> Column:
    """0..4: website, e-mail pattern, phone, profile."""
    return (flag(present("website")) + flag(present("email_format"))
            + flag(present("phone_number")) + flag(present("linkedin_url")))


def quality_score(contact_count: Column | str = "contact_count") -> Column:
    """0..100: field weights plus 4 per contact for up to five contacts."""
    count = F.col(contact_count) if isinstance(contact_count, str) else contact_count
    contacts = F.least(F.coalesce(count, F.lit(0)), F.lit(5)) * 4
    return F.least(weighted(rules.QUALITY_WEIGHTS) + contacts, F.lit(100)).cast("int")


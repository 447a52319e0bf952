"""Every occurrence of a pattern in a text, with the text around it."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .presence import as_col


def occurrences(c: Column | str, pattern: str, before: int, after: int, least: int) -> Column:
    """array of struct(found, before, after): all matches in their order, with at most `before` characters up to each and
    `after` from its end on. `least` is the length that the shortest match has.

    The text is cut at the matches once, long pieces between them are reduced to their two ends, and a context is put
    together from as many neighbouring pieces as can lie within it. Linear in the text, however many matches it has.
    """
    text = as_col(c)
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    short = F.transform(pieces, lambda p: F.when(F.length(p) > before + after, F.concat(F.left(p, F.lit(after)), F.right(p, F.lit(before)))).otherwise(p))
    steps = F.zip_with(short, found, lambda p, m: F.struct(p.alias("p"), F.coalesce(m, F.lit("")).alias("m")))

    def of(all_: Column) -> Column:
        def at(i: Column, match: Column) -> Column:
            back = -(-before // least) + 1
            start = F.greatest(i + 1 - back, F.lit(0))  # from 0
            led = F.array_join(F.transform(F.slice(all_, start + 1, i - start), lambda s: F.concat(s["p"], s["m"])), "")
            led = F.concat(led, F.get(all_, i)["p"])
            followed = F.array_join(F.transform(F.slice(all_, i + 2, F.lit(-(-after // least) + 1)), lambda s: F.concat(s["p"], s["m"])), "")
            return F.struct(match.alias("found"), F.right(led, F.lit(before)).alias("before"), F.left(followed, F.lit(after)).alias("after"))

        return F.transform(found, lambda m, i: at(i, m))

    # bound once: the pieces are not cut anew for every match
    return F.get(F.transform(F.array(steps), of), F.lit(0))

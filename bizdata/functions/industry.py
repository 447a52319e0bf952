"""Industry columns: ordered keyword rules turned into JVM expressions."""

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .presence import as_col, present


def _first_contained(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    found = F.when(F.lit(False), F.lit(""))
    for keyword, industry in pairs:
        found = found.when(F.contains(text, F.lit(keyword)), F.lit(industry))
    return found


def sic_text_industry(c: Column | str) -> Column:
    return _first_contained(F.lower(as_col(c)), rules.SIC_TEXT).otherwise(F.lit("Other"))


def sic_prefix_industry(c: Column | str, detailed: bool = False) -> Column:
    """Industry of a code's first two digits; `detailed` uses the wider table and its own default."""
    table = rules.SIC_DIVISIONS_DETAILED if detailed else rules.SIC_DIVISIONS
    default = "Professional Services" if detailed else "Other"
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    c = as_col(c)
    known = F.coalesce(F.try_element_at(lookup, F.substring(c, 1, 2)), F.lit(default))
    return known if detailed else F.when(c.isNotNull(), known)


# --- keyword rules: one search for all keywords -----------------------------------------------

def keyword_patterns(words: Iterable[str]) -> list[str]:
    """Patterns that find every place of every word, overlapping ones too, as group 1.

    A look-ahead takes no characters, so each character of a text is tried once. At one place a pattern gives one word;
    words that begin with another word of the list go to a further pattern, so that no place of a word is lost. Words
    that begin alike share their branches.
    """
    groups: list[list[str]] = []
    for word in sorted(set(words), key=lambda w: (len(w), w)):
        for group in groups:
            if not any(word.startswith(w) for w in group):
                group.append(word)
                break
        else:
            groups.append([word])

    def branches(rest: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for word in rest:
            if word:
                heads.setdefault(word[0], []).append(word[1:])
        parts = [re.escape(head) + branches(tails) for head, tails in sorted(heads.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})" if parts else ""

    return [f"(?=[{re.escape(''.join(sorted({w[0] for w in group})))}])(?=({branches(group)}))" for group in groups]


def _rule_table(key: Callable[[str], str]) -> Column:
    """The keyword rules as one constant array of (label, word -> weight); the weight is the length of the keyword as
    written, outer space included."""
    def text(value: str) -> str:
        return "'" + value.replace("'", "\\'") + "'"

    def weights(keywords: list[str]) -> str:
        summed: dict[str, int] = {}
        for word in keywords:
            summed[key(word)] = summed.get(key(word), 0) + len(word)
        return ", ".join(f"{text(word)}, {weight}" for word, weight in summed.items())

    return F.expr("array(" + ", ".join(
        f"named_struct('label', {text(label)}, 'weights', map({weights(keywords)}))" for label, keywords in rules.INDUSTRY_KEYWORDS) + ")")


def _best(text: Column, key: Callable[[str], str], counted: bool, at_least: int) -> Column:
    """Label of the rule whose keywords, as `key` writes them, weigh most in the text, each counted once or (`counted`) as often as
    it can be taken out; the earlier rule on ties; NULL below `at_least`."""
    words = {key(word) for _, keywords in rules.INDUSTRY_KEYWORDS for word in keywords}
    # a word that begins as it ends may overlap itself; its places are then more than its occurrences
    own_overlap = [w for w in sorted(words) if any(w.startswith(w[i:]) for i in range(1, len(w)))]

    def judge(t: Column, hits: Column) -> Column:
        def times(word: Column) -> Column:
            taken_out = (F.length(t) - F.length(F.replace(t, word, F.lit("")))) / F.length(word)
            return F.when(word.isin(*own_overlap), taken_out.cast("int")).otherwise(F.size(F.filter(hits, lambda h: h == word)))

        found = F.transform(F.array_distinct(hits), lambda w: F.struct(w.alias("word"), (times(w) if counted else F.lit(1)).alias("n")))
        return F.get(F.transform(F.array(found), label), F.lit(0))

    def label(found: Column) -> Column:
        scored = F.transform(_rule_table(key), lambda r, i: F.struct(
            F.aggregate(found, F.lit(0), lambda total, f: total + f["n"] * F.coalesce(F.try_element_at(r["weights"], f["word"]), F.lit(0))).alias("score"),
            (-i).alias("rank"), r["label"].alias("label")))
        return F.array_max(F.filter(scored, lambda r: r["score"] >= at_least))["label"]

    def searched(t: Column) -> Column:
        hits = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in keyword_patterns(words)])
        return F.get(F.transform(F.array(hits), lambda h: F.when(F.size(h) > 0, judge(t, h))), F.lit(0))

    # bound as lambda variables, so that the text, its hits and their counts are computed once
    return F.get(F.transform(F.array(text), searched), F.lit(0))


def industry_by_name(c: Column | str) -> Column:
    """Industry whose keywords cover most letters of the name; longer keywords weigh more."""
    return _best(F.concat(F.lit(" "), F.lower(as_col(c)), F.lit(" ")), str.lower, counted=False, at_least=1)


def industry_by_text(page_text: Column | str) -> Column:
    """Industry with the largest sum of keyword occurrences x length in the text, when that is >= 10."""
    return _best(F.lower(as_col(page_text)), lambda word: word.lower().strip(), counted=True, at_least=rules.PAGE_TEXT_THRESHOLD)


def norm_industry(c: Column | str) -> Column:
    """Standard name for a free-text industry: first synonym contained, else the keyword rules."""
    c = as_col(c)
    mapped = _first_contained(F.lower(c), rules.INDUSTRY_SYNONYMS)
    return F.when(present(c), mapped.otherwise(industry_by_name(c)))


def industry_hint(description: Column | str) -> Column:
    return _first_contained(F.lower(as_col(description)), rules.DESCRIPTION_HINTS).otherwise(
        F.lit(None).cast("string"))


def needs_classification(c: Column | str) -> Column:
    c = as_col(c)
    return c.isNull() | c.isin(*rules.UNCLASSIFIED)


def needs_normalisation(c: Column | str) -> Column:
    c = as_col(c)
    return present(c) & ~c.isin(*rules.STANDARD_INDUSTRIES)

"""E-mail pattern mining, generated addresses and verification (A-31, A-32, X-07, P-22, P-23, P-35)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.email import (apply_pattern, guarded, candidate_locals, detect_pattern, email_score, email_score_detailed,
                               fallback_pattern, is_generic, is_personal,
                               local_part, mail_domain, site_emails)
from ..functions.names import parse_name
from ..functions.nearby import occurrences
from ..functions.presence import blank_to_null, missing, present
from ..functions.web import domain, visible_text
from .keys import compute_once, first_n, keep_first


def best_pattern(emails: DataFrame) -> DataFrame:
    """A-31: most frequent pattern per domain, the earlier one on ties.

    Input (domain, email, first_name, last_name, pos).  A domain without any detectable pattern gets
    the coarse pattern of its first address.
    """
    seen = compute_once(emails, _pattern=detect_pattern("email", "first_name", "last_name"))
    counted = (seen.filter(F.col("_pattern").isNotNull()).groupBy("domain", "_pattern")
               .agg(F.count(F.lit(1)).alias("_n"), F.min("pos").alias("_pos")))
    top = keep_first(counted, ["domain"], [F.desc("_n"), F.asc("_pos"), F.asc("_pattern")])
    first = emails.groupBy("domain").agg(F.min(F.struct("pos", "email"))["email"].alias("_email"))
    out = first.join(top, "domain", "left")
    return out.select(
        "domain", F.coalesce("_pattern", fallback_pattern("_email", "domain")).alias("email_format"),
        F.coalesce("_n", F.lit(0)).alias("n_addresses")).filter(F.col("email_format").isNotNull())


def confirm_pattern(contacts: DataFrame, per_domain: int | None = None) -> DataFrame:
    """A-32: pattern that rebuilds most of the known addresses of a domain, the more usual one on ties.

    Input (domain, full_name, email, pos).  `per_domain` limits how many contacts vote, on request.
    """
    known = contacts if per_domain is None else first_n(contacts, ["domain"], per_domain, [F.asc("pos")])
    named = compute_once(known, _name=parse_name("full_name"))
    email = F.lower("email")
    locals_ = candidate_locals(F.col("_name.first"), F.col("_name.last"))
    agreeing = F.filter(
        F.transform(locals_, lambda x, i: F.when(F.concat(x, F.lit("@"), F.col("domain")) == email, i)), lambda i: i.isNotNull())
    votes = named.select("domain", F.explode(agreeing).alias("_i")).groupBy("domain", "_i").agg(
        F.count(F.lit(1)).alias("confirmed"))
    best = keep_first(votes, ["domain"], [F.desc("confirmed"), F.asc("_i")])
    patterns = F.array(*[F.lit(p) for p in rules.EMAIL_PATTERNS])
    return best.select("domain", F.get(patterns, F.col("_i")).alias("pattern"), "confirmed")


def page_emails(pages: DataFrame) -> DataFrame:
    """Addresses on pages that belong to the page's own host: (domain, email, first_name, last_name, pos).

    The name is the pair of capitalised words nearest to any place where the page prints the address, within 120
    characters before or after it; a mail link to the address is a place at no distance from the pair in its own text.
    Of equally near ones the one before the address counts, then the first on the page.
    """
    read = compute_once(pages.select("page_id", "url", "html"), domain=domain("url"), _text=visible_text("html"), _emails=site_emails("html"))
    listed = read.select("page_id", "domain", F.posexplode("_emails").alias("_i", "email"))

    def pair(text: Column, place: int) -> Column:
        return F.try_element_at(F.regexp_extract_all(text, F.lit(rules.FULL_NAME_PAIR), F.lit(0)), F.lit(place))

    printed = compute_once(read, _places=occurrences("_text", guarded(rules.EMAIL_ON_SITE), 120, 120, least=6)).select(
        "page_id", "domain", F.posexplode("_places").alias("_k", "_p"))
    named = compute_once(printed, _left=pair(F.col("_p.before"), -1), _right=pair(F.col("_p.after"), 1))

    def gap(side: str, name: str, count: int) -> Column:
        return F.length(F.call_function("substring_index", F.col(f"_p.{side}"), F.col(name), F.lit(count)))

    around = named.select("page_id", "domain", "_k", F.lower("_p.found").alias("email"), F.explode(F.array(
        F.struct(gap("before", "_left", -1).alias("_gap"), F.lit(1).alias("_side"), F.col("_left").alias("_name")),
        F.struct(gap("after", "_right", 1).alias("_gap"), F.lit(2).alias("_side"), F.col("_right").alias("_name")))).alias("_c")).select(
        "page_id", "domain", "email", "_k", "_c.*")
    links = F.arrays_zip(F.regexp_extract_all("html", F.lit(rules.MAILTO_LINK), F.lit(1)).alias("to"),
                         F.regexp_extract_all("html", F.lit(rules.MAILTO_LINK), F.lit(2)).alias("said"))
    linked = compute_once(read, _links=links).select("page_id", "domain", F.posexplode("_links").alias("_k", "_l"))
    linked = compute_once(linked, _name=pair(F.regexp_replace("_l.said", "<[^>]+>", " "), 1)).select(
        "page_id", "domain", F.lower("_l.to").alias("email"), "_k", F.lit(0).alias("_gap"), F.lit(0).alias("_side"), "_name")
    nearest = around.unionByName(linked).where(F.col("_name").isNotNull()).groupBy("page_id", "domain", "email").agg(
        F.min(F.struct("_gap", "_side", "_k", "_name"))["_name"].alias("_name"))
    stem = F.split_part("domain", F.lit("."), F.lit(1))
    host = mail_domain("email")
    near = listed.filter((host == F.col("domain")) | F.contains(host, stem)).join(nearest, ["page_id", "domain", "email"], "left")

    def part(group: int) -> Column:
        return F.nullif(F.regexp_extract("_name", rules.FULL_NAME_PAIR, group), F.lit(""))

    return near.select("domain", "email", part(1).alias("first_name"), part(2).alias("last_name"), F.struct("page_id", "_i").alias("pos"))


def mine_patterns(accounts: DataFrame, pages: DataFrame) -> DataFrame:
    """P-22: pattern per account, from the personal addresses on pages of its host."""
    people = page_emails(pages).filter(~is_generic("email"))
    patterns = best_pattern(people)
    wanted = accounts.filter(missing("email_format") | ~F.startswith("email_format", F.lit("{")))
    hosts = wanted.select("account_id", domain("website").alias("domain")).dropna(subset=["domain"])
    return hosts.join(patterns, "domain").select("account_id", "domain", "email_format", "n_addresses")


def personal_page_emails(pages: DataFrame) -> DataFrame:
    """(domain, email) -> first place (pos) of each personal address at a page's own host."""
    read = compute_once(pages.select("page_id", "url", "html"), domain=domain("url"), _emails=site_emails("html"))
    found = read.select("domain", "page_id", F.posexplode("_emails").alias("_i", "email"))
    own = found.filter((mail_domain("email") == F.col("domain")) & is_personal("email") & (F.length(local_part("email")) <= 64))
    return own.groupBy("domain", "email").agg(F.min(F.struct("page_id", "_i")).alias("pos"))


def name_part_index(pages: DataFrame, names: DataFrame) -> DataFrame:
    """(domain, part) -> first personal address on the host whose local part contains `part`, for `names` (domain, part).

    A local part has at most 64 characters (RFC 5321); longer runs before an @ are no address. It is cut into pieces of the
    lengths that the names asked of its host have, so "contains the name" is an equi-join, and nothing grows with
    contacts times addresses of a host.
    """
    sizes = (names.select("domain", F.length("part").alias("n")).where(F.col("n").between(1, 64)).groupBy("domain")
             .agg(F.collect_set("n").alias("_sizes")))  # at most 64 numbers a host
    local = local_part("email")
    cut = personal_page_emails(pages).join(sizes, "domain")
    pieces = F.flatten(F.transform(F.filter("_sizes", lambda n: n <= F.length(local)), lambda n: F.transform(
        F.sequence(F.lit(1), F.length(local) - n + 1), lambda at: F.substr(local, at, n))))
    return (cut.select("domain", "email", "pos", F.explode(F.array_distinct(pieces)).alias("part"))
            .groupBy("domain", "part").agg(F.min(F.struct("pos", "email")).alias("hit")))


def mail_link_index(pages: DataFrame) -> DataFrame:
    """(domain, part) -> first personal address of a mail link that has the name `part` within 500 characters of the page
    source, for single words and pairs of words one space apart. Every link and every mention counts."""
    read = compute_once(pages.select("page_id", "url", "html"), domain=domain("url"), _links=occurrences("html", rules.MAILTO, 500, 500, least=8))
    rows = read.select("page_id", "domain", F.posexplode("_links").alias("_k", "_l"))
    email = F.split_part(F.lower(F.substring("_l.found", 8, 1000)), F.lit("?"), F.lit(1))
    around = F.lower(F.concat("_l.before", F.lit("\n"), "_l.after"))
    words = F.regexp_extract_all(around, F.lit(r"[a-z'-]+"), F.lit(0))
    pairs = F.regexp_extract_all(around, F.lit(r"(?<![a-z'-])(?=([a-z'-]+ [a-z'-]+))"), F.lit(1))
    made = compute_once(rows, email=email).where(F.contains("email", F.lit("@")) & is_personal("email"))
    return (made.select("domain", "page_id", "_k", "email", F.explode(F.array_distinct(F.concat(words, pairs))).alias("part"))
            .groupBy("domain", "part").agg(F.min(F.struct("page_id", "_k", "email"))["email"].alias("linked")))


def contact_sites(contacts: DataFrame, accounts: DataFrame) -> DataFrame:
    sites = accounts.select(F.col("account_id").alias("linked_account_id"), domain("website").alias("domain"), "email_format")
    return contacts.join(sites, "linked_account_id", "left")


def fill_emails(contacts: DataFrame, accounts: DataFrame, pages: DataFrame) -> DataFrame:
    """P-23: an address for contacts without one; adds email_source (page / pattern) and email_generated.

    First the personal address on the company's pages that contains the first or last name, else the personal address of
    a mail link near the full name, else the company's pattern.  An address built from a pattern is marked as generated
    and never as verified.
    """
    todo = contacts.filter(missing("email") & present("first_name") & ~F.col("first_name").isin("General", "Contact"))
    keyed = (contact_sites(todo, accounts).withColumn("_first", F.lower("first_name")).withColumn("_last", F.lower(blank_to_null("last_name")))
             .withColumn("_full", F.lower(F.trim(F.concat_ws(" ", "first_name", "last_name")))))
    asked = keyed.select("domain", F.explode(F.array("_first", "_last")).alias("part")).dropna().distinct()
    index = name_part_index(pages, asked)
    by_first = index.select("domain", F.col("part").alias("_first"), F.col("hit").alias("_hit1"))
    by_last = index.select("domain", F.col("part").alias("_last"), F.col("hit").alias("_hit2"))
    by_link = mail_link_index(pages).withColumnRenamed("part", "_full")
    matched = (keyed.join(by_first, ["domain", "_first"], "left").join(by_last, ["domain", "_last"], "left")
               .join(by_link, ["domain", "_full"], "left"))
    found = F.coalesce(F.array_min(F.array_compact(F.array("_hit1", "_hit2")))["email"], F.col("linked"))
    built = F.when(F.startswith("email_format", F.lit("{")), apply_pattern(
        "email_format", "first_name", "last_name", "domain", missing_last="unknown"))
    out = matched.withColumn("_found", found).withColumn("_built", built)
    return out.withColumn("email", F.coalesce("_found", "_built")).withColumn(
        "email_source", F.when(F.col("_found").isNotNull(), F.lit("page")).when(F.col("_built").isNotNull(), F.lit("pattern"))
    ).withColumn("email_generated", F.col("email_source") == "pattern").select(
        *contacts.columns, "email_source", "email_generated")


def score_emails(df: DataFrame, facts: DataFrame, detailed: bool = False) -> DataFrame:
    """X-07 / X-08: verification score of every row's e-mail; facts are one row per address."""
    known = facts.select(F.lower("email").alias("_email"), "mx_count", "smtp_result", "catch_all")
    joined = df.join(known, F.lower(F.trim("email")) == F.col("_email"), "left")
    result = (email_score_detailed("email", "mx_count", "smtp_result", "catch_all") if detailed
              else email_score("email", "mx_count", "smtp_result"))
    return joined.withColumn("_r", result).select(*df.columns, "_r.*")


def verify_contacts(contacts: DataFrame, facts: DataFrame) -> DataFrame:
    """P-35: results of all contacts with a not yet judged address."""
    todo = contacts.filter(present("email") & F.col("email_verified").isNull())
    return score_emails(todo, facts)


def verify_counts(contacts: DataFrame, facts: DataFrame) -> DataFrame:
    """P-35: number of addresses per result."""
    return verify_contacts(contacts, facts).groupBy("valid", "reason").agg(F.count(F.lit(1)).alias("n"))

"""Joins (J-01 … J-11, J-15 … J-18, J-22 … J-26).

Join strategy is left to Spark: dimensions below spark.sql.autoBroadcastJoinThreshold are broadcast
from their real size, everything else is shuffled, and adaptive execution splits hot keys.  One side of
every join here is unique on the key.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.presence import present
from ..functions.web import domain
from .keys import counts, nest


def with_locations(companies: DataFrame, countries: DataFrame, states: DataFrame, cities: DataFrame,
                   districts: DataFrame | None = None) -> DataFrame:
    """J-01: the country must exist, the finer levels may be missing."""
    out = (companies
           .join(countries.select("country_id", "country_name"), "country_id")
           .join(states.select("state_id", "state_name"), "state_id", "left")
           .join(cities.select("city_id", "city_name"), "city_id", "left"))
    if districts is not None:
        out = out.join(districts.select("district_id", "district_name"), "district_id", "left")
    return out


def contacts_with_account(contacts: DataFrame, accounts: DataFrame) -> DataFrame:
    """J-02."""
    company = accounts.select(
        "account_id", "company_name", "website", F.col("country").alias("account_country"),
        F.col("city").alias("account_city"), F.col("industry").alias("account_industry"))
    return contacts.join(company, F.col("linked_account_id") == F.col("account_id"), "left").drop("account_id")


def with_contact_count(accounts: DataFrame, contacts: DataFrame) -> DataFrame:
    """J-03: missing counts are 0."""
    per_account = counts(contacts, "linked_account_id", "contact_count")
    out = accounts.join(per_account, F.col("account_id") == F.col("linked_account_id"), "left")
    return out.withColumn("contact_count", F.coalesce("contact_count", F.lit(0))).drop("linked_account_id")


def nest_contacts(companies: DataFrame, contacts: DataFrame, key: str = "id",
                  child_key: str = "company_id", fields: Sequence[str] = ("contact_type", "value"),
                  order: Sequence[str] = ("contact_type", "value"), parts: int = 1) -> DataFrame:
    """J-04: see keys.nest for `parts`."""
    return nest(companies, contacts, key, child_key, fields, order, "contacts", parts)


def nest_active_officers(companies: DataFrame, officers: DataFrame, parts: int = 1) -> DataFrame:
    """J-05: only officers without a resignation are nested; companies without any survive."""
    active = officers.filter(F.col("resigned_date").isNull()).withColumnRenamed("id", "officer_id")
    return nest(companies, active, "id", "company_id", ("name", "role", "appointed_date"),
                ("officer_id",), "officers", parts)


def company_officers(companies: DataFrame, officers: DataFrame, active_only: bool = False) -> DataFrame:
    """J-06: officers with their company and an is_active flag."""
    names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    out = officers.join(names, "company_id").withColumn("is_active", F.col("resigned_date").isNull())
    return out.filter("is_active") if active_only else out


def nest_appointments(officers: DataFrame, companies: DataFrame, parts: int = 1) -> DataFrame:
    """J-07: one row per officer name, appointments newest first."""
    dated = company_officers(companies, officers).select(
        F.col("name").alias("officer_name"),
        F.date_diff(F.lit("9999-12-31").cast("date"), "appointed_date").alias("age_order"),
        "appointed_date", "resigned_date", "company_name", "role", F.col("id").alias("appointment_id"))
    people = officers.select("name").distinct()
    return nest(people, dated, "name", "officer_name",
                ("company_name", "role", "appointed_date", "resigned_date"),
                ("age_order", "appointment_id"), "appointments", parts)


def without(df: DataFrame, other: DataFrame, on: Sequence[tuple[str, str]],
            condition: Column | None = None) -> DataFrame:
    """J-08, J-09: rows with no partner among the (filtered) rows of `other`."""
    partners = other if condition is None else other.filter(condition)
    keys = partners.select(*[F.col(theirs).alias(f"_{i}") for i, (_, theirs) in enumerate(on)])
    match = [F.col(mine) == F.col(f"_{i}") for i, (mine, _) in enumerate(on)]
    return df.join(keys, match, "left_anti")


def without_officers(companies: DataFrame, officers: DataFrame) -> DataFrame:
    return without(companies, officers, [("id", "company_id")])


def orphans(contacts: DataFrame, accounts: DataFrame) -> DataFrame:
    """J-10: contacts that point to no account.  Contacts that point nowhere are not orphans."""
    linked = contacts.filter(F.col("linked_account_id").isNotNull())
    return without(linked, accounts, [("linked_account_id", "account_id")])


def having_contacts(accounts: DataFrame, contacts: DataFrame) -> DataFrame:
    """J-11."""
    keys = contacts.select(F.col("linked_account_id").alias("account_id"))
    return accounts.join(keys, "account_id", "left_semi")


def areas_with_counts(areas: DataFrame, accounts: DataFrame) -> DataFrame:
    """J-15: finished areas with today's number of accounts, ignoring letter case."""
    places = ("city", "state_region", "country")
    totals = accounts.groupBy(*[F.lower(p).alias("_" + p) for p in places]).agg(
        F.count(F.lit(1)).alias("current_companies"))
    on = [F.lower(F.col(p)) == F.col("_" + p) for p in places]
    out = areas.join(totals, on, "left").drop(*["_" + p for p in places])
    return out.withColumn("current_companies", F.coalesce("current_companies", F.lit(0)))


def counts_by_dim(dim: DataFrame, companies: DataFrame, key: str) -> DataFrame:
    """J-16: every member of a dimension with its number of companies, 0 included."""
    per_key = counts(companies, key, "company_count")
    return dim.join(per_key, key, "left").withColumn("company_count", F.coalesce("company_count", F.lit(0)))


def match_any(new: DataFrame, old: DataFrame, new_id: str = "new_id") -> DataFrame:
    """J-17, J-18: for every new contact the lowest id of an existing one that shares its e-mail, phone,
    profile, or name and account (a missing account equals a missing account); unmatched rows are absent.

    One equi-join per key instead of a disjunctive join.  The existing side is reduced to one row per
    key value first, so a value shared by very many contacts costs one row, not a product.
    """
    person = [F.lower("first_name"), F.lower("last_name"),
              F.coalesce(F.col("linked_account_id").cast("string"), F.lit("<none>"))]
    keys: dict[str, list[Column]] = {
        "email": [F.col("email")], "phone_number": [F.col("phone_number")],
        "linkedin_url": [F.col("linkedin_url")], "person": person}
    hits = None
    for parts in keys.values():
        named = [c.alias(f"_k{i}") for i, c in enumerate(parts)]
        columns = [f"_k{i}" for i in range(len(parts))]
        known = old.select(*named, "contact_id").dropna(subset=columns).groupBy(*columns).agg(
            F.min("contact_id").alias("matched_id"))
        hit = new.select(new_id, *named).dropna(subset=columns).join(known, columns).select(new_id, "matched_id")
        hits = hit if hits is None else hits.unionByName(hit)
    return hits.groupBy(new_id).agg(F.min("matched_id").alias("matched_id"))


def contacts_with_validation(contacts: DataFrame, validations: DataFrame) -> DataFrame:
    """J-22."""
    facts = validations.select("contact_id", "email_valid", "email_score", "phone_valid")
    return contacts.join(facts, "contact_id", "left")


def first_containing(stored: DataFrame, text: Column, stored_id: str, needles: DataFrame, needle: str, mark: str = ".") -> DataFrame:
    """For each distinct `needle` the lowest `stored_id` whose text contains it anywhere: (needle, hit); the others are absent.

    A needle is found around its first `mark`: every mark of a stored text is a place where it may lie, and what lies
    there is cut out in the shapes (characters before the first mark, and from it on) that occur among the needles. So a
    text gives marks times shapes keys, not all its pieces, and the match is an equi-join on whole needles. Needles without the mark
    are cut out at every place in the lengths that occur among them. Only names of hosts are meant: needles of more than 253
    characters match nothing. Keys are reduced to their lowest id before the shuffle, so a site of very many rows is one key a task.
    """
    wanted = needles.select(F.col(needle).alias("_needle")).where(F.col("_needle").isNotNull() & F.length("_needle").between(1, 253)).distinct()
    before = F.instr("_needle", F.lit(mark)) - 1
    shapes = wanted.agg(F.collect_set(F.when(before >= 0, F.struct(before.alias("left"), (F.length("_needle") - before).alias("right")))).alias("_shapes"),
                        F.collect_set(F.when(before < 0, F.length("_needle"))).alias("_sizes"))
    # one row: at most 253 sizes, and as many shapes as a label of a host and the rest of one can make
    texts = stored.select(F.col(stored_id).alias("_id"), text.alias("_text")).where(F.col("_text").isNotNull() & (F.col("_text") != "")).join(F.broadcast(shapes))
    # where the marks are: the lengths of the parts between them, added up
    parts = F.transform(F.split("_text", F.lit("\\" + mark)), lambda p: F.length(p) + 1)
    ends = F.aggregate(parts, F.array(F.lit(0)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))
    marks = F.slice(ends, F.lit(2), F.greatest(F.size(ends) - 2, F.lit(0)))
    at_marks = F.flatten(F.transform(marks, lambda at: F.transform("_shapes", lambda s: F.when(
        (at - s["left"] >= 1) & (at + s["right"] - 1 <= F.length("_text")), F.substr("_text", at - s["left"], s["left"] + s["right"])))))
    fitting = F.filter("_sizes", lambda n: n <= F.length("_text"))
    everywhere = F.flatten(F.transform(fitting, lambda n: F.transform(F.sequence(F.lit(1), F.length("_text") - n + 1), lambda at: F.substr("_text", at, n))))
    keys = texts.select("_id", F.explode(F.array_distinct(F.array_compact(F.concat(at_marks, everywhere)))).alias("_needle"))
    found = keys.groupBy("_needle").agg(F.min("_id").alias("hit"))
    return found.join(wanted, "_needle", "left_semi").select(F.col("_needle").alias(needle), "hit")


def possible_duplicates(new: DataFrame, accounts: DataFrame, new_id: str = "new_id") -> DataFrame:
    """J-24: lowest existing account with the same lower-case name, and the lowest one whose website contains the host of the
    new one, as in `https://shop.acme.test/home` for `acme.test`; letters of a website count as lower-case ones."""
    by_name = accounts.groupBy(F.lower("company_name").alias("_name")).agg(F.min("account_id").alias("name_match"))
    hosted = new.withColumn("_host", domain("website"))
    by_site = first_containing(accounts, F.lower("website"), "account_id", hosted, "_host").withColumnRenamed("hit", "site_match")
    return (hosted.join(by_name, F.lower("company_name") == F.col("_name"), "left")
            .join(by_site, "_host", "left")
            .filter(F.col("name_match").isNotNull() | F.col("site_match").isNotNull())
            .select(new_id, "name_match", "site_match"))


def match_name_or_address(new: DataFrame, accounts: DataFrame, new_id: str = "new_id", head: int = 30) -> DataFrame:
    """J-26: lowest existing account with the same name, or with an address that contains the first `head` characters of
    the new one (all of a shorter one).

    Stored addresses are indexed by their pieces of the lengths that occur among the new heads, at most `head` of
    them, so the match is an equi-join and the index grows with the stored text.
    """
    by_name = accounts.groupBy(F.lower("company_name").alias("_name")).agg(F.min("account_id").alias("name_match"))
    start = F.substring(F.lower("address"), 1, head)
    heads = new.filter(present("address")).select(start.alias("_head")).distinct().withColumn("_size", F.length("_head"))
    sizes = heads.agg(F.collect_set("_size").alias("_sizes"))  # one row of at most `head` numbers
    stored = accounts.filter(present("address")).select("account_id", F.lower("address").alias("_text")).join(F.broadcast(sizes))
    pieces = stored.select("account_id", "_text", F.explode("_sizes").alias("_size")).filter(F.length("_text") >= F.col("_size")).select(
        "account_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("_text") - F.col("_size") + 1),
                                            lambda at: F.substring(F.col("_text"), at, F.col("_size")))).alias("_piece"))
    by_address = (pieces.join(heads.select("_head"), F.col("_piece") == F.col("_head"), "left_semi")
                  .groupBy(F.col("_piece").alias("_head")).agg(F.min("account_id").alias("address_match")))
    return (new.join(by_name, F.lower("company_name") == F.col("_name"), "left")
            .join(by_address, start == F.col("_head"), "left")
            .filter(F.col("name_match").isNotNull() | F.col("address_match").isNotNull())
            .select(new_id, "name_match", "address_match"))


def company_detail(companies: DataFrame, contacts: DataFrame, sources: DataFrame,
                   parts: int = 1) -> DataFrame:
    """J-23: company with nested contacts and nested sources.

    Both children are nested by themselves and meet on (company, part), so a company with many of both
    gives as many rows as the longer list needs, not their product.
    """
    ids = companies.select("id")
    people = nest(ids, contacts, "id", "company_id", ("contact_type", "value"), ("contact_type", "value"), "contacts", parts)
    origins = nest(ids, sources, "id", "company_id", ("source_name", "reliability"), ("source_name",), "sources", parts)
    both = people.join(origins, ["id", "part"], "full_outer")
    for name in ("contacts", "sources"):
        both = both.withColumn(name, F.coalesce(name, F.array().cast(both.schema[name].dataType)))
    return companies.join(both, "id")


def set_primary(contacts: DataFrame, choice: DataFrame, key: str = "linked_account_id") -> DataFrame:
    """W-04: the chosen contact of a company is primary, its other contacts are not.

    `choice` has one row per company: the key and `chosen_id`.  Companies without a choice are unchanged.
    """
    out = contacts.join(choice.select(key, "chosen_id"), key, "left")
    primary = F.when(F.col("chosen_id").isNotNull(), F.col("contact_id") == F.col("chosen_id")).otherwise(F.col("is_primary"))
    return out.withColumn("is_primary", primary).select(*contacts.columns)


def known_names(names: DataFrame, companies: DataFrame, accounts: DataFrame) -> DataFrame:
    """U-02: rows of `names` (column name) whose lower-case name exists in either table."""
    both = (companies.select(F.lower("name").alias("_known"))
            .union(accounts.select(F.lower("company_name"))).distinct())
    return names.join(both, F.lower("name") == F.col("_known"), "left_semi")

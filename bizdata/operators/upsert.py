"""Writes as table algebra: old state + delta -> new state (P-01 … P-10, P-34, P-36 … P-41, P-43, P-44).

Parquet has no MERGE, so every job returns the complete new state for an atomic folder swap.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.company import (as_time, company_key, discoverable_name, jurisdiction_country,
                                 jurisdiction_state)
from ..functions.presence import blank_to_null, present
from ..session import cut_lineage
from .joins import without
from .keys import keep_first

REGISTRY_FIELDS = ("name", "legal_name", "company_type", "status", "incorporation_date", "address_line_1",
                   "address_line_2", "locality", "region", "postal_code", "country", "data_source")
FOUND_FIELDS = ("website", "phone", "email", "description", "industry", "employee_count", "annual_revenue")
CSV_FIELDS = ("name", "status", "company_type")
WIDE_CSV_FIELDS = ("name", "legal_name", "company_type", "status", "incorporation_date", "address_line_1",
                   "address_line_2", "locality", "region", "postal_code", "country", "industry")


def new_key(hashed: Column) -> Column:
    """Non-negative key of a new row from a hash of what identifies it."""
    return F.pmod(hashed, F.lit(2 ** 62))


def latest(delta: DataFrame, keys: Sequence[str], seq: str | None) -> DataFrame:
    """Last row of a batch per key. Without an order column it is the greatest row, so the choice is the same at every run."""
    if seq is not None:
        return keep_first(delta, keys, [F.desc(seq)]).drop(seq)
    rest = [F.desc_nulls_last(c) for c in delta.columns if c not in keys]
    return keep_first(delta, keys, rest) if rest else delta.dropDuplicates(list(keys))


def keyed(df: DataFrame, keys: Sequence[str]) -> Column:
    """Whether every key column holds something: NULL and '' identify no row."""
    held = F.lit(True)
    for k in keys:
        held = held & (present(k) if df.schema[k].dataType.typeName() == "string" else F.col(k).isNotNull())
    return held


def merge_rows(old: DataFrame, delta: DataFrame, keys: Sequence[str], overwrite: Sequence[str] = (),
               prefer_new: Sequence[str] = (), prefer_filled: Sequence[str] = (),
               fill_empty: Sequence[str] = (), stamp: Mapping[str, Column] | None = None,
               insert: bool = True, seq: str | None = None, inserted: Mapping[str, Column] | None = None) -> DataFrame:
    """UPSERT with one rule per column.

    overwrite: new value, even NULL.  prefer_new: coalesce(new, old).  prefer_filled: as prefer_new,
    but '' counts as missing.  fill_empty: old value unless NULL or ''.  Other columns keep the old
    value.  Unmatched delta rows are inserted (if `insert`), with the values of `inserted` where they have none
    (columns over the delta row).  `stamp` sets columns of touched rows.

    Of delta rows with one key the last by `seq` counts, without it the greatest.  Rows whose key is NULL or '' match
    nothing: old ones stay as they are, delta ones are inserted each.  Old rows meet at most one delta row, so a hot
    old key can be split over tasks, and rows without a key take no part in the join.
    """
    held = delta.filter(keyed(delta, keys))
    loose = delta.filter(~keyed(delta, keys))
    loose = loose if seq is None else loose.drop(seq)
    fresh = latest(held, keys, seq)
    marked = fresh.select(*[F.col(c).alias(f"_n_{c}") for c in fresh.columns], F.lit(True).alias("_new"))
    on = [F.col(k) == F.col(f"_n_{k}") for k in keys]
    joined = old.filter(keyed(old, keys)).join(marked, on, "left")

    def value(c: str) -> Column:
        mine = F.col(c)
        if f"_n_{c}" not in joined.columns:
            result = mine
        else:
            theirs = F.col(f"_n_{c}")
            if c in overwrite:
                result = F.when(F.col("_new"), theirs).otherwise(mine)
            elif c in prefer_new:
                result = F.coalesce(theirs, mine)
            elif c in prefer_filled:
                result = F.coalesce(blank_to_null(theirs), mine)
            elif c in fill_empty:
                result = F.coalesce(blank_to_null(mine), theirs, mine)
            else:
                result = mine
        if stamp and c in stamp:
            result = F.when(F.col("_new"), stamp[c]).otherwise(result)
        return result.alias(c)

    out = joined.select(*[value(c) for c in old.columns]).unionByName(old.filter(~keyed(old, keys)))
    if not insert:
        return out
    made = {**(inserted or {}), **(stamp or {})}

    def new_value(c: str) -> Column:
        kind = old.schema[c].dataType
        if c in fresh.columns:
            result = F.coalesce(F.col(c), made[c].cast(kind)) if c in made and c not in (stamp or {}) else made[c] if c in made else F.col(c)
        else:
            result = made.get(c, F.lit(None))
        return result.cast(kind).alias(c)

    added = fresh.join(old.select(*keys).distinct(), list(keys), "left_anti").unionByName(loose)
    return out.unionByName(added.select(*[new_value(c) for c in old.columns]))


def upsert_companies(old: DataFrame, delta: DataFrame, as_of: str, seq: str | None = None) -> DataFrame:
    """P-01: registry fields overwrite, found fields survive a NULL; new companies get an id and a creation time."""
    return merge_rows(old, delta, ["company_number"], overwrite=REGISTRY_FIELDS, prefer_new=FOUND_FIELDS,
                      stamp={"last_updated": as_time(as_of)}, seq=seq, inserted=new_company(delta, as_of, seq))


def upsert_registry(old: DataFrame, delta: DataFrame, as_of: str, wide: bool = False,
                    seq: str | None = None) -> DataFrame:
    """P-02: a registry file changes name, status and type only (`wide`: all registry fields)."""
    return merge_rows(old, delta, ["company_number"], overwrite=WIDE_CSV_FIELDS if wide else CSV_FIELDS,
                      stamp={"last_updated": as_time(as_of)}, seq=seq, inserted=new_company(delta, as_of, seq))


def new_company(delta: DataFrame, as_of: str, seq: str | None = None) -> dict[str, Column]:
    """Key and creation time of an inserted company; the key follows from the number, or from the whole row without one."""
    number = F.when(present("company_number"), F.xxhash64("company_number")).otherwise(F.xxhash64(*sorted(c for c in delta.columns if c != seq)))
    return {"id": new_key(number), "created_at": as_time(as_of)}


def upsert_counts(old: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """P-03: how many delta keys are new and how many exist."""
    known = old.select(*keys).distinct().withColumn("_old", F.lit(True))
    marked = delta.select(*keys).distinct().join(known, list(keys), "left")
    return marked.agg(F.count_if(F.col("_old").isNull()).alias("inserted"),
                      F.count_if(F.col("_old")).alias("updated"))


def upsert_contacts_by_url(old: DataFrame, delta: DataFrame, seq: str | None = None) -> DataFrame:
    """P-04: contacts with a profile address; the connection degree is overwritten. Contacts without one stay as they are."""
    named = delta.filter(present("linkedin_url")).withColumn("confidence_score", F.lit(85))
    return merge_rows(old, named, ["linkedin_url"], overwrite=["connection_degree"],
                      prefer_new=["job_title", "email", "phone_number", "city", "country", "seniority",
                                  "industry_hint", "email_format_guess"], seq=seq,
                      inserted={"contact_id": new_key(F.xxhash64("linkedin_url")), "verified": F.lit(True)})


def upsert_contacts_by_name(old: DataFrame, delta: DataFrame, seq: str | None = None) -> DataFrame:
    """P-05: same lower-case name at the same account is the same person; empty fields are filled.

    Rows without an account never match, so they are always inserted.
    """
    def by_name(df: DataFrame) -> DataFrame:
        return df.withColumn("_first", F.lower("first_name")).withColumn("_last", F.lower("last_name"))

    keys = ["_first", "_last", "linked_account_id"]
    incoming = by_name(delta)
    if seq is not None:
        known = incoming.dropna(subset=keys)
        anonymous = without(incoming, known, [(seq, seq)])
        incoming = latest(known, keys, seq).unionByName(anonymous.drop(seq))
    target = by_name(old)
    # several old rows may share a name: the lowest id is the one that is updated
    first = target.dropna(subset=keys).groupBy(*keys).agg(F.min("contact_id").alias("contact_id"))
    marked = incoming.drop("contact_id").join(first, keys, "left")
    updates = marked.filter(F.col("contact_id").isNotNull()).drop(*keys)
    inserts = marked.filter(F.col("contact_id").isNull()).drop("_first", "_last", "contact_id")
    fill = [c for c in ("job_title", "email", "phone_number", "city", "country") if c in old.columns]
    kept = merge_rows(old, updates, ["contact_id"], prefer_filled=fill, insert=False)
    identity = F.xxhash64("first_name", "last_name", "linked_account_id", "email", "phone_number")
    added = inserts.withColumn("contact_id", new_key(identity)).withColumn("confidence_score", F.lit(70))
    return kept.unionByName(added.select(*[c for c in old.columns if c in added.columns]), allowMissingColumns=True)


def resolve_accounts(leads: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P-06: accounts for the companies named in leads; returns (leads with account_id, all accounts).

    An existing account with the same lower-case name is used (lowest id) and gets the industry if it
    had none; a new name gives one new account with a hash key.
    """
    name = F.lower(F.trim("company"))
    known = accounts.groupBy(F.lower("company_name").alias("_name")).agg(F.min("account_id").alias("_id"))
    named = leads.filter(present(F.trim("company"))).withColumn("_name", name)
    first_industry = F.min(F.when(present("industry"), F.struct("lead_id", "industry")))["industry"]
    wanted = named.groupBy("_name").agg(
        F.min(F.struct("lead_id", F.trim("company").alias("company"), "city", "country")).alias("_first"),
        first_industry.alias("_industry"))
    wanted = wanted.join(known, "_name", "left").withColumn("_is_new", F.col("_id").isNull())
    # one row per company named, written because all three outputs need it
    wanted = cut_lineage(wanted.withColumn("account_id", F.coalesce("_id", new_key(F.xxhash64("_name")))))
    resolved = named.join(wanted.select("_name", "account_id", F.col("_is_new").alias("is_new")), "_name").drop("_name")
    gains = wanted.filter(~F.col("_is_new")).select("account_id", F.col("_industry").alias("industry"))
    updated = (accounts.join(gains.withColumnRenamed("industry", "_gain"), "account_id", "left")
               .withColumn("industry", F.coalesce("industry", "_gain")).select(*accounts.columns))
    added = wanted.filter("_is_new").select(
        "account_id", F.col("_first.company").alias("company_name"), F.col("_first.city").alias("city"),
        F.col("_first.country").alias("country"), F.col("_industry").alias("industry"))
    return resolved, updated.unionByName(added, allowMissingColumns=True)


def add_contacts(old: DataFrame, delta: DataFrame, keys: Sequence[str] = ("company_id", "contact_type", "value")) -> DataFrame:
    """P-07: typed contact rows; a row that exists stays as it is."""
    once = delta.dropDuplicates(list(keys))
    return old.unionByName(once.join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def replace_officers(old: DataFrame, delta: DataFrame) -> DataFrame:
    """P-08: the officers of a touched company are replaced as a whole."""
    return without(old, delta, [("company_id", "company_id")]).unionByName(delta, allowMissingColumns=True)


def upsert_appointments(old: DataFrame, delta: DataFrame, seq: str | None = None) -> DataFrame:
    """P-09: (company, officer, appointed_on) identifies an appointment."""
    fresh = delta.withColumn("is_active", F.col("resigned_on").isNull())
    return merge_rows(old, fresh, ["company_id", "officer_id", "appointed_on"],
                      overwrite=["officer_role", "resigned_on", "appointment_type", "is_active", "ch_links"], seq=seq)


def accounts_from_companies(companies: DataFrame) -> DataFrame:
    """P-10: account rows of all named companies."""
    return companies.filter(F.col("name").isNotNull()).select(
        F.col("id").alias("company_id"), F.col("name").alias("company_name"),
        jurisdiction_country("jurisdiction").alias("country"), jurisdiction_state("jurisdiction").alias("state_region"),
        F.col("address_line_1").alias("address"), "website", F.col("phone").alias("phone_number"),
        F.col("incorporation_date").alias("created_at"))


def missing_uk_accounts(companies: DataFrame, accounts: DataFrame) -> DataFrame:
    """P-10: account rows of UK companies that have none."""
    uk = companies.filter((F.col("jurisdiction") == "gb") & present("name"))
    known = accounts.filter(F.col("country") == "United Kingdom")
    return without(uk, known, [("name", "company_name")]).select(
        F.col("id").alias("company_id"), F.col("name").alias("company_name"),
        F.lit("United Kingdom").alias("country"), F.col("region").alias("state_region"),
        F.concat_ws(", ", "address_line_1", "address_line_2", "locality", "postal_code").alias("address"),
        "website", F.col("phone").alias("phone_number"), F.col("incorporation_date").alias("created_at"))


def accounts_from_companies_full(companies: DataFrame) -> DataFrame:
    """P-41: wider mapping with fall-backs."""
    name = F.coalesce("name", "legal_name")
    return companies.filter(name.isNotNull()).select(
        F.col("id").alias("company_id"), name.alias("company_name"),
        jurisdiction_country("jurisdiction", F.col("jurisdiction")).alias("country"),
        jurisdiction_state("jurisdiction", F.col("region")).alias("state_region"),
        F.col("locality").alias("city"), F.concat_ws(", ", "address_line_1", "address_line_2").alias("address"),
        "website", F.col("phone").alias("phone_number"), "industry",
        F.coalesce(F.col("incorporation_date").cast("timestamp_ntz"), F.col("created_at")).alias("created_at"))


def apply_validation(contacts: DataFrame, validations: DataFrame, facts: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """P-34: store validation facts and mirror the flags on the contacts; returns (contacts, validations)."""
    stored = merge_rows(validations, facts.withColumn("validated_at", as_time(as_of)), ["contact_id"],
                        prefer_new=["email_valid", "email_score", "phone_valid"], overwrite=["validated_at"])
    flags = facts.select("contact_id", F.col("email_valid").alias("email_verified"),
                         F.col("phone_valid").alias("phone_verified"))
    mirrored = merge_rows(contacts, flags, ["contact_id"], prefer_new=["email_verified", "phone_verified"], insert=False)
    return mirrored, stored


def diff_history(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """P-36: one row per changed field between two versions of a table."""
    a = old.select(F.col(key), *[F.col(f).cast("string").alias(f"_o_{f}") for f in fields])
    b = new.select(F.col(key), *[F.col(f).cast("string").alias(f"_n_{f}") for f in fields])
    changes = F.array(*[
        F.struct(F.lit(f).alias("field_name"), F.col(f"_o_{f}").alias("old_value"), F.col(f"_n_{f}").alias("new_value"))
        for f in fields])
    rows = a.join(b, key, "full_outer").select(key, F.explode(changes).alias("_c")).select(key, "_c.*")
    return rows.filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def delete_companies(ids: DataFrame, **tables: tuple[DataFrame, str]) -> dict[str, DataFrame]:
    """P-37: every table without the rows of the given companies; tables are name=(frame, key column)."""
    return {name: without(df, ids, [(key, "id")]) for name, (df, key) in tables.items()}


def patch(df: DataFrame, delta: DataFrame, key: str, allowed: Sequence[str]) -> DataFrame:
    """P-38: change permitted columns only; a NULL input changes nothing."""
    return merge_rows(df, delta.select(key, *[c for c in allowed if c in delta.columns]), [key],
                      prefer_new=allowed, insert=False)


def insert_discovered(accounts: DataFrame, found: DataFrame, seq: str) -> DataFrame:
    """P-39: rows to insert: acceptable name, first of its name key in the run, not stored in that city."""
    valid = found.filter(discoverable_name("company_name"))
    once = keep_first(valid.withColumn("_key", company_key("company_name")), ["_key"], [F.asc(seq)]).drop("_key")
    stored = accounts.select(F.lower("company_name").alias("_name"), F.lower("city").alias("_city"))
    match = (F.lower("company_name") == F.col("_name")) & (F.lower("city") == F.col("_city"))
    return once.join(stored, match, "left_anti")


def merge_sources(*feeds: DataFrame, id_column: str) -> DataFrame:
    """P-40: several feeds in order of trust; the first row per number, else per name key, stays."""
    ranked = None
    for order, feed in enumerate(feeds):
        feed = feed.withColumn("source_order", F.lit(order))
        ranked = feed if ranked is None else ranked.unionByName(feed, allowMissingColumns=True)
    key = F.coalesce(blank_to_null("company_number"), company_key("company_name"))
    return keep_first(ranked.withColumn("_key", key), ["_key"], [F.asc("source_order"), F.asc(id_column)]).drop("_key")


def apply_enrichment(df: DataFrame, results: DataFrame, key: str, prefer_new: Sequence[str] = (),
                     fill_empty: Sequence[str] = (), processed: str | None = None) -> DataFrame:
    """P-43: take found values by one of two policies and mark the row as processed."""
    base = df if processed is None or processed in df.columns else df.withColumn(processed, F.lit(False))
    stamp = {processed: F.lit(True)} if processed else None
    return merge_rows(base, results, [key], prefer_new=prefer_new, fill_empty=fill_empty, stamp=stamp, insert=False)


"""Search, filters and ranked lists (F-01 … F-24, T-01 … T-07)."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.company import before, is_uk
from ..functions.industry import needs_classification, needs_normalisation
from ..functions.presence import flag, icontains, missing, present
from ..functions.scores import enrichment_score, weighted
from .joins import with_contact_count
from .keys import counts

ACCOUNT_ORDERS = ("created_at", "updated_at", "company_name", "city", "country", "state_region",
                  "industry", "account_id")
CONTACT_ORDERS = ("created_at", "updated_at", "first_name", "last_name", "job_title", "email",
                  "contact_id")
ENRICHED_ORDERS = ("updated_at", "created_at", "company_name", "country", "city", "industry",
                   "enrichment_score", "contact_count")


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """F-23: page of an ordered frame, as long as asked for.

    A far page gathers offset + limit rows; page_after does not.
    """
    if limit < 1 or offset < 0:
        raise ValueError("a page has at least one row and begins at 0 or later")
    return df.offset(offset).limit(limit) if offset else df.limit(limit)


def page_after(df: DataFrame, key: str, last: object, limit: int) -> DataFrame:
    """F-23: the page that follows the row with key `last` (None: the first page), by ascending unique key."""
    if limit < 1:
        raise ValueError("a page has at least one row")
    rest = df if last is None else df.filter(F.col(key) > F.lit(last))
    return rest.orderBy(key).limit(limit)


def page_with_total(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """T-01: one page with the size of the whole result and whether more follows."""
    total = df.agg(F.count(F.lit(1))).scalar()
    end = offset + limit
    out = page(df.orderBy(*order), limit, offset).withColumn("total", total)
    return out.withColumn("has_more", F.col("total") > end)


def _where(df: DataFrame, conditions: Sequence[Column | None]) -> DataFrame:
    for condition in conditions:
        if condition is not None:
            df = df.filter(condition)
    return df


def _contains(column: str, value: str | None) -> Column | None:
    return icontains(column, value) if value else None


def _equals(column: str, value: object) -> Column | None:
    return F.col(column) == value if value not in (None, "") else None


def country_condition(value: str | None, column: str = "country") -> Column | None:
    """F-02: a UK synonym stands for all its nations, any other text is a substring."""
    if not value:
        return None
    return is_uk(column) if value.lower() in rules.UK_SYNONYMS else icontains(column, value)


def search_companies(df: DataFrame, name: str | None = None, country: str | None = None,
                     region: str | None = None, locality: str | None = None,
                     industry: str | None = None, status: str | None = None,
                     jurisdiction: str | None = None, min_employees: int | None = None,
                     max_employees: int | None = None) -> DataFrame:
    """F-01: every filter is optional; page the result with page_with_total."""
    employees = F.col("employee_count") if {"employee_count"} <= set(df.columns) else None
    return _where(df, [
        _contains("name", name), country_condition(country), _contains("region", region),
        _contains("locality", locality), _contains("industry", industry), _equals("status", status),
        _equals("jurisdiction", jurisdiction),
        employees >= min_employees if min_employees is not None else None,
        employees <= max_employees if max_employees is not None else None,
    ])


def filter_accounts(df: DataFrame, prefixes: Mapping[str, Sequence[str]] | None = None,
                    country: str | None = None, state_region: str | None = None,
                    city: str | None = None, district: str | None = None, ward: str | None = None,
                    revenue: str | None = None, company_size: str | None = None,
                    search: str | None = None, industry: str | None = None) -> DataFrame:
    """F-03: equality on places, size prefix, name-or-website text, industry by code prefix or text.

    `prefixes` maps a category to its industry-code prefixes; any other industry is a substring.
    """
    text = icontains("company_name", search) | icontains("website", search) if search else None
    size = F.startswith(F.lower("company_size"), F.lit(company_size.lower())) if company_size else None
    return _where(df, [
        _equals("country", country), _equals("state_region", state_region), _equals("city", city),
        _equals("district", district), _equals("ward", ward), _equals("revenue", revenue), size,
        text, industry_condition(industry, prefixes or {})])


def industry_condition(industry: str | None, prefixes: Mapping[str, Sequence[str]]) -> Column | None:
    """J-20: codes of a known category by prefix, other texts by substring."""
    if industry in prefixes:
        return F.col("industry").rlike("^(" + "|".join(prefixes[industry]) + ")")
    return _contains("industry", industry)


def ordered(df: DataFrame, allowed: Sequence[str], by: str, direction: str, tie: str,
            default: str = "created_at") -> DataFrame:
    """Order by a permitted column only; anything else falls back to the default, newest first.

    NULLs come first when descending and last when ascending, as in the source database.
    """
    by = by if by in allowed and by in df.columns else default
    descending = direction.upper() != "ASC"
    key = F.desc_nulls_first(by) if descending else F.asc_nulls_last(by)
    return df.orderBy(key, F.asc(tie))


def filter_contacts(contacts: DataFrame, accounts: DataFrame, name: str | None = None,
                    title: str | None = None, country: str | None = None,
                    company: str | None = None, account_id: int | None = None) -> DataFrame:
    """F-04: contact filters over the left join with accounts."""
    from .joins import contacts_with_account

    either = icontains("first_name", name) | icontains("last_name", name) if name else None
    return _where(contacts_with_account(contacts, accounts), [
        either, _contains("job_title", title), _equals("account_country", country),
        _contains("company_name", company), _equals("linked_account_id", account_id)])


def search_registry(df: DataFrame, term: str | None = None, status: str | None = None,
                    industry: str | None = None, locality: str | None = None,
                    region: str | None = None) -> DataFrame:
    """F-05: the total of a page uses the same filter."""
    text = icontains("name", term) | icontains("company_number", term) if term else None
    return _where(df, [text, _contains("status", status), _contains("industry", industry),
                       _contains("locality", locality), _contains("region", region)])


def advanced_filter(df: DataFrame, industry: str | None = None, status: str | None = None,
                    created_from: str | None = None, created_to: str | None = None,
                    min_employees: int | None = None, max_employees: int | None = None,
                    country: str | None = None) -> DataFrame:
    """F-06."""
    def bound(text: str) -> Column:
        return F.lit(text).cast("timestamp_ntz")

    return _where(df, [
        _contains("industry", industry), _equals("status", status),
        F.col("created_at") >= bound(created_from) if created_from else None,
        F.col("created_at") <= bound(created_to) if created_to else None,
        F.col("employee_count") >= min_employees if min_employees is not None else None,
        F.col("employee_count") <= max_employees if max_employees is not None else None,
        _equals("country", country)])


def search_by_name(df: DataFrame, term: str, limit: int, score: str = "quality_score") -> DataFrame:
    """F-07: NULL scores come first, as in the source database."""
    hit = icontains("name", term) | icontains("company_number", term)
    return page(df.filter(hit).orderBy(F.desc_nulls_first(score), F.asc("name"), F.asc("id")), limit)


def search_by_location(companies: DataFrame, **ids: int | None) -> DataFrame:
    """F-08: drill-down by any of country_id, state_id, city_id, district_id."""
    return _where(companies, [_equals(c, v) for c, v in ids.items()])


def enriched_accounts(accounts: DataFrame, contacts: DataFrame, search: str | None = None,
                      country: str | None = None, city: str | None = None,
                      industry: str | None = None, has_website: bool = False,
                      has_email: bool = False, has_phone: bool = False,
                      has_linkedin: bool = False, has_contacts: bool = False) -> DataFrame:
    """F-09: accounts with at least one found field, with contact count and enrichment score."""
    any_field = (present("website") | present("email_format") | present("phone_number")
                 | present("linkedin_url"))
    hit = _where(accounts, [
        any_field, _contains("company_name", search), _equals("country", country),
        _equals("city", city), _contains("industry", industry),
        present("website") if has_website else None,
        present("email_format") if has_email else None,
        present("phone_number") if has_phone else None,
        present("linkedin_url") if has_linkedin else None])
    out = with_contact_count(hit, contacts).withColumn("enrichment_score", enrichment_score())
    return out.filter(F.col("contact_count") > 0) if has_contacts else out


def stale(df: DataFrame, days: int, n: int, as_of: str) -> DataFrame:
    """F-10: rows not updated for `days`, oldest first."""
    old = df.filter(F.col("last_updated") < before(as_of, days=days))
    return old.orderBy(F.asc("last_updated"), F.asc("id")).limit(n)


def recent(df: DataFrame, days: int, as_of: str, n: int | None = None, ts: str = "created_at",
           tie: str = "account_id") -> DataFrame:
    """F-11: rows created in the last `days`, newest first."""
    out = df.filter(F.col(ts) >= before(as_of, days=days)).orderBy(F.desc(ts), F.asc(tie))
    return out if n is None else out.limit(n)


def needs_verification(df: DataFrame, as_of: str) -> DataFrame:
    """F-12: asked for, never verified, or verified more than 30 days ago."""
    days = F.datediff(F.lit(as_of).cast("date"), F.col("last_verified").cast("date"))
    due = (F.col("status") == "needs_update") | F.col("last_verified").isNull() | (days > 30)
    return df.filter(due).withColumn("days_since_verified", days)


def contacts_to_verify(contacts: DataFrame, accounts: DataFrame) -> DataFrame:
    """F-13: an unverified e-mail or phone, with the company, oldest first."""
    due = ((present("email") & ~F.coalesce("email_verified", F.lit(False)))
           | (present("phone_number") & ~F.coalesce("phone_verified", F.lit(False))))
    names = accounts.select("account_id", "company_name")
    return (contacts.filter(due)
            .join(names, F.col("linked_account_id") == F.col("account_id")).drop("account_id")
            .orderBy(F.asc_nulls_first("created_at"), F.asc("contact_id")))


def contacts_by(df: DataFrame, **equal: object) -> DataFrame:
    """F-14: contacts with the given values, best confidence first."""
    return _where(df, [_equals(c, v) for c, v in equal.items()]).orderBy(
        F.desc_nulls_last("confidence_score"), F.asc("contact_id"))


def find_contact(df: DataFrame, email: str | None = None, phone: str | None = None) -> DataFrame:
    """F-15: exact e-mail, or phone in its raw or its formatted column."""
    hit = F.lit(False)
    if email:
        hit = hit | (F.col("email") == email)
    if phone:
        hit = hit | (F.col("phone_number") == phone) | (F.col("phone_formatted") == phone)
    return df.filter(F.coalesce(hit, F.lit(False)))


def rank_text(df: DataFrame, query: str, fields: Sequence[tuple[str, float]], n: int, tie: str) -> DataFrame:
    """F-16: the n rows whose fields share most words with the query; each field has a weight.

    A row scores the sum over fields of weight x distinct query words found in it.
    """
    words = sorted(set(w for w in "".join(ch if ch.isalnum() else " " for ch in query.lower()).split()))
    asked = F.array(*[F.lit(w) for w in words])
    score = F.lit(0.0)
    for column, weight in fields:
        tokens = F.split(F.lower(F.coalesce(column, F.lit(""))), "[^a-z0-9]+")
        score = score + F.size(F.array_intersect(tokens, asked)) * F.lit(weight)
    return (df.withColumn("rank", F.round(score, 6)).filter(F.col("rank") > 0)
            .orderBy(F.desc("rank"), F.asc(tie)).limit(n))


def needs_classifying(df: DataFrame) -> DataFrame:
    """F-18."""
    return df.filter(needs_classification("industry"))


def needs_normalising(df: DataFrame) -> DataFrame:
    """F-18: an industry that is not one of the standard names."""
    return df.filter(needs_normalisation("industry"))


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """F-19: n random rows.  The random number is a hash of key and seed, so a retried task agrees."""
    draw = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))
    return df.orderBy(draw, F.asc(key)).limit(n)


def is_completed(queue: DataFrame, areas: DataFrame, with_country: bool = True,
                 with_district: bool = False) -> DataFrame:
    """F-20: queue rows whose area is finished, ignoring letter case."""
    keys = ["city", "state_region"] + ["country"] * with_country + ["district"] * with_district
    done = areas.select(*[F.lower(k).alias("_" + k) for k in keys])
    on = [F.lower(F.col(k)) == F.col("_" + k) for k in keys]
    return queue.join(done, on, "left_semi")


def incomplete(df: DataFrame, as_of: str) -> DataFrame:
    """F-21: a contact field is missing and the last attempt is over 24 hours old."""
    fields = missing("website") | missing("phone_number") | missing("email_format") | missing("linkedin_url")
    rested = F.col("updated_at").isNull() | (F.col("updated_at") < before(as_of, hours=24))
    return df.filter(present("company_name") & fields & rested)


def needs_enrichment(accounts: DataFrame, contacts: DataFrame, k: int) -> DataFrame:
    """F-22: low score or fewer than k contacts."""
    weak = F.col("quality_score").isNull() | (F.col("quality_score") < 50) | (F.col("contact_count") < k)
    return with_contact_count(accounts, contacts).filter(weak)


def enrichment_history(log: DataFrame, company_id: object, n: int) -> DataFrame:
    """F-24: last runs of one company."""
    return (log.filter(F.col("company_id") == company_id)
            .orderBy(F.desc("created_at"), F.asc("log_id")).limit(n))


def recent_runs(log: DataFrame, companies: DataFrame, n: int) -> DataFrame:
    """F-24: newest runs with the company name."""
    newest = log.orderBy(F.desc("created_at"), F.asc("log_id")).limit(n)
    names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    return newest.join(names, "company_id", "left")


# --- ranked lists -----------------------------------------------------------------------------

def next_locations(queue: DataFrame, n: int) -> DataFrame:
    """T-02."""
    return (queue.filter(F.col("status") == "pending")
            .orderBy(F.asc("priority"), F.desc_nulls_last("population"), F.asc("queue_id")).limit(n))


def next_jobs(queue: DataFrame, n: int, as_of: str) -> DataFrame:
    """T-03: pending, due, attempts left."""
    due = ((F.col("status") == "pending") & (F.col("scheduled_for") <= F.lit(as_of).cast("timestamp_ntz"))
           & (F.col("attempts") < F.col("max_attempts")))
    return (queue.filter(due)
            .orderBy(F.desc("priority"), F.asc("created_at"), F.asc("queue_id")).limit(n))


def rank_by_completeness(df: DataFrame, weights: Sequence[tuple[str, int]], n: int,
                         key: str = "account_id") -> DataFrame:
    """T-04: most complete rows first; ties by key, so that the list is repeatable."""
    return (df.withColumn("completeness", weighted(weights))
            .orderBy(F.desc("completeness"), F.asc(key)).limit(n))


def two_phase_pick(df: DataFrame, n: int, as_of: str) -> DataFrame:
    """T-05: n rows: one fifth (rounded down) without a website, the others with one to finish off."""
    rested = F.col("updated_at").isNull() | (F.col("updated_at") < before(as_of, hours=24))
    named = df.filter(present("company_name") & rested)
    gaps = missing("phone_number") | missing("email_format") | missing("linkedin_url")
    half = rank_by_completeness(named.filter(present("website") & gaps), rules.HALF_ENRICHED_WEIGHTS, n - n // 5)
    empty = rank_by_completeness(named.filter(missing("website")), rules.EMPTY_WEIGHTS, n // 5)
    return half.withColumn("phase", F.lit(1)).unionByName(empty.withColumn("phase", F.lit(2)))


def recent_updates(log: DataFrame, n: int) -> DataFrame:
    """T-07."""
    return log.orderBy(F.desc("started_at"), F.asc("update_id")).limit(n)


def accounts_needing_contacts(accounts: DataFrame, contacts: DataFrame, k: int, n: int,
                              city: str | None = None, state: str | None = None) -> DataFrame:
    """J-25: fewer than k contacts, in a place if given; website holders first, then UK, then newest."""
    here = accounts
    if city:
        here = here.filter(F.lower("city") == city.lower())
    if state:
        here = here.filter((F.lower("state_region") == state.lower()) | (F.lower("country") == state.lower()))
    return (with_contact_count(here, contacts).filter(F.col("contact_count") < k)
            .orderBy(F.desc(flag(present("website"))), F.desc(flag(is_uk("country"))),
                     F.desc_nulls_last("created_at"), F.asc("account_id")).limit(n))


def contact_counts(contacts: DataFrame) -> DataFrame:
    return counts(contacts, "linked_account_id", "contact_count")

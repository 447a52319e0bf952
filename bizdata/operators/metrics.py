"""Aggregations (A-01 … A-36) and window-shaped reports (W-02).

Every report over one table is a single pass with map-side partial aggregation.  Reports over several
tables take one pass per table and meet as one-row scalar subqueries, so there is no cross join.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.company import as_time, before
from ..functions.presence import count_present, flag, icontains, present
from .joins import having_contacts
from .keys import first_n, top_groups


def _n() -> Column:
    return F.count(F.lit(1))


def by_location(df: DataFrame, n: int) -> DataFrame:
    """A-01: largest (city, state) groups with a printable label."""
    label = F.when(present("city"), F.concat_ws(", ", "city", "state_region")).otherwise(F.col("state_region"))
    located = df.filter(F.col("state_region").isNotNull())
    return top_groups(located, ["city", "state_region"], n).withColumn("location", label)


def by_industry(df: DataFrame, n: int) -> DataFrame:
    """A-02."""
    return top_groups(df.filter(F.col("industry").isNotNull()), ["industry"], n)


def completeness(df: DataFrame) -> DataFrame:
    """A-03: one pass for all counts."""
    return df.agg(
        _n().alias("total"), count_present("website").alias("with_website"),
        count_present("email_format").alias("with_email"), count_present("phone_number").alias("with_phone"),
        count_present("linkedin_url").alias("with_linkedin"))


def summary(df: DataFrame, as_of: str) -> DataFrame:
    """A-04: totals, distinct industries and places (a place may have NULL parts), rate in percent."""
    web = count_present("website")
    rate = F.coalesce(F.round(F.try_divide(100 * web, _n()), 0), F.lit(0.0))
    return df.agg(
        _n().alias("total"), web.alias("with_website"),
        count_present("email_format").alias("with_email"), count_present("phone_number").alias("with_phone"),
        F.count_distinct("industry").alias("industries"),
        F.count_distinct(F.struct("city", "state_region")).alias("locations"),
        F.count_if(F.col("created_at") >= before(as_of, days=7)).alias("added_7d"),
        rate.cast("bigint").alias("enrichment_rate"))


def geo_distribution(df: DataFrame, country: str | None = None, n: int | None = None, at_least: int = 1) -> dict[str, DataFrame]:
    """A-05: countries, states, and cities with at least `at_least` companies (the largest n; all by default)."""
    enriched = count_present("website").alias("enriched_count")
    here = df.filter(F.col("country") == country) if country else df
    states = here.filter(F.col("state_region").isNotNull()).groupBy(
        "country", F.col("state_region").alias("state")).agg(_n().alias("count"), enriched)
    cities = (here.filter(F.col("city").isNotNull() & F.col("state_region").isNotNull())
              .groupBy("country", F.col("state_region").alias("state"), "city")
              .agg(_n().alias("count"), enriched).filter(F.col("count") >= at_least)
              .orderBy(F.desc("count"), F.asc("country"), F.asc("state"), F.asc("city")))
    cities = cities if n is None else cities.limit(n)
    countries = df.filter(F.col("country").isNotNull()).groupBy("country").agg(_n().alias("count"), enriched)
    return {"countries": countries, "states": states, "cities": cities}


def top_cities(df: DataFrame, n: int, country: str | None = None) -> DataFrame:
    """A-06."""
    here = df.filter(F.col("city").isNotNull())
    here = here.filter(F.col("country") == country) if country else here
    return top_groups(here, ["city", F.col("state_region").alias("state"), "country"], n,
                      enriched_count=count_present("website"))


def account_stats(df: DataFrame) -> DataFrame:
    """A-07."""
    return df.agg(
        _n().alias("total"), F.count_distinct("country").alias("countries"),
        F.count_distinct("industry").alias("industries"), count_present("website").alias("with_website"),
        count_present("phone_number").alias("with_phone"), count_present("email_format").alias("with_email"))


def contact_stats(df: DataFrame) -> DataFrame:
    """A-08: here a field counts when it is not NULL."""
    return df.agg(
        _n().alias("total"), F.count_distinct("linked_account_id").alias("companies"),
        F.count("email").alias("with_email"), F.count("phone_number").alias("with_phone"),
        F.count("linkedin_url").alias("with_linkedin"))


def _some_field() -> Column:
    return present("website") | present("email_format") | present("phone_number")


def enrichment_stats(accounts: DataFrame, contacts: DataFrame, as_of: str) -> DataFrame:
    """A-09, the one-row part; the top lists are enriched_top."""
    full = present("website") & present("email_format") & present("phone_number")
    some = _some_field() | present("linkedin_url")
    people = contacts.agg(F.struct(
        _n().alias("n"), F.count_distinct("linked_account_id").alias("companies"),
        count_present("email").alias("email"), count_present("phone_number").alias("phone"))).scalar()
    out = accounts.agg(
        _n().alias("total_companies"), count_present("website").alias("with_website"),
        count_present("email_format").alias("with_email"), count_present("phone_number").alias("with_phone"),
        count_present("linkedin_url").alias("with_linkedin"), F.count_if(full).alias("fully_enriched"),
        F.count_if(some).alias("any_enrichment"),
        F.count_if((F.col("updated_at") > before(as_of, hours=24)) & _some_field()).alias("enriched_24h"))
    return out.withColumn("_p", people).select(
        "*", F.col("_p.n").alias("total_contacts"), F.col("_p.companies").alias("companies_with_contacts"),
        F.col("_p.email").alias("contacts_with_email"), F.col("_p.phone").alias("contacts_with_phone")).drop("_p")


def enriched_top(accounts: DataFrame, column: str, n: int) -> DataFrame:
    """A-09: largest countries or industries among accounts with a found field."""
    rows = accounts.filter(_some_field())
    if column == "industry":
        rows = rows.filter(present("industry"))
    return top_groups(rows, [column], n)


def contact_quality(accounts: DataFrame, contacts: DataFrame) -> DataFrame:
    """A-10, the one-row part; the source list is top_groups over data_source."""
    with_any = having_contacts(accounts, contacts).agg(_n()).scalar()
    all_accounts = accounts.agg(_n()).scalar()
    return contacts.agg(
        _n().alias("total_contacts"), F.count_if(F.col("verified")).alias("verified_contacts"),
        count_present("email").alias("with_email"), count_present("phone_number").alias("with_phone"),
        F.count("linkedin_url").alias("with_linkedin"),
        F.count_distinct("linked_account_id").alias("companies_with_contacts"),
    ).withColumn("companies_without_contacts", all_accounts - with_any)


def top_sources(df: DataFrame, n: int) -> DataFrame:
    return top_groups(df.filter(F.col("data_source").isNotNull()), ["data_source"], n)


def contact_summary(contacts: DataFrame, key: str = "linked_account_id") -> DataFrame:
    """A-11."""
    return contacts.groupBy(key).agg(
        _n().alias("total_contacts"), F.count_if(F.col("is_primary")).alias("primary_contacts"),
        F.count_if(F.col("email_verified")).alias("verified_emails"),
        F.count_if(F.col("phone_verified")).alias("verified_phones"),
        F.count("linkedin_url").alias("linkedin_profiles"),
        F.round(F.avg("confidence_score"), 6).alias("avg_confidence"))


def queue_progress(queue: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A-12: counts per status and percent done, overall or per country / state."""
    status = {s: F.count_if(F.col("status") == s) for s in
              ("pending", "in_progress", "completed", "failed", "skipped")}
    done = F.count_if(F.col("status").isin("completed", "skipped"))
    percent = F.round(F.try_divide(done * F.lit(100.0), _n()), 1)
    return queue.groupBy(*by).agg(
        _n().alias("total"), *[c.alias(s) for s, c in status.items()], percent.alias("percent_done"),
        F.coalesce(F.sum("companies_found"), F.lit(0)).alias("total_companies_found"))


def recent_activity(queue: DataFrame, as_of: str) -> DataFrame:
    """A-13."""
    done = F.col("status") == "completed"
    found = F.when(done & (F.col("completed_at") > before(as_of, hours=1)), F.col("companies_found"))
    return queue.agg(
        F.max(F.when(done, F.col("completed_at"))).alias("last_completed"),
        F.count_if(done & (F.col("completed_at") > before(as_of, minutes=10))).alias("done_10min"),
        F.count_if(done & (F.col("completed_at") > before(as_of, hours=1))).alias("done_1h"),
        F.coalesce(F.sum(found), F.lit(0)).alias("found_1h"))


def queue_status(queue: DataFrame) -> DataFrame:
    """A-14."""
    return queue.groupBy("status").agg(
        _n().alias("count"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"),
        F.round(F.avg("attempts"), 6).alias("avg_attempts"))


def active_workers(queue: DataFrame) -> DataFrame:
    """A-14: workers with running jobs."""
    running = queue.filter((F.col("status") == "processing") & F.col("worker_id").isNotNull())
    return running.groupBy("worker_id").agg(_n().alias("jobs"))


def registry_stats(df: DataFrame, jurisdiction: str | None = "gb") -> DataFrame:
    """A-15.  "active" is a substring test, so 'inactive' counts as active, as in the source."""
    here = df.filter(F.col("jurisdiction") == jurisdiction) if jurisdiction else df
    return here.agg(
        _n().alias("total_companies"), F.count_if(icontains("status", "active")).alias("active_companies"),
        F.count("website").alias("with_website"), F.count("email").alias("with_email"),
        F.count("phone").alias("with_phone"), F.count("linkedin_url").alias("with_linkedin"),
        F.count_distinct("industry").alias("industries"), F.count_distinct("locality").alias("localities"),
        F.count_distinct("region").alias("regions"))


def source_share(df: DataFrame) -> DataFrame:
    """A-16: rows per source and their share of all rows, sourceless ones included in the total."""
    total = df.agg(_n()).scalar()
    grouped = df.filter(F.col("data_source").isNotNull()).groupBy("data_source").agg(_n().alias("count"))
    return grouped.withColumn("percent", F.round(F.try_divide(F.col("count") * F.lit(100.0), total), 1))


def source_activity(df: DataFrame, as_of: str, ts: str = "created_at") -> DataFrame:
    """A-17."""
    return df.filter(F.col("data_source").isNotNull()).groupBy("data_source").agg(
        _n().alias("total"), F.count_if(F.col(ts) > before(as_of, hours=1)).alias("last_hour"),
        F.max(ts).alias("last_seen"))


def officer_search(officers: DataFrame, term: str, n: int, person: str = "name") -> DataFrame:
    """A-18: people by name with distinct companies in all and at present."""
    current = F.when(F.col("resigned_date").isNull(), F.col("company_id"))
    return (officers.filter(icontains("name", term)).groupBy(person).agg(
        F.count_distinct("company_id").alias("total_appointments"),
        F.count_distinct(current).alias("active_appointments"))
        .orderBy(F.desc("active_appointments"), F.asc(person)).limit(n))


def officer_stats(officers: DataFrame, companies: DataFrame) -> DataFrame:
    """A-19."""
    with_any = companies.join(officers.select(F.col("company_id").alias("id")), "id", "left_semi").agg(_n()).scalar()
    all_companies = companies.agg(_n()).scalar()
    return officers.agg(
        F.count_distinct("name").alias("total_officers"), _n().alias("total_appointments"),
        F.count_if(F.col("resigned_date").isNull()).alias("active_appointments"),
        F.count_distinct("company_id").alias("companies_with_officers"),
    ).withColumn("companies_without_officers", all_companies - with_any)


def completeness_pct(df: DataFrame, by: str = "jurisdiction", pattern: str = "us_%", *, n: int) -> DataFrame:
    """A-20: '_' in the pattern is any one character; a field counts when it is not NULL."""
    def pct(c: str) -> Column:
        return F.round(F.try_divide(F.count(c) * F.lit(100.0), _n()), 1).alias(f"{c}_pct")

    fields = ("website", "email", "phone")
    return (df.filter(F.col(by).like(pattern)).groupBy(by).agg(
        _n().alias("total"), *[F.count(c).alias(f"with_{c}") for c in fields], *[pct(c) for c in fields])
        .orderBy(F.desc("total"), F.asc(by)).limit(n))


def recent_imports(df: DataFrame, as_of: str, pattern: str = "us_%", *, n: int) -> DataFrame:
    """A-21."""
    new = df.filter(F.col("jurisdiction").like(pattern) & (F.col("created_at") > before(as_of, days=7)))
    return (new.groupBy("jurisdiction").agg(F.max("created_at").alias("last_import"), _n().alias("count"))
            .orderBy(F.desc("last_import"), F.asc("jurisdiction")).limit(n))


def coverage_by_country(accounts: DataFrame, as_of: str) -> DataFrame:
    """A-22: per country."""
    return accounts.groupBy("country").agg(
        _n().alias("total"), F.count_distinct("city").alias("cities"),
        F.count_distinct("state_region").alias("states"),
        F.count_if(F.col("created_at") > before(as_of, hours=24)).alias("added_24h"))


def coverage_top_cities(accounts: DataFrame, countries: Sequence[str], as_of: str, n: int) -> DataFrame:
    """A-22: largest (city, state) groups of each chosen country."""
    grouped = accounts.filter(F.col("country").isin(*countries)).groupBy("country", "city", "state_region").agg(
        _n().alias("count"), F.count_if(F.col("created_at") > before(as_of, hours=24)).alias("added_24h"))
    return first_n(grouped, ["country"], n, [F.desc("count"), F.asc_nulls_last("city"), F.asc_nulls_last("state_region")])


def coverage_rate(accounts: DataFrame, as_of: str) -> DataFrame:
    """A-22: totals, additions in the last hour and 10 minutes, projection per day and week."""
    hour = F.count_if(F.col("created_at") > before(as_of, hours=1))
    return accounts.agg(
        _n().alias("total_companies"), F.count_distinct("city").alias("unique_cities"),
        F.count_distinct("state_region").alias("unique_states"),
        F.count_distinct("country").alias("unique_countries"),
        F.count_if(F.col("created_at") > before(as_of, minutes=10)).alias("last_10min"),
        hour.alias("last_hour"), (hour * 24).alias("per_day"), (hour * 168).alias("per_week"))


def eta(accounts: DataFrame, contacts: DataFrame, as_of: str, workers: Sequence[int] = (2, 5, 10, 20, 50)) -> DataFrame:
    """A-23: time left at the rate of the last 10 minutes; NULL when nothing happened."""
    total = accounts.agg(_n()).scalar()
    out = contacts.agg(
        F.count_distinct("linked_account_id").alias("processed"),
        F.count_if(F.col("created_at") > before(as_of, minutes=10)).alias("last_10min"),
        F.count_if(F.col("created_at") > before(as_of, hours=1)).alias("last_hour"),
    ).withColumn("total_companies", total)
    out = out.withColumn("remaining", F.col("total_companies") - F.col("processed"))
    hours = F.try_divide(F.col("remaining").cast("double"), F.col("last_10min") * F.lit(6.0))
    out = out.withColumn("hours", F.round(hours, 6)).withColumn("days", F.round(hours / 24, 6))
    out = out.withColumn("weeks", F.round(hours / 168, 6)).withColumn("months", F.round(hours / 720, 6))
    for k in workers:
        out = out.withColumn(f"days_{k}_workers", F.round(hours / 24 / k, 6))
    return out


def popular_searches(log: DataFrame, n: int) -> DataFrame:
    """A-24."""
    return top_groups(log.filter(F.col("search_query").isNotNull()), ["search_query"], n)


def db_stats(accounts: DataFrame, contacts: DataFrame, companies: DataFrame, officers: DataFrame, as_of: str) -> DataFrame:
    """A-25: whole-database numbers in one row, one pass per table."""
    def one(df: DataFrame, value: Column) -> Column:
        return df.agg(value).scalar()

    quality = accounts.agg(F.struct(
        _n().alias("n"), count_present("website").alias("web"), F.round(F.avg("quality_score"), 1).alias("q"))).scalar()
    out = companies.agg(
        _n().alias("total_companies"),
        F.count_if(F.col("last_updated") < before(as_of, days=30)).alias("stale_companies"))
    return out.withColumn("_a", quality).select(
        "*", one(contacts, _n()).alias("total_contacts"), one(officers, _n()).alias("total_officers"),
        F.col("_a.n").alias("total_accounts"), F.col("_a.web").alias("accounts_with_website"),
        F.col("_a.q").alias("avg_quality")).drop("_a")


def counts_by(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """A-26."""
    grouped = df.groupBy(column).agg(_n().alias("count"))
    return grouped if n is None else grouped.orderBy(F.desc("count"), F.asc_nulls_last(column)).limit(n)


def distinct_values(df: DataFrame, column: str, n: int | None = None, **equal: object) -> DataFrame:
    """A-27: values for a filter list."""
    for name, value in equal.items():
        df = df.filter(F.col(name) == value)
    out = df.filter(present(column)).select(column).distinct().orderBy(column)
    return out if n is None else out.limit(n)


def districts_from_address(df: DataFrame, n: int | None = None) -> DataFrame:
    """A-28: first comma part of the address, for places without district data."""
    part = F.trim(F.split_part("address", F.lit(","), F.lit(1)))
    out = df.filter(present("address")).select(part.alias("district")).filter(F.col("district") != "").distinct()
    out = out.orderBy("district")
    return out if n is None else out.limit(n)


def area_stats(areas: DataFrame) -> DataFrame:
    """A-29."""
    return areas.agg(
        _n().alias("total_areas"), F.coalesce(F.sum("companies_found"), F.lit(0)).alias("total_companies"),
        F.coalesce(F.sum("contacts_found"), F.lit(0)).alias("total_contacts"),
        F.count_distinct("city").alias("cities"), F.count_distinct("country").alias("countries"))


def table_counts(**tables: DataFrame) -> DataFrame:
    """A-33."""
    out = None
    for name, df in tables.items():
        row = df.agg(_n().alias("records")).select(F.lit(name).alias("table_name"), "records")
        out = row if out is None else out.unionByName(row)
    return out


def with_metrics(df: DataFrame, name: str | Observation, imported: Column, failed: Column | None = None) -> DataFrame:
    """A-34: count total / imported / skipped / failed rows while the job runs (no extra pass)."""
    failed = F.lit(False) if failed is None else failed
    return df.observe(
        name, _n().alias("total"), F.sum(flag(imported)).alias("imported"), F.sum(flag(failed)).alias("failed"),
        F.sum(flag(~F.coalesce(imported, F.lit(False)) & ~F.coalesce(failed, F.lit(False)))).alias("skipped"))


def progress(accounts: DataFrame, targets: Mapping[str, int] = rules.TARGETS) -> DataFrame:
    """A-35: accounts per country against its own target, or the target of 'Other'."""
    table = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
    target = F.coalesce(F.try_element_at(table, F.col("country")), F.lit(targets["Other"])).cast("bigint")
    out = accounts.groupBy("country").agg(_n().alias("count")).withColumn("target", target)
    return (out.withColumn("percent", F.round(F.col("count") * F.lit(100.0) / F.col("target"), 6))
            .withColumn("remaining", F.greatest(F.col("target") - F.col("count"), F.lit(0))))


def progress_total(accounts: DataFrame, total_target: int = rules.TOTAL_TARGET) -> DataFrame:
    """A-35: all countries against the overall target."""
    return accounts.agg(_n().alias("count")).select(
        "count", F.lit(total_target).cast("bigint").alias("target"),
        F.round(F.col("count") * F.lit(100.0) / F.lit(total_target), 6).alias("percent"),
        F.greatest(F.lit(total_target) - F.col("count"), F.lit(0)).cast("bigint").alias("remaining"))


def queue_backlog(queue: DataFrame, as_of: str) -> DataFrame:
    """A-36."""
    due = (F.col("status") == "pending") & (F.col("scheduled_for") <= as_time(as_of))
    return queue.groupBy("status").agg(
        _n().alias("count"), F.count_if(due).alias("due_now"), F.round(F.avg("attempts"), 6).alias("avg_attempts"))


def snapshot_rates(df: DataFrame, ts: str, values: Sequence[str]) -> DataFrame:
    """W-02: change since the previous snapshot, and its rate per minute and hour.

    The previous snapshot is found inside the day; only the last snapshot of each day travels to the
    next one, so the one unpartitioned window sees one row per calendar day.
    """
    row = F.struct(ts, *values)
    by_day = df.withColumn("_day", F.to_date(ts))
    last = by_day.groupBy("_day").agg(F.max(row).alias("_last"))
    carried = last.select("_day", F.lag("_last").over(Window.orderBy("_day")).alias("_carried"))
    inside = by_day.withColumn("_before", F.lag(row).over(Window.partitionBy("_day").orderBy(ts)))
    out = inside.join(carried, "_day").withColumn("_prev", F.coalesce("_before", "_carried"))
    seconds = (F.unix_micros(F.col(ts).cast("timestamp"))
               - F.unix_micros(F.col("_prev")[ts].cast("timestamp"))) / 1e6
    out = out.withColumn("seconds", F.round(seconds, 6))
    for v in values:
        change = F.col(v) - F.col("_prev")[v]
        out = out.withColumn(f"{v}_diff", change)
        out = out.withColumn(f"{v}_per_minute", F.round(F.try_divide(change * 60.0, F.col("seconds")), 0))
        out = out.withColumn(f"{v}_per_hour", F.round(F.try_divide(change * 3600.0, F.col("seconds")), 0))
    return out.drop("_day", "_before", "_carried", "_prev")

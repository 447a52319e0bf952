"""Queries A-01 … A-36, W-01 … W-05."""

from pyspark.sql import functions as F

from ..operators import keys, metrics
from .registry import query
from .views import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"
WEB, MAIL, TEL, IN = ("(website IS NOT NULL AND website <> '')", "(email_format IS NOT NULL AND email_format <> '')",
                      "(phone_number IS NOT NULL AND phone_number <> '')", "(linkedin_url IS NOT NULL AND linkedin_url <> '')")


def n(cond: str) -> str:
    return f"COUNT(*) FILTER (WHERE {cond})"


query("a01_by_location", """
    SELECT city, state_region, COUNT(*) AS count,
      CASE WHEN city IS NOT NULL AND city <> '' THEN city || ', ' || state_region ELSE state_region END AS location
    FROM accounts_v WHERE state_region IS NOT NULL GROUP BY city, state_region
    ORDER BY count DESC, city NULLS LAST, state_region LIMIT 100""")(lambda t: metrics.by_location(t.accounts, 100))

query("a02_by_industry", """
    SELECT industry, COUNT(*) AS count FROM accounts_v WHERE industry IS NOT NULL GROUP BY industry
    ORDER BY count DESC, industry LIMIT 100""")(lambda t: metrics.by_industry(t.accounts, 100))

query("a03_completeness", f"""
    SELECT COUNT(*) AS total, {n(WEB)} AS with_website, {n(MAIL)} AS with_email, {n(TEL)} AS with_phone, {n(IN)} AS with_linkedin
    FROM accounts_v""")(lambda t: metrics.completeness(t.accounts))

query("a04_summary", f"""
    SELECT COUNT(*) AS total, {n(WEB)} AS with_website, {n(MAIL)} AS with_email, {n(TEL)} AS with_phone,
      COUNT(DISTINCT industry) AS industries,
      (SELECT COUNT(*) FROM (SELECT DISTINCT city, state_region FROM accounts_v)) AS locations,
      {n(f"created_at >= {NOW} - INTERVAL 7 DAY")} AS added_7d,
      CAST(COALESCE(ROUND(100.0 * {n(WEB)} / NULLIF(COUNT(*), 0), 0), 0) AS BIGINT) AS enrichment_rate
    FROM accounts_v""")(lambda t: metrics.summary(t.accounts, AS_OF))

query("a05_geo_states", f"""
    SELECT country, state_region AS state, COUNT(*) AS count, {n(WEB)} AS enriched_count
    FROM accounts_v WHERE state_region IS NOT NULL GROUP BY country, state_region""")(
    lambda t: metrics.geo_distribution(t.accounts)["states"])

query("a05_geo_cities", f"""
    SELECT country, state_region AS state, city, COUNT(*) AS count, {n(WEB)} AS enriched_count
    FROM accounts_v WHERE state_region IS NOT NULL AND city IS NOT NULL GROUP BY country, state_region, city
    HAVING COUNT(*) >= 10 ORDER BY count DESC, country NULLS FIRST, state, city LIMIT 500""")(
    lambda t: metrics.geo_distribution(t.accounts, n=500, at_least=10)["cities"])

query("a05_geo_countries", f"""
    SELECT country, COUNT(*) AS count, {n(WEB)} AS enriched_count FROM accounts_v WHERE country IS NOT NULL GROUP BY country""")(
    lambda t: metrics.geo_distribution(t.accounts)["countries"])

query("a06_top_cities", f"""
    SELECT city, state_region AS state, country, COUNT(*) AS count, {n(WEB)} AS enriched_count FROM accounts_v
    WHERE city IS NOT NULL GROUP BY city, state_region, country
    ORDER BY count DESC, city NULLS LAST, state NULLS LAST, country NULLS LAST LIMIT 20""")(lambda t: metrics.top_cities(t.accounts, 20))

query("a07_account_stats", f"""
    SELECT COUNT(*) AS total, COUNT(DISTINCT country) AS countries, COUNT(DISTINCT industry) AS industries,
      {n(WEB)} AS with_website, {n(TEL)} AS with_phone, {n(MAIL)} AS with_email FROM accounts_v""")(
    lambda t: metrics.account_stats(t.accounts))

query("a08_contact_stats", """
    SELECT COUNT(*) AS total, COUNT(DISTINCT linked_account_id) AS companies, COUNT(email) AS with_email,
      COUNT(phone_number) AS with_phone, COUNT(linkedin_url) AS with_linkedin FROM contacts_v""")(
    lambda t: metrics.contact_stats(t.contacts))

query("a09_enrichment_stats", f"""
    SELECT a.*, c.* FROM (SELECT COUNT(*) AS total_companies, {n(WEB)} AS with_website, {n(MAIL)} AS with_email, {n(TEL)} AS with_phone,
      {n(IN)} AS with_linkedin, {n(f'{WEB} AND {MAIL} AND {TEL}')} AS fully_enriched, {n(f'{WEB} OR {MAIL} OR {TEL} OR {IN}')} AS any_enrichment,
      {n(f"updated_at > {NOW} - INTERVAL 24 HOUR AND ({WEB} OR {MAIL} OR {TEL})")} AS enriched_24h FROM accounts_v) a,
    (SELECT COUNT(*) AS total_contacts, COUNT(DISTINCT linked_account_id) AS companies_with_contacts,
      {n("email <> ''")} AS contacts_with_email, {n("phone_number <> ''")} AS contacts_with_phone FROM contacts_v) c""")(
    lambda t: metrics.enrichment_stats(t.accounts, t.contacts, AS_OF))

query("a09_enriched_countries", f"""
    SELECT country, COUNT(*) AS count FROM accounts_v WHERE {WEB} OR {MAIL} OR {TEL} GROUP BY country
    ORDER BY count DESC, country NULLS LAST LIMIT 10""")(lambda t: metrics.enriched_top(t.accounts, "country", 10))

query("a09_enriched_industries", f"""
    SELECT industry, COUNT(*) AS count FROM accounts_v WHERE industry <> '' AND ({WEB} OR {MAIL} OR {TEL}) GROUP BY industry
    ORDER BY count DESC, industry LIMIT 10""")(lambda t: metrics.enriched_top(t.accounts, "industry", 10))

query("a10_contact_quality", f"""
    SELECT COUNT(*) AS total_contacts, {n('verified')} AS verified_contacts, {n("email <> ''")} AS with_email,
      {n("phone_number <> ''")} AS with_phone, COUNT(linkedin_url) AS with_linkedin, COUNT(DISTINCT linked_account_id) AS companies_with_contacts,
      (SELECT COUNT(*) FROM accounts_v a WHERE NOT EXISTS (SELECT 1 FROM contacts_v c WHERE c.linked_account_id = a.account_id))
        AS companies_without_contacts FROM contacts_v""")(lambda t: metrics.contact_quality(t.accounts, t.contacts))

query("a10_top_sources", """
    SELECT data_source, COUNT(*) AS count FROM contacts_v WHERE data_source IS NOT NULL GROUP BY data_source
    ORDER BY count DESC, data_source LIMIT 10""")(lambda t: metrics.top_sources(t.contacts, 10))

query("a11_contact_summary", f"""
    SELECT linked_account_id, COUNT(*) AS total_contacts, {n('is_primary')} AS primary_contacts, {n('email_verified')} AS verified_emails,
      {n('phone_verified')} AS verified_phones, COUNT(linkedin_url) AS linkedin_profiles, ROUND(AVG(confidence_score), 6) AS avg_confidence
    FROM contacts_v GROUP BY linked_account_id""")(lambda t: metrics.contact_summary(t.contacts))

PROGRESS = f"""
      {n("status = 'pending'")} AS pending, {n("status = 'in_progress'")} AS in_progress, {n("status = 'completed'")} AS completed,
      {n("status = 'failed'")} AS failed, {n("status = 'skipped'")} AS skipped,
      ROUND(100.0 * {n("status IN ('completed', 'skipped')")} / NULLIF(COUNT(*), 0), 1) AS percent_done,
      CAST(COALESCE(SUM(companies_found), 0) AS BIGINT) AS total_companies_found"""

query("a12_queue_progress", f"SELECT COUNT(*) AS total, {PROGRESS} FROM queue_v")(lambda t: metrics.queue_progress(t.queue))
query("a12_queue_by_country", f"SELECT country, country_code, COUNT(*) AS total, {PROGRESS} FROM queue_v GROUP BY country, country_code")(
    lambda t: metrics.queue_progress(t.queue, ["country", "country_code"]))
query("a12_queue_by_state", f"SELECT state_region, state_code, COUNT(*) AS total, {PROGRESS} FROM queue_v GROUP BY state_region, state_code")(
    lambda t: metrics.queue_progress(t.queue, ["state_region", "state_code"]))

query("a13_recent_activity", f"""
    SELECT MAX(completed_at) AS last_completed, {n(f"completed_at > {NOW} - INTERVAL 10 MINUTE")} AS done_10min,
      {n(f"completed_at > {NOW} - INTERVAL 1 HOUR")} AS done_1h,
      CAST(COALESCE(SUM(companies_found) FILTER (WHERE completed_at > {NOW} - INTERVAL 1 HOUR), 0) AS BIGINT) AS found_1h
    FROM queue_v WHERE status = 'completed'""")(lambda t: metrics.recent_activity(t.queue, AS_OF))

query("a14_queue_status", """
    SELECT status, COUNT(*) AS count, MIN(created_at) AS oldest, MAX(created_at) AS newest, ROUND(AVG(attempts), 6) AS avg_attempts
    FROM jobs_v GROUP BY status""")(lambda t: metrics.queue_status(t.jobs))
query("a14_active_workers", """
    SELECT worker_id, COUNT(*) AS jobs FROM jobs_v WHERE status = 'processing' AND worker_id IS NOT NULL GROUP BY worker_id""")(
    lambda t: metrics.active_workers(t.jobs))

query("a15_registry_stats", f"""
    SELECT COUNT(*) AS total_companies, {n("status ILIKE '%active%'")} AS active_companies, COUNT(website) AS with_website,
      COUNT(email) AS with_email, COUNT(phone) AS with_phone, COUNT(linkedin_url) AS with_linkedin, COUNT(DISTINCT industry) AS industries,
      COUNT(DISTINCT locality) AS localities, COUNT(DISTINCT region) AS regions FROM companies_v WHERE jurisdiction = 'gb'""")(
    lambda t: metrics.registry_stats(t.companies))

query("a16_source_share", """
    SELECT data_source, COUNT(*) AS count, ROUND(100.0 * COUNT(*) / (SELECT COUNT(*) FROM accounts_v), 1) AS percent
    FROM accounts_v WHERE data_source IS NOT NULL GROUP BY data_source""")(lambda t: metrics.source_share(t.accounts))

query("a17_source_activity", f"""
    SELECT data_source, COUNT(*) AS total, {n(f"created_at > {NOW} - INTERVAL 1 HOUR")} AS last_hour, MAX(created_at) AS last_seen
    FROM contacts_v WHERE data_source IS NOT NULL GROUP BY data_source""")(lambda t: metrics.source_activity(t.contacts, AS_OF))

query("a18_officer_search", """
    SELECT name, COUNT(DISTINCT company_id) AS total_appointments,
      COUNT(DISTINCT company_id) FILTER (WHERE resigned_date IS NULL) AS active_appointments
    FROM officers_v WHERE name ILIKE '%smith%' GROUP BY name ORDER BY active_appointments DESC, name LIMIT 50""")(
    lambda t: metrics.officer_search(t.officers, "smith", 50))

query("a19_officer_stats", f"""
    SELECT COUNT(DISTINCT name) AS total_officers, COUNT(*) AS total_appointments, {n('resigned_date IS NULL')} AS active_appointments,
      COUNT(DISTINCT company_id) AS companies_with_officers,
      (SELECT COUNT(*) FROM companies_v c LEFT JOIN (SELECT DISTINCT company_id FROM officers_v) o ON c.id = o.company_id
       WHERE o.company_id IS NULL) AS companies_without_officers FROM officers_v""")(
    lambda t: metrics.officer_stats(t.officers, t.companies))

query("a20_completeness_pct", """
    SELECT jurisdiction, COUNT(*) AS total, COUNT(website) AS with_website, COUNT(email) AS with_email, COUNT(phone) AS with_phone,
      ROUND(100.0 * COUNT(website) / COUNT(*), 1) AS website_pct, ROUND(100.0 * COUNT(email) / COUNT(*), 1) AS email_pct,
      ROUND(100.0 * COUNT(phone) / COUNT(*), 1) AS phone_pct
    FROM companies_v WHERE jurisdiction LIKE 'us_%' GROUP BY jurisdiction ORDER BY total DESC, jurisdiction LIMIT 20""")(
    lambda t: metrics.completeness_pct(t.companies, n=20))

query("a21_recent_imports", f"""
    SELECT jurisdiction, MAX(created_at) AS last_import, COUNT(*) AS count FROM companies_v
    WHERE jurisdiction LIKE 'us_%' AND created_at > {NOW} - INTERVAL 7 DAY GROUP BY jurisdiction
    ORDER BY last_import DESC, jurisdiction LIMIT 5""")(lambda t: metrics.recent_imports(t.companies, AS_OF, n=5))

query("a22_coverage_by_country", f"""
    SELECT country, COUNT(*) AS total, COUNT(DISTINCT city) AS cities, COUNT(DISTINCT state_region) AS states,
      {n(f"created_at > {NOW} - INTERVAL 24 HOUR")} AS added_24h FROM accounts_v GROUP BY country""")(
    lambda t: metrics.coverage_by_country(t.accounts, AS_OF))

query("a22_coverage_top_cities", f"""
    SELECT country, city, state_region, count, added_24h FROM (
      SELECT country, city, state_region, COUNT(*) AS count, {n(f"created_at > {NOW} - INTERVAL 24 HOUR")} AS added_24h,
        ROW_NUMBER() OVER (PARTITION BY country ORDER BY COUNT(*) DESC, city NULLS LAST, state_region NULLS LAST) AS rn
      FROM accounts_v WHERE country IN ('United Kingdom', 'ASIA', 'EUROPE') GROUP BY country, city, state_region) WHERE rn <= 10""")(
    lambda t: metrics.coverage_top_cities(t.accounts, ["United Kingdom", "ASIA", "EUROPE"], AS_OF, 10))

query("a22_coverage_rate", f"""
    SELECT COUNT(*) AS total_companies, COUNT(DISTINCT city) AS unique_cities, COUNT(DISTINCT state_region) AS unique_states,
      COUNT(DISTINCT country) AS unique_countries, {n(f"created_at > {NOW} - INTERVAL 10 MINUTE")} AS last_10min,
      {n(f"created_at > {NOW} - INTERVAL 1 HOUR")} AS last_hour, 24 * {n(f"created_at > {NOW} - INTERVAL 1 HOUR")} AS per_day,
      168 * {n(f"created_at > {NOW} - INTERVAL 1 HOUR")} AS per_week FROM accounts_v""")(lambda t: metrics.coverage_rate(t.accounts, AS_OF))

query("a23_eta", f"""
    WITH b AS (SELECT COUNT(DISTINCT linked_account_id) AS processed, {n(f"created_at > {NOW} - INTERVAL 10 MINUTE")} AS last_10min,
        {n(f"created_at > {NOW} - INTERVAL 1 HOUR")} AS last_hour, (SELECT COUNT(*) FROM accounts_v) AS total_companies FROM contacts_v),
      h AS (SELECT *, total_companies - processed AS remaining, (total_companies - processed) / NULLIF(last_10min * 6.0, 0) AS hr FROM b)
    SELECT processed, last_10min, last_hour, total_companies, remaining, ROUND(hr, 6) AS hours, ROUND(hr / 24, 6) AS days,
      ROUND(hr / 168, 6) AS weeks, ROUND(hr / 720, 6) AS months, ROUND(hr / 24 / 2, 6) AS days_2_workers,
      ROUND(hr / 24 / 5, 6) AS days_5_workers, ROUND(hr / 24 / 10, 6) AS days_10_workers, ROUND(hr / 24 / 20, 6) AS days_20_workers,
      ROUND(hr / 24 / 50, 6) AS days_50_workers FROM h""")(lambda t: metrics.eta(t.accounts, t.contacts, AS_OF))

query("a24_popular_searches", """
    SELECT search_query, COUNT(*) AS count FROM search_logs_v WHERE search_query IS NOT NULL GROUP BY search_query
    ORDER BY count DESC, search_query LIMIT 10""")(lambda t: metrics.popular_searches(t.search_logs, 10))

query("a25_db_stats", f"""
    SELECT COUNT(*) AS total_companies, {n(f"last_updated < {NOW} - INTERVAL 30 DAY")} AS stale_companies,
      (SELECT COUNT(*) FROM contacts_v) AS total_contacts, (SELECT COUNT(*) FROM officers_v) AS total_officers,
      (SELECT COUNT(*) FROM accounts_v) AS total_accounts, (SELECT {n(WEB)} FROM accounts_v) AS accounts_with_website,
      (SELECT ROUND(AVG(quality_score), 1) FROM accounts_v) AS avg_quality FROM companies_v""")(
    lambda t: metrics.db_stats(t.accounts, t.contacts, t.companies, t.officers, AS_OF))

query("a26_counts_by_status", "SELECT status, COUNT(*) AS count FROM companies_v GROUP BY status")(
    lambda t: metrics.counts_by(t.companies, "status"))
query("a26_counts_by_verified", "SELECT verified, COUNT(*) AS count FROM contacts_v GROUP BY verified")(
    lambda t: metrics.counts_by(t.contacts, "verified"))
query("a26_top_countries", "SELECT country, COUNT(*) AS count FROM accounts_v GROUP BY country ORDER BY count DESC, country NULLS LAST LIMIT 10")(
    lambda t: metrics.counts_by(t.accounts, "country", 10))

for _column in ("country", "industry", "state_region", "city", "district"):
    query(f"a27_values_{_column}", f"SELECT DISTINCT {_column} FROM accounts_v WHERE {_column} IS NOT NULL AND {_column} <> ''")(
        lambda t, c=_column: metrics.distinct_values(t.accounts, c))
query("a27_values_title", "SELECT DISTINCT job_title FROM contacts_v WHERE job_title <> ''")(
    lambda t: metrics.distinct_values(t.contacts, "job_title"))

query("a28_districts_from_address", """
    SELECT DISTINCT TRIM(SPLIT_PART(address, ',', 1)) AS district FROM accounts_v
    WHERE address <> '' AND TRIM(SPLIT_PART(address, ',', 1)) <> ''""")(lambda t: metrics.districts_from_address(t.accounts, None))

query("a29_area_stats", """
    SELECT COUNT(*) AS total_areas, CAST(SUM(companies_found) AS BIGINT) AS total_companies, CAST(SUM(contacts_found) AS BIGINT) AS total_contacts,
      COUNT(DISTINCT city) AS cities, COUNT(DISTINCT country) AS countries FROM areas_v""")(lambda t: metrics.area_stats(t.areas))

query("a33_table_counts", """
    SELECT 'accounts' AS table_name, COUNT(*) AS records FROM accounts_v UNION ALL SELECT 'contacts', COUNT(*) FROM contacts_v
    UNION ALL SELECT 'companies', COUNT(*) FROM companies_v UNION ALL SELECT 'officers', COUNT(*) FROM officers_v""")(
    lambda t: metrics.table_counts(accounts=t.accounts, contacts=t.contacts, companies=t.companies, officers=t.officers))

query("a35_progress", """
    SELECT country, COUNT(*) AS count, CASE WHEN country = 'United Kingdom' THEN 6000000 ELSE 10000000 END AS target,
      ROUND(100.0 * COUNT(*) / CASE WHEN country = 'United Kingdom' THEN 6000000 ELSE 10000000 END, 6) AS percent,
      GREATEST(CASE WHEN country = 'United Kingdom' THEN 6000000 ELSE 10000000 END - COUNT(*), 0) AS remaining
    FROM accounts_v GROUP BY country""")(lambda t: metrics.progress(t.accounts))
query("a35_progress_total", """
    SELECT COUNT(*) AS count, 200000000 AS target, ROUND(100.0 * COUNT(*) / 200000000, 6) AS percent,
      GREATEST(200000000 - COUNT(*), 0) AS remaining FROM accounts_v""")(lambda t: metrics.progress_total(t.accounts))

query("a36_queue_backlog", f"""
    SELECT status, COUNT(*) AS count, {n(f"status = 'pending' AND scheduled_for <= {NOW}")} AS due_now, ROUND(AVG(attempts), 6) AS avg_attempts
    FROM jobs_v GROUP BY status""")(lambda t: metrics.queue_backlog(t.jobs, AS_OF))

# --- window-shaped ----------------------------------------------------------------------------

query("w01_keep_first", """
    SELECT MIN(account_id) AS account_id FROM accounts_v GROUP BY LOWER(TRIM(company_name)), LOWER(COALESCE(city, ''))""")(
    lambda t: keys.keep_first(t.accounts.select("account_id", "company_name", "city"),
                              [F.lower(F.trim("company_name")), F.lower(F.coalesce("city", F.lit("")))],
                              [F.asc("account_id")]).select("account_id"))

query("w02_snapshot_rates", """
    SELECT taken_at, companies, contacts, ROUND(s, 6) AS seconds, cd AS companies_diff, ROUND(cd * 60.0 / NULLIF(s, 0), 0) AS companies_per_minute,
      ROUND(cd * 3600.0 / NULLIF(s, 0), 0) AS companies_per_hour, nd AS contacts_diff,
      ROUND(nd * 60.0 / NULLIF(s, 0), 0) AS contacts_per_minute, ROUND(nd * 3600.0 / NULLIF(s, 0), 0) AS contacts_per_hour
    FROM (SELECT *, EPOCH(taken_at) - EPOCH(LAG(taken_at) OVER w) AS s, companies - LAG(companies) OVER w AS cd,
            contacts - LAG(contacts) OVER w AS nd FROM snapshots_v WINDOW w AS (ORDER BY taken_at))""")(
    lambda t: metrics.snapshot_rates(t.snapshots, "taken_at", ["companies", "contacts"]))

query("w03_best_per_key", """
    SELECT linked_account_id, contact_id, confidence_score FROM (SELECT *, ROW_NUMBER() OVER (
      PARTITION BY linked_account_id ORDER BY confidence_score DESC NULLS LAST, contact_id) AS rn FROM contacts_v) WHERE rn = 1""")(
    lambda t: keys.best_per_key(t.contacts, ["linked_account_id"], "confidence_score", ["contact_id"]).select(
        "linked_account_id", "contact_id", "confidence_score"))

query("w05_first_n", """
    SELECT linked_account_id, contact_id FROM (SELECT *, ROW_NUMBER() OVER (
      PARTITION BY linked_account_id ORDER BY contact_id) AS rn FROM contacts_v) WHERE rn <= 5""")(
    lambda t: keys.first_n(t.contacts, ["linked_account_id"], 5, [F.asc("contact_id")]).select("linked_account_id", "contact_id"))

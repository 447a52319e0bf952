"""Queries F-01 … F-24, T-01 … T-07."""

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import search
from ..operators.locations import resolve_region
from .registry import query
from .views import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"


def has(c: str) -> str:
    return f"({c} IS NOT NULL AND {c} <> '')"


def lacks(c: str) -> str:
    return f"({c} IS NULL OR {c} = '')"


def weights(pairs: list[tuple[str, int]]) -> str:
    return " + ".join(f"CASE WHEN {has(c)} THEN {w} ELSE 0 END" for c, w in pairs)


ANY_FIELD = " OR ".join(has(c) for c in ("website", "email_format", "phone_number", "linkedin_url"))
SCORE = " + ".join(f"CASE WHEN {has(c)} THEN 1 ELSE 0 END" for c in ("website", "email_format", "phone_number", "linkedin_url"))
COUNTS = "(SELECT linked_account_id, COUNT(*) AS contact_count FROM contacts_v GROUP BY linked_account_id)"
UK = "(country ILIKE '%United Kingdom%' OR country ILIKE '%England%' OR country ILIKE '%Scotland%' OR country ILIKE '%Wales%' OR country ILIKE '%Northern Ireland%')"

query("f01_search_companies", f"""
    SELECT id, name, country FROM companies_v WHERE name ILIKE '%ring%' AND {UK} AND region ILIKE '%brand%' AND status = 'active'
      AND employee_count >= 10 AND employee_count <= 400""")(
    lambda t: search.search_companies(t.companies, name="ring", country="uk", region="brand", status="active",
                                      min_employees=10, max_employees=400).select("id", "name", "country"))

query("f02_uk_synonyms", f"SELECT id, country FROM companies_v WHERE {UK}")(
    lambda t: search.search_companies(t.companies, country="GB").select("id", "country"))

query("f03_filter_accounts", """
    SELECT account_id, company_name, website FROM accounts_v WHERE country = 'ASIA' AND district = 'Old Town'
      AND (company_name ILIKE '%e%' OR website ILIKE '%e%')""")(
    lambda t: search.filter_accounts(t.accounts, country="ASIA", district="Old Town", search="e").select(
        "account_id", "company_name", "website"))

query("f03_filter_by_category", "SELECT account_id, industry FROM accounts_v WHERE industry LIKE '6201%' OR industry LIKE '6202%'")(
    lambda t: search.filter_accounts(t.accounts, {"Computer Software": ["6201", "6202"]}, industry="Computer Software")
    .select("account_id", "industry"))

query("f03_ordered_page", """
    SELECT account_id, created_at FROM accounts_v ORDER BY created_at DESC, account_id LIMIT 500""")(
    lambda t: search.page(search.ordered(t.accounts, search.ACCOUNT_ORDERS, "drop table", "sideways", "account_id"), 500)
    .select("account_id", "created_at"))

query("f04_filter_contacts", """
    SELECT contact_id, company_name FROM contacts_v LEFT JOIN accounts_v a ON linked_account_id = account_id
    WHERE (first_name ILIKE '%ma%' OR last_name ILIKE '%ma%') AND job_title ILIKE '%director%' AND a.country = 'ASIA'""")(
    lambda t: search.filter_contacts(t.contacts, t.accounts, name="ma", title="director", country="ASIA").select(
        "contact_id", "company_name"))

query("f05_search_registry", """
    SELECT id, name, (SELECT COUNT(*) FROM companies_v WHERE (name ILIKE '%ring%' OR company_number ILIKE '%ring%') AND status ILIKE '%active%'
      AND locality ILIKE '%town 1%') AS total
    FROM companies_v WHERE (name ILIKE '%ring%' OR company_number ILIKE '%ring%') AND status ILIKE '%active%' AND locality ILIKE '%town 1%'
    ORDER BY name, id LIMIT 20""")(
    lambda t: search.page_with_total(search.search_registry(t.companies, "ring", "active", locality="town 1"),
                                     [F.asc("name"), F.asc("id")], 20).select("id", "name", "total"))

query("f06_advanced_filter", """
    SELECT id, created_at FROM companies_v WHERE status = 'active' AND created_at >= TIMESTAMP '2024-02-10 00:00:00'
      AND created_at <= TIMESTAMP '2024-02-28 00:00:00' AND employee_count >= 50""")(
    lambda t: search.advanced_filter(t.companies, status="active", created_from="2024-02-10", created_to="2024-02-28",
                                     min_employees=50).select("id", "created_at"))

query("f07_search_by_name", """
    SELECT id, name, quality_score FROM companies_v WHERE name ILIKE '%widget%' OR company_number ILIKE '%widget%'
    ORDER BY quality_score DESC NULLS FIRST, name, id LIMIT 50""")(
    lambda t: search.search_by_name(t.companies, "widget", 50).select("id", "name", "quality_score"))

query("f08_search_by_location", """
    SELECT l.id, country_name, state_name, city_name FROM located_v l JOIN countries_v c ON l.country_id = c.country_id
      LEFT JOIN states_v s ON l.state_id = s.state_id LEFT JOIN cities_v ci ON l.city_id = ci.city_id
    WHERE l.country_id = 2 AND l.state_id = 12""")(
    lambda t: _located(search.search_by_location(t.located, country_id=2, state_id=12), t))


def _located(companies, t):
    from ..operators.joins import with_locations

    return with_locations(companies, t.countries, t.states, t.cities).select("id", "country_name", "state_name", "city_name")


query("f09_enriched_accounts", f"""
    SELECT a.account_id, COALESCE(contact_count, 0) AS contact_count, {SCORE} AS enrichment_score
    FROM accounts_v a LEFT JOIN {COUNTS} c ON a.account_id = c.linked_account_id WHERE ({ANY_FIELD}) AND {has('phone_number')}""")(
    lambda t: search.enriched_accounts(t.accounts, t.contacts, has_phone=True).select("account_id", "contact_count", "enrichment_score"))

query("f10_stale", f"""
    SELECT id, last_updated FROM companies_v WHERE last_updated < {NOW} - INTERVAL 30 DAY ORDER BY last_updated, id LIMIT 100""")(
    lambda t: search.stale(t.companies, 30, 100, AS_OF).select("id", "last_updated"))

query("f11_recent", f"SELECT account_id, created_at FROM accounts_v WHERE created_at >= {NOW} - INTERVAL 7 DAY")(
    lambda t: search.recent(t.accounts, 7, AS_OF).select("account_id", "created_at"))

query("f12_needs_verification", f"""
    SELECT id, DATE_DIFF('day', CAST(last_verified AS DATE), DATE '2024-03-01') AS days_since_verified FROM companies_v
    WHERE status = 'needs_update' OR last_verified IS NULL OR DATE_DIFF('day', CAST(last_verified AS DATE), DATE '2024-03-01') > 30""")(
    lambda t: search.needs_verification(t.companies, AS_OF).select("id", "days_since_verified"))

query("f13_contacts_to_verify", f"""
    SELECT contact_id, company_name FROM contacts_v c JOIN accounts_v a ON linked_account_id = account_id
    WHERE (c.email <> '' AND NOT COALESCE(email_verified, FALSE)) OR (c.phone_number <> '' AND NOT COALESCE(phone_verified, FALSE))""")(
    lambda t: search.contacts_to_verify(t.contacts, t.accounts).select("contact_id", "company_name"))

query("f14_contacts_by", """
    SELECT contact_id, confidence_score FROM contacts_v WHERE data_source = '2-HIGH' AND verified""")(
    lambda t: search.contacts_by(t.contacts, data_source="2-HIGH", verified=True).select("contact_id", "confidence_score"))

query("f15_find_contact", """
    SELECT contact_id FROM contacts_v WHERE email = 'user7@gmail.com' OR phone_number = '+44 2079 460 150' OR phone_formatted = '+44 2079 460 150'""")(
    lambda t: search.find_contact(t.contacts, "user7@gmail.com", "+44 2079 460 150").select("contact_id"))

_TOKENS = "LIST_DISTINCT(STRING_SPLIT_REGEX(LOWER(COALESCE({c}, '')), '[^a-z0-9]+'))"
query("f16_rank_text", f"""
    SELECT id, ROUND(LEN(LIST_INTERSECT({_TOKENS.format(c='name')}, ['brand', 'red', 'ring'])) * 1.0
      + LEN(LIST_INTERSECT({_TOKENS.format(c='legal_name')}, ['brand', 'red', 'ring'])) * 1.0
      + LEN(LIST_INTERSECT({_TOKENS.format(c='locality')}, ['brand', 'red', 'ring'])) * 0.4
      + LEN(LIST_INTERSECT({_TOKENS.format(c='region')}, ['brand', 'red', 'ring'])) * 0.4
      + LEN(LIST_INTERSECT({_TOKENS.format(c='industry')}, ['brand', 'red', 'ring'])) * 0.2, 6) AS rank
    FROM companies_v ORDER BY rank DESC, id LIMIT 50""")(
    lambda t: search.rank_text(t.companies, "Red ring, brand", [("name", 1.0), ("legal_name", 1.0), ("locality", 0.4),
                                                                ("region", 0.4), ("industry", 0.2)], 50, "id").select("id", "rank"))

query("f17_resolve_region", """
    SELECT queue_id, CASE WHEN queue_id % 3 = 0 THEN (SELECT MIN(s.state_name) FROM states_v s JOIN countries_v c ON s.country_id = c.country_id
        WHERE LOWER(c.country_code) = LOWER(q.country_code) AND LOWER(s.state_name) = LOWER(q.state_region))
      WHEN queue_id % 3 = 1 THEN NULL ELSE 'Elsewhere' END AS region_filter FROM queue_v q""")(
    lambda t: resolve_region(
        t.queue.withColumn("region", F.when(F.col("queue_id") % 3 == 0, F.lower("state_region"))
                           .when(F.col("queue_id") % 3 == 1, F.lit("zz")).otherwise(F.lit("Elsewhere"))),
        t.states.join(t.countries, "country_id").select("country_code", "state_code", "state_name")).select("queue_id", "region_filter"))

query("f18_needs_classifying", """
    SELECT account_id FROM accounts_v WHERE industry IS NULL OR industry IN ('', 'Unknown', 'Other', 'Professional Services')""")(
    lambda t: search.needs_classifying(t.accounts).select("account_id"))
query("f18_needs_normalising", "SELECT account_id FROM accounts_v WHERE industry <> '' AND industry NOT IN ("
      + ", ".join(f"'{i}'" for i in rules.STANDARD_INDUSTRIES) + ")")(
    lambda t: search.needs_normalising(t.accounts).select("account_id"))

query("f19_sample", "SELECT contact_id FROM contacts_v ORDER BY MD5(CAST(contact_id AS STRING) || '-7'), contact_id LIMIT 200")(
    lambda t: search.sample_n(t.contacts, 200, 7, "contact_id").select("contact_id"))

query("f20_is_completed", """
    SELECT queue_id FROM queue_v q WHERE EXISTS (SELECT 1 FROM areas_v a WHERE LOWER(a.city) = LOWER(q.city)
      AND LOWER(a.state_region) = LOWER(q.state_region) AND LOWER(a.country) = LOWER(q.country))""")(
    lambda t: search.is_completed(t.queue, t.areas).select("queue_id"))

REST = f"(updated_at IS NULL OR updated_at < {NOW} - INTERVAL 24 HOUR)"
query("f21_incomplete", f"""
    SELECT account_id FROM accounts_v WHERE company_name <> '' AND {REST}
      AND ({lacks('website')} OR {lacks('phone_number')} OR {lacks('email_format')} OR {lacks('linkedin_url')})""")(
    lambda t: search.incomplete(t.accounts, AS_OF).select("account_id"))

query("f22_needs_enrichment", f"""
    SELECT a.account_id FROM accounts_v a LEFT JOIN {COUNTS} c ON a.account_id = c.linked_account_id
    WHERE quality_score IS NULL OR quality_score < 50 OR COALESCE(contact_count, 0) < 3""")(
    lambda t: search.needs_enrichment(t.accounts, t.contacts, 3).select("account_id"))

query("f23_page", "SELECT account_id FROM accounts_v ORDER BY account_id LIMIT 5000 OFFSET 40")(
    lambda t: search.page(t.accounts.select("account_id").orderBy("account_id"), 5000, 40))

query("f23_page_after", "SELECT account_id FROM accounts_v WHERE account_id > 140 ORDER BY account_id LIMIT 300")(
    lambda t: search.page_after(t.accounts.select("account_id"), "account_id", 140, 300))

query("f24_history", "SELECT log_id FROM log_v WHERE company_id = 8 ORDER BY created_at DESC, log_id LIMIT 20")(
    lambda t: search.enrichment_history(t.log, 8, 20).select("log_id"))
query("f24_recent_runs", """
    SELECT log_id, name AS company_name FROM (SELECT * FROM log_v ORDER BY created_at DESC, log_id LIMIT 50) l
    LEFT JOIN companies_v c ON l.company_id = c.id""")(
    lambda t: search.recent_runs(t.log, t.companies, 50).select("log_id", "company_name"))

# --- ranked lists -----------------------------------------------------------------------------

query("t01_page_with_total", """
    SELECT account_id, (SELECT COUNT(*) FROM accounts_v WHERE country = 'ASIA') AS total,
      (SELECT COUNT(*) FROM accounts_v WHERE country = 'ASIA') > 60 AS has_more
    FROM accounts_v WHERE country = 'ASIA' ORDER BY created_at DESC, account_id LIMIT 20 OFFSET 40""")(
    lambda t: search.page_with_total(t.accounts.filter("country = 'ASIA'"), [F.desc("created_at"), F.asc("account_id")], 20, 40)
    .select("account_id", "total", "has_more"))

query("t02_next_locations", """
    SELECT queue_id FROM queue_v WHERE status = 'pending' ORDER BY priority, population DESC NULLS LAST, queue_id LIMIT 100""")(
    lambda t: search.next_locations(t.queue, 100).select("queue_id"))

query("t03_next_jobs", f"""
    SELECT queue_id FROM jobs_v WHERE status = 'pending' AND scheduled_for <= {NOW} AND attempts < max_attempts
    ORDER BY priority DESC, created_at, queue_id LIMIT 100""")(lambda t: search.next_jobs(t.jobs, 100, AS_OF).select("queue_id"))

for _name, _weights in (("phone", rules.PHONE_JOB_WEIGHTS), ("website", rules.WEBSITE_JOB_WEIGHTS), ("contact", rules.CONTACT_JOB_WEIGHTS)):
    query(f"t04_rank_{_name}_job", f"""
        SELECT account_id, {weights(_weights)} AS completeness FROM accounts_v ORDER BY completeness DESC, account_id LIMIT 200""")(
        lambda t, w=_weights: search.rank_by_completeness(t.accounts, w, 200).select("account_id", "completeness"))

query("t05_two_phase_pick", f"""
    SELECT * FROM (SELECT account_id, 1 AS phase FROM accounts_v WHERE company_name <> '' AND {REST} AND {has('website')}
      AND ({lacks('phone_number')} OR {lacks('email_format')} OR {lacks('linkedin_url')})
      ORDER BY {weights(rules.HALF_ENRICHED_WEIGHTS)} DESC, account_id LIMIT 80)
    UNION ALL SELECT * FROM (SELECT account_id, 2 AS phase FROM accounts_v WHERE company_name <> '' AND {REST} AND {lacks('website')}
      ORDER BY {weights(rules.EMPTY_WEIGHTS)} DESC, account_id LIMIT 20)""")(
    lambda t: search.two_phase_pick(t.accounts, 100, AS_OF).select("account_id", "phase"))

query("t06_nulls_last", "SELECT account_id, quality_score FROM accounts_v ORDER BY quality_score DESC NULLS LAST, account_id LIMIT 300")(
    lambda t: t.accounts.select("account_id", "quality_score").orderBy(F.desc_nulls_last("quality_score"), F.asc("account_id")).limit(300))

query("t07_recent_updates", "SELECT log_id AS update_id FROM log_v ORDER BY created_at DESC, log_id LIMIT 100")(
    lambda t: search.recent_updates(t.log.withColumnRenamed("log_id", "update_id").withColumnRenamed("created_at", "started_at"), 100)
    .select("update_id"))

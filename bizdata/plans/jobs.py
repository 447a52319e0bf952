"""Queries P-01 … P-44, A-30 … A-34, S-01 … S-12, K-01 … K-06."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import classify, dedup, emails, keys, locations, metrics, pages, quality, queue, upsert
from ..sinks import export
from ..session import shared_folder
from ..sources import places, registry, tables
from .columns import (BAD_WORDS, BY_NAME, BY_OLD, CONSUMER, DETECT, DISCOVERABLE, DISPOSABLE, FACTED, FAKE, FN, HOST, KEY, KNOWN, LN, PHONE_OK,
                      REASONS, ROLE_OK, SCORED, TITLE_OK, VALID, VISIBLE, any_of, best_rule, element, gib, host, listing, ordered_case, q, text_score)
from .joins import ALL_PAIRS
from .registry import TEXTS_OF, query
from .views import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"

# --- upserts ----------------------------------------------------------------------------------

# delta: every registry row again under a renumbered key, two batches apart, so that keys repeat and some are new
DELTA = """SELECT CASE WHEN id % 7 = 0 THEN 'NEW-' || CAST(id % 350 AS STRING) ELSE company_number END AS company_number, 'New ' || legal_name AS name,
    legal_name, company_type, 'active' AS status, CASE WHEN id % 3 = 0 THEN NULL ELSE website END AS website, phone, CAST(NULL AS STRING) AS email,
    industry, employee_count, country, id AS seq FROM companies_v"""
BASE = "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY company_number ORDER BY id) AS rn FROM companies_v) WHERE rn = 1"


def _base(t):
    return t.sql(BASE).drop("rn").withColumn("annual_revenue", F.lit(None).cast("decimal(20,2)"))


def _keyless(companies):
    """With two rows that have no company number, NULL and ''."""
    some = companies.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in companies.schema])
    rows = some.withColumns({"id": F.lit(900000001).cast(companies.schema["id"].dataType), "name": F.lit("keyless"), "created_at": F.lit(AS_OF).cast("timestamp_ntz")})
    return companies.unionByName(rows).unionByName(rows.withColumns({"id": (F.col("id") + 1).cast(companies.schema["id"].dataType), "company_number": F.lit("")}))


def _with_keys(t, merged):
    """Whether every row has an id, how many rows share it, and the id where the row is an old one."""
    old = _keyless(_base(t)).select(F.col("id").alias("old_id"))
    shared = merged.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("same_id"))
    return merged.join(old, F.col("id") == F.col("old_id"), "left").join(shared, "id").withColumn("has_id", F.col("id").isNotNull())


LAST = f"SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY company_number ORDER BY seq DESC) AS rn FROM ({DELTA})) WHERE rn = 1"
query("p01_upsert_companies", f"""
    SELECT COALESCE(d.company_number, o.company_number) AS company_number, CASE WHEN d.rn = 1 THEN d.name ELSE o.name END AS name,
      CASE WHEN d.rn = 1 THEN d.country ELSE o.country END AS country, COALESCE(d.website, o.website) AS website, COALESCE(d.phone, o.phone) AS phone,
      o.email AS email, CASE WHEN d.rn = 1 THEN {NOW} ELSE o.last_updated END AS last_updated, o.id AS old_id, TRUE AS has_id, 1 AS same_id,
      COALESCE(o.created_at, {NOW}) AS created_at
    FROM ({BASE}) o FULL JOIN ({LAST}) d ON o.company_number = d.company_number
    UNION ALL SELECT NULLIF('', u), 'keyless', NULL, NULL, NULL, NULL, NULL, 900000001 + k, TRUE, 1, {NOW} FROM (SELECT UNNEST([0, 1]) AS k, UNNEST(['', 'x']) AS u)""")(
    lambda t: _with_keys(t, upsert.upsert_companies(_keyless(_base(t)), t.sql(DELTA), AS_OF, "seq")).select(
        "company_number", "name", "country", "website", "phone", "email", "last_updated", "old_id", "has_id", "same_id", "created_at"))
query("p02_upsert_registry", f"""
    SELECT COALESCE(d.company_number, o.company_number) AS company_number, CASE WHEN d.rn = 1 THEN d.name ELSE o.name END AS name,
      CASE WHEN o.rn = 1 THEN o.country ELSE d.country END AS country, CASE WHEN o.rn = 1 THEN o.website ELSE d.website END AS website,
      o.id AS old_id, TRUE AS has_id, 1 AS same_id
    FROM ({BASE}) o FULL JOIN ({LAST}) d ON o.company_number = d.company_number""")(
    lambda t: _with_keys(t, upsert.upsert_registry(_base(t), t.sql(DELTA), AS_OF, seq="seq")).select(
        "company_number", "name", "country", "website", "old_id", "has_id", "same_id"))
query("p03_upsert_counts", f"""
    SELECT COUNT(*) FILTER (WHERE company_number NOT IN (SELECT company_number FROM companies_v)) AS inserted,
      COUNT(*) FILTER (WHERE company_number IN (SELECT company_number FROM companies_v)) AS updated FROM (SELECT DISTINCT company_number FROM ({DELTA}))""")(
    lambda t: upsert.upsert_counts(t.companies, t.sql(DELTA), ["company_number"]))

query("p04_upsert_contacts_by_url", f"""
    SELECT COALESCE(n.linkedin_url, o.linkedin_url) AS linkedin_url, COALESCE(n.job_title, o.job_title) AS job_title, COALESCE(n.email, o.email) AS email,
      CASE WHEN o.contact_id IS NULL THEN 85 ELSE o.confidence_score END AS confidence_score, o.contact_id AS old_id, 1 AS same_id
    FROM contacts_v o FULL JOIN (SELECT * FROM new_contacts_v WHERE linkedin_url <> '') n ON o.linkedin_url <> '' AND o.linkedin_url = n.linkedin_url""")(
    lambda t: _by_url(t))


def _by_url(t):
    """P-04 with every new contact given twice."""
    merged = upsert.upsert_contacts_by_url(t.contacts, t.new_contacts.unionByName(t.new_contacts))
    shared = merged.groupBy("contact_id").agg(F.count(F.lit(1)).cast("int").alias("same_id"))
    old = t.contacts.select(F.col("contact_id").alias("old_id"))
    return merged.join(shared, "contact_id").join(old, F.col("contact_id") == F.col("old_id"), "left").select(
        "linkedin_url", "job_title", "email", "confidence_score", "old_id", "same_id")

query("p05_upsert_contacts_by_name", """
    WITH k AS (SELECT MIN(contact_id) AS cid, LOWER(first_name) AS f, LOWER(last_name) AS l, linked_account_id AS a FROM contacts_v
        WHERE first_name IS NOT NULL AND last_name IS NOT NULL AND linked_account_id IS NOT NULL GROUP BY 2, 3, 4),
      n AS (SELECT n.*, k.cid FROM new_contacts_v n LEFT JOIN k ON LOWER(n.first_name) = k.f AND LOWER(n.last_name) = k.l AND n.linked_account_id = k.a)
    SELECT c.contact_id IS NULL AS is_new, COALESCE(c.first_name, n.first_name) AS first_name, COALESCE(NULLIF(n.email, ''), c.email) AS email,
      CASE WHEN c.contact_id IS NULL THEN n.job_title ELSE COALESCE(n.job_title, c.job_title) END AS job_title
    FROM contacts_v c FULL JOIN n ON c.contact_id = n.cid""")(lambda t: _by_name(t))


def _by_name(t):
    """P-05 with the marker whether the row is new."""
    old = t.contacts
    merged = upsert.upsert_contacts_by_name(old, t.new_contacts.withColumn("contact_id", F.lit(None).cast("bigint")))
    known = old.select("contact_id", F.lit(False).alias("_old"))
    return merged.join(known, "contact_id", "left").select(F.col("_old").isNull().alias("is_new"), "first_name", "email", "job_title")


LEADS = """SELECT c_custkey AS lead_id, CASE WHEN c_custkey % 5 = 0 THEN 'Fresh Firm ' || CAST(c_custkey % 40 AS STRING)
    ELSE UPPER('Pizza Kitchen ' || CAST(c_custkey % 97 AS STRING) || ' LTD') END AS company, 'Leeds' AS city, 'UK' AS country,
    CASE WHEN c_custkey % 2 = 0 THEN 'Hospitality' END AS industry FROM customer"""
query("p06_resolve_accounts", f"""
    SELECT lead_id, k.account_id AS known_id, k.account_id IS NULL AS is_new FROM ({LEADS}) l
    LEFT JOIN (SELECT LOWER(company_name) AS n, MIN(account_id) AS account_id FROM accounts_v GROUP BY 1) k ON LOWER(TRIM(company)) = k.n""")(
    lambda t: upsert.resolve_accounts(t.sql(LEADS), t.accounts)[0].select(
        "lead_id", F.when(~F.col("is_new"), F.col("account_id")).alias("known_id"), "is_new"))
query("p06_new_accounts", f"""
    SELECT account_id, company_name, industry FROM (SELECT a.account_id, a.company_name, COALESCE(a.industry, g.industry) AS industry FROM accounts_v a
        LEFT JOIN (SELECT k.account_id, MIN_BY(l.industry, l.lead_id) FILTER (WHERE l.industry IS NOT NULL) AS industry FROM ({LEADS}) l
          JOIN (SELECT LOWER(company_name) AS n, MIN(account_id) AS account_id FROM accounts_v GROUP BY 1) k ON LOWER(TRIM(company)) = k.n GROUP BY 1) g
        ON a.account_id = g.account_id)""")(
    lambda t: upsert.resolve_accounts(t.sql(LEADS), t.accounts)[1].join(t.accounts.select("account_id"), "account_id", "left_semi").select(
        "account_id", "company_name", "industry"))

TYPED = "SELECT company_id + 1 AS company_id, contact_type, value, first_order FROM company_contacts_v"
query("p07_add_contacts", f"""
    SELECT company_id, contact_type, value FROM company_contacts_v UNION SELECT company_id, contact_type, value FROM ({TYPED})""")(
    lambda t: upsert.add_contacts(t.company_contacts, t.sql(TYPED)).select("company_id", "contact_type", "value"))

OFFICERS_NEW = "SELECT id + 1000000000 AS id, company_id, name, role, appointed_date, resigned_date FROM officers_v WHERE role = 'director' AND resigned_date IS NOT NULL"
query("p08_replace_officers", f"""
    SELECT id, company_id FROM officers_v WHERE company_id NOT IN (SELECT company_id FROM ({OFFICERS_NEW})) UNION ALL SELECT id, company_id FROM ({OFFICERS_NEW})""")(
    lambda t: upsert.replace_officers(t.officers, t.sql(OFFICERS_NEW)).select("id", "company_id"))

APPOINTED = """SELECT company_id, name AS officer_id, appointed_date AS appointed_on, MIN(role) AS officer_role, MAX(resigned_date) AS resigned_on,
    'director' AS appointment_type, FALSE AS is_active, CAST(NULL AS STRING) AS ch_links FROM officers_v WHERE name IS NOT NULL GROUP BY 1, 2, 3"""
NEXT = f"""SELECT company_id, officer_id, CASE WHEN company_id % 3 = 0 THEN DATE '2024-01-01' ELSE appointed_on END AS appointed_on, 'chair' AS officer_role,
    CASE WHEN company_id % 2 = 0 THEN NULL ELSE DATE '2024-02-02' END AS resigned_on, 'x' AS appointment_type, '/officers/' || officer_id AS ch_links,
    officer_id || CAST(appointed_on AS STRING) AS seq FROM ({APPOINTED})"""
query("p09_upsert_appointments", f"""
    WITH n AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY company_id, officer_id, appointed_on ORDER BY seq DESC) AS rn FROM ({NEXT})) WHERE rn = 1)
    SELECT COALESCE(n.company_id, o.company_id) AS company_id, COALESCE(n.officer_id, o.officer_id) AS officer_id, COALESCE(n.appointed_on, o.appointed_on) AS appointed_on,
      CASE WHEN n.rn = 1 THEN n.resigned_on ELSE o.resigned_on END AS resigned_on, CASE WHEN n.rn = 1 THEN n.resigned_on IS NULL ELSE o.is_active END AS is_active,
      CASE WHEN n.rn = 1 THEN n.officer_role ELSE o.officer_role END AS officer_role, CASE WHEN n.rn = 1 THEN n.appointment_type ELSE o.appointment_type END AS appointment_type,
      CASE WHEN n.rn = 1 THEN n.ch_links ELSE o.ch_links END AS ch_links
    FROM ({APPOINTED}) o FULL JOIN n ON o.company_id = n.company_id AND o.officer_id = n.officer_id AND o.appointed_on = n.appointed_on""")(
    lambda t: upsert.upsert_appointments(t.sql(APPOINTED), t.sql(NEXT), "seq").select(
        "company_id", "officer_id", "appointed_on", "resigned_on", "is_active", "officer_role", "appointment_type", "ch_links"))

COUNTRY = "CASE WHEN jurisdiction = 'gb' THEN 'United Kingdom' WHEN jurisdiction LIKE 'us_%' THEN 'United States'{e} END"
STATE = "CASE WHEN jurisdiction = 'us_ny' THEN 'New York' WHEN jurisdiction = 'us_ca' THEN 'California'{e} END"
query("p10_accounts_from_companies", f"""
    SELECT id AS company_id, name AS company_name, {COUNTRY.format(e='')} AS country, {STATE.format(e='')} AS state_region, address_line_1 AS address,
      website, phone AS phone_number, incorporation_date AS created_at FROM companies_v WHERE name IS NOT NULL""")(
    lambda t: upsert.accounts_from_companies(t.companies))
query("p10_missing_uk_accounts", """
    SELECT id AS company_id, name AS company_name, CONCAT_WS(', ', address_line_1, address_line_2, locality, postal_code) AS address FROM companies_v
    WHERE jurisdiction = 'gb' AND name <> '' AND name NOT IN (SELECT company_name FROM accounts_v WHERE country = 'United Kingdom' AND company_name IS NOT NULL)
      AND name NOT IN (SELECT name FROM companies_v WHERE id % 4 = 0 AND jurisdiction = 'gb' AND id % 3 = 0 AND name IS NOT NULL)""")(
    lambda t: upsert.missing_uk_accounts(t.companies, t.accounts.unionByName(t.companies.filter("jurisdiction = 'gb' AND id % 3 = 0").select(
        F.col("name").alias("company_name"), F.lit("United Kingdom").alias("country")), allowMissingColumns=True)).select("company_id", "company_name", "address"))
query("p41_accounts_from_companies_full", f"""
    SELECT id AS company_id, COALESCE(name, legal_name) AS company_name, {COUNTRY.format(e=' ELSE jurisdiction')} AS country, {STATE.format(e=' ELSE region')} AS state_region,
      locality AS city, CONCAT_WS(', ', address_line_1, address_line_2) AS address, website, phone AS phone_number, industry,
      COALESCE(CAST(incorporation_date AS TIMESTAMP), created_at) AS created_at
    FROM companies_v""")(lambda t: upsert.accounts_from_companies_full(t.companies))

# --- merges -----------------------------------------------------------------------------------

query("a30_dup_groups", """
    SELECT REGEXP_REPLACE(REGEXP_REPLACE(LOWER(website), '^https?://', ''), '^www\\.', '') AS site, MIN(account_id) AS keep_id, COUNT(*) AS n_accounts
    FROM accounts_v WHERE website <> '' GROUP BY 1 HAVING COUNT(*) > 1""")(lambda t: dedup.dup_groups(t.accounts))
SITES = """SELECT account_id, MIN(account_id) OVER (PARTITION BY REGEXP_REPLACE(REGEXP_REPLACE(LOWER(website), '^https?://', ''), '^www\\.', '')) AS keep_id
    FROM accounts_v WHERE website <> ''"""
query("p14_dedup_accounts", f"SELECT account_id FROM accounts_v WHERE account_id NOT IN (SELECT account_id FROM ({SITES}) WHERE account_id <> keep_id)")(
    lambda t: dedup.dedup_accounts(t.accounts, t.contacts)[0].select("account_id"))
query("p14_moved_contacts", f"""
    SELECT contact_id, COALESCE(s.keep_id, c.linked_account_id) AS linked_account_id FROM contacts_v c LEFT JOIN ({SITES}) s ON c.linked_account_id = s.account_id""")(
    lambda t: dedup.dedup_accounts(t.accounts, t.contacts)[1].select("contact_id", "linked_account_id"))

FIELDS = [f for f in rules.MERGE_FIELDS if f != "registration_number"]
query("p11_merge_preview", f"""
    SELECT id1, id2, CONCAT_WS(',', {', '.join(f"CASE WHEN (a.{f} IS NULL OR a.{f} = '') AND b.{f} <> '' THEN {q(f)} END" for f in FIELDS)}) AS changes,
      {' + '.join(f"CASE WHEN (a.{f} IS NULL OR a.{f} = '') AND b.{f} <> '' THEN 1 ELSE 0 END" for f in FIELDS)} AS will_update
    FROM ({ALL_PAIRS}) p JOIN companies_v a ON a.id = p.id1 JOIN companies_v b ON b.id = p.id2""")(
    lambda t: dedup.merge_preview(dedup.find_duplicates(t.companies), t.companies))

COMPONENTS = f"""WITH RECURSIVE e AS (SELECT id1 AS a, id2 AS b FROM ({ALL_PAIRS}) WHERE o <> 1 UNION SELECT id2, id1 FROM ({ALL_PAIRS}) WHERE o <> 1),
    r AS (SELECT DISTINCT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b),
    c AS (SELECT id, MIN(root) AS component FROM r GROUP BY id)"""
query("p13_components", f"{COMPONENTS} SELECT id, component FROM c")(
    lambda t: dedup.connected_components(dedup.find_duplicates(t.companies, 0.95)))
# the lowest-id donor of each field wins; pair reasons below 0.95 take no part
query("p13_auto_merge", f"""{COMPONENTS},
    m AS (SELECT c.component, x.* FROM c JOIN companies_v x ON x.id = c.id WHERE c.id <> c.component),
    d AS (SELECT component, {', '.join(f"MIN_BY({f}, id) FILTER (WHERE {f} <> '') AS d_{f}" for f in FIELDS)},
        MAX(last_enriched) FILTER (WHERE enrichment_status = 'completed') AS d_enriched FROM m GROUP BY component),
    j AS (SELECT x.*, c.component, d.* EXCLUDE (component), c.component IS NULL OR c.id = c.component AS survives,
        d_enriched IS NOT NULL AND (x.last_enriched IS NULL OR d_enriched > x.last_enriched) AS newer,
        {' OR '.join(f"COALESCE(COALESCE(x.{f}, '') = '' AND d_{f} <> '', FALSE)" for f in FIELDS)} AS filled FROM companies_v x LEFT JOIN c ON c.id = x.id LEFT JOIN d ON d.component = x.id)
    SELECT * EXCLUDE (component, {', '.join(f'd_{f}' for f in FIELDS)}, d_enriched, survives, newer, filled) REPLACE (
      {', '.join(f"CASE WHEN survives THEN COALESCE(NULLIF({f}, ''), d_{f}, {f}) ELSE {f} END AS {f}" for f in FIELDS)},
      CASE WHEN survives AND newer THEN d_enriched WHEN survives AND filled THEN {NOW} ELSE last_enriched END AS last_enriched,
      CASE WHEN survives AND newer THEN 'completed' ELSE enrichment_status END AS enrichment_status,
      CASE WHEN survives THEN status ELSE 'merged' END AS status,
      CASE WHEN survives THEN notes ELSE CONCAT_WS(chr(10), notes, 'Merged into company ID ' || CAST(component AS STRING) || ' on {AS_OF}') END AS notes) FROM j""")(
    lambda t: dedup.auto_merge(t.companies, AS_OF)[0])
query("p12_merge_log", f"""{COMPONENTS} SELECT component AS company_id, 'merged' AS status,
      'Merged duplicate company ID ' || CAST(c.id AS STRING) || ' (' || COALESCE(x.name, 'no name') || ')' AS notes FROM c JOIN companies_v x ON x.id = c.id WHERE c.id <> c.component""")(
    lambda t: dedup.merge_pairs(dedup.find_duplicates(t.companies, 0.95), t.companies, AS_OF)[1])

# --- cleaning ---------------------------------------------------------------------------------

FIRST_REASON = f"COALESCE({REASONS})"
JUDGED = f"""SELECT account_id, CASE WHEN nr IS NOT NULL THEN nr WHEN account_id <> MIN(CASE WHEN nr IS NULL THEN account_id END) OVER (PARTITION BY LOWER(TRIM(company_name)), LOWER(COALESCE(city, '')))
      THEN 'duplicate' END AS reason FROM (SELECT account_id, company_name, city, {FIRST_REASON} AS nr FROM accounts_v)"""
query("p15_account_reasons", JUDGED)(lambda t: quality.account_reasons(t.accounts).select("account_id", "reason"))
query("p15_clean_counts", f"SELECT COALESCE(reason, 'kept') AS step, COUNT(*) AS n FROM ({JUDGED}) GROUP BY 1")(lambda t: quality.clean_counts(t.accounts))
query("p15_orphans", f"SELECT contact_id FROM contacts_v WHERE linked_account_id NOT IN (SELECT account_id FROM ({JUDGED}) WHERE reason IS NULL)")(
    lambda t: quality.clean_accounts(t.accounts, t.contacts)["orphans"].select("contact_id"))
SRC = "COALESCE(data_source, '')"
FAKE_ROW = f"""(({any_of(SRC, rules.FAKE_SOURCES)} OR (data_source IS NULL AND NOT COALESCE(verified, TRUE)) OR (data_source IS NULL AND COALESCE(REGEXP_MATCHES(company_name,
    {q(rules.SYNTHETIC_NAME)}), FALSE)) OR COALESCE(company_name IN ({listing(rules.FAKE_NAMES)}), FALSE)) AND NOT {any_of(SRC, rules.PROTECTED_SOURCES)})"""
query("p16_purge_fake", f"SELECT account_id FROM accounts_v WHERE {FAKE_ROW}")(lambda t: quality.purge_fake(t.accounts, t.contacts)["fake"].select("account_id"))
query("p16_kept_contacts", f"""
    SELECT contact_id FROM contacts_v c WHERE NOT EXISTS (SELECT 1 FROM accounts_v a WHERE {FAKE_ROW.replace('data_source', 'a.data_source').replace('verified', 'a.verified')}
      AND a.account_id = c.linked_account_id)""")(lambda t: quality.purge_fake(t.accounts, t.contacts)["contacts"].select("contact_id"))
PERSON = f"""COALESCE({FN} NOT IN {BAD_WORDS} AND {LN} NOT IN {BAD_WORDS} AND LENGTH({FN}) BETWEEN 2 AND 15 AND LENGTH({LN}) BETWEEN 2 AND 25 AND REGEXP_MATCHES({FN}, '^[a-z''-]+$')
    AND REGEXP_MATCHES({LN}, '^[a-z''-]+$') AND (LENGTH({FN}) <= 12 OR {FN} IN {KNOWN}) AND LENGTH({LN}) <= 15 AND NOT REGEXP_MATCHES({FN}, {q(rules.COMMON_LEADING_WORDS)})
    AND ({FN} IN {KNOWN} OR (LENGTH({FN}) >= 3 AND NOT REGEXP_MATCHES({FN}, {q(rules.WORD_ENDINGS_CLEANUP)}) AND NOT REGEXP_MATCHES({LN}, {q(rules.WORD_ENDINGS_CLEANUP)}))), FALSE)"""
query("p17_contact_reasons", f"""
    SELECT contact_id, CASE WHEN COALESCE(first_name, '') = '' OR COALESCE(last_name, '') = '' THEN 'missing_name'
      WHEN LENGTH(first_name) < 2 OR LENGTH(last_name) < 2 THEN 'short_name' WHEN NOT {PERSON} THEN 'not_a_person' END AS reason FROM contacts_v""")(
    lambda t: quality.contact_reasons(t.contacts, t.first_names, t.not_names).select("contact_id", "reason"))
query("p18_nullify_bad", f"""
    SELECT contact_id, CASE WHEN email <> '' AND {FAKE} IS NOT NULL THEN NULL ELSE email END AS email,
      CASE WHEN phone_number <> '' AND NOT {PHONE_OK} THEN NULL ELSE phone_number END AS phone_number,
      CASE WHEN job_title <> '' AND NOT {TITLE_OK} THEN NULL ELSE job_title END AS job_title,
      CONCAT_WS(',', CASE WHEN email <> '' AND {FAKE} IS NOT NULL THEN 'email' END, CASE WHEN phone_number <> '' AND NOT {PHONE_OK} THEN 'phone_number' END,
        CASE WHEN job_title <> '' AND NOT {TITLE_OK} THEN 'job_title' END) AS nullified, {gib('last_name')} AS name_flag FROM contacts_v""")(
    lambda t: quality.nullify_bad(t.contacts, title="job_title", name="last_name").select(
        "contact_id", "email", "phone_number", "job_title", "nullified", "name_flag"))
query("p19_enforce_title", f"SELECT contact_id, job_title FROM contacts_v WHERE {ROLE_OK}")(
    lambda t: quality.enforce_title(t.contacts)[0].select("contact_id", "job_title"))
query("p19_refused_titles", f"""
    SELECT contact_id, CASE WHEN TRIM(COALESCE(job_title, '')) = '' THEN 'missing title' WHEN LENGTH(TRIM(job_title)) < 3 THEN 'title too short' ELSE 'no valid role' END AS title_reason
    FROM contacts_v WHERE NOT {ROLE_OK}""")(lambda t: quality.enforce_title(t.contacts)[1].select("contact_id", "title_reason"))
query("p20_backfill_scores", f"""
    SELECT a.account_id, COALESCE(a.quality_score, s.quality_score) AS quality_score FROM accounts_v a JOIN ({SCORED}) s ON a.account_id = s.account_id""")(
    lambda t: quality.backfill_scores(t.accounts, t.contacts).select("account_id", "quality_score"))
query("p20_average_score", "SELECT COUNT(quality_score) AS scored, ROUND(AVG(quality_score), 6) AS avg_score FROM accounts_v")(
    lambda t: quality.average_score(t.accounts))

# --- sites and people -------------------------------------------------------------------------

MAIN = f"""SELECT * FROM (SELECT page_id, url, html, {host('url')} AS host, ROW_NUMBER() OVER (PARTITION BY {host('url')} ORDER BY LENGTH(url), page_id) AS rn FROM pages_v) WHERE rn = 1"""
BY_PAGE = best_rule(f"SELECT host, LOWER({VISIBLE}) AS s FROM ({MAIN})", "host", text_score, rules.PAGE_TEXT_THRESHOLD)
query("p21_classify_accounts", f"""
    SELECT a.account_id, COALESCE(n.industry, p.industry, CASE WHEN a.industry <> '' THEN COALESCE({ordered_case('LOWER(a.industry)', rules.INDUSTRY_SYNONYMS, 'NULL')}, o.industry) END,
      a.industry) AS new_industry FROM accounts_v a JOIN ({BY_NAME}) n ON n.account_id = a.account_id JOIN ({BY_OLD}) o ON o.account_id = a.account_id
    LEFT JOIN ({BY_PAGE}) p ON p.host = {host('a.website')}""")(
    lambda t: classify.classify_accounts(t.accounts, t.pages).select("account_id", "new_industry"))

KNOWN_MAIL = f"SELECT {HOST} AS domain, email, first_name, last_name, contact_id AS pos FROM contacts_v WHERE email <> ''"


def best_pattern_sql(known: str) -> str:
    return f"""
    WITH k AS (SELECT *, {DETECT} AS pt FROM ({known})),
      b AS (SELECT * FROM (SELECT domain, pt, COUNT(*) AS n, ROW_NUMBER() OVER (PARTITION BY domain ORDER BY COUNT(*) DESC, MIN(pos), pt) AS rn FROM k WHERE pt IS NOT NULL GROUP BY domain, pt) WHERE rn = 1),
      f AS (SELECT domain, MIN_BY(SPLIT_PART(LOWER(email), '@', 1), pos) AS lp FROM k GROUP BY domain)
    SELECT f.domain, COALESCE(b.pt, CASE WHEN CONTAINS(lp, '.') THEN '{{first}}.{{last}}@' || f.domain WHEN CONTAINS(lp, '_') THEN '{{first}}_{{last}}@' || f.domain
      WHEN REGEXP_MATCHES(lp, '^[a-z][a-z]+$') AND LENGTH(lp) > 4 THEN '{{f}}{{last}}@' || f.domain END) AS email_format, COALESCE(b.n, 0) AS n_addresses
    FROM f LEFT JOIN b ON f.domain = b.domain WHERE email_format IS NOT NULL"""


query("a31_best_pattern", best_pattern_sql(KNOWN_MAIL))(lambda t: emails.best_pattern(t.sql(KNOWN_MAIL)))
NAMED_MAIL = f"SELECT {HOST} AS domain, email, first_name || ' ' || last_name AS full_name, contact_id AS pos FROM contacts_v WHERE email <> '' AND first_name <> ''"


def _local(p: str) -> str:
    text = q(p)
    for token, value in (("{first}", "f"), ("{last}", "l"), ("{f}", "LEFT(f, 1)"), ("{l}", "LEFT(l, 1)")):
        text = f"REPLACE({text}, {q(token)}, {value})"
    return text


query("a32_confirm_pattern", f"""
    WITH k AS (SELECT domain, LOWER(email) AS email, LOWER(SPLIT_PART(full_name, ' ', 1)) AS f, LOWER(SPLIT_PART(full_name, ' ', 2)) AS l FROM ({NAMED_MAIL}) WHERE full_name IS NOT NULL),
      v AS ({' UNION ALL '.join(f"SELECT domain, {i} AS i, {q(p)} AS pattern FROM k WHERE {_local(p)} || '@' || domain = email" for i, p in enumerate(rules.EMAIL_PATTERNS))})
    SELECT domain, pattern, confirmed FROM (SELECT domain, pattern, COUNT(*) AS confirmed, ROW_NUMBER() OVER (PARTITION BY domain ORDER BY COUNT(*) DESC, i) AS rn
      FROM v GROUP BY domain, pattern, i) WHERE rn = 1""")(lambda t: emails.confirm_pattern(t.sql(NAMED_MAIL)))
HOSTS = "SELECT id, 'site' || CAST(id % 60 AS STRING) || '.test' AS host FROM companies_v"
_seen = f"SELECT host, url, LOWER(html) AS html, LOWER({VISIBLE}) AS txt FROM ({MAIN})"
query("p24_site_evidence", f"""
    WITH site AS ({_seen}),
      pair AS (SELECT h.id, s.host, s.url, s.html, s.txt, c.name, LOWER(REGEXP_REPLACE(company_number, '\\s', '', 'g')) AS number, REGEXP_REPLACE(LOWER(c.name), '[^a-z0-9]', '', 'g') AS clean,
          SPLIT_PART(s.host, '.', 1) AS stem, LOWER(address_line_1) AS street, LOWER(REGEXP_REPLACE(postal_code, '\\s', '', 'g')) AS post, address_line_1 <> '' AND postal_code <> '' AS placed
        FROM ({HOSTS}) h JOIN site s ON h.host = s.host JOIN companies_v c ON c.id = h.id),
      people AS (SELECT p.id, p.host, COUNT(*) AS n FROM pair p JOIN officers_v o ON o.company_id = p.id
        WHERE LENGTH(STRING_SPLIT_REGEX(TRIM(LOWER(o.name)), '\\s+')[-1]) > 3 AND CONTAINS(p.txt, STRING_SPLIT_REGEX(TRIM(LOWER(o.name)), '\\s+')[-1]) GROUP BY ALL),
      fact AS (SELECT pair.*, COALESCE(people.n, 0) AS n, COALESCE(CONTAINS(html, number) OR CONTAINS(txt, number), FALSE) AS has_number,
          COALESCE(CONTAINS(clean, stem) OR CONTAINS(stem, clean), FALSE) AS has_host, COALESCE(placed AND CONTAINS(txt, post), FALSE) AS has_post,
          COALESCE(placed AND CONTAINS(txt, post) AND CONTAINS(txt, street), FALSE) AS has_street, COALESCE(CONTAINS(txt, LOWER(name)), FALSE) AS has_name
        FROM pair LEFT JOIN people ON people.id = pair.id AND people.host = pair.host),
      scored AS (SELECT *, CASE WHEN has_number THEN 70 ELSE 0 END + CASE WHEN has_host THEN 30 ELSE 0 END + CASE WHEN has_street THEN 40 WHEN has_post THEN 20 ELSE 0 END
          + LEAST(n * 15, 30) + CASE WHEN has_name THEN 10 ELSE 0 END AS score FROM fact)
    SELECT id, host, url, CAST(LEAST(score, 100) AS INT) AS confidence, score >= 50 AS valid, CONCAT_WS(',', CASE WHEN has_number THEN 'company_number' END, CASE WHEN has_host THEN 'domain_match' END,
      CASE WHEN has_street THEN 'full_address' WHEN has_post THEN 'postcode' END, CASE WHEN n > 0 THEN n || '_officers' END, CASE WHEN has_name THEN 'company_name' END) AS matches
    FROM scored""")(lambda t: pages.site_evidence(t.companies, t.officers, t.pages, t.sql(HOSTS)))
_clean = f"LOWER(TRIM(REGEXP_REPLACE(REGEXP_REPLACE(company_name, {q(rules.LEGAL_WORDS_IN_TITLES)}, '', 'g'), '[^a-zA-Z0-9\\s]', '', 'g')))"
_content = """TRIM(REGEXP_EXTRACT(html, '(?is)<meta\\s[^>]*name=["'']description["''][^>]*content=["'']([^"'']*)["'']', 1))"""
for _entity, _char in rules.HTML_ENTITIES:
    _content = f"REPLACE({_content}, {q(_entity)}, {q(_char)})"
ABOUT = f"NULLIF({_content}, '')"
_fields = ", ".join(f"LOWER(COALESCE({text}, '')) AS {name}" for text, name in (
    (element("title"), "title"), (element("h1"), "h1"), (element("footer"), "footer"), (ABOUT, "description")))


def _hits(field: str) -> str:
    return f"LEN(LIST_FILTER(words, lambda w: CONTAINS({field}, w)))"


query("p25_site_match", f"""
    SELECT account_id, website, confidence, confidence >= 30 AS valid FROM (SELECT *, CASE WHEN LEN(words) = 0 THEN 50
        WHEN host IS NULL THEN CASE WHEN by_host THEN 40 ELSE 10 END
        ELSE LEAST(100, CASE WHEN {_hits('title')} >= CEIL(LEN(words) * 0.5) THEN 40 WHEN {_hits('title')} > 0 THEN 20 ELSE 0 END
          + CASE WHEN {_hits('description')} >= CEIL(LEN(words) * 0.5) THEN 20 WHEN {_hits('description')} > 0 THEN 10 ELSE 0 END
          + CASE WHEN by_host THEN 25 ELSE 0 END + CASE WHEN {_hits('h1')} > 0 THEN 10 ELSE 0 END
          + CASE WHEN {_hits('footer')} >= CEIL(LEN(words) * 0.5) THEN 15 ELSE 0 END) END AS confidence
      FROM (SELECT *, LIST_FILTER(STRING_SPLIT_REGEX(c, '\\s+'), lambda w: LENGTH(w) > 2) AS words,
          CONTAINS(REGEXP_REPLACE(site, '[-_.]', '', 'g'), REGEXP_REPLACE(c, '\\s', '', 'g'))
            OR CONTAINS(REGEXP_REPLACE(c, '\\s', '', 'g'), REGEXP_REPLACE(site, '[-_.]', '', 'g')) AS by_host
        FROM (SELECT account_id, website, {host('website')} AS site, {_clean} AS c FROM accounts_v WHERE website <> '' AND company_name <> '') a
        LEFT JOIN (SELECT host, {_fields} FROM ({MAIN})) m ON a.site = m.host))""")(lambda t: pages.site_match(t.accounts, t.pages))

RECORD_FIELDS = ("linkedin", "twitter", "facebook", "instagram", "address", "contact_link", "industry")
RECORDS = f"""SELECT domain, COUNT(*) AS n_pages,
      MIN_BY(email, (CASE WHEN REGEXP_MATCHES(email, {q(rules.SITE_GENERIC)}) THEN 1 ELSE 0 END) * 1000000000 + page_id) FILTER (WHERE email IS NOT NULL) AS email,
      MIN_BY(phone, (CASE WHEN STARTS_WITH(phone, '+') THEN 0 ELSE 1 END) * 1000000000 + page_id) FILTER (WHERE phone IS NOT NULL) AS phone,
      {', '.join(f"MIN_BY({c}, page_id) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in RECORD_FIELDS)}
    FROM (SELECT p.page_id, {host('url')} AS domain, e.email, h.phone, s.linkedin, s.twitter, s.facebook, s.instagram, a.address, k.contact AS contact_link,
        {ordered_case(f'LOWER({ABOUT})', rules.DESCRIPTION_HINTS, 'NULL')} AS industry FROM pages_v p
      JOIN ({TEXTS_OF['x47_choose_email']}) e ON e.page_id = p.page_id JOIN ({TEXTS_OF['x48_choose_phone']}) h ON h.page_id = p.page_id
      JOIN ({TEXTS_OF['x21_social_links']}) s ON s.page_id = p.page_id JOIN ({TEXTS_OF['x18_html_address']}) a ON a.page_id = p.page_id
      JOIN ({TEXTS_OF['x22_contact_link']}) k ON k.page_id = p.page_id) WHERE domain IS NOT NULL GROUP BY domain"""
query("p26_page_contacts", RECORDS)(lambda t: pages.page_contacts(t.pages))
query("p44_apply_page_contacts", f"""
    SELECT account_id, COALESCE(NULLIF(r.phone, ''), a.phone_number) AS phone_number, COALESCE(NULLIF(r.address, ''), a.address) AS address,
      COALESCE(NULLIF(r.linkedin, ''), a.linkedin_url) AS linkedin_url, CASE WHEN COALESCE(r.phone, r.address, r.linkedin) IS NOT NULL THEN {NOW} ELSE a.updated_at END AS updated_at
    FROM accounts_v a LEFT JOIN ({RECORDS}) r ON r.domain = {host('a.website')}""")(
    lambda t: pages.apply_page_contacts(t.accounts, pages.page_contacts(t.pages), AS_OF).select(
        "account_id", "phone_number", "address", "linkedin_url", "updated_at"))

# --- queue ------------------------------------------------------------------------------------

query("p29_enqueue", f"""
    SELECT CAST(queue_id AS STRING) AS queue_id, company_id, status FROM jobs_v UNION ALL
    SELECT * FROM (SELECT 'job-' || CAST(id AS STRING), id, 'pending' FROM companies_v WHERE (website IS NULL OR website = '')
      AND id NOT IN (SELECT company_id FROM jobs_v WHERE status IN ('pending', 'processing')) ORDER BY created_at DESC NULLS LAST, id LIMIT 50)""")(
    lambda t: queue.enqueue(t.jobs.withColumn("queue_id", F.col("queue_id").cast("string")), t.companies, 50, AS_OF).select("queue_id", "company_id", "status"))
query("p30_upsert_queue", """
    SELECT COALESCE(j.company_id, w.company_id) AS company_id, COALESCE(w.priority, j.priority) AS priority FROM (SELECT * FROM jobs_v WHERE status = 'pending') j
      FULL JOIN (SELECT c_custkey AS company_id, 9 AS priority FROM customer) w ON j.company_id = w.company_id
    UNION ALL SELECT company_id, priority FROM jobs_v WHERE status <> 'pending'""")(
    lambda t: queue.upsert_queue(t.jobs, t.sql("SELECT c_custkey AS company_id, 9 AS priority FROM customer")).select("company_id", "priority"))
# every line item of an order is an event of its job, so a job may be started several times and fail in one batch; delivered twice
EVENTS = """SELECT DISTINCT l_orderkey AS queue_id, l_orderkey * 10 + l_linenumber AS event_id,
    CASE l_linenumber % 3 WHEN 1 THEN 'started' WHEN 2 THEN 'failed' ELSE CASE WHEN l_orderkey % 4 = 0 THEN 'completed' ELSE 'started' END END AS result,
    CASE WHEN l_linenumber % 3 = 2 THEN 'timeout ' || CAST(l_linenumber AS STRING) END AS error FROM lineitem WHERE l_orderkey % 5 > 0"""
query("p31_apply_results", f"""
    SELECT j.queue_id, CASE WHEN done > 0 THEN 'completed' WHEN failed > 0 THEN CASE WHEN attempts + started >= max_attempts THEN 'failed' ELSE 'pending' END
        WHEN started > 0 THEN 'processing' ELSE j.status END AS status,
      CAST(attempts + COALESCE(started, 0) AS INT) AS attempts, CASE WHEN started > 0 THEN {NOW} ELSE started_at END AS started_at,
      CASE WHEN failed > 0 AND done = 0 THEN {NOW} + INTERVAL 1 HOUR ELSE scheduled_for END AS scheduled_for,
      CASE WHEN done > 0 THEN {NOW} ELSE completed_at END AS completed_at, CASE WHEN failed > 0 AND done = 0 THEN r.error END AS error_message
    FROM jobs_v j LEFT JOIN (SELECT queue_id, COUNT(*) FILTER (result = 'started') AS started, COUNT(*) FILTER (result = 'failed') AS failed,
        COUNT(*) FILTER (result = 'completed') AS done, MAX(error) FILTER (result = 'failed') AS error FROM ({EVENTS}) GROUP BY queue_id) r ON j.queue_id = r.queue_id""")(
    lambda t: queue.apply_results(t.jobs, t.sql(f"{EVENTS} UNION ALL {EVENTS}"), AS_OF).select(
        "queue_id", "status", "attempts", "started_at", "scheduled_for", "completed_at", "error_message"))
query("p32_assign_batch", f"""
    SELECT queue_id, CAST(NTILE(7) OVER (ORDER BY priority DESC, created_at, queue_id) AS INT) AS worker FROM (SELECT * FROM jobs_v WHERE status = 'pending'
      AND scheduled_for <= {NOW} AND attempts < max_attempts ORDER BY priority DESC, created_at, queue_id LIMIT 100)""")(
    lambda t: queue.assign_batch(t.jobs, 100, 7, AS_OF).select("queue_id", "worker"))
query("p33_reset_stale", f"""
    SELECT queue_id, CASE WHEN status = 'in_progress' AND (started_at IS NULL OR started_at < {NOW} - INTERVAL 20 MINUTE) THEN 'pending' ELSE status END AS status FROM queue_v""")(
    lambda t: queue.reset_stale(t.queue, AS_OF).select("queue_id", "status"))
query("p33_skip_completed", """
    SELECT queue_id, CASE WHEN status = 'pending' AND EXISTS (SELECT 1 FROM areas_v a WHERE LOWER(a.city) = LOWER(q.city) AND LOWER(a.state_region) = LOWER(q.state_region)
      AND LOWER(a.country) = LOWER(q.country)) THEN 'skipped' ELSE status END AS status FROM queue_v q""")(
    lambda t: queue.skip_completed(t.queue, t.areas).select("queue_id", "status"))
query("p33_clear_done", "SELECT queue_id FROM jobs_v WHERE status NOT IN ('completed', 'failed')")(lambda t: queue.clear_done(t.jobs).select("queue_id"))

# --- state of tables --------------------------------------------------------------------------

OLD_FACTS = "SELECT o_orderkey AS contact_id, FALSE AS email_valid, 10 AS email_score, TRUE AS phone_valid, CAST(NULL AS TIMESTAMP) AS validated_at FROM orders WHERE o_orderstatus = 'F'"
NEW_FACTS = "SELECT contact_id, verified AS email_valid, 80 AS email_score, CAST(NULL AS BOOLEAN) AS phone_valid FROM contacts_v WHERE data_source = '2-HIGH'"
query("p34_validations", f"""
    SELECT COALESCE(n.contact_id, o.contact_id) AS contact_id, COALESCE(n.email_valid, o.email_valid) AS email_valid, COALESCE(n.email_score, o.email_score) AS email_score,
      COALESCE(n.phone_valid, o.phone_valid) AS phone_valid, CASE WHEN n.contact_id IS NOT NULL THEN {NOW} ELSE o.validated_at END AS validated_at
    FROM ({OLD_FACTS}) o FULL JOIN ({NEW_FACTS}) n ON o.contact_id = n.contact_id""")(
    lambda t: upsert.apply_validation(t.contacts, t.sql(OLD_FACTS), t.sql(NEW_FACTS + " UNION ALL " + NEW_FACTS), AS_OF)[1])
query("p34_mirrored_flags", f"""
    SELECT c.contact_id, COALESCE(n.email_valid, c.email_verified) AS email_verified, c.phone_verified FROM contacts_v c LEFT JOIN ({NEW_FACTS}) n ON c.contact_id = n.contact_id""")(
    lambda t: upsert.apply_validation(t.contacts, t.sql(OLD_FACTS), t.sql(NEW_FACTS + " UNION ALL " + NEW_FACTS), AS_OF)[0].select("contact_id", "email_verified", "phone_verified"))
query("p35_verify_counts", f"""
    SELECT k NOT IN (1, 2, 4, 6, 8) AS valid, ['invalid_syntax', 'disposable_email', 'catch_all_domain', 'no_mx_records', 'smtp_verified', 'mailbox_not_found',
      'mx_valid_smtp_unknown', ''][k] AS reason, COUNT(*) AS n
    FROM (SELECT CASE WHEN NOT {VALID} THEN 1 WHEN {DISPOSABLE} THEN 2 WHEN {CONSUMER} THEN 3 WHEN COALESCE(mx_count, 0) = 0 THEN 4 WHEN smtp_result = 'ok' THEN 5
      WHEN smtp_result = 'mailbox_not_found' THEN 6 WHEN smtp_result IS NULL THEN 7 ELSE 8 END AS k FROM {FACTED} WHERE email <> '' AND email_verified IS NULL) GROUP BY k""")(
    lambda t: emails.verify_counts(t.contacts, t.facts))

VERSION2 = "SELECT id, CASE WHEN id % 4 = 0 THEN 'dissolved' ELSE status END AS status, CASE WHEN id % 6 = 0 THEN NULL ELSE region END AS region FROM companies_v WHERE locality IS NOT NULL OR phone IS NULL"
query("p36_diff_history", f"""
    SELECT * FROM (SELECT COALESCE(o.id, n.id) AS id, UNNEST(['status', 'region']) AS field_name, UNNEST([o.status, o.region]) AS old_value, UNNEST([n.status, n.region]) AS new_value
      FROM companies_v o FULL JOIN ({VERSION2}) n ON o.id = n.id) WHERE old_value IS DISTINCT FROM new_value""")(
    lambda t: upsert.diff_history(t.companies, t.sql(VERSION2), "id", ["status", "region"]))
query("p37_delete_companies", """
    SELECT id FROM officers_v WHERE company_id NOT IN (SELECT id FROM companies_v WHERE status = 'inactive')""")(
    lambda t: upsert.delete_companies(t.companies.filter("status = 'inactive'"), officers=(t.officers, "company_id"))["officers"].select("id"))
PATCH = "SELECT account_id, CASE WHEN account_id % 2 = 0 THEN 'patched' END AS industry, 'x' AS company_name FROM accounts_v WHERE quality_score IS NULL"
query("p38_patch", f"""
    SELECT a.account_id, COALESCE(p.industry, a.industry) AS industry, a.company_name FROM accounts_v a LEFT JOIN ({PATCH}) p ON a.account_id = p.account_id""")(
    lambda t: upsert.patch(t.accounts, t.sql(PATCH + " UNION ALL " + PATCH), "account_id", ["industry", "city"]).select("account_id", "industry", "company_name"))
FOUND = "SELECT account_id AS seq, company_name, 'BUILDING' AS city FROM accounts_v"
query("p39_insert_discovered", f"""
    SELECT seq, company_name FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {KEY.replace('{c}', 'company_name')} ORDER BY seq) AS rn FROM ({FOUND}) WHERE {DISCOVERABLE}) f WHERE rn = 1
      AND NOT EXISTS (SELECT 1 FROM accounts_v a WHERE LOWER(a.company_name) = LOWER(f.company_name) AND LOWER(a.city) = 'building')""")(
    lambda t: upsert.insert_discovered(t.accounts, t.sql(FOUND), "seq").select("seq", "company_name"))
FEED1 = "SELECT account_id AS row_id, CASE WHEN account_id % 3 = 0 THEN 'N' || CAST(account_id % 100 AS STRING) END AS company_number, company_name FROM accounts_v"
FEED2 = "SELECT id AS row_id, company_number, legal_name AS company_name FROM companies_v"
query("p40_merge_sources", f"""
    SELECT row_id, source_order FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY COALESCE(NULLIF(company_number, ''), {KEY.replace('{c}', 'company_name')}) ORDER BY source_order, row_id) AS rn
      FROM (SELECT *, 0 AS source_order FROM ({FEED1}) UNION ALL SELECT *, 1 FROM ({FEED2}))) WHERE rn = 1""")(
    lambda t: upsert.merge_sources(t.sql(FEED1), t.sql(FEED2), id_column="row_id").select("row_id", "source_order"))
RESULT = "SELECT account_id, 'Found' AS industry, CASE WHEN account_id % 2 = 0 THEN 'https://found.test' END AS website FROM accounts_v WHERE email_format IS NOT NULL"
query("p43_apply_enrichment", f"""
    SELECT a.account_id, COALESCE(NULLIF(a.industry, ''), r.industry, a.industry) AS industry, COALESCE(r.website, a.website) AS website, r.account_id IS NOT NULL AS processed
    FROM accounts_v a LEFT JOIN ({RESULT}) r ON a.account_id = r.account_id""")(
    lambda t: upsert.apply_enrichment(t.accounts, t.sql(RESULT + " UNION ALL " + RESULT), "account_id", prefer_new=["website"], fill_empty=["industry"], processed="processed")
    .select("account_id", "industry", "website", "processed"))

# --- sources ----------------------------------------------------------------------------------


def _raw(t):
    """Registry rows with the headers of the bulk file, one of them with a leading space."""
    r = t.registry
    return registry.raw_columns(r.select(
        F.col("number").alias(" CompanyNumber"), F.col("name").alias("CompanyName"), F.col("category").alias("CompanyCategory"),
        F.col("status").alias("CompanyStatus"), F.col("born").alias("IncorporationDate"), F.col("line1").alias("RegAddress.AddressLine1"),
        F.col("town").alias("RegAddress.PostTown"), F.col("country").alias("RegAddress.Country"), F.col("sic").alias("SICCode.SicText_1")))


query("s01_registry_rows", f"""
    SELECT number AS company_number, name, CAST(TRY_STRPTIME(born, '%d/%m/%Y') AS DATE) AS incorporation_date, COALESCE(NULLIF(country, ''), 'United Kingdom') AS country,
      CASE WHEN sic = '' THEN 'Other' ELSE {ordered_case('LOWER(sic)', rules.SIC_TEXT, q('Other'))} END AS industry FROM registry_v""")(
    lambda t: registry.map_registry_rows(_raw(t)).select("company_number", "name", "incorporation_date", "country", "industry"))
query("s02_active_registry_rows", f"""
    SELECT number AS company_number, TRIM(REGEXP_REPLACE(TRIM(name), '^"+|"+$', '', 'g')) AS name,
      CASE {' '.join(f"WHEN LOWER(country) = {q(n.lower())} THEN {q(n)}" for n in rules.HOME_NATIONS)} ELSE NULLIF(country, '') END AS country, NULLIF(sic, '') AS industry
    FROM registry_v WHERE number <> '' AND status LIKE '%Active%'""")(
    lambda t: registry.map_registry_rows(_raw(t), active_only=True).select("company_number", "name", "country", "industry"))

PAYLOAD3 = """SELECT id, '{"' || CASE id % 3 WHEN 0 THEN 'company_number' WHEN 1 THEN 'registrationNumber' ELSE 'id' END || '": "' || company_number || '", "'
    || CASE id % 2 WHEN 0 THEN 'company_name' ELSE 'title' END || '": "' || legal_name || '", "company_status": "active", "date_of_creation": "2001-02-03", "sic_codes": ["'
    || CASE id % 4 WHEN 0 THEN '62012' WHEN 1 THEN '47190' ELSE '01110' END || '"], "registered_office_address": {"address_line_1": "1 Way", "postalCode": "AB1"}}' AS payload FROM companies_v"""
query("s03_registry_json", """
    SELECT company_number, legal_name AS name, 'active' AS status, DATE '2001-02-03' AS incorporation_date, '1 Way' AS address_line_1, 'AB1' AS postal_code,
      'United Kingdom' AS country, CASE id % 4 WHEN 0 THEN 'Technology' WHEN 1 THEN 'Retail Trade' ELSE 'Other' END AS industry FROM companies_v""")(
    lambda t: registry.map_registry_json(t.sql(PAYLOAD3)).select(
        "company_number", "name", "status", "incorporation_date", "address_line_1", "postal_code", "country", "industry"))
PAYLOAD4 = """SELECT id, CASE WHEN id % 2 = 0 THEN '{"company": ' ELSE '' END || '{"company_number": "' || company_number || '", "name": "' || legal_name
    || '", "jurisdiction_code": "' || jurisdiction || '", "current_status": "live", ' || CASE WHEN id % 3 = 0 THEN '"registered_address_in_full": "1 Main St, Suite 4, Albany, NY, 122' || CAST(id % 90 + 10 AS STRING) || '"}' ELSE '"registered_address": {"locality": "Leeds"}}' END || CASE WHEN id % 2 = 0 THEN '}' ELSE '' END AS payload
    FROM companies_v"""
query("s04_open_registry_json", "SELECT company_number, legal_name AS name, jurisdiction, 'live' AS status, CASE WHEN id % 3 = 0 THEN 'Albany' ELSE 'Leeds' END AS locality, CASE WHEN id % 3 = 0 THEN '1 Main St' END AS address_line_1, CASE WHEN id % 3 = 0 THEN 'NY' END AS region, CASE WHEN id % 3 = 0 THEN '122' || CAST(id % 90 + 10 AS STRING) END AS postal_code, CASE WHEN id % 3 = 0 THEN 'United States' END AS country FROM companies_v")(
    lambda t: registry.map_open_registry_json(t.sql(PAYLOAD4)).select("company_number", "name", "jurisdiction", "status", "locality", "address_line_1", "region", "postal_code", "country"))
PAYLOAD5 = """SELECT company_id, '{"items": [{"name": ' || COALESCE('"' || name || '"', 'null') || ', "officer_role": "' || role || '", "appointed_on": "' || CAST(appointed_date AS STRING)
    || '", "date_of_birth": {"year": 1970, "month": ' || CAST(1 + id % 12 AS STRING) || '}, "links": {"officer": {"appointments": "/officers/k' || CAST(id AS STRING)
    || '/appointments"}}}, {"name": "Second", "appointed_on": "2020-01-01"}]}' AS payload FROM officers_v"""
query("s05_officers_json", """
    SELECT company_id, 'k' || CAST(id AS STRING) AS officer_id, name, role, appointed_date, MAKE_DATE(1970, 1 + id % 12, 1) AS date_of_birth FROM officers_v
    UNION ALL SELECT company_id, NULL, 'Second', 'director', DATE '2020-01-01', NULL FROM officers_v""")(
    lambda t: registry.map_officers_json(t.sql(PAYLOAD5)).select("company_id", "officer_id", "name", "role", "appointed_date", "date_of_birth"))


def _nodes(t):
    """Place and business nodes with tag maps, from the customer table."""
    return t.base("customer").select(
        F.col("c_custkey").alias("id"), F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon"), F.map_filter(F.create_map(
            F.lit("name"), F.when(F.col("c_custkey") % 10 > 0, F.col("c_name")), F.lit("place"), F.when(F.col("c_custkey") % 3 > 0, F.lit("town")),
            F.lit("population"), F.when(F.col("c_custkey") % 4 > 0, (F.col("c_custkey") * 100).cast("string")).otherwise(F.lit("many")),
            F.lit("is_in:state"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")), F.lit("addr:street"), F.col("c_mktsegment"),
            F.lit("addr:postcode"), F.when(F.col("c_custkey") % 2 > 0, F.lit("AB1")), F.lit("shop"), F.when(F.col("c_custkey") % 7 > 0, F.lit("bakery")),
            F.lit("contact:phone"), F.lit("123")), lambda k, v: v.isNotNull()).alias("tags"))


query("s06_places_to_queue", """
    SELECT c_custkey AS queue_id, c_name AS city, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment ELSE 'France' END AS state_region,
      CASE WHEN c_custkey % 3 > 0 THEN 'town' ELSE 'locality' END AS place_type, CASE WHEN c_custkey % 4 > 0 THEN c_custkey * 100 ELSE 0 END AS population,
      CASE WHEN c_custkey % 3 > 0 THEN CASE WHEN c_custkey % 4 > 0 AND c_custkey * 100 > 10000 THEN 2 ELSE 3 END ELSE 5 END AS priority
    FROM customer WHERE c_custkey % 10 > 0""")(lambda t: places.places_to_queue(_nodes(t), "France", "FR").select(
        "queue_id", "city", "state_region", "place_type", "population", "priority"))
query("s07_osm_to_accounts", """
    SELECT c_custkey AS node_id, CASE WHEN c_custkey % 10 > 0 THEN c_name END AS company_name, c_mktsegment || CASE WHEN c_custkey % 2 > 0 THEN ', AB1' ELSE '' END AS address,
      '123' AS phone_number, CASE WHEN c_custkey % 7 > 0 THEN 'bakery' ELSE 'Business' END AS industry FROM customer""")(
    lambda t: places.osm_to_accounts(_nodes(t), "France", "Nord", "Lille").select("node_id", "company_name", "address", "phone_number", "industry"))


def _tree(t):
    """The nested location file, rebuilt from the location tables."""
    cities = t.cities.groupBy("state_id").agg(F.collect_list(F.struct(
        F.col("city_name").alias("name"), F.array(F.lit("Old"), F.lit("New")).alias("districts"))).alias("cities"))
    states = t.states.join(cities, "state_id", "left").groupBy("country_id").agg(F.collect_list(F.struct(
        F.col("state_code").alias("code"), F.col("state_name").alias("name"), "cities")).alias("states"))
    return t.countries.join(states, "country_id").select(F.array(F.struct(
        F.col("country_code").alias("code"), F.col("country_name").alias("name"), "states")).alias("countries"))


query("s08_locations", """
    SELECT country_name AS country, state_name AS state_region, city_name AS city, d AS district FROM countries_v c JOIN states_v s ON c.country_id = s.country_id
    LEFT JOIN (SELECT state_id AS sid, city_name, UNNEST(['Old', 'New']) AS d FROM cities_v) x ON x.sid = s.state_id""")(
    lambda t: places.flatten_locations(_tree(t)).select("country", "state_region", "city", "district"))
query("s09_union_locations", """
    SELECT state_name AS state_region, 3 AS priority, 0 AS population FROM states_v UNION ALL SELECT city_name, 2, 7 FROM cities_v""")(
    lambda t: locations.union_locations(t.states.select(F.col("state_name").alias("state_region")),
                                        t.cities.select(F.col("city_name").alias("state_region"), F.lit(7).alias("population"))))
# six kinds of block, told apart by the key: subtitles with and without a company, free text only, maps entries, filters of the page
WHO, WHERE = "COALESCE(first_name, 'Ann') || ' ' || COALESCE(NULLIF(last_name, ''), 'Lee')", "'Town' || CHR(CAST(65 + contact_id % 26 AS INT))"
CALLED = "CASE WHEN first_name = '' THEN COALESCE(NULLIF(last_name, ''), 'Lee') ELSE " + WHO + " END"
LEAD_ROWS = f"""SELECT contact_id AS lead_id, CASE WHEN contact_id % 6 = 3 THEN 'maps' ELSE 'people' END AS strategy,
    CASE contact_id % 4 WHEN 0 THEN '["Retail ' || CAST(contact_id % 30 AS STRING) || '"]' WHEN 1 THEN '["25"]' END AS asked_industry, 'Ham, Essex, England' AS asked_place,
    CASE contact_id % 6
      WHEN 0 THEN '{{"name": "• ' || {WHO} || ' 2nd", "subtitle": "Head of Sales ' || CAST(contact_id % 9 AS STRING) || ' at Firm' || CAST(contact_id % 70 AS STRING) || ' Ltd · x", "location": "' || {WHERE} || ', Kent, United Kingdom", "rawText": "call +44 161 496 ' || CAST(1000 + contact_id % 9000 AS STRING) || ' or a' || CAST(contact_id AS STRING) || '@acme.test now"}}'
      WHEN 1 THEN '{{"name": "' || {WHO} || '", "subtitle": "Founder", "company": " Own' || CAST(contact_id % 50 AS STRING) || ' ", "industry": "Food", "email": "x' || CAST(contact_id AS STRING) || '@b.test", "rawText": "other@c.test"}}'
      WHEN 2 THEN '{{"rawText": "Sarah Walker\\\\n2nd degree connection\\\\nChief Baker' || CAST(contact_id % 8 AS STRING) || ' at Bread' || CAST(contact_id % 60 AS STRING) || ' Co, Leeds\\\\n555-' || CAST(100000 + contact_id % 900000 AS STRING) || '"}}'
      WHEN 3 THEN '{{"name": "Cafe ' || {WHERE} || '", "phone": "020 7946 0' || CAST(100 + contact_id % 900 AS STRING) || '", "website": "cafe' || CAST(contact_id AS STRING) || '.test"}}'
      WHEN 4 THEN '{{"name": "' || {WHO} || '", "rawText": "Message · follow · Plumber and fitter ' || CAST(contact_id % 40 AS STRING) || ' · View", "location": "France"}}'
      ELSE '{{"name": "", "subtitle": "  ", "rawText": "no name here, m' || CAST(contact_id AS STRING) || '@d.test"}}' END AS payload FROM contacts_v"""
query("s10_parse_leads", f"""
    SELECT contact_id AS lead_id,
      CASE contact_id % 6 WHEN 2 THEN 'Sarah Walker' WHEN 3 THEN NULL WHEN 5 THEN NULL ELSE {CALLED} END AS full_name,
      CASE contact_id % 6 WHEN 0 THEN 'Head of Sales ' || (contact_id % 9) WHEN 1 THEN 'Founder' WHEN 2 THEN 'Sarah Walker'
        WHEN 4 THEN 'Plumber and fitter ' || (contact_id % 40) END AS job_title,
      CASE contact_id % 6 WHEN 0 THEN 'Firm' || (contact_id % 70) || ' Ltd' WHEN 1 THEN 'Own' || (contact_id % 50) WHEN 3 THEN 'Cafe ' || {WHERE.replace('CHR(', 'chr(')} END AS company,
      CASE contact_id % 6 WHEN 0 THEN 'a' || contact_id || '@acme.test' WHEN 1 THEN 'x' || contact_id || '@b.test' WHEN 5 THEN 'm' || contact_id || '@d.test' END AS email,
      CASE contact_id % 6 WHEN 0 THEN '+44 161 496 ' || (1000 + contact_id % 9000) WHEN 2 THEN '555-' || (100000 + contact_id % 900000) WHEN 3 THEN '020 7946 0' || (100 + contact_id % 900) END AS phone_number,
      CASE contact_id % 6 WHEN 3 THEN 'cafe' || contact_id || '.test' END AS website,
      CASE contact_id % 6 WHEN 0 THEN {WHERE.replace('CHR(', 'chr(')} WHEN 4 THEN NULL ELSE 'Ham' END AS city,
      CASE contact_id % 6 WHEN 0 THEN 'United Kingdom' WHEN 4 THEN 'France' ELSE 'England' END AS country,
      CASE WHEN contact_id % 6 = 1 THEN 'Food' WHEN contact_id % 4 = 0 THEN 'Retail ' || (contact_id % 30) END AS industry FROM contacts_v""")(
    lambda t: places.parse_leads(t.sql(LEAD_ROWS), strategy="strategy", filter_industry="asked_industry", filter_location="asked_place").select(
        "lead_id", "full_name", "job_title", "company", "email", "phone_number", "website", "city", "country", "industry"))


def _reloaded(t):
    """The account table written as Parquet and loaded with its declared schema."""
    folder = shared_folder(t.spark)
    t.accounts.write.parquet(folder)
    return tables.load(t.spark, "accounts", folder)


query("s12_load", "SELECT account_id, company_name, quality_score, created_at, CAST(NULL AS STRING) AS ward FROM accounts_v")(
    lambda t: _reloaded(t).select("account_id", "company_name", "quality_score", "created_at", "ward"))


def _written(t):
    """Documents written as CSV and read back."""
    folder = shared_folder(t.spark)
    export.write_csv(t.base("documents").select("doc_id", "text"), folder)
    return t.spark.read.schema("doc_id bigint, text string").options(header=True, quote='"', escape='"', lineSep="\r\n").csv(folder)


query("k05_csv_round_trip", "SELECT doc_id, NULLIF(TRIM(REGEXP_REPLACE(text, '[\\r\\n]+', ' ', 'g')), '') AS text FROM documents")(
    lambda t: _written(t))

# --- exports ----------------------------------------------------------------------------------

HEADED = ", ".join(f'{c if c not in ("twitter_url", "facebook_url", "instagram_url") else "NULL"} AS "{h}"' for h, c in export.COMPANY_HEADINGS.items() if h != "Contact Count")
query("k01_export_companies", f"""
    SELECT account_id, {HEADED}, COALESCE(k, 0) AS "Contact Count" FROM accounts_v a
    LEFT JOIN (SELECT linked_account_id, COUNT(*) AS k FROM contacts_v GROUP BY 1) c ON a.account_id = c.linked_account_id
    WHERE quality_score >= 20 AND LOWER(city) LIKE '%build%'""")(
    lambda t: export.export_companies(t.accounts, t.contacts, min_quality=20, city="Build"))
query("k02_export_companies_full", """
    SELECT a.* REPLACE (CASE WHEN verified THEN 'Yes' ELSE 'No' END AS verified), COALESCE(k, 0) AS contact_count, COALESCE(e, 0) AS contacts_with_email
    FROM accounts_v a LEFT JOIN (SELECT linked_account_id, COUNT(*) AS k, COUNT(email) AS e FROM contacts_v GROUP BY 1) c ON linked_account_id = account_id""")(
    lambda t: export.export_companies_full(t.accounts, t.contacts))
query("k03_export_contacts", """
    SELECT c.* REPLACE (CASE WHEN c.verified THEN 'Yes' ELSE 'No' END AS verified), a.company_name, a.website, a.country AS account_country, a.city AS account_city, a.industry AS account_industry
    FROM contacts_v c LEFT JOIN accounts_v a ON linked_account_id = account_id WHERE email <> '' AND a.country = 'EUROPE'""")(
    lambda t: export.export_contacts(t.contacts, t.accounts, has_email=True, country="EUROPE"))
query("k04_export_combined", """
    SELECT contact_id, first_name || ' ' || last_name AS full_name, job_title, email, c.phone_number, c.linkedin_url, a.company_name, a.website, a.industry, a.city, a.country,
      CASE WHEN c.verified THEN 'Yes' ELSE 'No' END AS verified, STRFTIME(c.created_at, '%Y-%m-%d') AS created_date
    FROM contacts_v c LEFT JOIN accounts_v a ON linked_account_id = account_id""")(
    lambda t: export.export_combined(t.contacts, t.accounts))
query("k05_flat_text", "SELECT doc_id, TRIM(REGEXP_REPLACE(text, '[\\r\\n]+', ' ', 'g')) AS text FROM documents")(
    lambda t: export.flat_text(t.base("documents").select("doc_id", "text")))
LOGGED = f"""SELECT id AS log_id, '{{"query":"' || search_query || '","user_session":' || CAST(user_session AS STRING) || '}}' AS filters, {NOW} AS searched_at FROM search_logs_v"""


def _log(t):
    return export.log_rows(t.search_logs.select(F.col("id").alias("log_id"), F.col("search_query").alias("query"), "user_session"), AS_OF,
                           "searched_at", "filters", ("query", "user_session")).select("log_id", "filters", "searched_at")


@query("k06_append_log", f"{LOGGED} UNION ALL {LOGGED} WHERE id % 3 = 0")
def _appended(t):
    """A log written by two runs, the second of some rows, read back."""
    folder, rows = shared_folder(t.spark), _log(t)
    export.append_log(rows, folder)
    export.append_log(rows.where("log_id % 3 = 0"), folder)
    return t.spark.read.schema(rows.schema).parquet(folder)


query("k06_log_rows", LOGGED)(_log)


def _counted(t, rows, counts):
    """The counts that a run over all rows has observed, as one row."""
    rows.write.format("noop").mode("overwrite").save()
    found = counts.get
    return t.spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} long" for k in found))


@query("a34_with_metrics", """
    SELECT COUNT(*) AS total, COUNT(*) FILTER (status = 'Active') AS imported, COUNT(*) FILTER (number = '') AS failed,
      COUNT(*) FILTER (status <> 'Active' AND number <> '') AS skipped FROM registry_v""")
def _run_metrics(t):
    seen = Observation()
    return _counted(t, metrics.with_metrics(t.registry, seen, F.col("status") == "Active", F.col("number") == ""), seen)


@query("s02_skipped_rows", """
    SELECT COUNT(*) AS read, COUNT(*) FILTER (number <> '' AND status LIKE '%Active%') AS imported, COUNT(*) FILTER (number = '') AS no_number,
      COUNT(*) FILTER (number <> '' AND status NOT LIKE '%Active%') AS not_active FROM registry_v""")
def _skipped(t):
    seen = Observation()
    return _counted(t, registry.map_registry_rows(registry.count_skipped(_raw(t), seen), active_only=True), seen)


query("w01_latest_delta", f"SELECT company_number, seq FROM ({LAST})")(
    lambda t: keys.keep_first(t.sql(DELTA), ["company_number"], [F.desc("seq")]).select("company_number", "seq"))

"""Queries J-01 … J-26, U-01 … U-03, W-04."""

from pyspark.sql import functions as F

from ..operators import classify, dedup, joins, locations, search
from .registry import query
from .views import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"
DOMAIN = ("NULLIF(TRIM(SPLIT_PART(SPLIT_PART(REGEXP_REPLACE(REGEXP_REPLACE(CASE WHEN CONTAINS({c}, '@') "
          "THEN SPLIT_PART(LOWER(TRIM({c})), '@', 2) ELSE LOWER(TRIM({c})) END, '^https?://', ''), '^www\\.', ''), '/', 1), '?', 1)), '')")

query("j01_with_locations", """
    SELECT l.id, country_name, state_name, city_name FROM located_v l JOIN countries_v c ON l.country_id = c.country_id
      LEFT JOIN states_v s ON l.state_id = s.state_id LEFT JOIN cities_v ci ON l.city_id = ci.city_id""")(
    lambda t: joins.with_locations(t.located, t.countries, t.states, t.cities).select("id", "country_name", "state_name", "city_name"))

query("j02_contacts_with_account", """
    SELECT contact_id, a.company_name, a.country AS account_country FROM contacts_v LEFT JOIN accounts_v a ON linked_account_id = account_id""")(
    lambda t: joins.contacts_with_account(t.contacts, t.accounts).select("contact_id", "company_name", "account_country"))

query("j03_with_contact_count", """
    SELECT account_id, COUNT(contact_id) AS contact_count FROM accounts_v LEFT JOIN contacts_v ON linked_account_id = account_id GROUP BY account_id""")(
    lambda t: joins.with_contact_count(t.accounts, t.contacts).select("account_id", "contact_count"))

query("j04_nest_contacts", """
    SELECT id, COALESCE(STRING_AGG(contact_type || '=' || value, ',' ORDER BY contact_type, value), '') AS contacts
    FROM companies_v LEFT JOIN company_contacts_v ON company_id = id GROUP BY id""")(
    lambda t: joins.nest_contacts(t.companies.select("id", "name"), t.company_contacts).select(
        "id", F.array_join(F.transform("contacts", lambda c: F.concat(c["contact_type"], F.lit("="), c["value"])), ",").alias("contacts")))

query("j05_nest_active_officers", """
    SELECT c.id, COALESCE(STRING_AGG(o.name || ':' || o.role, ',' ORDER BY o.id, o.name, o.role) FILTER (WHERE o.name IS NOT NULL), '') AS officers,
      COUNT(o.id) AS n FROM companies_v c LEFT JOIN (SELECT * FROM officers_v WHERE resigned_date IS NULL) o ON o.company_id = c.id GROUP BY c.id""")(
    lambda t: joins.nest_active_officers(t.companies.select("id"), t.officers).select(
        "id", F.array_join(F.transform("officers", lambda o: F.concat(o["name"], F.lit(":"), o["role"])), ",").alias("officers"),
        F.size("officers").cast("bigint").alias("n")))

query("j06_company_officers", """
    SELECT o.id, c.name AS company_name, o.resigned_date IS NULL AS is_active FROM officers_v o JOIN companies_v c ON o.company_id = c.id""")(
    lambda t: joins.company_officers(t.companies, t.officers).select("id", "company_name", "is_active"))

query("j07_nest_appointments", """
    SELECT o.name, c.name AS company_name, o.role, o.appointed_date, o.resigned_date FROM officers_v o JOIN companies_v c ON o.company_id = c.id WHERE o.name IS NOT NULL
    UNION ALL SELECT * FROM (SELECT DISTINCT o.name, NULL, NULL, CAST(NULL AS DATE), CAST(NULL AS DATE) FROM officers_v o WHERE o.name IS NULL
      OR NOT EXISTS (SELECT 1 FROM officers_v p JOIN companies_v c ON p.company_id = c.id WHERE p.name = o.name))""")(
    lambda t: joins.nest_appointments(t.officers, t.companies, parts=3).select("name", F.explode_outer("appointments").alias("a")).select("name", "a.*"))

query("j08_without_officers", "SELECT id FROM companies_v WHERE id NOT IN (SELECT company_id FROM officers_v)")(
    lambda t: joins.without_officers(t.companies, t.officers.filter(F.col("company_id").isNotNull())).select("id"))

query("j09_without", """
    SELECT account_id FROM accounts_v a WHERE NOT EXISTS (SELECT 1 FROM contacts_v c WHERE c.linked_account_id = a.account_id
      AND c.data_source = '5-LOW')""")(
    lambda t: joins.without(t.accounts, t.contacts, [("account_id", "linked_account_id")], F.col("data_source") == "5-LOW").select("account_id"))

query("j10_orphans", "SELECT contact_id FROM contacts_v WHERE linked_account_id NOT IN (SELECT account_id FROM accounts_v)")(
    lambda t: joins.orphans(t.contacts, t.accounts).select("contact_id"))

query("j11_having_contacts", "SELECT account_id FROM accounts_v WHERE account_id IN (SELECT linked_account_id FROM contacts_v)")(
    lambda t: joins.having_contacts(t.accounts, t.contacts).select("account_id"))

STAR = """SELECT k.keep AS id1, r.id AS id2{carry} FROM ({rows}) r JOIN (SELECT key, MIN(id) AS keep FROM ({rows}) GROUP BY key HAVING COUNT(*) > 1) k
    ON r.key = k.key AND r.id <> k.keep"""
WEB_ROWS = "SELECT id, website AS key FROM companies_v WHERE website IS NOT NULL AND website <> ''"
NAME_ROWS = """SELECT id, LOWER(TRIM(name)) || '|' || LOWER(TRIM(COALESCE(address_line_1, ''))) || '|' || LOWER(TRIM(COALESCE(locality, ''))) AS key
    FROM companies_v WHERE LENGTH(name) > 3 AND (address_line_1 IS NOT NULL OR locality IS NOT NULL)"""
REG_ROWS = "SELECT id, REPLACE(REPLACE(UPPER(company_number), '-', ''), ' ', '') AS key FROM companies_v WHERE LENGTH(company_number) > 3"

query("j12_dup_by_website", STAR.format(rows=WEB_ROWS, carry=", 0.95 AS confidence, r.key AS match_field"))(
    lambda t: dedup.dup_by_website(t.companies).select("id1", "id2", "confidence", "match_field"))
query("j13_dup_by_name_address", STAR.format(rows=NAME_ROWS, carry=", 0.9 AS confidence"))(
    lambda t: dedup.dup_by_name_address(t.companies).select("id1", "id2", "confidence"))
query("j14_dup_by_registration", STAR.format(rows=REG_ROWS, carry=", 1.0 AS confidence"))(
    lambda t: dedup.dup_by_registration(t.companies).select("id1", "id2", "confidence"))

ALL_PAIRS = f"""
    SELECT id1, id2, MIN(o) AS o FROM (SELECT id1, id2, 0 AS o FROM ({STAR.format(rows=WEB_ROWS, carry='')})
      UNION ALL SELECT id1, id2, 1 FROM ({STAR.format(rows=NAME_ROWS, carry='')})
      UNION ALL SELECT id1, id2, 2 FROM ({STAR.format(rows=REG_ROWS, carry='')})) GROUP BY id1, id2"""
query("u03_find_duplicates", f"""
    SELECT id1, id2, CASE o WHEN 0 THEN 'same_website' WHEN 1 THEN 'same_name_and_address' ELSE 'same_registration_number' END AS match_reason,
      CASE o WHEN 0 THEN 0.95 WHEN 1 THEN 0.9 ELSE 1.0 END AS confidence FROM ({ALL_PAIRS})""")(
    lambda t: dedup.find_duplicates(t.companies).select("id1", "id2", "match_reason", "confidence"))

query("j15_areas_with_counts", """
    SELECT a.country, a.state_region, a.city, (SELECT COUNT(*) FROM accounts_v x WHERE LOWER(x.city) = LOWER(a.city)
      AND LOWER(x.state_region) = LOWER(a.state_region) AND LOWER(x.country) = LOWER(a.country)) AS current_companies FROM areas_v a""")(
    lambda t: joins.areas_with_counts(t.areas, t.accounts).select("country", "state_region", "city", "current_companies"))

for _dim, _key in (("countries", "country_id"), ("states", "state_id"), ("cities", "city_id")):
    query(f"j16_counts_by_{_dim}", f"""
        SELECT d.{_key}, COUNT(l.id) AS company_count FROM {_dim}_v d LEFT JOIN located_v l ON d.{_key} = l.{_key} GROUP BY d.{_key}""")(
        lambda t, d=_dim, k=_key: joins.counts_by_dim(getattr(t, d), t.located, k).select(k, "company_count"))

query("j17_match_any", """
    SELECT n.new_id, MIN(c.contact_id) AS matched_id FROM new_contacts_v n JOIN contacts_v c ON c.email = n.email OR c.phone_number = n.phone_number
      OR c.linkedin_url = n.linkedin_url OR (LOWER(c.first_name) = LOWER(n.first_name) AND LOWER(c.last_name) = LOWER(n.last_name)
        AND c.linked_account_id IS NOT DISTINCT FROM n.linked_account_id) GROUP BY n.new_id""")(
    lambda t: joins.match_any(t.new_contacts, t.contacts))

# a small dictionary in declared order; '6201' belongs to two categories, '62' is a short prefix
PREFIXES = {"Computer Software": ["6201", "6202", "6203", "6209"], "Retail": ["4711", "4719", "4721"], "Computer Games": ["5821", "6201"],
            "Import & Export": ["471"]}
query("j19_naics_category", """
    SELECT account_id, CASE WHEN industry LIKE '6201%' OR industry LIKE '6202%' OR industry LIKE '6203%' OR industry LIKE '6209%' THEN 'Computer Software'
      WHEN industry LIKE '4711%' OR industry LIKE '4719%' OR industry LIKE '4721%' THEN 'Retail' WHEN industry LIKE '5821%' THEN 'Computer Games'
      WHEN industry LIKE '471%' THEN 'Import & Export' ELSE industry END AS category FROM accounts_v""")(
    lambda t: classify.naics_category(t.accounts, "industry", PREFIXES).select("account_id", "category"))

query("j20_accounts_in_category", "SELECT account_id FROM accounts_v WHERE industry LIKE '4711%' OR industry LIKE '4719%' OR industry LIKE '4721%'")(
    lambda t: search.filter_accounts(t.accounts, PREFIXES, industry="Retail").select("account_id"))

query("j21_location_backlog", """
    SELECT q.queue_id, COUNT(a.account_id) AS existing FROM queue_v q LEFT JOIN accounts_v a ON LOWER(a.city) = LOWER(q.city)
      AND LOWER(a.state_region) = LOWER(q.state_region) AND LOWER(a.country) = LOWER(q.country)
    WHERE NOT EXISTS (SELECT 1 FROM areas_v d WHERE d.city = UPPER(q.city) AND d.state_region = q.state_region AND d.country = LOWER(q.country))
    GROUP BY q.queue_id""")(
    lambda t: locations.location_backlog(t.queue, t.accounts, t.areas.select(
        F.upper("country").alias("country"), "state_region", "city")).select("queue_id", "existing"))

query("j21_backlog_first", """
    SELECT country, state_region, city, priority, existing FROM (SELECT q.*, (SELECT COUNT(*) FROM accounts_v a WHERE LOWER(a.city) = LOWER(q.city)
        AND LOWER(a.state_region) = LOWER(q.state_region) AND LOWER(a.country) = LOWER(q.country)) AS existing
      FROM queue_v q) ORDER BY priority, existing, population DESC, country, state_region, city LIMIT 50""")(
    lambda t: locations.backlog_order(locations.location_backlog(t.queue, t.accounts)).limit(50).select(
        "country", "state_region", "city", "priority", "existing"))

query("j22_contacts_with_validation", """
    SELECT c.contact_id, v.email_score FROM contacts_v c LEFT JOIN (SELECT log_id AS contact_id, CAST(FLOOR(score) AS INT) AS email_score FROM log_v) v
    ON c.contact_id = v.contact_id""")(
    lambda t: joins.contacts_with_validation(t.contacts, t.sql(
        "SELECT log_id AS contact_id, TRUE AS email_valid, CAST(FLOOR(score) AS INT) AS email_score, TRUE AS phone_valid FROM log_v"))
    .select("contact_id", "email_score"))

query("j23_company_detail", """
    SELECT c.id, COALESCE(k.n, 0) AS n_contacts, COALESCE(s.names, '') AS sources FROM companies_v c
      LEFT JOIN (SELECT company_id, COUNT(*) AS n FROM company_contacts_v GROUP BY 1) k ON k.company_id = c.id
      LEFT JOIN (SELECT company_id, STRING_AGG(source_name || ':' || CAST(reliability AS STRING), ',' ORDER BY source_name) AS names FROM sources_v GROUP BY 1) s
        ON s.company_id = c.id""")(
    lambda t: joins.company_detail(t.companies.select("id", "name"), t.company_contacts, t.sources).select(
        "id", F.size("contacts").cast("bigint").alias("n_contacts"),
        F.array_join(F.transform("sources", lambda s: F.concat(s["source_name"], F.lit(":"), s["reliability"].cast("string"))), ",").alias("sources")))

# stored sites with subdomains, paths that name another host, ports and capitals; new ones with and without a dot
SITES = """SELECT account_id, company_name, CASE WHEN account_id % 5 = 0 THEN 'https://Shop.' || REPLACE(REPLACE(website, 'https://www.', ''), '/', '') || ':8080/home'
    WHEN account_id % 7 = 0 THEN 'http://example.org/to/' || website WHEN account_id % 11 = 0 THEN 'my' || website ELSE website END AS website FROM accounts_v"""
ARRIVED = """SELECT contact_id AS new_id, CASE WHEN contact_id % 2 = 0 THEN 'CITY Dental Clinic 1 LIMITED' ELSE 'Pizza' END AS company_name,
    CASE WHEN contact_id % 13 = 0 THEN 'localhost' WHEN contact_id % 17 = 0 THEN 'http://e4.test' WHEN contact_id % 19 = 0 THEN 'https://shop.site' || CAST(contact_id % 90 AS STRING) || '.test'
      WHEN contact_id % 23 = 0 THEN 'Y/site' WHEN contact_id % 29 = 0 THEN NULL ELSE 'site' || CAST(contact_id % 90 AS STRING) || '.test/x' END AS website FROM contacts_v"""
query("j24_possible_duplicates", f"""
    WITH n AS (SELECT *, {DOMAIN.format(c='website')} AS host FROM ({ARRIVED})), s AS (SELECT account_id, company_name, LOWER(website) AS site FROM ({SITES})),
      by_name AS (SELECT LOWER(company_name) AS name, MIN(account_id) AS name_match FROM s GROUP BY 1),
      by_site AS (SELECT host, MIN(account_id) AS site_match FROM (SELECT DISTINCT host FROM n) h JOIN s ON CONTAINS(s.site, h.host) GROUP BY host)
    SELECT new_id, name_match, site_match FROM n LEFT JOIN by_name ON LOWER(n.company_name) = by_name.name LEFT JOIN by_site ON by_site.host = n.host
    WHERE name_match IS NOT NULL OR site_match IS NOT NULL""")(
    lambda t: joins.possible_duplicates(t.sql(ARRIVED), t.sql(SITES)))

query("j25_accounts_needing_contacts", f"""
    SELECT account_id FROM (SELECT a.*, COALESCE(contact_count, 0) AS k FROM accounts_v a LEFT JOIN
      (SELECT linked_account_id, COUNT(*) AS contact_count FROM contacts_v GROUP BY 1) c ON account_id = linked_account_id
      WHERE LOWER(city) = 'building' AND (LOWER(state_region) = 'europe' OR LOWER(country) = 'europe')) WHERE k < 11
    ORDER BY CASE WHEN website <> '' THEN 1 ELSE 0 END DESC, created_at DESC, account_id LIMIT 40""")(
    lambda t: search.accounts_needing_contacts(t.accounts, t.contacts, 11, 40, "Building", "Europe").select("account_id"))

query("j26_match_name_or_address", """
    SELECT new_id, name_match, address_match FROM (SELECT n.new_id,
        (SELECT MIN(account_id) FROM accounts_v a WHERE LOWER(a.company_name) = LOWER(n.company_name)) AS name_match,
        (SELECT MIN(account_id) FROM accounts_v a WHERE a.address <> '' AND n.address <> '' AND CONTAINS(LOWER(a.address), SUBSTR(LOWER(n.address), 1, 30))) AS address_match
      FROM (SELECT contact_id AS new_id, COALESCE(first_name, 'x') AS company_name, CASE WHEN contact_id % 3 = 0 THEN 'street, automobile'
          WHEN contact_id % 7 = 0 THEN '' ELSE CAST(contact_id % 60 AS STRING) || ' high street, AUTOMOBILE, NATION_3, ZZ' END AS address FROM contacts_v) n) WHERE name_match IS NOT NULL OR address_match IS NOT NULL""")(
    lambda t: joins.match_name_or_address(t.sql("""SELECT contact_id AS new_id, COALESCE(first_name, 'X') AS company_name,
        CASE WHEN contact_id % 3 = 0 THEN 'street, automobile' WHEN contact_id % 7 = 0 THEN '' ELSE CAST(contact_id % 60 AS STRING) || ' high street, AUTOMOBILE, NATION_3, ZZ' END
        AS address FROM contacts_v"""), t.accounts))

query("u01_search_locations", """
    SELECT 'city' AS type, city_id AS id, city_name AS name, s.state_id AS parent_id, state_name AS parent_name, country_name FROM cities_v c
      JOIN states_v s ON c.state_id = s.state_id JOIN countries_v k ON s.country_id = k.country_id WHERE city_name ILIKE '%a%'
    UNION ALL SELECT 'state', state_id, state_name, k.country_id, country_name, country_name FROM states_v s JOIN countries_v k ON s.country_id = k.country_id
      WHERE state_name ILIKE '%a%'
    UNION ALL SELECT 'country', country_id, country_name, NULL, NULL, country_name FROM countries_v WHERE country_name ILIKE '%a%'""")(
    lambda t: locations.search_locations("a", t.countries, t.states, t.cities))

query("u02_known_names", """
    SELECT id, name FROM companies_v WHERE LOWER(name) IN (SELECT LOWER(name) FROM companies_v WHERE status = 'active' UNION SELECT LOWER(company_name) FROM accounts_v)""")(
    lambda t: joins.known_names(t.companies.select("id", "name"), t.companies.filter("status = 'active'"), t.accounts))

query("w04_set_primary", """
    SELECT contact_id, CASE WHEN chosen_id IS NULL THEN is_primary ELSE contact_id = chosen_id END AS is_primary
    FROM contacts_v c LEFT JOIN (SELECT linked_account_id AS k, MAX(contact_id) AS chosen_id FROM contacts_v WHERE verified GROUP BY 1) x
    ON c.linked_account_id = x.k""")(
    lambda t: joins.set_primary(t.contacts, t.contacts.filter("verified").groupBy("linked_account_id").agg(
        F.max("contact_id").alias("chosen_id"))).select("contact_id", "is_primary"))

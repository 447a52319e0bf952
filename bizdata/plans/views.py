"""Company and contact tables derived from the benchmark tables.

Each view is one SELECT that Spark and DuckDB read alike; Spark reads the Parquet files in place of the
table names.  No row of a base table is left out unless the view says DISTINCT or GROUP BY.
"""

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-03-01 12:00:00"
CITY = ("c_nationkey * 10 + CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 "
        "WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END")
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

FIRST = ("CASE {k} % 12 WHEN 0 THEN 'James' WHEN 1 THEN 'Mary' WHEN 2 THEN 'Oliver' WHEN 3 THEN 'Fiona' WHEN 4 THEN 'Neil' "
         "WHEN 5 THEN 'Sarah' WHEN 6 THEN 'Click' WHEN 7 THEN 'Grace' WHEN 8 THEN 'Q' WHEN 9 THEN '' WHEN 10 THEN 'Stephen' END")
LAST = ("CASE {k} % 11 WHEN 0 THEN 'Smith' WHEN 1 THEN 'Jones' WHEN 2 THEN 'Brown' WHEN 3 THEN 'Walker' WHEN 4 THEN 'Here' "
        "WHEN 5 THEN 'Patel' WHEN 6 THEN 'Murray' WHEN 7 THEN 'Building' WHEN 8 THEN 'Taylor' WHEN 9 THEN 'Services' END")


def _first(key: str) -> str:
    return FIRST.format(k=key)


def _last(key: str) -> str:
    return LAST.format(k=key)


VIEWS: dict[str, str] = {
    "accounts_v": """
        SELECT c_custkey AS account_id,
          CASE c_custkey % 24 WHEN 0 THEN 'Northern Software' WHEN 1 THEN 'City Dental Clinic' WHEN 2 THEN 'Harbour Bank'
            WHEN 3 THEN 'Precision Tooling' WHEN 4 THEN 'Corner Shop ' WHEN 5 THEN 'Pizza Kitchen' WHEN 6 THEN 'Advisory Partners'
            WHEN 7 THEN 'Oak Roofing' WHEN 8 THEN 'Park Property' WHEN 9 THEN 'Mills Law ' WHEN 10 THEN 'Hill School'
            WHEN 11 THEN 'Bright Branding' WHEN 12 THEN 'Motor Garage' WHEN 13 THEN 'Sea Hotel' WHEN 14 THEN 'Quick Courier'
            WHEN 15 THEN 'Sun Solar' WHEN 16 THEN 'Plain Widgets' WHEN 17 THEN 'How to buy now' WHEN 18 THEN 'www.deals.com'
            WHEN 19 THEN '77' WHEN 20 THEN 'Elite Garden Group' WHEN 21 THEN 'Top 10 widgets 2020' WHEN 22 THEN 'Ärztehaus Süd'
            WHEN 23 THEN 'x' END
          || CASE WHEN c_custkey % 24 IN (19, 23) THEN '' ELSE ' ' || CAST(c_custkey % 97 AS STRING) END
          || CASE WHEN c_custkey % 24 IN (19, 23) THEN '' WHEN c_custkey % 3 = 0 THEN ' LTD' WHEN c_custkey % 3 = 1 THEN ' LIMITED'
             ELSE '' END AS company_name,
          CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Other' WHEN 3 THEN 'Unknown' WHEN 4 THEN 'web shop'
            WHEN 5 THEN '62012 - Software' WHEN 6 THEN '47190' WHEN 7 THEN 'Technology' ELSE c_mktsegment END AS industry,
          CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 13 = 1 THEN 'United Kingdom' WHEN c_custkey % 13 = 2 THEN 'Scotland'
            ELSE r_name END AS country,
          CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE n_name END AS state_region,
          CASE WHEN c_custkey % 31 = 0 THEN NULL WHEN c_custkey % 31 = 1 THEN '' ELSE c_mktsegment END AS city,
          CASE WHEN c_custkey % 7 = 0 THEN 'Old Town' WHEN c_custkey % 7 = 1 THEN '' END AS district,
          CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN ''
            ELSE CAST(c_custkey % 40 AS STRING) || ' High Street, ' || c_mktsegment || ', ' || n_name || ', AB1 2CD' END AS address,
          CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'https://www.site' || CAST(c_custkey % 50 AS STRING) || '.test/'
            ELSE 'site' || CAST(c_custkey % 50 AS STRING) || '.test' END AS website,
          CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '020 7946 0' || CAST(100 + c_custkey % 900 AS STRING)
            WHEN 3 THEN '1111111111' WHEN 4 THEN '12' ELSE '+44 161 496 0' || CAST(100 + c_custkey % 900 AS STRING) END AS phone_number,
          CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '{first}.{last}@site' || CAST(c_custkey % 50 AS STRING) || '.test'
            WHEN 3 THEN '{f}{last}' ELSE 'info@site' || CAST(c_custkey % 50 AS STRING) || '.test' END AS email_format,
          CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN ''
            ELSE 'http://www.linkedin.com/company/Acme-' || CAST(c_custkey % 60 AS STRING) END AS linkedin_url,
          CAST(c_custkey % 300 AS INT) AS employee_count,
          CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 101 AS INT) END AS quality_score,
          CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN TRUE ELSE FALSE END AS verified,
          CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Companies House Test' WHEN 2 THEN 'Fallback list' WHEN 3 THEN 'OpenStreetMap'
            WHEN 4 THEN 'Directory' ELSE 'Registry' END AS data_source,
          CAST('2024-03-01 12:00:00' AS TIMESTAMP) - INTERVAL '1' MINUTE * CAST((c_custkey % 100) * (c_custkey % 100) * 8 AS INT) AS created_at,
          CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST('2024-03-01 12:00:00' AS TIMESTAMP)
            - INTERVAL '1' MINUTE * CAST((c_custkey % 50) * 60 AS INT) END AS updated_at
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "contacts_v": f"""
        SELECT o_orderkey AS contact_id,
          CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN o_custkey + 100000000 ELSE o_custkey END AS linked_account_id,
          {_first('o_orderkey')} AS first_name, {_last('o_orderkey')} AS last_name,
          CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'Managing Director' WHEN 2 THEN 'Head of Sales' WHEN 3 THEN 'senior engineer'
            WHEN 4 THEN 'Accept all cookies' WHEN 5 THEN 'CEO & Founder' WHEN 6 THEN 'HR Manager' WHEN 7 THEN 'x' WHEN 8 THEN 'Junior Analyst'
            ELSE 'Gardener' END AS job_title,
          CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN ''
            WHEN 2 THEN LOWER(COALESCE({_first('o_orderkey')}, 'kim')) || '.' || LOWER(COALESCE({_last('o_orderkey')}, 'lee'))
              || '@site' || CAST(o_custkey % 50 AS STRING) || '.test'
            WHEN 3 THEN SUBSTR(LOWER(COALESCE({_first('o_orderkey')}, 'kim')), 1, 1) || LOWER(COALESCE({_last('o_orderkey')}, 'lee'))
              || '@site' || CAST(o_custkey % 50 AS STRING) || '.test'
            WHEN 4 THEN 'info@site' || CAST(o_custkey % 50 AS STRING) || '.test' WHEN 5 THEN 'user' || CAST(o_custkey % 90 AS STRING) || '@gmail.com'
            ELSE CASE o_orderkey % 4 WHEN 0 THEN 'a@b' WHEN 1 THEN 'bob@mailinator.com' WHEN 2 THEN 'test@site1.test' ELSE 'bcdfghj@site2.test' END
            END AS email,
          CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '020 7946 0' || CAST(100 + o_custkey % 900 AS STRING)
            WHEN 3 THEN '9999999' ELSE '+1 (212) 555-' || CAST(1000 + o_orderkey % 9000 AS STRING) END AS phone_number,
          CASE WHEN o_orderkey % 5 = 2 THEN '+44 2079 460 ' || CAST(100 + o_custkey % 900 AS STRING) END AS phone_formatted,
          CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'https://linkedin.com/in/p' || CAST(o_orderkey AS STRING) END AS linkedin_url,
          o_orderpriority AS data_source, (o_orderstatus = 'F') AS verified,
          CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN TRUE ELSE FALSE END AS email_verified,
          CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN TRUE ELSE FALSE END AS phone_verified,
          (o_orderkey % 4 = 0) AS is_primary,
          CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS INT) END AS confidence_score,
          CAST('2024-03-01 12:00:00' AS TIMESTAMP) - INTERVAL '1' MINUTE * CAST((o_orderkey % 150) * (o_orderkey % 150) * 4 AS INT) AS created_at
        FROM orders""",
    "companies_v": """
        SELECT p_partkey AS id,
          CASE WHEN p_partkey % 2 = 0 THEN 'SC-' || CAST(100000 + CAST(FLOOR(p_partkey / 2.0) AS BIGINT) AS STRING)
            ELSE 'sc ' || CAST(100000 + CAST(FLOOR(p_partkey / 2.0) AS BIGINT) % 700 AS STRING) END AS company_number,
          CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE p_name || ' ' || CAST(p_partkey % 90 AS STRING)
            || CASE p_partkey % 3 WHEN 0 THEN ' Ltd' WHEN 1 THEN ' PLC' ELSE ' (UK)' END END AS name,
          p_name || ' ' || p_brand AS legal_name,
          CASE p_partkey % 4 WHEN 0 THEN 'gb' WHEN 1 THEN 'us_ca' WHEN 2 THEN 'us_ny' ELSE 'fr' END AS jurisdiction,
          p_type AS company_type,
          CASE p_partkey % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'inactive' WHEN 2 THEN 'Active' WHEN 3 THEN 'needs_update' ELSE NULL END AS status,
          CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE DATE '2000-01-01' + CAST(p_partkey % 5000 AS INT) END AS incorporation_date,
          CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE CAST(p_partkey % 30 AS STRING) || ' Mill Lane' END AS address_line_1,
          CASE WHEN p_partkey % 3 = 0 THEN 'Unit 5' END AS address_line_2,
          CASE p_partkey % 5 WHEN 0 THEN NULL ELSE 'Town ' || CAST(p_size % 20 AS STRING) END AS locality,
          CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS region,
          'AB' || CAST(p_size % 9 AS STRING) || ' 2CD' AS postal_code,
          CASE p_partkey % 6 WHEN 0 THEN 'England' WHEN 1 THEN 'Scotland' WHEN 2 THEN 'France' WHEN 3 THEN NULL ELSE 'United Kingdom' END AS country,
          CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'https://site' || CAST(p_partkey % 800 AS STRING) || '.test' END AS website,
          CASE p_partkey % 3 WHEN 0 THEN NULL ELSE '0161 496 ' || CAST(1000 + p_partkey % 9000 AS STRING) END AS phone,
          CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'office@site' || CAST(p_partkey % 800 AS STRING) || '.test' END AS email,
          CASE p_partkey % 7 WHEN 0 THEN 'https://linkedin.com/company/c' || CAST(p_partkey AS STRING) END AS linkedin_url,
          CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_type END AS industry, CAST(p_size * 10 AS INT) AS employee_count,
          CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_partkey % 101 AS INT) END AS quality_score,
          CASE p_partkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' END AS enrichment_status,
          CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE CAST('2024-02-01 00:00:00' AS TIMESTAMP) + INTERVAL '1' MINUTE * CAST(p_partkey % 40000 AS INT) END AS last_enriched,
          CASE WHEN p_partkey % 10 = 0 THEN 'checked' END AS notes,
          CAST('2024-03-01 12:00:00' AS TIMESTAMP) - INTERVAL '1' MINUTE * CAST((p_partkey % 120) * 1440 AS INT) AS last_updated,
          CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST('2024-03-01 12:00:00' AS TIMESTAMP) - INTERVAL '1' MINUTE * CAST((p_partkey % 70) * 1440 AS INT) END AS last_verified,
          CAST('2024-03-01 12:00:00' AS TIMESTAMP) - INTERVAL '1' MINUTE * CAST((p_partkey % 60) * 600 AS INT) AS created_at
        FROM part""",
    "officers_v": f"""
        SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS company_id,
          {_first('l_orderkey')} || ' ' || {_last('l_suppkey')} AS name,
          CASE l_linenumber % 3 WHEN 0 THEN 'director' WHEN 1 THEN 'secretary' ELSE 'llp-member' END AS role,
          CAST(l_shipdate AS DATE) AS appointed_date,
          CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS DATE) + 400 END AS resigned_date
        FROM lineitem""",
    "queue_v": """
        SELECT o_orderkey AS queue_id, r_name AS country, SUBSTR(r_name, 1, 2) AS country_code, n_name AS state_region,
          SUBSTR(n_name, 1, 3) AS state_code, c_mktsegment AS city, CAST(o_totalprice AS BIGINT) AS population,
          CAST(SUBSTR(o_orderpriority, 1, 1) AS INT) AS priority,
          CASE WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'P' THEN 'in_progress' WHEN o_orderkey % 3 = 0 THEN 'completed'
            WHEN o_orderkey % 3 = 1 THEN 'failed' ELSE 'skipped' END AS status,
          CAST(o_orderkey % 40 AS INT) AS companies_found,
          CASE WHEN o_orderstatus = 'P' THEN CAST('2024-03-01 12:00:00' AS TIMESTAMP) - INTERVAL '1' MINUTE * CAST(o_orderkey % 90 AS INT) END AS started_at,
          CASE WHEN o_orderstatus = 'F' THEN CAST('2024-03-01 12:00:00' AS TIMESTAMP) - INTERVAL '1' MINUTE * CAST(o_orderkey % 300 AS INT) END AS completed_at
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "jobs_v": """
        SELECT o_orderkey AS queue_id, o_orderkey AS company_id, CAST(SUBSTR(o_orderpriority, 1, 1) AS INT) AS priority,
          CASE WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'P' THEN 'processing' WHEN o_orderkey % 2 = 0 THEN 'completed'
            ELSE 'failed' END AS status,
          CAST(o_orderkey % 5 AS INT) AS attempts, 3 AS max_attempts,
          CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'w' || CAST(o_orderkey % 15 AS STRING) END AS worker_id,
          CAST(NULL AS STRING) AS error_message,
          CAST('2024-03-01 12:00:00' AS TIMESTAMP) + INTERVAL '1' MINUTE * CAST(o_orderkey % 120 - 60 AS INT) AS scheduled_for,
          CASE WHEN o_orderstatus = 'P' THEN CAST('2024-03-01 11:00:00' AS TIMESTAMP) END AS started_at,
          CAST(NULL AS TIMESTAMP) AS completed_at,
          CAST('2024-03-01 12:00:00' AS TIMESTAMP) - INTERVAL '1' MINUTE * CAST(o_orderkey % 5000 AS INT) AS created_at,
          CAST(NULL AS TIMESTAMP) AS updated_at
        FROM orders""",
    "results_v": """
        SELECT l_orderkey AS queue_id, CASE WHEN MAX(l_linenumber) % 3 = 0 THEN 'started' WHEN MAX(l_linenumber) % 3 = 1 THEN 'completed' ELSE 'failed' END AS result,
          CASE WHEN MAX(l_linenumber) % 3 = 2 THEN 'timeout' END AS error
        FROM lineitem GROUP BY l_orderkey""",
    "areas_v": """
        SELECT LOWER(r_name) AS country, n_name AS state_region, UPPER(c_mktsegment) AS city,
          CAST(COUNT(*) AS INT) AS companies_found, CAST(SUM(c_custkey % 3) AS INT) AS contacts_found
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        GROUP BY r_name, n_name, c_mktsegment HAVING AVG(c_acctbal) > 4500""",
    "countries_v": "SELECT r_regionkey AS country_id, SUBSTR(r_name, 1, 2) AS country_code, r_name AS country_name FROM region",
    "states_v": """
        SELECT n_nationkey AS state_id, n_regionkey AS country_id, 'N' || CAST(n_nationkey AS STRING) AS state_code, n_name AS state_name
        FROM nation""",
    "cities_v": f"""
        SELECT DISTINCT {CITY} AS city_id, c_nationkey AS state_id, n_regionkey AS country_id,
          c_mktsegment AS city_name
        FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'BUILDING'""",
    "located_v": f"""
        SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 20 = 0 THEN 99 ELSE n_regionkey END AS country_id,
          CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_nationkey END AS state_id,
          CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE {CITY} END AS city_id
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "company_contacts_v": """
        SELECT l_partkey AS company_id, CASE l_linenumber % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' ELSE 'website' END AS contact_type,
          'v' || CAST(l_suppkey % 40 AS STRING) AS value, MIN(l_orderkey) AS first_order
        FROM lineitem GROUP BY 1, 2, 3""",
    "sources_v": """
        SELECT l_partkey AS company_id, l_returnflag || l_linestatus AS source_name, CAST(MAX(l_quantity) AS INT) AS reliability
        FROM lineitem GROUP BY 1, 2""",
    "search_logs_v": """
        SELECT event_id AS id, event_type AS search_query, user_id AS user_session, ts AS searched_at FROM events""",
    "log_v": """
        SELECT event_id AS log_id, user_id AS company_id, event_type AS status, ts AS created_at, value AS score FROM events""",
    "snapshots_v": """
        SELECT DATE_TRUNC('hour', ts) AS taken_at, CAST(SUM(COUNT(*)) OVER (ORDER BY DATE_TRUNC('hour', ts)) AS BIGINT) AS companies,
          CAST(SUM(COUNT(DISTINCT user_id)) OVER (ORDER BY DATE_TRUNC('hour', ts)) AS BIGINT) AS contacts
        FROM events GROUP BY DATE_TRUNC('hour', ts)""",
    "facts_v": """
        SELECT LOWER(email) AS email, CAST(MIN(contact_id) % 3 AS INT) AS mx_count,
          CASE MIN(contact_id) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'ok' WHEN 2 THEN 'mailbox_not_found' WHEN 3 THEN 'greylisted' END AS smtp_result,
          (MIN(contact_id) % 4 = 0) AS catch_all
        FROM contacts_v WHERE email IS NOT NULL AND email <> '' GROUP BY LOWER(email)""",
    "pages_v": f"""
        SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://www.site' ELSE 'http://site' END || CAST(page_id % 40 AS STRING) || '.test/'
            || CASE WHEN page_id % 2 = 0 THEN 'team/' || CAST(page_id AS STRING) ELSE '' END AS url,
          CASE page_id % 8 WHEN 0 THEN '' WHEN 1 THEN '<meta name="description" content=" Plain Widgets &amp; more ">'
              ELSE '<meta charset="x"><META name=''description'' content="Our ' || CASE page_id % 7 WHEN 0 THEN 'software and law' WHEN 1 THEN 'health' WHEN 2 THEN 'finance' WHEN 3 THEN 'retail'
                WHEN 4 THEN 'Manufacturing' WHEN 5 THEN 'consulting' ELSE 'widgets' END || ' site">' END || '<p>Welcome from ' || {_first('(page_id + 1)')} || ' ' || {_last('(page_id + 2)')} || '.</p>' || html || '<section><h2>Team:</h2><p>' || {_first('(page_id + 1)')} || ' ' || {_last('(page_id + 2)')} || ', Managing Director, '
            || LOWER(COALESCE({_first('(page_id + 1)')}, 'kim')) || '.' || LOWER(COALESCE({_last('(page_id + 2)')}, 'lee'))
            || '@site' || CAST(page_id % 40 AS STRING) || '.test, tel 020 7946 0' || CAST(100 + page_id % 900 AS STRING) || '</p>'
            || '<a href="mailto:info@site' || CAST(page_id % 40 AS STRING) || '.test?x=1">Mail</a> <a href="tel:+44 161 496 0'
            || CAST(100 + page_id % 900 AS STRING) || '">Call</a> <a href="/contact-us">Contact us</a>'
            || CASE WHEN page_id % 2 = 0 THEN ' <a href="https://www.linkedin.com/company/acme-' || CAST(page_id % 40 AS STRING) || '">in</a>' ELSE '' END
            || CASE WHEN page_id % 3 = 0 THEN ' <a href="https://twitter.com/acme' || CAST(page_id % 40 AS STRING) || '">tw</a>' ELSE '' END
            || CASE WHEN page_id % 5 = 0 THEN ' <a class="m" href="mailto:sw' || CAST(page_id % 40 AS STRING) || 'x@site' || CAST(page_id % 40 AS STRING) || '.test?subject=hi"><b>Sarah</b> Walker</a>'
                 || ' or ring Mary Jones: 020 7946 0' || CAST(100 + page_id % 900 AS STRING) ELSE '' END
            || CASE WHEN page_id % 7 = 0 THEN ' Write to GMurray@site' || CAST(page_id % 40 AS STRING) || '.test (Grace Murray), to Neil Patel on +44 20 7946 ' || CAST(1000 + page_id % 900 AS STRING)
                 || ' or <a href="mailto:oliver.brown@other.test">mail</a> Oliver Brown' ELSE '' END
            || '</section><footer>Plain Widgets, 5 High Street, AB1 2CD</footer>' AS html
        FROM pages""",
    "new_contacts_v": f"""
        SELECT c_custkey AS new_id, {_first('(c_custkey + 3)')} AS first_name, {_last('(c_custkey + 5)')} AS last_name,
          CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey END AS linked_account_id, 'Owner' AS job_title,
          CASE c_custkey % 4 WHEN 0 THEN NULL ELSE 'user' || CAST(c_custkey % 120 AS STRING) || '@gmail.com' END AS email,
          CASE c_custkey % 5 WHEN 0 THEN '020 7946 0' || CAST(100 + c_custkey % 900 AS STRING) END AS phone_number,
          CASE c_custkey % 7 WHEN 0 THEN 'https://linkedin.com/in/p' || CAST(c_custkey * 2 AS STRING) END AS linkedin_url
        FROM customer""",
    "registry_v": """
        SELECT CAST(p_partkey AS STRING) AS seq, CASE WHEN p_partkey % 50 = 0 THEN '' ELSE LPAD(CAST(p_partkey % 1500 AS STRING), 8, '0') END AS number,
          '"' || p_name || '" ' AS name, p_type AS category, CASE p_partkey % 3 WHEN 0 THEN 'Active' WHEN 1 THEN 'Liquidation' ELSE ' "Active"' END AS status,
          CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '31/12/2001' WHEN 2 THEN '5/6/1999' ELSE '31-12' END AS born,
          CAST(p_size AS STRING) || ' Mill Lane' AS line1, p_brand AS town, CASE p_partkey % 4 WHEN 0 THEN 'ENGLAND' WHEN 1 THEN '' WHEN 2 THEN 'wales' ELSE 'France' END AS country,
          CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '62012 - Business software' WHEN 2 THEN '41100 - Development of building projects'
            WHEN 3 THEN '56101 - Licensed restaurants and food' WHEN 4 THEN '86900 - Other human health' ELSE '99999 - Dormant' END AS sic
        FROM part""",
}


def _needed(text: str) -> list[str]:
    """Views that a text uses, each after the views it uses itself."""
    found: list[str] = []

    def visit(body: str) -> None:
        for name in re.findall(r"\b(\w+_v)\b", body):
            if name in VIEWS and name not in found:
                visit(VIEWS[name])
                found.append(name)

    visit(text)
    return found


def with_views(text: str) -> str:
    """A query over views as one stand-alone statement."""
    names = _needed(text)
    if not names:
        return text
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    text = text.strip()
    if text.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {text[len('WITH RECURSIVE'):].strip()}"
    if text.upper().startswith("WITH "):
        return f"WITH {ctes}, {text[5:].strip()}"
    return f"WITH {ctes} {text}"


def spark_text(text: str, folder: str) -> str:
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(BASE)})\b", rf"\1 parquet.`{folder}/\2.parquet`", with_views(text))
    return text.replace(" AS TIMESTAMP)", " AS TIMESTAMP_NTZ)")


class Tables:
    """The derived tables of one data folder: t.accounts, t.contacts, …, and the base tables as t.base(name)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(spark_text(text, self.folder))

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if f"{name}_v" not in VIEWS:
            raise AttributeError(name)
        return self.sql(f"SELECT * FROM {name}_v")

    @cached_property
    def first_names(self) -> DataFrame:
        """Dictionary of first names: those of the contact table that are names."""
        return self.sql("SELECT DISTINCT LOWER(first_name) AS word FROM contacts_v "
                        "WHERE first_name IN ('James', 'Mary', 'Oliver', 'Fiona', 'Neil', 'Sarah', 'Grace', 'Stephen')")

    @cached_property
    def not_names(self) -> DataFrame:
        """Dictionary of words that are not names, from the same table."""
        return self.sql("SELECT DISTINCT LOWER(last_name) AS word FROM contacts_v WHERE last_name IN ('Here', 'Services') "
                        "UNION SELECT DISTINCT LOWER(first_name) FROM contacts_v WHERE first_name = 'Click'")

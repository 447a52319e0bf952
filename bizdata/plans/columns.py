"""Queries X-01 … X-61: every column function over whole columns of a table."""

from pyspark.sql import functions as F

from ..functions import company, email, industry, names, phone, rules, scores, web
from ..operators import emails, locations, quality
from .joins import DOMAIN
from .registry import query
from .views import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def host(c: str) -> str:
    return DOMAIN.format(c=c)


def sub(c: str, pattern: str, to: str = "") -> str:
    return f"REGEXP_REPLACE({c}, {q(pattern)}, {q(to)}, 'g')"


def any_of(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"CONTAINS({c}, {q(w)})" for w in words) + ")"


def listing(words: list[str]) -> str:
    return ", ".join(q(w) for w in words)


def joined(array):
    return F.array_join(F.array_sort(array), "|")


# --- addresses of sites -----------------------------------------------------------------------

query("x01_domain", f"SELECT account_id, {host('website')} AS domain FROM accounts_v")(
    lambda t: t.accounts.select("account_id", web.domain("website").alias("domain")))
query("x01_domain_of_email", f"SELECT contact_id, {host('email')} AS domain FROM contacts_v")(
    lambda t: t.contacts.select("contact_id", web.domain("email").alias("domain")))

KEY = sub(sub("LOWER({c})", rules.LEGAL_WORDS_IN_KEYS), "[^a-z0-9]")
query("x02_company_key", f"SELECT account_id, {KEY.replace('{c}', 'company_name')} AS key FROM accounts_v")(
    lambda t: t.accounts.select("account_id", company.company_key("company_name").alias("key")))

TRADING = "TRIM(" + "REGEXP_REPLACE(" * 6 + "{c}" + "".join(f", {q('(?i)' + chr(92) + 's+' + e + '$')}, '')" for e in rules.NAME_ENDINGS) + ")"
query("x03_name_variants", f"""
    SELECT id, ARRAY_TO_STRING(LIST_SORT(LIST_FILTER(LIST_DISTINCT([name, tn, CASE WHEN LEN(w) >= 2 THEN w[1] END,
      CASE WHEN LEN(w) >= 2 THEN w[1] || ' ' || w[2] END]), lambda n: LENGTH(n) >= 3)), '|') AS variants
    FROM (SELECT id, name, {TRADING.replace('{c}', 'name')} AS tn, STRING_SPLIT_REGEX({TRADING.replace('{c}', 'name')}, '\\s+') AS w
      FROM companies_v)""")(
    lambda t: t.companies.select("id", joined(company.name_variants("name")).alias("variants")))

query("x04_candidate_urls", f"""
    SELECT id, 'https://www.' || s || '.com' || CASE WHEN uk THEN '|https://www.' || s || '.co.uk' ELSE '' END || CASE WHEN de THEN '|https://www.' || s || '.de' ELSE '' END
      || CASE WHEN fr THEN '|https://www.' || s || '.fr' ELSE '' END || '|https://' || s || '.com' || CASE WHEN uk THEN '|https://' || s || '.co.uk' ELSE '' END
      || CASE WHEN de THEN '|https://' || s || '.de' ELSE '' END || CASE WHEN fr THEN '|https://' || s || '.fr' ELSE '' END AS urls
    FROM (SELECT id, {sub(sub("LOWER(name)", rules.LEGAL_WORDS_IN_URLS), "[^a-z0-9]")} AS s, CONTAINS(l, 'uk') OR CONTAINS(l, 'united kingdom') AS uk,
        CONTAINS(l, 'germany') OR CONTAINS(l, 'de') AS de, CONTAINS(l, 'france') OR CONTAINS(l, 'fr') AS fr
      FROM (SELECT *, LOWER(COALESCE(country, '')) AS l FROM companies_v))""")(
    lambda t: t.companies.select(
        "id", F.array_join(web.candidate_urls("name", "country"), "|").alias("urls")))

# --- e-mail -----------------------------------------------------------------------------------

LOCAL, HOST = "LOWER(SPLIT_PART(email, '@', 1))", "LOWER(SPLIT_PART(email, '@', 2))"
VALID = f"COALESCE(REGEXP_MATCHES(LOWER(TRIM(email)), {q(rules.EMAIL_SYNTAX)}), FALSE)"
GENERIC = f"COALESCE({any_of(LOCAL, rules.GENERIC_MAILBOXES)} OR REGEXP_MATCHES({LOCAL}, '^[0-9]'), TRUE)"
PERSONAL = (f"COALESCE(NOT REGEXP_MATCHES({LOCAL}, {q('^(' + '|'.join(rules.ROLE_MAILBOXES) + ')($|[._])')}) "
            f"AND REGEXP_MATCHES({LOCAL}, '^([a-z]+[.][a-z]+|[a-z]+_[a-z]+|[a-z]{{5,}})$'), FALSE)")
query("x05_email_valid", f"SELECT contact_id, {VALID} AS ok FROM contacts_v")(
    lambda t: t.contacts.select("contact_id", email.email_valid("email").alias("ok")))
query("x06_email_kind", f"""
    SELECT contact_id, COALESCE({HOST} IN ({listing(rules.DISPOSABLE_DOMAINS)}), FALSE) AS disposable,
      COALESCE({HOST} IN ({listing(rules.CONSUMER_DOMAINS)}), FALSE) AS consumer FROM contacts_v""")(
    lambda t: t.contacts.select("contact_id", email.is_disposable("email").alias("disposable"), email.is_consumer("email").alias("consumer")))

FACTED = "contacts_v c LEFT JOIN (SELECT email AS fe, mx_count, smtp_result, catch_all FROM facts_v) f ON LOWER(TRIM(c.email)) = f.fe"
DISPOSABLE, CONSUMER = f"{HOST} IN ({listing(rules.DISPOSABLE_DOMAINS)})", f"{HOST} IN ({listing(rules.CONSUMER_DOMAINS)})"
query("x07_score_email", f"""
    SELECT contact_id, k NOT IN (1, 2, 4, 6, 8) AS valid, ['invalid_syntax', 'disposable_email', 'catch_all_domain', 'no_mx_records', 'smtp_verified',
      'mailbox_not_found', 'mx_valid_smtp_unknown', ''][k] AS reason, [0, 20, 80, 30, 100, 20, 80, 60][k] AS score
    FROM (SELECT contact_id, CASE WHEN NOT {VALID} THEN 1 WHEN {DISPOSABLE} THEN 2 WHEN {CONSUMER} THEN 3 WHEN COALESCE(mx_count, 0) = 0 THEN 4
      WHEN smtp_result = 'ok' THEN 5 WHEN smtp_result = 'mailbox_not_found' THEN 6 WHEN smtp_result IS NULL THEN 7 ELSE 8 END AS k FROM {FACTED})""")(
    lambda t: emails.score_emails(t.contacts, t.facts).select("contact_id", "valid", "reason", "score"))
query("x08_score_email_detailed", f"""
    SELECT contact_id, alive AND (smtp_result IS NULL OR smtp_result = 'ok') AS valid,
      CASE WHEN NOT syn THEN 'invalid_syntax' WHEN disp THEN 'disposable_email' WHEN NOT mx THEN 'no_mx_records' WHEN NOT alive THEN 'mailbox_not_found'
        WHEN smtp_result = 'ok' AND ca THEN 'smtp_verified_on_catch_all' WHEN smtp_result = 'ok' THEN 'smtp_verified' WHEN ca THEN 'catch_all_domain'
        WHEN smtp_result IS NULL THEN 'mx_valid_smtp_unknown' ELSE smtp_result END AS reason,
      CASE WHEN NOT syn THEN 0 WHEN disp THEN 20 WHEN NOT mx THEN 30 WHEN NOT alive THEN 50
        ELSE 50 + CASE WHEN smtp_result = 'ok' THEN 45 WHEN smtp_result IS NULL AND ca THEN 5 WHEN smtp_result IS NULL THEN 20 ELSE 0 END
          + CASE WHEN con THEN 5 ELSE 0 END END AS score,
      CASE WHEN syn AND NOT disp AND mx AND con THEN 'consumer' ELSE 'business' END AS provider_type
    FROM (SELECT contact_id, smtp_result, {VALID} AS syn, COALESCE({DISPOSABLE}, FALSE) AS disp, COALESCE({CONSUMER}, FALSE) AS con,
        COALESCE(mx_count, 0) > 0 AS mx, COALESCE(catch_all, FALSE) AS ca,
        {VALID} AND NOT COALESCE({DISPOSABLE}, FALSE) AND COALESCE(mx_count, 0) > 0 AND COALESCE(smtp_result, '') <> 'mailbox_not_found' AS alive FROM {FACTED})""")(
    lambda t: emails.score_emails(t.contacts, t.facts, detailed=True).select("contact_id", "valid", "reason", "score", "provider_type"))
query("x09_is_generic", f"SELECT contact_id, {GENERIC} AS generic FROM contacts_v")(
    lambda t: t.contacts.select("contact_id", email.is_generic("email").alias("generic")))
query("x10_is_personal", f"SELECT contact_id, {PERSONAL} AS personal FROM contacts_v")(
    lambda t: t.contacts.select("contact_id", email.is_personal("email").alias("personal")))

FOUND_MAIL = f"LIST_FILTER(REGEXP_EXTRACT_ALL({{c}}, {q(rules.EMAIL_IN_TEXT)}), lambda e: NOT CONTAINS(e, 'example.com') AND NOT CONTAINS(e, 'placeholder'))"
query("x11_extract_emails", f"SELECT page_id, ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT({FOUND_MAIL.replace('{c}', 'html')})), '|') AS emails FROM pages_v")(
    lambda t: t.pages.select("page_id", joined(email.extract_emails("html")).alias("emails")))
query("x11_emails_in_documents", f"SELECT doc_id, ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT({FOUND_MAIL.replace('{c}', 'text')})), '|') AS emails FROM documents")(
    lambda t: t.base("documents").select("doc_id", joined(email.extract_emails("text")).alias("emails")))

# --- phones -----------------------------------------------------------------------------------

for _table, _key, _text in (("pages_v", "page_id", "html"), ("documents", "doc_id", "text")):
    query(f"x12_phones_in_{_table.removesuffix('_v')}", f"""
        SELECT {_key}, ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT(REGEXP_EXTRACT_ALL({_text}, {q(rules.US_PHONE)}))), '|') AS phones FROM {_table}""")(
        lambda t, b=_table, k=_key, x=_text: (t.pages if b == "pages_v" else t.base(b)).select(k, joined(phone.extract_phones(x)).alias("phones")))
    _raw = " || ".join(f"REGEXP_EXTRACT_ALL({_text}, {q(p)})" for p in rules.UK_PHONES)
    query(f"x13_uk_phones_in_{_table.removesuffix('_v')}", f"""
        SELECT {_key}, ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT(LIST_FILTER(LIST_TRANSFORM({_raw},
          lambda m: REGEXP_REPLACE(REGEXP_REPLACE(m, '[\\s.-]', '', 'g'), '^[+]?44', '0')),
          lambda p: LENGTH(p) BETWEEN 10 AND 12 AND REGEXP_MATCHES(p, '^0[1-9]')))), '|') AS phones FROM {_table}""")(
        lambda t, b=_table, k=_key, x=_text: (t.pages if b == "pages_v" else t.base(b)).select(k, joined(phone.extract_uk_phones(x)).alias("phones")))

UK_PLACE = any_of("LOWER(country)", rules.UK_PHONE_PLACES)
query("x14_format_uk_phone", f"""
    SELECT account_id, CASE WHEN NOT COALESCE({UK_PLACE}, FALSE) THEN phone_number
      WHEN LENGTH(d) = 10 THEN '+44 ' || SUBSTR(d, 1, 4) || ' ' || SUBSTR(d, 5, 3) || ' ' || SUBSTR(d, 8)
      WHEN LENGTH(d) = 11 THEN '+44 ' || SUBSTR(d, 1, 3) || ' ' || SUBSTR(d, 4, 4) || ' ' || SUBSTR(d, 8) END AS phone
    FROM (SELECT *, REGEXP_REPLACE(REGEXP_REPLACE({sub('phone_number', '[^0-9]')}, '^0', ''), '^44', '') AS d FROM accounts_v)""")(
    lambda t: t.accounts.select("account_id", phone.format_uk_phone("phone_number", "country").alias("phone")))
query("x15_uk_phone_valid", f"""
    SELECT account_id, COALESCE(REGEXP_MATCHES({sub('phone_number', '[ .-]')}, '^0[1-9][0-9]{{8,10}}$'), FALSE) AS ok FROM accounts_v""")(
    lambda t: t.accounts.select("account_id", phone.uk_phone_valid("phone_number").alias("ok")))
PHONE_OK = (f"(phone_number IS NOT NULL AND LENGTH(TRIM(phone_number)) >= 7 AND LENGTH({sub('phone_number', '[^0-9]')}) BETWEEN 7 AND 15 AND "
            f"REPLACE({sub('phone_number', '[^0-9]')}, LEFT({sub('phone_number', '[^0-9]')}, 1), '') <> '' AND "
            f"LEFT({sub('phone_number', '[^0-9]')}, 10) NOT IN ({listing(rules.PLACEHOLDER_NUMBERS)}))")
query("x15_phone_valid", f"SELECT contact_id, {PHONE_OK} AS ok FROM contacts_v")(
    lambda t: t.contacts.select("contact_id", phone.phone_valid("phone_number").alias("ok")))

# --- places -----------------------------------------------------------------------------------

PARTS = "LIST_TRANSFORM(STRING_SPLIT(NULLIF(address, ''), ','), lambda p: TRIM(p))"
query("x16_parse_address", f"""
    SELECT account_id, NULLIF(p[1], '') AS line1, CASE WHEN LEN(p) >= 3 THEN NULLIF(p[LEN(p) - 2], '') END AS locality,
      CASE WHEN LEN(p) >= 2 THEN NULLIF(p[LEN(p) - 1], '') END AS region, NULLIF(p[LEN(p)], '') AS postal_code
    FROM (SELECT account_id, {PARTS} AS p FROM accounts_v)""")(
    lambda t: t.accounts.select("account_id", company.parse_address("address").alias("a")).select("account_id", "a.*"))
query("x17_split_location", """
    SELECT account_id, CASE WHEN LEN(p) > 1 THEN p[1] END AS city, p[LEN(p)] AS country
    FROM (SELECT account_id, LIST_FILTER(LIST_TRANSFORM(STRING_SPLIT(COALESCE(city, '') || ', ,' || COALESCE(country, ''), ','), lambda p: TRIM(p)),
      lambda p: p <> '') AS p FROM accounts_v)""")(
    lambda t: t.accounts.select("account_id", company.split_location(
        F.concat(F.coalesce("city", F.lit("")), F.lit(", ,"), F.coalesce("country", F.lit("")))).alias("l")).select("account_id", "l.*"))
query("x18_extract_address", f"""
    SELECT page_id, CASE WHEN us <> '' THEN us WHEN pc <> '' THEN TRIM(SUBSTR(html, GREATEST(i - 100, 1), i + 50 - GREATEST(i - 100, 1))) END AS address
    FROM (SELECT page_id, html, us, pc, INSTR(html, pc) AS i FROM (SELECT page_id, html, REGEXP_EXTRACT(html, {q(rules.US_ADDRESS)}) AS us,
      REGEXP_EXTRACT(html, {q(rules.UK_POSTCODE)}) AS pc FROM pages_v))""")(
    lambda t: t.pages.select("page_id", company.extract_address("html").alias("address")))
query("x18_html_address", f"""
    SELECT page_id, CASE WHEN pc <> '' AND LENGTH(c) BETWEEN 16 AND 199 THEN NULLIF(TRIM(REGEXP_EXTRACT(c, {q(rules.UK_ADDRESS_LINE)})), '') END AS address
    FROM (SELECT page_id, pc, TRIM(REGEXP_REPLACE(REGEXP_REPLACE(SUBSTR(html, GREATEST(i - 150, 1), i + 20 - GREATEST(i - 150, 1)), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS c
      FROM (SELECT *, INSTR(html, pc) AS i FROM (SELECT page_id, html, REGEXP_EXTRACT(html, {q(rules.UK_POSTCODE_LOOSE)}) AS pc FROM pages_v)))""")(
    lambda t: t.pages.select("page_id", company.extract_html_address("html").alias("address")))

# --- HTML -------------------------------------------------------------------------------------

VISIBLE = ("REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), "
           "'<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')")
query("x19_html_text", f"SELECT page_id, LOWER({VISIBLE}) AS text FROM pages_v")(
    lambda t: t.pages.select("page_id", web.html_text("html").alias("text")))


def clean(c: str) -> str:
    text = f"TRIM(REGEXP_REPLACE(REGEXP_REPLACE({c}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
    for entity, char in rules.HTML_ENTITIES:
        text = f"REPLACE({text}, {q(entity)}, {q(char)})"
    return text


def element(tag: str) -> str:
    inner = f"REGEXP_EXTRACT(html, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}>', 1)"
    return f"NULLIF({clean(inner)}, '')"


HREFS = "REGEXP_EXTRACT_ALL(html, '(?is)<a\\s[^>]*href=[\"'']([^\"'']*)[\"'']', 1)"
query("x20_html_fields", f"""
    SELECT page_id, {element('title')} AS title, {element('h1')} AS h1, {element('footer')} AS footer, LEN({HREFS}) AS n_links,
      ARRAY_TO_STRING(LIST_TRANSFORM(LIST_FILTER({HREFS}, lambda h: STARTS_WITH(LOWER(h), 'tel:')), lambda h: SPLIT_PART(SUBSTR(h, 5), '?', 1)), '|') AS tels,
      ARRAY_TO_STRING(LIST_TRANSFORM(LIST_FILTER({HREFS}, lambda h: STARTS_WITH(LOWER(h), 'mailto:')), lambda h: SPLIT_PART(SUBSTR(h, 8), '?', 1)), '|') AS mailtos
    FROM pages_v""")(
    lambda t: t.pages.select("page_id", web.html_fields("html").alias("f")).select(
        "page_id", "f.title", "f.h1", "f.footer", F.col("f.n_links").cast("bigint").alias("n_links"),
        F.array_join("f.tels", "|").alias("tels"), F.array_join("f.mailtos", "|").alias("mailtos")))
query("x21_social_links", f"""
    SELECT page_id, LIST_FILTER({HREFS}, lambda h: CONTAINS(h, 'linkedin.com'))[1] AS linkedin,
      LIST_FILTER({HREFS}, lambda h: CONTAINS(h, 'twitter.com') OR CONTAINS(h, 'x.com'))[1] AS twitter,
      LIST_FILTER({HREFS}, lambda h: CONTAINS(h, 'facebook.com'))[1] AS facebook, LIST_FILTER({HREFS}, lambda h: CONTAINS(h, 'instagram.com'))[1] AS instagram
    FROM pages_v""")(lambda t: t.pages.select("page_id", web.social_links("html").alias("s")).select("page_id", "s.*"))
_profiles = ", ".join(
    f"SPLIT_PART(REGEXP_REPLACE(LIST_FILTER(REGEXP_EXTRACT_ALL(html, {q(p)}), lambda h: NOT {any_of('LOWER(h)', rules.SKIP_PROFILES)})[1], '/$', ''), '?', 1) AS {net}"
    for net, p in rules.PROFILE_PATTERNS)
query("x21_social_profiles", f"SELECT page_id, {_profiles} FROM pages_v")(
    lambda t: t.pages.select("page_id", web.social_profiles("html").alias("s")).select("page_id", "s.*"))
ANCHOR = "'(?is)<a\\s[^>]*href=[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>'"
query("x22_contact_link", f"""
    SELECT page_id, LIST_FILTER(LIST_ZIP(REGEXP_EXTRACT_ALL(html, {ANCHOR}, 1), REGEXP_EXTRACT_ALL(html, {ANCHOR}, 2)),
      lambda z: REGEXP_MATCHES(z[1], {q(rules.CONTACT_LINK)}) OR REGEXP_MATCHES({clean('z[2]')}, {q(rules.CONTACT_LINK)}))[1][1] AS contact FROM pages_v""")(
    lambda t: t.pages.select("page_id", web.contact_link(web.links("html")).alias("contact")))

# --- registry values --------------------------------------------------------------------------

query("x23_uk_date", "SELECT seq, CAST(TRY_STRPTIME(born, '%d/%m/%Y') AS DATE) AS day FROM registry_v")(
    lambda t: t.registry.select("seq", company.uk_date("born").alias("day")))
query("x24_norm_country", f"""
    SELECT seq, CASE {' '.join(f"WHEN LOWER(country) = {q(n.lower())} THEN {q(n)}" for n in rules.HOME_NATIONS)} ELSE NULLIF(country, '') END AS country
    FROM registry_v""")(lambda t: t.registry.select("seq", company.norm_country("country").alias("country")))


def ordered_case(c: str, pairs: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN CONTAINS({c}, {q(k)}) THEN {q(v)}" for k, v in pairs) + f" ELSE {default} END"


query("x25_sic_text_industry", f"SELECT seq, {ordered_case('LOWER(sic)', rules.SIC_TEXT, q('Other'))} AS industry FROM registry_v")(
    lambda t: t.registry.select("seq", industry.sic_text_industry("sic").alias("industry")))
query("x26_sic_prefix_industry", f"""
    SELECT seq, CASE {' '.join(f"WHEN LEFT(sic, 2) = {q(k)} THEN {q(v)}" for k, v in rules.SIC_DIVISIONS.items())} ELSE 'Other' END AS industry,
      CASE {' '.join(f"WHEN LEFT(sic, 2) = {q(k)} THEN {q(v)}" for k, v in rules.SIC_DIVISIONS_DETAILED.items())} ELSE 'Professional Services' END AS detailed
    FROM registry_v""")(lambda t: t.registry.select(
        "seq", industry.sic_prefix_industry("sic").alias("industry"), industry.sic_prefix_industry("sic", detailed=True).alias("detailed")))


def best_rule(source: str, key: str, score, least: int) -> str:
    """Rows (key, industry) of the best keyword rule over `source`, a SELECT of key and s (text)."""
    columns = ", ".join(f"{score(words)} AS s{i}" for i, (_, words) in enumerate(rules.INDUSTRY_KEYWORDS))
    every = ", ".join(f"s{i}" for i in range(len(rules.INDUSTRY_KEYWORDS)))
    case = " ".join(f"WHEN s{i} = m THEN {q(label)}" for i, (label, _) in enumerate(rules.INDUSTRY_KEYWORDS))
    return (f"SELECT {key}, CASE WHEN m IS NULL OR m < {least} THEN NULL {case} END AS industry FROM "
            f"(SELECT *, GREATEST({every}) AS m FROM (SELECT {key}, {columns} FROM ({source})))")


def name_score(words: list[str]) -> str:
    return " + ".join(f"CASE WHEN CONTAINS(s, {q(w.lower())}) THEN {len(w)} ELSE 0 END" for w in words)


def text_score(words: list[str]) -> str:
    return " + ".join(f"((LENGTH(s) - LENGTH(REPLACE(s, {q(w.lower().strip())}, ''))) // {len(w.strip())}) * {len(w)}" for w in words)


BY_NAME = best_rule("SELECT account_id, ' ' || LOWER(company_name) || ' ' AS s FROM accounts_v", "account_id", name_score, 1)
query("x27_industry_by_name", BY_NAME)(
    lambda t: t.accounts.select("account_id", industry.industry_by_name("company_name").alias("industry")))
query("x28_industry_by_text", best_rule(f"SELECT page_id, LOWER({VISIBLE}) AS s FROM pages_v", "page_id", text_score, rules.PAGE_TEXT_THRESHOLD))(
    lambda t: t.pages.select("page_id", industry.industry_by_text(web.html_text("html")).alias("industry")))
BY_OLD = best_rule("SELECT account_id, ' ' || LOWER(industry) || ' ' AS s FROM accounts_v", "account_id", name_score, 1)
query("x29_norm_industry", f"""
    SELECT a.account_id, CASE WHEN a.industry <> '' THEN COALESCE({ordered_case('LOWER(a.industry)', rules.INDUSTRY_SYNONYMS, 'NULL')}, k.industry) END AS industry
    FROM accounts_v a JOIN ({BY_OLD}) k ON a.account_id = k.account_id""")(
    lambda t: t.accounts.select("account_id", industry.norm_industry("industry").alias("industry")))
query("x30_industry_hint", f"SELECT doc_id, {ordered_case('LOWER(text)', rules.DESCRIPTION_HINTS, 'NULL')} AS hint FROM documents")(
    lambda t: t.base("documents").select("doc_id", industry.industry_hint("text").alias("hint")))

# --- people -----------------------------------------------------------------------------------

FULL = "first_name || ' ' || last_name"
WORDS = f"LIST_FILTER(STRING_SPLIT_REGEX(REGEXP_REPLACE(TRIM(LOWER({FULL})), '[^a-z\\s-]', '', 'g'), '\\s+'), lambda w: w <> '')"
query("x31_parse_name", f"""
    SELECT contact_id, w[1] AS first, CASE WHEN LEN(w) > 1 THEN w[LEN(w)] WHEN LEN(w) = 1 THEN '' END AS last, LEFT(w[1], 1) AS initial,
      CASE WHEN LEN(w) > 1 THEN LEFT(w[LEN(w)], 1) END AS last_initial FROM (SELECT contact_id, {WORDS} AS w FROM contacts_v)""")(
    lambda t: t.contacts.select("contact_id", names.parse_name(F.concat("first_name", F.lit(" "), "last_name")).alias("n")).select("contact_id", "n.*"))

NOISY = "'• ' || company_name || ' 2nd+ & co <b> ' || company_name || ' ' || company_name || ' – |'"
_c = f"REGEXP_REPLACE(REGEXP_REPLACE(TRIM(v), '^[\\s•·\\-–—|]+', ''), '[\\s•·\\-–—|]+$', '')"
_c = f"REGEXP_REPLACE(REGEXP_REPLACE({_c}, '(?i)\\b[0-9]+(st|nd|rd|th)\\+?\\b', '', 'g'), '<[^>]*>', '', 'g')"
_c = f"TRIM(REGEXP_REPLACE(REGEXP_REPLACE({_c}, '[^a-zA-ZÀ-ÿ\\s''.\\-]', '', 'g'), '\\s{{2,}}', ' ', 'g'))"
query("x32_clean_name", f"""
    SELECT account_id, c AS name, LENGTH(c) > 60 AS too_long
    FROM (SELECT account_id, {_c} AS c FROM (SELECT account_id, {NOISY} AS v FROM accounts_v))""")(
    lambda t: t.accounts.select("account_id", names.clean_name(F.expr(NOISY)).alias("name"), names.too_long(F.expr(NOISY)).alias("too_long")))

OFFICER = "SELECT id, UPPER(SPLIT_PART(name, ' ', 2)) || ', ' || SPLIT_PART(name, ' ', 1) || ' Ann' AS name, role, resigned_date FROM officers_v"
query("x33_officer_contact", f"""
    SELECT id, CASE WHEN ok THEN SPLIT_PART(given, ' ', 1) END AS first_name, CASE WHEN ok THEN CASE WHEN LENGTH(ln) > 1 THEN LEFT(ln, 1) || LOWER(SUBSTR(ln, 2)) ELSE ln END END AS last_name,
      CASE WHEN ok THEN CASE role WHEN 'llp-member' THEN 'Partner' ELSE 'Director' END END AS job_title
    FROM (SELECT *, resigned_date IS NULL AND role <> 'secretary' AND LENGTH(given) >= 2 AS ok FROM (
      SELECT id, role, resigned_date, COALESCE(TRIM(SPLIT_PART(name, ',', 1)), '') AS ln, COALESCE(TRIM(SPLIT_PART(name, ',', 2)), '') AS given FROM ({OFFICER})))""")(
    lambda t: t.sql(OFFICER).select("id", names.officer_contact("name", "role", "resigned_date").alias("o")).select("id", "o.*"))

FN, LN = "LOWER(TRIM(first_name))", "LOWER(TRIM(last_name))"
KNOWN = "('james', 'mary', 'oliver', 'fiona', 'neil', 'sarah', 'grace', 'stephen')"
BAD_WORDS = "('here', 'services', 'click')"
STRICT = (f"COALESCE(LENGTH({FN}) BETWEEN 2 AND 15 AND LENGTH({LN}) BETWEEN 2 AND 25 AND REGEXP_MATCHES({FN}, '^[a-z''-]+$') AND REGEXP_MATCHES({LN}, '^[a-z''-]+$') "
          f"AND NOT REGEXP_MATCHES({FN}, {q(rules.WORD_ENDINGS_STRICT)}) AND NOT REGEXP_MATCHES({LN}, {q(rules.WORD_ENDINGS_STRICT)}) "
          f"AND {LN} NOT IN ({listing(rules.NOT_A_SURNAME)}) AND {FN} <> {LN} AND {FN} IN {KNOWN} AND {FN} NOT IN {BAD_WORDS} AND {LN} NOT IN {BAD_WORDS}, FALSE)")
query("x34_valid_person", f"SELECT contact_id, {STRICT} AS person_ok FROM contacts_v")(
    lambda t: quality.valid_person(t.contacts, t.first_names, t.not_names).select("contact_id", "person_ok"))
query("x35_plausible_first", f"""
    SELECT contact_id, COALESCE(LENGTH({FN}) BETWEEN 4 AND 15 AND REGEXP_MATCHES({FN}, '^[a-z''-]+$') AND NOT REGEXP_MATCHES({FN}, {q(rules.WORD_ENDINGS_LENIENT)}), FALSE) AS ok
    FROM contacts_v""")(lambda t: t.contacts.select("contact_id", names.plausible_first("first_name").alias("ok")))
# first names of contacts, words of part names and made ones; every second word of a part name is in the dictionary of ordinary words
FIRSTS = """SELECT contact_id AS id, first_name FROM contacts_v UNION ALL SELECT p_partkey + 100000000, SPLIT_PART(p_name, ' ', 2) FROM part
    UNION ALL SELECT p_partkey + 200000000, CASE p_partkey % 3 WHEN 0 THEN ' Kirsten' WHEN 1 THEN 'Attainment' ELSE 'R2' END FROM part"""
PLAIN_WORDS = "SELECT DISTINCT UPPER(SPLIT_PART(p_name, ' ', 2)) AS word FROM part WHERE LENGTH(SPLIT_PART(p_name, ' ', 2)) % 2 = 0"
query("x35_plausible_first_names", f"""
    SELECT id, first_name, why AS first_why, CASE why WHEN 'known' THEN 100 WHEN 'plausible' THEN 60 WHEN 'ordinary_word' THEN 20 ELSE 0 END AS first_score FROM (
      SELECT *, CASE WHEN COALESCE({FN} IN {KNOWN}, FALSE) THEN 'known' WHEN COALESCE({FN} IN (SELECT LOWER(word) FROM ({PLAIN_WORDS})), FALSE) THEN 'ordinary_word'
        WHEN COALESCE(LENGTH({FN}) BETWEEN 4 AND 15 AND REGEXP_MATCHES({FN}, '^[a-z''-]+$') AND NOT REGEXP_MATCHES({FN}, {q(rules.WORD_ENDINGS_LENIENT)}), FALSE) THEN 'plausible' ELSE 'malformed' END AS why
      FROM ({FIRSTS}))""")(lambda t: quality.plausible_first_names(t.sql(FIRSTS), t.first_names, t.sql(PLAIN_WORDS)))
TITLE_OK = (f"COALESCE(LENGTH(TRIM(job_title)) BETWEEN 3 AND 60 AND NOT REGEXP_MATCHES(TRIM(job_title), '(?i)[a-z]{{20,}}') "
            f"AND NOT REGEXP_MATCHES(job_title, '[<>{{}}()\\[\\]|\\\\/]') AND NOT REGEXP_MATCHES(job_title, {q(rules.TITLE_GARBAGE)}), FALSE)")
query("x36_valid_title", f"SELECT contact_id, {TITLE_OK} AS ok FROM contacts_v")(
    lambda t: t.contacts.select("contact_id", names.valid_title("job_title").alias("ok")))
ROLE_OK = f"COALESCE(LENGTH(TRIM(job_title)) >= 3 AND {any_of('LOWER(job_title)', rules.ROLE_WORDS)}, FALSE)"
query("x37_has_role", f"SELECT contact_id, {ROLE_OK} AS ok FROM contacts_v")(
    lambda t: t.contacts.select("contact_id", names.has_role("job_title").alias("ok")))
query("x38_seniority", f"""
    SELECT contact_id, CASE {' '.join(f"WHEN REGEXP_MATCHES(LOWER(job_title), {q(p)}) THEN {q(n)}" for n, p in rules.SENIORITY)} ELSE 'Unknown' END AS level
    FROM contacts_v""")(lambda t: t.contacts.select("contact_id", names.seniority("job_title").alias("level")))
query("x39_canonical_title", f"""
    SELECT contact_id, CASE WHEN LENGTH(job_title) BETWEEN 2 AND 80 THEN CASE
        {' '.join(f"WHEN REGEXP_MATCHES(LOWER(job_title), {q(p)}) THEN {q(n)}" for p, n, _ in rules.MANAGEMENT_TITLES)} END END AS title,
      CASE WHEN LENGTH(job_title) BETWEEN 2 AND 80 THEN CASE
        {' '.join(f"WHEN REGEXP_MATCHES(LOWER(job_title), {q(p)}) THEN {tier}" for p, _, tier in rules.MANAGEMENT_TITLES)} END END AS tier FROM contacts_v""")(
    lambda t: t.contacts.select("contact_id", names.canonical_title("job_title").alias("m")).select("contact_id", "m.title", "m.tier"))

# --- scores -----------------------------------------------------------------------------------

query("x40_enrichment_score", f"""
    SELECT account_id, {' + '.join(f"CASE WHEN {c} <> '' THEN 1 ELSE 0 END" for c in ('website', 'email_format', 'phone_number', 'linkedin_url'))} AS score
    FROM accounts_v""")(lambda t: t.accounts.select("account_id", scores.enrichment_score().alias("score")))
PLACE = "CASE queue_id % 6 WHEN 0 THEN 'city' WHEN 1 THEN 'town' WHEN 2 THEN 'village' WHEN 3 THEN 'suburb' WHEN 4 THEN 'hamlet' END"
query("x41_place_priority", f"""
    SELECT queue_id, CASE WHEN pt = 'city' AND population > 100000 THEN 1 WHEN pt = 'city' OR (pt = 'town' AND population > 10000) THEN 2
      WHEN pt IN ('town', 'village') THEN 3 WHEN pt IN ('suburb', 'neighbourhood') THEN 4 ELSE 5 END AS priority
    FROM (SELECT *, {PLACE} AS pt FROM queue_v)""")(
    lambda t: t.queue.select("queue_id", company.place_priority(F.expr(PLACE), "population").alias("priority")))
QUALITY = " + ".join(f"CASE WHEN {c} <> '' THEN {w} ELSE 0 END" for c, w in rules.QUALITY_WEIGHTS)
SCORED = f"""SELECT a.account_id, CAST(LEAST({QUALITY} + 4 * LEAST(COALESCE(k, 0), 5), 100) AS INT) AS quality_score FROM accounts_v a
    LEFT JOIN (SELECT linked_account_id, COUNT(*) AS k FROM contacts_v GROUP BY 1) c ON a.account_id = c.linked_account_id"""
query("x42_quality_score", SCORED)(
    lambda t: quality.score_accounts(t.accounts, t.contacts).select("account_id", "quality_score"))

# --- patterns ---------------------------------------------------------------------------------

PEOPLE = "SELECT contact_id, first_name || ' ' || last_name AS full_name, 'site1.test' AS dom FROM contacts_v WHERE first_name IS NOT NULL AND last_name IS NOT NULL"
NAMED = f"""SELECT contact_id, dom, w[1] AS first_name, CASE WHEN LEN(w) > 1 THEN w[LEN(w)] ELSE '' END AS last_name FROM (
    SELECT contact_id, dom, LIST_FILTER(STRING_SPLIT_REGEX(LOWER(full_name), '\\s+'), lambda w: w <> '') AS w FROM ({PEOPLE}))"""


def substitute(pattern: str, first: str = "LOWER(first_name)", last: str = "LOWER(last_name)") -> str:
    text = q(pattern)
    for token, value in (("{first}", first), ("{last}", last), ("{f}", f"LEFT({first}, 1)"), ("{l}", f"LEFT({last}, 1)")):
        text = f"REPLACE({text}, {q(token)}, {value})"
    return text


def candidate(pattern: str) -> str:
    local = f"REGEXP_REPLACE(REGEXP_REPLACE({substitute(pattern)}, '[.]+', '.', 'g'), '^[.]|[.]$', '', 'g')"
    return f"CASE WHEN LENGTH({local}) >= 2 THEN {local} || '@' || dom END"


query("x43_email_permutations", f"""
    SELECT contact_id, ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT([{', '.join(candidate(p) for p in rules.EMAIL_PATTERNS)}])), '|') AS addresses FROM ({NAMED})""")(
    lambda t: t.sql(PEOPLE).select("contact_id", joined(email.email_permutations("full_name", "dom")).alias("addresses")))

LINKED = f"SELECT contact_id, first_name, last_name, email_format, {{}} AS dom FROM contacts_v JOIN accounts_v ON linked_account_id = account_id"
_f, _l = f"NULLIF({sub('LOWER(first_name)', '[^a-z]')}, '')", f"NULLIF({sub('LOWER(last_name)', '[^a-z]')}, '')"


def built(last: str) -> str:
    text = "NULLIF(email_format, '')"
    for token, value in (("{first}", _f), ("{last}", last), ("{f}", f"LEFT({_f}, 1)"), ("{l}", f"LEFT({last}, 1)")):
        text = f"REPLACE({text}, {q(token)}, {value})"
    full = f"CASE WHEN CONTAINS({text}, '@') THEN {text} ELSE {text} || '@' || dom END"
    return f"CASE WHEN REGEXP_MATCHES({full}, {q(rules.GENERATED_SYNTAX)}) THEN {full} END"


query("x44_apply_pattern", f"SELECT contact_id, {built(_l)} AS strict, {built(f'COALESCE({_l}, {q(chr(117) + 'nknown')})')} AS lenient FROM ({LINKED.format(host('website'))})")(
    lambda t: t.contacts.join(t.accounts.select("account_id", "website", "email_format"), F.col("linked_account_id") == F.col("account_id")).select(
        "contact_id", email.apply_pattern("email_format", "first_name", "last_name", web.domain("website")).alias("strict"),
        email.apply_pattern("email_format", "first_name", "last_name", web.domain("website"), missing_last="unknown").alias("lenient")))

_pf, _pl = "NULLIF(LOWER(first_name), '')", "NULLIF(LOWER(last_name), '')"
_exact = " ".join(f"WHEN {LOCAL} = {substitute(p, _pf, _pl)} THEN {q(p)}" for p in
                  ["{first}.{last}", "{first}_{last}", "{first}{last}", "{last}.{first}", "{f}{last}", "{f}.{last}", "{first}.{l}", "{first}{l}", "{first}", "{last}"])
DETECT = f"""CASE WHEN {GENERIC} OR {LOCAL} = '' OR {HOST} = '' THEN NULL {_exact} WHEN REGEXP_MATCHES({LOCAL}, '^[a-z]+[.][a-z]+$') THEN '{{first}}.{{last}}'
    WHEN REGEXP_MATCHES({LOCAL}, '^[a-z]+_[a-z]+$') THEN '{{first}}_{{last}}' WHEN REGEXP_MATCHES({LOCAL}, '^[a-z]{{4,}}$') THEN '{{f}}{{last}}' END || '@' || {HOST}"""
query("x45_detect_pattern", f"SELECT contact_id, {DETECT} AS pattern FROM contacts_v")(
    lambda t: t.contacts.select("contact_id", email.detect_pattern("email", "first_name", "last_name").alias("pattern")))
query("x46_pattern_of", f"""
    SELECT contact_id, CASE WHEN email <> '' AND {HOST} <> '' THEN CASE WHEN CONTAINS({LOCAL}, '.') THEN 'first.last@' WHEN CONTAINS({LOCAL}, '_') THEN 'first_last@'
      WHEN REGEXP_MATCHES({LOCAL}, '^[a-z]{{8,}}$') THEN 'firstlast@' ELSE 'firstname@' END || {HOST} END AS pattern FROM contacts_v""")(
    lambda t: t.contacts.select("contact_id", email.pattern_of("email", email.mail_domain("email")).alias("pattern")))

OWN = f"LIST_FILTER({FOUND_MAIL.replace('{c}', 'html')}, lambda e: CONTAINS(LOWER(e), '@' || {host('url')}))"
_people = f"LIST_FILTER(own, lambda e: NOT REGEXP_MATCHES(e, {q(rules.SITE_GENERIC)}))"
CHOSEN = (f"COALESCE(LIST_FILTER({_people}, lambda e: CONTAINS(SPLIT_PART(LOWER(e), '@', 1), '.') OR REGEXP_MATCHES(SPLIT_PART(LOWER(e), '@', 1), '^[a-z]{{3,}}$'))[1], {_people}[1], "
          + ", ".join(f"LIST_FILTER(own, lambda e: STARTS_WITH(LOWER(e), {q(p)}))[1]" for p in rules.PREFERRED_GENERIC) + ", own[1])")
query("x47_choose_email", f"SELECT page_id, {CHOSEN} AS email FROM (SELECT page_id, {OWN} AS own FROM pages_v)")(
    lambda t: t.pages.select("page_id", email.choose_email(email.extract_emails("html"), web.domain("url")).alias("email")))
query("x48_choose_phone", f"""
    SELECT page_id, COALESCE(LIST_FILTER(p, lambda x: STARTS_WITH(x, '+'))[1], p[1]) AS phone FROM (
      SELECT page_id, REGEXP_EXTRACT_ALL(html, {q(rules.US_PHONE)}) AS p FROM pages_v)""")(
    lambda t: t.pages.select("page_id", phone.choose_phone(phone.extract_phones("html")).alias("phone")))

# --- name tests -------------------------------------------------------------------------------

LETTERS = f"LENGTH({sub('company_name', '[^a-zA-Z]')})"
FOREIGN = f"LENGTH({sub('company_name', '[[:ascii:]]')})"
REASONS = f"""CASE WHEN {FOREIGN} > 0 AND ({LETTERS} < 3 OR {FOREIGN} > LENGTH(company_name) * 0.3) THEN 'non_english' END,
    CASE WHEN {any_of('LOWER(company_name)', rules.SPAM_PHRASES)} OR (CONTAINS(LOWER(company_name), 'best ') AND CONTAINS(LOWER(company_name), ' 20')) THEN 'spam_phrase' END,
    CASE WHEN company_name IS NULL OR LENGTH(company_name) < 3 OR TRIM(company_name) = '' THEN 'too_short' END,
    CASE WHEN LENGTH(company_name) > 100 THEN 'too_long' END, CASE WHEN {any_of('company_name', rules.URL_PARTS)} THEN 'url_in_name' END,
    CASE WHEN {LETTERS} < 3 THEN 'few_letters' END"""
query("x49_spam_reasons", f"SELECT account_id, CONCAT_WS('|', {REASONS}) AS reasons FROM accounts_v")(
    lambda t: t.accounts.select("account_id", F.array_join(company.spam_reasons("company_name"), "|").alias("reasons")))
DISCOVERABLE = (f"COALESCE(LENGTH(company_name) BETWEEN 2 AND 100 AND REGEXP_MATCHES(company_name, '[a-zA-Z]{{2,}}') "
                f"AND NOT REGEXP_MATCHES(company_name, {q(rules.DISCOVERY_SPAM)}), FALSE)")
query("x49_discoverable_name", f"SELECT account_id, {DISCOVERABLE} AS ok FROM accounts_v")(
    lambda t: t.accounts.select("account_id", company.discoverable_name("company_name").alias("ok")))
query("x50_headline_name", f"""
    SELECT account_id, COALESCE(({any_of('LOWER(company_name)', rules.HEADLINE_PHRASES)} OR LENGTH(company_name) NOT BETWEEN 3 AND 100
      OR REGEXP_MATCHES(company_name, '^[0-9]+$')) AND country <> 'United Kingdom', FALSE) AS headline FROM accounts_v""")(
    lambda t: t.accounts.select("account_id", company.headline_name("company_name", "country").alias("headline")))


def gib(c: str) -> str:
    runs = f"LEN(LIST_FILTER(RANGE(1, LENGTH({c}) - 3), lambda i: SUBSTR({c}, i, 5) = REPEAT(SUBSTR({c}, i, 1), 5))) > 0"
    return f"COALESCE(REGEXP_MATCHES({c}, '^[^aeiouAEIOU]{{6,}}$') OR {runs} OR REGEXP_MATCHES({c}, '^[a-z]{{1,2}}[0-9]{{3,}}') OR REGEXP_MATCHES({c}, '^[0-9]+$'), FALSE)"


query("x51_gibberish", f"SELECT account_id, {gib('phone_number')} AS phone_odd, {gib('company_name')} AS name_odd FROM accounts_v")(
    lambda t: t.accounts.select("account_id", company.gibberish("phone_number").alias("phone_odd"), company.gibberish("company_name").alias("name_odd")))
FAKE = f"""CASE WHEN email IS NULL OR NOT REGEXP_MATCHES(TRIM(email), {q(rules.EMAIL_SYNTAX)}) THEN 'invalid format'
    WHEN {any_of('LOWER(email)', rules.FAKE_EMAIL_PARTS)} THEN 'known placeholder domain/prefix' WHEN REGEXP_MATCHES({LOCAL}, '^[a-z]{{1,2}}$') THEN 'local part too short'
    WHEN {gib(LOCAL)} THEN 'gibberish local part' END"""
query("x52_fake_email", f"SELECT contact_id, {FAKE} AS reason FROM contacts_v")(
    lambda t: t.contacts.select("contact_id", email.fake_email_reason("email").alias("reason")))

NAMES = f"SELECT account_id, {KEY.replace('{c}', 'company_name')} AS a, REGEXP_REPLACE(SPLIT_PART(LOWER(COALESCE(linkedin_url, '')), '/company/', 2), '-', '') AS b FROM accounts_v"
query("x53_char_similarity", f"""
    SELECT account_id, CASE WHEN a = '' OR b = '' THEN 0 WHEN CONTAINS(lg, sh) THEN ROUND(LENGTH(sh) * 1.0 / LENGTH(lg), 6)
      ELSE ROUND(LEN(LIST_FILTER(STRING_SPLIT(sh, ''), lambda ch: ch <> '' AND CONTAINS(lg, ch))) * 1.0 / LENGTH(lg), 6) END AS score
    FROM (SELECT *, CASE WHEN LENGTH(a) > LENGTH(b) THEN a ELSE b END AS lg, CASE WHEN LENGTH(a) > LENGTH(b) THEN b ELSE a END AS sh FROM ({NAMES}))""")(
    lambda t: t.accounts.select("account_id", F.round(company.char_similarity(
        company.company_key("company_name"),
        F.regexp_replace(F.split_part(F.lower(F.coalesce("linkedin_url", F.lit(""))), F.lit("/company/"), F.lit(2)), "-", "")), 6).alias("score")))
query("x54_profile_url", "SELECT account_id, REPLACE(REPLACE(LOWER(linkedin_url), 'http://', 'https://'), 'www.', '') AS url FROM accounts_v")(
    lambda t: t.accounts.select("account_id", web.profile_url("linkedin_url").alias("url")))

BULLETS = "SELECT contact_id, COALESCE(first_name, 'Al') || ' ' || last_name || ' · ' || job_title || ' at Acme Ltd · Leeds, United Kingdom' AS text, first_name, last_name, job_title FROM contacts_v"
query("x55_parse_bullets", f"""
    SELECT contact_id, CASE WHEN named THEN COALESCE(first_name, 'Al') END AS first_name, CASE WHEN named THEN last_name END AS last_name,
      CASE WHEN text IS NOT NULL THEN job_title END AS job_title, CASE WHEN text IS NOT NULL THEN 'Acme Ltd' END AS company,
      CASE WHEN text IS NOT NULL THEN 'Leeds' END AS city, CASE WHEN text IS NOT NULL THEN 'United Kingdom' END AS country
    FROM (SELECT *, text IS NOT NULL AND COALESCE(first_name, 'Al') <> '' AS named FROM ({BULLETS}))""")(
    lambda t: t.sql(BULLETS).select("contact_id", names.parse_bullets("text").alias("b")).select(
        "contact_id", "b.first_name", "b.last_name", "b.job_title", "b.company", "b.city", "b.country"))

query("x56_full_address", """
    SELECT id, CONCAT_WS(', ', NULLIF(address_line_1, ''), NULLIF(address_line_2, ''), NULLIF(locality, ''), NULLIF(region, ''), NULLIF(postal_code, '')) AS address
    FROM companies_v""")(lambda t: t.companies.select("id", company.full_address(
        "address_line_1", "address_line_2", "locality", "region", "postal_code").alias("address")))
query("x57_is_recent", f"SELECT id, COALESCE(last_updated > {NOW} - INTERVAL 30 DAY, FALSE) AS recent FROM companies_v")(
    lambda t: t.companies.select("id", company.is_recent("last_updated", 30, AS_OF).alias("recent")))
query("x58_likely_site", f"""
    SELECT account_id, COALESCE(LEN(LIST_FILTER(STRING_SPLIT(REGEXP_REPLACE(LOWER(company_name), '[^a-z0-9]+', ' ', 'g'), ' '),
        lambda w: LENGTH(w) > 2 AND CONTAINS({host('linkedin_url')}, w))) > 0, FALSE) AS likely,
      {any_of(host('linkedin_url'), rules.BLOCKED_HOSTS)} AS blocked FROM accounts_v""")(
    lambda t: t.accounts.select("account_id", web.likely_site("linkedin_url", "company_name").alias("likely"), web.blocked_host("linkedin_url").alias("blocked")))
BOXES = "SELECT c_custkey AS box, CAST(c_nationkey AS DOUBLE) AS south, c_nationkey + 0.07 AS north, -1.0 AS west, -1.0 + 0.01 * (1 + c_custkey % 13) AS east FROM customer"
query("x59_grid_cells", f"""
    SELECT box, ROUND(south + i * 0.05, 6) AS south, ROUND(LEAST(south + (i + 1) * 0.05, north), 6) AS north, ROUND(west + j * 0.05, 6) AS west,
      ROUND(LEAST(west + (j + 1) * 0.05, east), 6) AS east
    FROM ({BOXES}) b, (SELECT UNNEST([0, 1]) AS i), (SELECT UNNEST([0, 1, 2]) AS j)
    WHERE ROUND(south + i * 0.05, 9) < ROUND(north, 9) AND ROUND(west + j * 0.05, 9) < ROUND(east, 9)""")(
    lambda t: locations.grid_cells(t.sql(BOXES)))

_near = " || ".join(f"REGEXP_EXTRACT_ALL(win, {q(p)})" for p in rules.UK_PHONES_NEAR_NAME)
query("x60_phone_near", f"""
    SELECT page_id, CASE WHEN i > 0 THEN LIST_FILTER(LIST_TRANSFORM({_near}, lambda m: REGEXP_REPLACE(REGEXP_REPLACE(m, '[\\s.-]', '', 'g'), '^[+]?44', '0')),
      lambda p: REGEXP_MATCHES(p, '^0[1-9][0-9]{{8,10}}$'))[1] END AS phone
    FROM (SELECT page_id, i, SUBSTR(html, GREATEST(i - 200, 1), i + 300 - GREATEST(i - 200, 1)) AS win FROM (
      SELECT page_id, html, INSTR(LOWER(html), 'managing') AS i FROM pages_v))""")(
    lambda t: t.pages.select("page_id", phone.phone_near("html", F.lit("Managing"), F.lit(None).cast("string")).alias("phone")))
query("x61_company_slug", f"""
    SELECT account_id, {sub('TRIM(' + sub(sub('LOWER(company_name)', rules.LEGAL_WORDS_IN_SLUGS), '[^a-z0-9' + chr(92) + 's-]') + ')', chr(92) + 's+', '-')} AS slug
    FROM accounts_v""")(lambda t: t.accounts.select("account_id", company.company_slug("company_name").alias("slug")))

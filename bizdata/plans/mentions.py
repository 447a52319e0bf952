"""Queries P-22, P-23, P-27, P-28 and P-42: people, addresses and numbers beside each other in texts.

The reference SQL finds every match by its position, summed over the parts between matches, and cuts contexts by position.
"""

from ..functions import rules
from ..operators import emails, pages
from .columns import GENERIC, PERSONAL, STRICT, TITLE_OK, VISIBLE, built, host, listing, q
from .jobs import best_pattern_sql
from .registry import query

PAGES = f"SELECT page_id, {host('url')} AS domain, html, {VISIBLE} AS txt FROM pages_v"


def places(source: str, text: str, pattern: str, keep: str) -> str:
    """One row per match: the kept columns, k (from 1), m (the match), s (where it starts) and the text."""
    return f"""(SELECT {keep}, text, k, found[k] AS m, 1 + CAST(list_sum(list_transform(cut[:k], lambda x: length(x))) + COALESCE(list_sum(list_transform(found[:k - 1], lambda x: length(x))), 0) AS BIGINT) AS s
      FROM (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM (SELECT {keep}, {text} AS text, regexp_extract_all({text}, {q(pattern)}) AS found, string_split_regex({text}, {q(pattern)}) AS cut FROM {source})))"""


def before(n: int) -> str:
    return f"substr(text, greatest(s - {n}, 1), s - greatest(s - {n}, 1))"


def after(n: int) -> str:
    return f"substr(text, s + length(m), {n})"


LISTED = f"""(SELECT page_id, domain, email, min(i) AS i FROM (SELECT page_id, domain, lower(unnest(found)) AS email, unnest(range(len(found))) AS i
    FROM (SELECT page_id, domain, regexp_extract_all(html, {q(rules.EMAIL_ON_SITE)}) AS found FROM pg)) GROUP BY ALL)"""
PAIR = q(rules.FULL_NAME_PAIR)
PAGE_EMAILS = f"""
    WITH pg AS ({PAGES}), listed AS {LISTED},
      printed AS (SELECT page_id, domain, lower(m) AS email, k, {before(120)} AS b, {after(120)} AS a FROM {places('pg', 'txt', rules.EMAIL_ON_SITE, 'page_id, domain')}),
      cand AS (SELECT page_id, domain, email, k, 1 AS side, regexp_extract_all(b, {PAIR})[-1] AS name, length(string_split(b, regexp_extract_all(b, {PAIR})[-1])[-1]) AS gap FROM printed
        UNION ALL SELECT page_id, domain, email, k, 2, regexp_extract_all(a, {PAIR})[1], length(string_split(a, regexp_extract_all(a, {PAIR})[1])[1]) FROM printed
        UNION ALL SELECT page_id, domain, lower(unnest(tos)), unnest(range(len(tos))), 0,
            unnest(list_transform(said, lambda x: regexp_extract_all(regexp_replace(x, '<[^>]+>', ' ', 'g'), {PAIR})[1])), 0
          FROM (SELECT page_id, domain, regexp_extract_all(html, {q(rules.MAILTO_LINK)}, 1) AS tos, regexp_extract_all(html, {q(rules.MAILTO_LINK)}, 2) AS said FROM pg)),
      named AS (SELECT page_id, domain, email, first(name ORDER BY gap, side, k, name) AS name FROM cand WHERE name IS NOT NULL GROUP BY ALL)
    SELECT l.domain, l.email, NULLIF(regexp_extract(name, {PAIR}, 1), '') AS first_name, NULLIF(regexp_extract(name, {PAIR}, 2), '') AS last_name, l.page_id * 100000 + l.i AS pos
    FROM listed l LEFT JOIN named n ON n.page_id = l.page_id AND n.domain = l.domain AND n.email = l.email
    WHERE split_part(l.email, '@', 2) = l.domain OR contains(split_part(l.email, '@', 2), split_part(l.domain, '.', 1))"""
query("p22_page_emails", f"SELECT domain, email, first_name, last_name, pos // 100000 AS page_id FROM ({PAGE_EMAILS})")(
    lambda t: emails.page_emails(t.pages).selectExpr("domain", "email", "first_name", "last_name", "pos.page_id"))
query("p22_mine_patterns", f"""
    SELECT account_id, p.domain, p.email_format, n_addresses FROM accounts_v a JOIN ({best_pattern_sql(f"SELECT * FROM ({PAGE_EMAILS}) WHERE NOT {GENERIC}")}) p ON p.domain = {host('a.website')}
    WHERE COALESCE(a.email_format, '') = '' OR NOT STARTS_WITH(a.email_format, '{{')""")(lambda t: emails.mine_patterns(t.accounts, t.pages))

LETTERS = "[a-z''-]"
query("p23_fill_emails", f"""
    WITH pg AS ({PAGES}), listed AS {LISTED},
      own AS (SELECT domain, email, split_part(email, '@', 1) AS lp, page_id, i FROM listed WHERE split_part(email, '@', 2) = domain AND {PERSONAL} AND length(split_part(email, '@', 1)) <= 64),
      links AS (SELECT domain, page_id, k, email, around FROM (SELECT domain, page_id, k, split_part(lower(substr(m, 8)), '?', 1) AS email, lower({before(500)} || chr(10) || {after(500)}) AS around
        FROM {places('pg', 'html', rules.MAILTO, 'page_id, domain')}) WHERE contains(email, '@') AND {PERSONAL}),
      todo AS (SELECT contact_id, first_name, last_name, email_format, {host('a.website')} AS dom, lower(first_name) AS f, lower(NULLIF(last_name, '')) AS l, lower(trim(concat_ws(' ', first_name, last_name))) AS whole
        FROM contacts_v LEFT JOIN accounts_v a ON linked_account_id = account_id WHERE COALESCE(email, '') = '' AND first_name <> '' AND first_name NOT IN ('General', 'Contact')),
      named AS (SELECT dom AS nd, f, l, first(email ORDER BY page_id, i, email) AS hit FROM (SELECT DISTINCT dom, f, l FROM todo) JOIN own ON domain = dom AND (contains(lp, f) OR contains(lp, l)) GROUP BY ALL),
      near AS (SELECT dom AS wd, whole, first(email ORDER BY page_id, k, email) AS hit FROM (SELECT DISTINCT dom, whole FROM todo WHERE regexp_matches(whole, '^{LETTERS}+( {LETTERS}+)?$')) JOIN links ON domain = dom
        AND regexp_matches(around, '(^|[^a-z''-])' || whole || '($|[^a-z''-])') GROUP BY ALL),
      made AS (SELECT contact_id, COALESCE(n.hit, w.hit) AS found, CASE WHEN STARTS_WITH(email_format, '{{') THEN {built("COALESCE(NULLIF(REGEXP_REPLACE(LOWER(last_name), '[^a-z]', '', 'g'), ''), 'unknown')")} END AS guess
        FROM todo t LEFT JOIN named n ON n.nd = t.dom AND n.f = t.f AND n.l IS NOT DISTINCT FROM t.l LEFT JOIN near w ON w.wd = t.dom AND w.whole = t.whole)
    SELECT contact_id, COALESCE(found, guess) AS email, CASE WHEN found IS NOT NULL THEN 'page' WHEN guess IS NOT NULL THEN 'pattern' END AS email_source,
      CASE WHEN found IS NOT NULL THEN FALSE WHEN guess IS NOT NULL THEN TRUE END AS email_generated FROM made""")(
    lambda t: emails.fill_emails(t.contacts, t.accounts, t.pages).select("contact_id", "email", "email_source", "email_generated"))

WORD = q(r"\b(" + "|".join(sorted(rules.PAGE_TITLES, key=len, reverse=True)) + r")\b")
query("p27_people_from_pages", f"""
    WITH pg AS ({PAGES}),
      named AS (SELECT page_id, domain, k, regexp_extract(m, {q(rules.NAME_PAIR)}, 1) AS first_name, regexp_extract(m, {q(rules.NAME_PAIR)}, 2) AS last_name, substr(text, s, 200) AS said
        FROM {places('pg', 'txt', rules.NAME_PAIR, 'page_id, domain')}),
      people AS (SELECT *, array_to_string(list_transform(string_split(trim(regexp_extract(lower(said), {WORD})), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS job_title,
          lower(list_filter(regexp_extract_all(said, {q(rules.EMAIL_ON_SITE)}), lambda e: lower(split_part(split_part(e, '@', 1), '.', 1)) NOT IN ({listing(rules.SITE_ROLE_MAILBOXES)}))[1]) AS email
        FROM named WHERE {STRICT})
    SELECT domain, page_id, first_name, last_name, CASE WHEN {TITLE_OK} THEN job_title END AS job_title, email FROM people
    QUALIFY row_number() OVER (PARTITION BY domain, lower(first_name), lower(last_name) ORDER BY page_id, k) = 1""")(
    lambda t: pages.people_from_pages(t.pages, t.first_names, t.not_names))

# names that stand first alone and later beside a title, or beside a title that comes first
SNIPPETS = """SELECT contact_id, CASE contact_id % 8 WHEN 0 THEN first_name || ' ' || last_name || ' - ' || job_title || ' at Acme Ltd | LinkedIn'
    WHEN 1 THEN 'Meet ' || first_name || ' ' || last_name || ', ' || job_title WHEN 2 THEN 'Our ' || job_title || ' since 2001 is ' || first_name || ' ' || last_name || ' of Leeds'
    WHEN 3 THEN 'please ring ' || first_name || ' ' || last_name || ' today'
    WHEN 4 THEN first_name || ' ' || last_name || ' joined us in spring. ' || REPEAT('much has changed since then; ', 12) || 'Now the ' || job_title || ' here is ' || first_name || ' ' || last_name || '.'
    WHEN 5 THEN 'The ' || job_title || ' is new. ' || REPEAT('nothing of note; ', 20) || first_name || ' ' || last_name || ' met Mary Jones. ' || REPEAT('x', 130) || ' Mary Jones, our chief executive officer'
    WHEN 6 THEN 'Grace Taylor and ' || first_name || ' ' || last_name || ' are ' || job_title || ' and founder' END AS text FROM contacts_v"""
FIRST_TITLE = "COALESCE(" + ", ".join(f"CASE WHEN regexp_matches(around, {q(p)}) THEN regexp_extract(around, {q(f'(?:{p})')}) END" for p, _, _ in rules.MANAGEMENT_TITLES) + ", '')"
CANONICAL = ("CASE WHEN length(title) BETWEEN 2 AND 80 THEN CASE " + " ".join(f"WHEN regexp_matches(lower(title), {q(p)}) THEN {q(n)}" for p, n, _ in rules.MANAGEMENT_TITLES) + " END END")


def paired(pattern: str, confidence: str) -> str:
    return f"""SELECT contact_id, pos, string_split_regex(trim(n), '\\s+') AS words, trim(t) AS title, {confidence} AS confidence FROM (
        SELECT contact_id, unnest(regexp_extract_all(text, {q(pattern)}, 1)) AS n, unnest(regexp_extract_all(text, {q(pattern)}, 2)) AS t, unnest(range(len(regexp_extract_all(text, {q(pattern)})))) AS pos FROM snippets)"""


query("p28_people_from_text", f"""
    WITH snippets AS ({SNIPPETS}),
      near AS (SELECT contact_id, k - 1 AS pos, string_split_regex(m, '\\s+') AS words, lower({before(120)} || m || {after(120)}) AS around FROM {places('snippets', 'text', rules.NAME_PAIR, 'contact_id')}),
      raw AS ({paired(rules.NAME_DASH_TITLE, '0.9')} UNION ALL {paired(rules.NAME_COMMA_TITLE, '0.85')}
        UNION ALL SELECT contact_id, pos, words, {FIRST_TITLE}, 0.7 FROM near UNION ALL SELECT contact_id, pos, words, '', 0.4 FROM near),
      found AS (SELECT contact_id, pos, words[1] AS first_name, words[-1] AS last_name, CASE WHEN confidence = 0.4 THEN 'Director' ELSE {CANONICAL} END AS job_title, confidence FROM raw WHERE len(words) >= 2),
      once AS (SELECT * FROM found WHERE job_title IS NOT NULL AND {STRICT}
        QUALIFY row_number() OVER (PARTITION BY contact_id, lower(first_name), lower(last_name) ORDER BY confidence DESC, pos, job_title) = 1)
    SELECT contact_id, first_name, last_name, job_title, CAST(confidence AS DOUBLE) AS confidence FROM once
    WHERE confidence > 0.4 OR contact_id NOT IN (SELECT contact_id FROM once WHERE confidence > 0.4)""")(
    lambda t: pages.people_from_text(t.sql(SNIPPETS), "text", "contact_id", t.first_names, t.not_names, "Director"))

NUMBERS = " UNION ALL ".join(f"""SELECT page_id, domain, {rank} AS shape, k, regexp_replace(regexp_replace(m, '[\\s.-]', '', 'g'), '^\\+?44', '0') AS phone,
    lower(right({before(300)} || m, 300) || substr(text, s + length(m), greatest(200 - length(m), 0))) AS around FROM {places('pg', 'txt', p, 'page_id, domain')}""" for rank, p in enumerate(rules.UK_PHONES_NEAR_NAME))
query("p42_fill_phones", f"""
    WITH pg AS ({PAGES}), numbers AS ({NUMBERS}),
      worded AS (SELECT *, list_filter(string_split_regex(around, '[^a-z''-]+'), lambda w: length(w) > 1) AS w FROM numbers WHERE regexp_matches(phone, '^0[1-9]\\d{{8,10}}$')),
      named AS (SELECT DISTINCT domain, page_id, shape, k, phone, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS name FROM worded),
      best AS (SELECT domain, name, first(phone ORDER BY page_id, shape, k, phone) AS phone FROM named GROUP BY domain, name),
      todo AS (SELECT contact_id, {host('a.website')} AS domain, lower(trim(concat_ws(' ', first_name, last_name))) AS whole, lower(first_name) AS f
        FROM contacts_v c JOIN accounts_v a ON linked_account_id = account_id WHERE COALESCE(c.phone_number, '') = '' AND first_name <> '')
    SELECT contact_id, COALESCE(b1.phone, b2.phone) AS phone_number FROM todo t LEFT JOIN best b1 ON b1.domain = t.domain AND b1.name = whole LEFT JOIN best b2 ON b2.domain = t.domain AND b2.name = f
    WHERE COALESCE(b1.phone, b2.phone) IS NOT NULL""")(lambda t: pages.fill_phones(t.contacts, t.accounts, t.pages).select("contact_id", "phone_number"))

"""Facts from crawled pages (P-24 … P-28, P-42, P-44)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.company import extract_html_address, name_variants
from ..functions.email import choose_email, extract_emails
from ..functions.industry import industry_hint
from ..functions.names import canonical_title, may_match, person_shape_ok, valid_title
from ..functions.nearby import occurrences
from ..functions.phone import choose_phone, extract_phones, format_uk_phone
from ..functions.presence import missing, present
from ..functions.web import (contact_link, domain, html_fields, html_text, links, social_links,
                             visible_text)
from ..session import cut_lineage
from .classify import main_pages
from .keys import compute_once, first_n, keep_first
from .quality import valid_person
from .upsert import merge_rows


# --- is this the company's site? --------------------------------------------------------------

def candidate_hosts(companies: DataFrame) -> DataFrame:
    """(id, host) guesses from the trading names of a company; nothing is fetched."""
    stems = F.transform(name_variants("name"), lambda n: F.regexp_replace(F.lower(n), "[^a-z0-9]", ""))
    local = F.when(F.col("country").isin("England", "Wales", "Scotland"), F.array(F.lit(".co.uk"), F.lit(".com")))
    endings = F.coalesce(local, F.array(F.lit(".com")))
    hosts = F.flatten(F.transform(stems, lambda s: F.transform(endings, lambda e: F.concat(s, e))))
    return companies.select("id", F.explode(F.array_distinct(hosts)).alias("host"))


def found_on_sites(asked: DataFrame, sites: DataFrame, per_block: int = 1000) -> DataFrame:
    """Of `asked` (host, kind, needle) the distinct rows whose needle the site contains: in its text, or for the kind 'number' in its
    text or source. `sites` has one row per host: host, _html, _text in lower case.

    A page meets the needles of its host in blocks of about `per_block`, by a hash of the needle, so it is read once a
    block and never copied to the companies that ask; a host that very many ask for is many blocks.
    """
    needles = asked.where(F.col("needle").isNotNull()).select("host", (F.col("kind") == "number").alias("source_too"), "needle").distinct()
    blocks = needles.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / per_block).alias("_blocks"))
    dealt = needles.join(blocks, "host").withColumn("_block", F.pmod(F.xxhash64("needle"), "_blocks"))
    listed = dealt.groupBy("host", "_block").agg(F.collect_list(F.struct("source_too", "needle")).alias("_asked"))
    held = F.filter("_asked", lambda n: F.contains(F.col("_text"), n["needle"]) | (n["source_too"] & F.contains(F.col("_html"), n["needle"])))
    found = listed.join(sites, "host").select("host", F.explode(held).alias("_n")).select("host", "_n.source_too", "_n.needle")
    return asked.select("host", "kind", "needle", (F.col("kind") == "number").alias("source_too")).distinct().join(
        found, ["host", "source_too", "needle"], "left_semi").select("host", "kind", "needle")


def site_evidence(companies: DataFrame, officers: DataFrame, pages: DataFrame,
                  hosts: DataFrame | None = None) -> DataFrame:
    """P-24: how surely a host is the company's: number 70, host name 30, address and postcode 40 (postcode
    alone 20), officers 15 each up to 30 by surname, exact name 10; valid from 50, at most 100.

    What each candidate asks of a site are short texts, looked up in the host's one main page by found_on_sites; pages do
    not meet candidates. Officers are counted per surname, each surname a row of its own.
    """
    hosts = (candidate_hosts(companies) if hosts is None else hosts).select("id", "host").distinct()
    site = main_pages(pages).select("host", "url", F.lower("html").alias("_html"), html_text("html").alias("_text"))
    urls = site.select("host", "url")
    surname = F.element_at(F.split(F.trim(F.lower("name")), r"\s+"), -1)
    people = (officers.select(F.col("company_id").alias("id"), surname.alias("needle")).filter(F.length("needle") > 3)
              .groupBy("id", "needle").agg(F.count(F.lit(1)).alias("n")))
    placed = present("address_line_1") & present("postal_code")
    facts = {"number": F.lower(F.regexp_replace("company_number", r"\s", "")), "name": F.lower("name"),
             "postcode": F.when(placed, F.regexp_replace(F.lower("postal_code"), r"\s", "")),
             "street": F.when(placed, F.lower("address_line_1"))}
    told = companies.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("needle")) for k, c in facts.items()])).alias("_f")).select(
        "id", "_f.kind", "_f.needle", F.lit(1).cast("long").alias("n"))
    every = told.unionByName(people.select("id", F.lit("officer").alias("kind"), "needle", "n")).where(F.col("needle").isNotNull())
    asked = hosts.join(urls, "host", "left_semi").join(every, "id")
    hits = asked.join(found_on_sites(asked, site), ["host", "kind", "needle"])
    counted = hits.groupBy("id", "host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"_{k}") for k in (*facts, "officer")])
    base = hosts.join(urls, "host").join(companies.select("id", "name"), "id").join(counted, ["id", "host"], "left").na.fill(0, [f"_{k}" for k in (*facts, "officer")])

    stem = F.split_part("host", F.lit("."), F.lit(1))
    clean = F.regexp_replace(F.lower("name"), "[^a-z0-9]", "")
    has_host = F.coalesce(F.contains(clean, stem) | F.contains(stem, clean), F.lit(False))
    has_number, has_name, has_postcode = (F.col(f"_{k}") > 0 for k in ("number", "name", "postcode"))
    has_address = has_postcode & (F.col("_street") > 0)
    score = (F.when(has_number, 70).otherwise(0) + F.when(has_host, 30).otherwise(0)
             + F.when(has_address, 40).when(has_postcode, 20).otherwise(0)
             + F.least(F.col("_officer") * 15, F.lit(30)) + F.when(has_name, 10).otherwise(0))
    matches = F.array_compact(F.array(
        F.when(has_number, F.lit("company_number")), F.when(has_host, F.lit("domain_match")),
        F.when(has_address, F.lit("full_address")).when(has_postcode, F.lit("postcode")),
        F.when(F.col("_officer") > 0, F.concat(F.col("_officer").cast("string"), F.lit("_officers"))),
        F.when(has_name, F.lit("company_name"))))
    return base.select("id", "host", "url", F.least(score, F.lit(100)).cast("int").alias("confidence"),
                       (score >= 50).alias("valid"), F.array_join(matches, ",").alias("matches"))


def site_match(accounts: DataFrame, pages: DataFrame) -> DataFrame:
    """P-25: how well the main page of an account's site names the company; valid from 30.

    Title 40/20, description 20/10, og:site_name 15, host 25, h1 10, footer 15.  A name without usable
    words gives 50; a site without a page is judged by its host alone, 40 or 10.
    """
    site = main_pages(pages).select(F.col("host").alias("_host"), html_fields("html").alias("_f"))
    clean = F.regexp_replace("company_name", rules.LEGAL_WORDS_IN_TITLES, "")
    clean = F.lower(F.trim(F.regexp_replace(clean, r"[^a-zA-Z0-9\s]", "")))
    rows = (accounts.filter(present("website") & present("company_name"))
            .withColumn("_clean", clean).withColumn("_site", domain("website"))
            .withColumn("_words", F.filter(F.split("_clean", r"\s+"), lambda w: F.length(w) > 2)))
    joined = rows.join(site, F.col("_site") == F.col("_host"), "left")
    total = F.size("_words")

    def text(field: str) -> Column:
        return F.lower(F.coalesce(F.col("_f")[field], F.lit("")))

    def hits(field: str) -> Column:
        return F.size(F.filter("_words", lambda w: F.contains(text(field), w)))

    def some(field: str) -> Column:
        return (text(field) != "") & (hits(field) > 0)

    def half(field: str) -> Column:
        return hits(field) >= F.ceil(total * 0.5)

    squeezed = F.regexp_replace("_site", "[-_.]", "")
    joined_name = F.regexp_replace("_clean", r"\s", "")
    by_host = F.contains(squeezed, joined_name) | F.contains(joined_name, squeezed)
    score = (F.when(half("title"), 40).when(hits("title") > 0, 20).otherwise(0)
             + F.when(half("description"), 20).when(hits("description") > 0, 10).otherwise(0)
             + F.when(some("site_name"), 15).otherwise(0) + F.when(by_host, 25).otherwise(0)
             + F.when(some("h1"), 10).otherwise(0) + F.when(half("footer"), 15).otherwise(0))
    confidence = (F.when(total == 0, 50).when(F.col("_f").isNull(), F.when(by_host, 40).otherwise(10))
                  .otherwise(F.least(score, F.lit(100))))
    return joined.select("account_id", "website", confidence.cast("int").alias("confidence")).withColumn(
        "valid", F.col("confidence") >= 30)


# --- contact record of a site -----------------------------------------------------------------

def page_facts(pages: DataFrame, country: str | None = None) -> DataFrame:
    """Contact facts of every page by itself."""
    fields, social = html_fields("html"), social_links("html")
    phones = extract_phones("html")
    if country:
        phones = F.array_compact(F.transform(phones, lambda p: format_uk_phone(p, F.lit(country))))
    host = domain("url")
    return pages.select(
        "page_id", host.alias("domain"), choose_email(extract_emails("html"), host).alias("email"),
        choose_phone(phones).alias("phone"), social.alias("social"), extract_html_address("html").alias("address"),
        fields["description"].alias("description"), contact_link(links("html")).alias("contact_link"))


def page_contacts(pages: DataFrame, country: str | None = None) -> DataFrame:
    """P-26: one contact record per host, best value over all its pages.

    Every field is a minimum over (rank, page), so a host with very many pages is combined on the map
    side and no list of its pages is ever built.
    """
    facts = page_facts(pages, country).dropna(subset=["domain"])

    def first(value: Column, rank: Column | None = None) -> Column:
        rank = F.lit(0) if rank is None else rank
        return F.min(F.when(value.isNotNull(), F.struct(rank.alias("r"), F.col("page_id"), value.alias("v"))))["v"]

    email = F.col("email")
    kind = F.when(email.rlike(rules.SITE_GENERIC), 1).otherwise(0)
    phone = F.col("phone")
    return facts.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_pages"),
        first(email, kind).alias("email"),
        first(phone, F.when(F.startswith(phone, F.lit("+")), 0).otherwise(1)).alias("phone"),
        *[first(F.col("social")[net]).alias(net) for net in ("linkedin", "twitter", "facebook", "instagram")],
        first(F.col("address")).alias("address"),
        first(industry_hint("description")).alias("industry"),
        first(F.col("contact_link")).alias("contact_link"))


def apply_page_contacts(accounts: DataFrame, records: DataFrame, as_of: str) -> DataFrame:
    """P-44: found values replace the account's ones when they are not empty."""
    sites = accounts.select("account_id", domain("website").alias("domain"))
    found = records.select(
        "domain", F.col("phone").alias("phone_number"), "address", F.col("linkedin").alias("linkedin_url"),
        F.col("twitter").alias("twitter_url"), F.col("facebook").alias("facebook_url"),
        F.col("instagram").alias("instagram_url"))
    names = [c for c in found.columns if c in accounts.columns]
    anything = F.lit(False)
    for c in names:
        anything = anything | present(c)
    delta = sites.join(found, "domain").filter(anything).select("account_id", *names)
    stamp = {"updated_at": F.lit(as_of).cast("timestamp_ntz")} if "updated_at" in accounts.columns else None
    return merge_rows(accounts, delta, ["account_id"], prefer_filled=names, stamp=stamp, insert=False)


# --- people -----------------------------------------------------------------------------------

def people_from_pages(pages: DataFrame, first_names: DataFrame, not_names: DataFrame | None = None,
                      per_site: int | None = None) -> DataFrame:
    """P-27: person names on pages with the job title (the first that follows) and e-mail within 200 characters.

    A person is listed once per host (first page, first position).  `per_site` keeps the first few
    people of a host on request.
    """
    read = compute_once(pages.select("page_id", "url", "html"), domain=domain("url"), _text=visible_text("html"))
    # each name with the text after its own place: pieces, not pages, are exploded and shuffled
    followed = F.lit(rules.NAME_PAIR + r"(?=([\s\S]{0,200}))")
    listed = compute_once(read, _names=F.arrays_zip(F.regexp_extract_all("_text", followed, F.lit(0)).alias("name"), F.regexp_extract_all("_text", followed, F.lit(3)).alias("after")))
    named = listed.select("page_id", "domain", F.posexplode("_names").alias("_i", "_n")).select(
        "page_id", "domain", "_i", F.col("_n.name").alias("_name"), F.left(F.concat("_n.name", "_n.after"), F.lit(200)).alias("_after"))
    people = compute_once(
        named, first_name=F.regexp_extract("_name", rules.NAME_PAIR, 1), last_name=F.regexp_extract("_name", rules.NAME_PAIR, 2))
    known = valid_person(people, first_names, not_names).filter("person_ok").drop("person_ok")
    title_word = F.regexp_extract(F.lower("_after"), r"\b(" + "|".join(sorted(rules.PAGE_TITLES, key=len, reverse=True)) + r")\b", 0)
    emails = F.regexp_extract_all("_after", F.lit(rules.EMAIL_ON_SITE), F.lit(0))
    personal = F.filter(emails, lambda e: ~F.lower(F.split_part(F.split_part(e, F.lit("@"), F.lit(1)), F.lit("."), F.lit(1)))
                        .isin(*rules.SITE_ROLE_MAILBOXES))
    described = compute_once(known, job_title=F.initcap(F.trim(title_word)), email=F.lower(F.get(personal, F.lit(0)))).select(
        "domain", "page_id", "_i", "first_name", "last_name", F.when(valid_title("job_title"), F.col("job_title")).alias("job_title"), "email")
    once = keep_first(described, ["domain", F.lower("first_name"), F.lower("last_name")], [F.asc("page_id"), F.asc("_i")])
    if per_site is not None:
        once = first_n(once, ["domain"], per_site, [F.asc("page_id"), F.asc("_i")])
    return once.drop("_i")


def people_from_text(df: DataFrame, text: str, key: str, first_names: DataFrame,
                     not_names: DataFrame | None = None, fallback_title: str | None = None) -> DataFrame:
    """P-28: people and titles in text snippets with a confidence.

    "Name - Title at Co" 0.9, "Name, Title" 0.85, a title within 120 characters of a mention of the name 0.7 (the
    first in the declared order; every name near it has it; of several mentions the first with a title), and for
    keys without any of these the bare names with `fallback_title` 0.4.  Each person counts once per key,
    with the most certain reading.
    """
    def pairs(pattern: str, confidence: float) -> Column:
        both = F.arrays_zip(F.regexp_extract_all("_text", F.lit(pattern), F.lit(1)).alias("n"),
                            F.regexp_extract_all("_text", F.lit(pattern), F.lit(2)).alias("t"))
        return F.transform(both, lambda p, i: F.struct(i.alias("pos"), F.split(F.trim(p["n"]), r"\s+").alias("_words"), F.trim(p["t"]).alias("_title"),
                                                       F.lit(None).cast("string").alias("_around"), F.lit(confidence).alias("confidence")))

    # every mention of a name with the text around it, not only the first one; a text is read once
    mentions = F.transform(occurrences(F.col("_text"), rules.NAME_PAIR, 120, 120, least=5), lambda o, i: F.struct(
        i.alias("pos"), F.split(o["found"], r"\s+").alias("_words"), F.lit("").alias("_title"),
        F.lower(F.concat(o["before"], o["found"], o["after"])).alias("_around"), F.lit(0.7).alias("confidence")))
    found = F.concat(pairs(rules.NAME_DASH_TITLE, 0.9), pairs(rules.NAME_COMMA_TITLE, 0.85), mentions)
    spark = df.sparkSession  # a file of few splits holds many texts: they are dealt over all tasks
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    raw = df.select(key, F.col(text).alias("_text")).repartition(tasks).select(key, F.explode(found).alias("_p")).select(key, "_p.*").filter(F.size("_words") >= 2)
    # of several titles near a name the one declared first counts, wherever it stands
    around = F.col("_around")
    first_title = F.coalesce(*[F.when(may_match(around, p) & around.rlike(p), F.regexp_extract(around, f"(?:{p})", 0)) for p, _, _ in rules.MANAGEMENT_TITLES], F.lit(""))
    titled = compute_once(raw, _said=F.when(around.isNull(), F.col("_title")).otherwise(first_title))
    titled = compute_once(titled, _canonical=canonical_title("_said"))
    readings = [F.struct(F.col("_canonical.title").alias("job_title"), "confidence")]
    if fallback_title:
        readings.append(F.when(around.isNotNull(), F.struct(F.lit(fallback_title).alias("job_title"), F.lit(0.4).alias("confidence"))))
    people = titled.select(key, "pos", F.get("_words", F.lit(0)).alias("first_name"), F.element_at("_words", -1).alias("last_name"),
                           F.explode(F.array(*readings)).alias("_r")).select(key, "pos", "first_name", "last_name", "_r.job_title", "_r.confidence")
    shaped = people.filter(F.col("job_title").isNotNull() & person_shape_ok("first_name", "last_name"))
    # the test of a name sees lower case only, so it may follow the choice among equal names
    single = keep_first(shaped, [key, F.lower("first_name"), F.lower("last_name")],
                        [F.desc("confidence"), F.asc("pos"), F.asc("job_title")]).drop("pos")
    once = valid_person(single, first_names, not_names).filter("person_ok").drop("person_ok")
    if not fallback_title:
        return once
    once = cut_lineage(once)
    certain = once.filter(F.col("confidence") > 0.4)
    return certain.unionByName(once.filter(F.col("confidence") == 0.4).join(
        certain.select(key).distinct(), key, "left_anti"))


# --- phones of people -------------------------------------------------------------------------

def phones_by_name(pages: DataFrame) -> DataFrame:
    """(domain, name) -> first UK number printed near that name, for single words and word pairs.

    Starts from the numbers, at every place where one is printed: a name qualifies when it begins at most 200 characters
    after the start of the number and at most 300 before its end.  Linear in the text around numbers. Pages count in
    their order; on a page the shapes of numbers in the declared order, then their places.
    """
    read = compute_once(pages.select("page_id", "url", "html"), domain=domain("url"), _text=visible_text("html"))

    def places(rank: int, pattern: str) -> Column:
        return F.transform(occurrences("_text", pattern, 300, 200, least=10), lambda o, k: F.struct(
            F.lit(rank).alias("_shape"), k.alias("_k"), o["found"].alias("_raw"), F.concat(
                F.right(F.concat(o["before"], o["found"]), F.lit(300)),
                F.left(o["after"], F.greatest(F.lit(200) - F.length(o["found"]), F.lit(0)))).alias("_around")))

    listed = [places(rank, p) for rank, p in enumerate(rules.UK_PHONES_NEAR_NAME)]
    rows = compute_once(read, _numbers=F.concat(*listed)).select("page_id", "domain", F.explode("_numbers").alias("_p")).select("page_id", "domain", "_p.*")
    digits = F.regexp_replace(F.regexp_replace("_raw", r"[\s.-]", ""), r"^\+?44", "0")
    placed = compute_once(rows, phone=digits).filter(F.col("phone").rlike(r"^0[1-9]\d{8,10}$"))
    around = F.col("_around")
    words = F.filter(F.split(F.lower(around), r"[^a-z'-]+"), lambda w: F.length(w) > 1)
    spaced = compute_once(placed, _w=words)
    couples = F.zip_with("_w", F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0))),
                         lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    names = F.array_distinct(F.array_compact(F.concat("_w", couples)))
    return (spaced.select("domain", "page_id", "_shape", "_k", "phone", F.explode(names).alias("name"))
            .groupBy("domain", "name").agg(F.min(F.struct("page_id", "_shape", "_k", "phone"))["phone"].alias("phone")))


def fill_phones(contacts: DataFrame, accounts: DataFrame, pages: DataFrame) -> DataFrame:
    """P-42: a number for contacts without one, found near the full name, else near the first name."""
    sites = accounts.select(F.col("account_id").alias("linked_account_id"), domain("website").alias("domain"))
    todo = contacts.filter(missing("phone_number") & present("first_name")).join(sites, "linked_account_id")
    index = phones_by_name(pages)
    full = F.lower(F.trim(F.concat_ws(" ", "first_name", "last_name")))
    keyed = todo.withColumn("_full", full).withColumn("_first", F.lower("first_name"))
    out = (keyed.join(index.select("domain", F.col("name").alias("_full"), F.col("phone").alias("_p1")), ["domain", "_full"], "left")
           .join(index.select("domain", F.col("name").alias("_first"), F.col("phone").alias("_p2")), ["domain", "_first"], "left"))
    out = out.withColumn("phone_number", F.coalesce("_p1", "_p2")).filter(F.col("phone_number").isNotNull())
    return out.select(*contacts.columns)


"""Address scans, containment and proximity on odd texts, against plain versions."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from bizdata.functions import email, nearby, rules
from bizdata.operators import emails, joins, pages, queue

AS_OF = "2024-03-01 12:00:00"


@pytest.mark.parametrize("pattern", [rules.EMAIL_IN_TEXT, rules.EMAIL_ON_SITE])
def test_guarded_scan_equals_the_plain_pattern(spark, pattern):
    rng = random.Random(1)
    texts = ["", "@", "a@b", "a@b.c", "a@b.com1x@y.org", "x@y@z.com", "a@b.com.", "a..b@c..de", "1@a.bcd@e.fgh", "q@a.b-c.de%f@g.hi", "é@a.com", "aé.b@c.dez"]
    texts += ["".join(rng.choice("abababab1._-%+@@. é") for _ in range(rng.randrange(60))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", email.addresses("t", pattern).alias("fast"), F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("plain")).collect()
    assert all(r["fast"] == r["plain"] for r in rows) and sum(bool(r["plain"]) for r in rows) > 100


@pytest.mark.parametrize("text", ["a" * 1_000_000, "a." * 500_000, "a@" * 500_000, "x@" + "b" * 1_000_000, ("a" * 999 + " ") * 1000])
def test_scan_is_linear(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(email.extract_emails("t").alias("e"), email.site_emails("t").alias("s"))
    df.collect()
    start = time.time()
    df.collect()
    assert time.time() - start < 2


def test_first_containing_equals_brute_force(spark):
    rng = random.Random(4)
    label = lambda: "".join(rng.choice("ab1-") for _ in range(rng.choice([1, 2, 3, 6])))
    sites = [(i, rng.choice([None, "", f"https://{label()}.{label()}.test/{label()}", f"{label()}.test", f"{label()}.co.uk?x={label()}.test", "..", label()])) for i in range(300)]
    needles = [None, "", ".", "a.", ".test", "x" * 300, *{f"{label()}.test" for _ in range(60)}, *{f"{label()}.{label()}.test" for _ in range(60)}, *{label() for _ in range(30)}, "co.uk"]
    stored = spark.createDataFrame(sites, "account_id long, website string")
    wanted = spark.createDataFrame([(n,) for n in needles], "n string")
    got = {r["n"]: r["hit"] for r in joins.first_containing(stored, F.col("website"), "account_id", wanted, "n").collect()}
    want = {n: min((i for i, s in sites if s and n in s), default=None) for n in needles if n and len(n) <= 253}
    assert got == {n: i for n, i in want.items() if i is not None} and len(got) > 20


def test_site_contains_the_host(spark):
    old = spark.createDataFrame([(5, "A", "https://Shop.ACME.test/home"), (6, "B", "acme.test"), (7, None, None)], "account_id long, company_name string, website string")
    new = spark.createDataFrame([(1, "x", "http://www.acme.test/"), (2, "b", None), (3, "x", "cme.test"), (4, "x", "other.test")], "new_id long, company_name string, website string")
    got = {r["new_id"]: (r["name_match"], r["site_match"]) for r in joins.possible_duplicates(new, old).collect()}
    assert got == {1: (None, 5), 2: (6, None), 3: (None, 5)}


def test_every_start_of_a_batch_is_an_attempt(spark):
    q = spark.createDataFrame([(i, "pending", 0, 3) for i in range(1, 6)], "queue_id long, status string, attempts int, max_attempts int")
    for c in ("started_at", "completed_at", "scheduled_for", "updated_at"):
        q = q.withColumn(c, F.lit(None).cast("timestamp_ntz"))
    q = q.withColumn("error_message", F.lit(None).cast("string"))
    rows = [(1, 1, "started", None), (1, 2, "failed", "e"), (2, 1, "started", None), (2, 2, "failed", "a"), (2, 3, "started", None), (2, 4, "failed", "b"), (2, 5, "started", None), (2, 6, "failed", None),
            (3, 1, "started", None), (3, 1, "started", None), (4, 1, "started", None), (4, 2, "completed", None), (None, 9, "started", None)]
    r = spark.createDataFrame(rows, "queue_id long, event_id long, result string, error string")
    got = {x.queue_id: (x.status, x.attempts, x.error_message) for x in queue.apply_results(q, r, AS_OF).collect()}
    assert got == {1: ("pending", 1, "e"), 2: ("failed", 3, "b"), 3: ("processing", 1, None), 4: ("completed", 1, None), 5: ("pending", 0, None)}




@pytest.mark.parametrize(("pattern", "before", "after", "least"), [(r"\d{3}", 7, 5, 3), (r"[a-z]{2,4}", 12, 0, 2), (r"ab+", 3, 40, 2)])
def test_occurrences_equal_brute_force(spark, pattern, before, after, least):
    rng = random.Random(5)
    texts = ["", "abc", "123", "😀123😀456", "é" * 50 + "abb" + "é" * 90, *("".join(rng.choice("ab1 2é") for _ in range(rng.randrange(120))) for _ in range(300))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", nearby.occurrences("t", pattern, before, after, least).alias("o"))
    for r in df.collect():
        want = [(m[0], r["t"][max(0, m.start() - before):m.start()], r["t"][m.end():m.end() + after]) for m in re.finditer(pattern, r["t"])]
        assert [tuple(o) for o in r["o"]] == want


def test_many_occurrences_take_linear_time(spark):
    df = spark.createDataFrame([("Ab Cd " * 60_000,)], "t string").select(F.size(nearby.occurrences("t", rules.NAME_PAIR, 120, 120, 5)).alias("n"))
    df.collect()
    start = time.time()
    assert df.first()["n"] == 60_000 and time.time() - start < 10


def page(spark, *htmls):
    return spark.createDataFrame([(i, "http://acme.test/", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_later_mentions_count(spark):
    gap = "nothing here " * 40
    names = spark.createDataFrame([("john",)], "word string")
    said = spark.createDataFrame([(1, f"John Smith. {gap} the managing director John Smith")], "k long, t string")
    assert [(r.last_name, r.confidence) for r in pages.people_from_text(said, "t", "k", names).collect()] == [("Smith", 0.7)]
    index = {r["name"]: r["phone"] for r in pages.phones_by_name(page(spark, f"020 7946 0123 {gap} John Smith, 020 7946 0123, {gap} Ann Lee")).collect()}
    assert index["john smith"] == "02079460123" and "ann lee" not in index


def test_nearest_name_of_an_address(spark):
    gap = "nothing here " * 20
    html = (f"ann.lee@acme.test {gap} Mr John Smith and ann.lee@acme.test (Ann Lee) {gap}"
            '<a href="mailto:jd@acme.test"><b>Jane</b> Doe</a> <a class="x" href=\'mailto:zz@acme.test?subject=a\'>write</a> Ben Good to bg@acme.test')
    got = {r["email"]: (r["first_name"], r["last_name"]) for r in emails.page_emails(page(spark, html)).collect()}
    assert got == {"ann.lee@acme.test": ("Ann", "Lee"), "jd@acme.test": ("Jane", "Doe"), "zz@acme.test": (None, None), "bg@acme.test": ("Ben", "Good")}


def test_address_of_a_contact(spark):
    """A local part with the name, else a mail link near any mention of the full name, else the pattern."""
    gap = "nothing here " * 60
    html = f"Kim Oak {gap} <p>Kim Oak <a href='mailto:ko.desk@other.test?x=1'>mail</a></p> {gap} annabel.lee@acme.test <a href='mailto:info@acme.test'>x</a> Lou Elm"
    contacts = spark.createDataFrame([(1, 7, "Kim", "Oak"), (2, 7, "Anna", "Fox"), (3, 7, "Bo", "Lee"), (4, 7, "Lou", "Elm"), (5, None, "Ann", None), (6, 7, "Bo", "")],
                                     "contact_id long, linked_account_id long, first_name string, last_name string").withColumn("email", F.lit(None).cast("string"))
    accounts = spark.createDataFrame([(7, "www.acme.test", "{first}.{last}@acme.test")], "account_id long, website string, email_format string")
    got = {r["contact_id"]: (r["email"], r["email_source"]) for r in emails.fill_emails(contacts, accounts, page(spark, html)).collect()}
    assert got == {1: ("ko.desk@other.test", "page"), 2: ("annabel.lee@acme.test", "page"), 3: ("annabel.lee@acme.test", "page"),
                   4: ("lou.elm@acme.test", "pattern"), 5: (None, None), 6: ("bo.unknown@acme.test", "pattern")}


def test_fixed_words_stand_for_title_patterns(spark):
    import re

    from bizdata.functions import rules
    from bizdata.functions.names import may_match

    texts = ["our co-founder", "cofounder", "non executive director", "nonexecutive director", "svp", "xceox", "head of sales & more", "", "chief  executive officer", "vp of it", None]
    texts += [re.sub(r"\?", "", p.replace(r"\b", "").split("|")[0]) for p, _, _ in rules.MANAGEMENT_TITLES]
    texts += [re.sub(r".\?", "", p.replace(r"\b", "").split("|")[-1]) for p, _, _ in rules.MANAGEMENT_TITLES]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    wrong = [p for p, _, _ in rules.MANAGEMENT_TITLES if df.filter(F.col("t").rlike(p) & ~may_match(F.col("t"), p)).count()]
    assert not wrong
    odd = [r"\bce[o0]\b", r"\bceos?\b", r"(chair|head)"]
    assert all("true" in str(may_match(F.col("t"), p)) for p in odd)


def test_people_are_read_once_from_few_splits(spark):
    from bizdata.operators import pages

    snippets = spark.createDataFrame([(i, "Meet Mary Jones, Head of Sales") for i in range(40)] + [(None, "James Smith rang")] * 2, "contact_id long, text string").coalesce(1)
    names = spark.createDataFrame([("mary",), ("james",)], "word string")
    found = pages.people_from_text(snippets, "text", "contact_id", names, None)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode(concat(") == 1 and "RoundRobinPartitioning" in plan
    assert {(r.first_name, r.job_title, r.confidence) for r in found.collect()} == {("Mary", "Head of Sales", 0.85)} and found.count() == 40
    everyone = pages.people_from_text(snippets, "text", "contact_id", names, None, "Director").collect()
    assert len(everyone) == 41 and [tuple(r)[1:] for r in everyone if r.contact_id is None] == [("James", "Smith", "Director", 0.4)]

"""Properties and small worked cases of table operators."""

import random

import pytest
from pyspark.sql import functions as F

from bizdata.operators import classify, dedup, joins, keys, metrics, pages, quality, queue, search, upsert
from bizdata.sinks import export
from bizdata.sources import registry, tables

AS_OF = "2024-03-01 12:00:00"
COMPANY = ("id long, company_number string, name string, address_line_1 string, locality string, website string, email string, phone string, "
           "linkedin_url string, region string, postal_code string, status string, enrichment_status string, last_enriched timestamp_ntz, notes string")


def companies(spark, rows):
    names = [f.split()[0] for f in COMPANY.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], COMPANY)


def test_star_pairs_hold_the_same_components_as_all_pairs(spark):
    random.seed(1)
    rows = [{"id": i, "company_number": f"n{random.randrange(40)}", "website": f"w{random.randrange(30)}", "name": f"Name {random.randrange(5)}",
             "locality": f"t{random.randrange(9)}"} for i in range(120)]
    df = companies(spark, rows)
    pairs = dedup.find_duplicates(df, 0.0).collect()
    assert all(p.id1 < p.id2 for p in pairs)
    assert len({(p.id1, p.id2) for p in pairs}) == len(pairs)

    parent = {r["id"]: r["id"] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in rows:
        for b in rows:
            same = (a["website"] == b["website"] or (a["name"], a["locality"]) == (b["name"], b["locality"])
                    or a["company_number"] == b["company_number"] and len(a["company_number"]) > 3)
            if a["id"] < b["id"] and same:
                x, y = root(a["id"]), root(b["id"])
                parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in dedup.connected_components(dedup.find_duplicates(df, 0.0)).collect()}
    want = {i: root(i) for i in parent if sum(root(j) == root(i) for j in parent) > 1}
    assert got == want


def test_components_of_a_long_chain(spark):
    chain = spark.range(60).select(F.col("id").alias("id1"), (F.col("id") + 1).alias("id2"))
    got = dedup.connected_components(chain)
    assert got.select("component").distinct().collect() == [(0,)]
    assert got.count() == 61


def test_auto_merge_keeps_every_row(spark):
    df = companies(spark, [
        {"id": 1, "company_number": "AB-1234", "name": "A", "website": "w"}, {"id": 2, "company_number": "x9991", "name": "B", "website": "w", "phone": "1"},
        {"id": 3, "company_number": "ab 1234", "name": "C", "email": "c@x", "phone": "2"}, {"id": 4, "company_number": "zz", "name": "D"}])
    out, log = dedup.auto_merge(df, AS_OF)
    rows = {r.id: r for r in out.collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    assert (rows[1].phone, rows[1].email, rows[1].status) == ("1", "c@x", None)
    assert rows[2].status == rows[3].status == "merged" and rows[4].status is None
    assert log.count() == 2


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("1", "a", "w1", None), ("2", "b", None, None)], "company_number string, name string, website string, last_updated timestamp_ntz")
    delta = spark.createDataFrame([("1", "x", None, 1), ("1", "y", None, 2), ("3", "c", "w3", 3)], "company_number string, name string, website string, seq int")
    once = upsert.upsert_companies(old, delta, AS_OF, "seq")
    twice = upsert.upsert_companies(once, delta, AS_OF, "seq")
    assert sorted(once.collect()) == sorted(twice.collect())
    rows = {r.company_number: (r.name, r.website) for r in once.collect()}
    assert rows == {"1": ("y", "w1"), "2": ("b", None), "3": ("c", "w3")}


@pytest.mark.parametrize("parts", [1, 4])
def test_nest_deals_every_parent_alike(spark, parts):
    parent = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    child = spark.createDataFrame([(1, "t", str(i)) for i in range(50)] + [(2, "t", "x"), (None, "t", "y")], "company_id long, contact_type string, value string")
    sizes = {}
    for r in joins.nest_contacts(parent, child, parts=parts).collect():
        sizes.setdefault(r.id, []).append(len(r.contacts))
    assert sum(sizes[1]) == 50 and len(sizes[1]) == parts
    assert sizes[2] == [1] and sizes[3] == [0]


def test_first_n_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    out = keys.first_n(df, ["k"], 5, [F.asc("id")])
    assert out.count() == 15
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_count_distinct_counts_places_with_null_parts(spark):
    rows = [("a", "x"), ("a", None), (None, None), ("a", "x")]
    df = spark.createDataFrame([(*r, None, None, None, None, None) for r in rows],
                               "city string, state_region string, website string, email_format string, phone_number string, industry string, created_at timestamp_ntz")
    got = metrics.summary(df, AS_OF).first()
    assert (got.total, got.locations, got.enrichment_rate) == (4, 3, 0)


def test_clean_and_rejected_make_up_the_input(spark):
    rows = [(1, "Good Firm", "X"), (2, "good firm ", "x"), (3, "how to", "x"), (4, None, None), (5, "Good Firm", None)]
    accounts = spark.createDataFrame(rows, "account_id long, company_name string, city string")
    contacts = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, 9)], "contact_id long, linked_account_id long")
    parts = quality.clean_accounts(accounts, contacts)
    assert sorted(r.account_id for r in parts["accounts"].collect()) == [1, 5]
    assert {r.account_id: r.reason for r in parts["rejected"].collect()} == {2: "duplicate", 3: "spam_phrase", 4: "too_short"}
    assert sorted(r.contact_id for r in parts["contacts"].collect()) == [1, 3]
    assert sorted(r.contact_id for r in parts["orphans"].collect()) == [2, 4]


def test_naics_first_declared_category_wins(spark):
    df = spark.createDataFrame([("62011 - x",), ("5821",), ("4719",), ("47",), ("text",), (None,)], "industry string")
    table = {"Software": ["6201"], "Games": ["5821", "6201"], "Trade": ["471"], "Retail": ["4719"]}
    got = [r.category for r in classify.naics_category(df, "industry", table).collect()]
    assert got == ["Software", "Games", "Trade", "47", "text", None]


def test_site_scores_stay_in_range(spark):
    accounts = spark.createDataFrame([(1, "Acme Widgets Ltd", "https://acmewidgets.test"), (2, "Acme Widgets", "none.test"), (3, "AB", "ab.test")],
                                     "account_id long, company_name string, website string")
    html = "<title>Acme Widgets</title><h1>Acme</h1><footer>Acme Widgets Ltd</footer>"
    site = spark.createDataFrame([(1, "https://www.acmewidgets.test/", html)], "page_id long, url string, html string")
    got = {r.account_id: (r.confidence, r.valid) for r in pages.site_match(accounts, site).collect()}
    assert got == {1: (90, True), 2: (10, False), 3: (50, True)}


def test_site_evidence(spark):
    co = spark.createDataFrame([(1, "SC123", "Acme Ltd", "1 Mill Lane", "AB1 2CD", "England")],
                               "id long, company_number string, name string, address_line_1 string, postal_code string, country string")
    officers = spark.createDataFrame([(1, "John Smith"), (1, "Ann Lee")], "company_id long, name string")
    html = "<p>Acme Ltd SC123, 1 Mill Lane, ab12cd. John Smith</p>"
    site = spark.createDataFrame([(1, "http://acme.co.uk/", html)], "page_id long, url string, html string")
    got = pages.site_evidence(co, officers, site).first()
    assert (got.confidence, got.valid) == (100, True)
    assert got.matches == "company_number,domain_match,full_address,1_officers,company_name"


def test_people_and_their_phones(spark):
    names = spark.createDataFrame([("ann",), ("john",)], "word string")
    text = "<p>Meet: Ann Lee, Managing Director, ann.lee@acme.test, tel 020 7946 0001. Click Here now.</p>"
    site = spark.createDataFrame([(1, "http://acme.test/team", text), (2, "http://acme.test/", text)], "page_id long, url string, html string")
    got = pages.people_from_pages(site, names).collect()
    assert [(r.first_name, r.last_name, r.job_title, r.email, r.page_id) for r in got] == [("Ann", "Lee", "Managing Director", "ann.lee@acme.test", 1)]
    accounts = spark.createDataFrame([(7, "acme.test")], "account_id long, website string")
    contacts = spark.createDataFrame([(1, 7, "Ann", "Lee", None), (2, 7, "Zed", "Lee", None), (3, 7, "Ann", "Lee", "1")],
                                     "contact_id long, linked_account_id long, first_name string, last_name string, phone_number string")
    assert [(r.contact_id, r.phone_number) for r in pages.fill_phones(contacts, accounts, site).collect()] == [(1, "02079460001")]


def test_people_from_text(spark):
    names = spark.createDataFrame([("ann",), ("john",), ("mary",)], "word string")
    df = spark.createDataFrame([(1, "Ann Lee - CEO at Acme | LinkedIn"), (2, "John Doe, Finance Director"), (3, "our director is Mary Poe today"), (4, "please ring Ann Lee")],
                               "k int, t string")
    got = {r.k: (r.first_name, r.last_name, r.job_title, r.confidence) for r in pages.people_from_text(df, "t", "k", names, fallback_title="Owner").collect()}
    assert got == {1: ("Ann", "Lee", "CEO", 0.9), 2: ("John", "Doe", "Finance Director", 0.85), 3: ("Mary", "Poe", "Director", 0.7), 4: ("Ann", "Lee", "Owner", 0.4)}


def test_filled_emails_against_brute_force(spark):
    from bizdata.operators import emails

    random.seed(3)
    firsts, lasts = ["ann", "john", "mary", "bo"], ["lee", "smith", "poe", "annan"]
    html = {h: [f"{random.choice(firsts)}.{random.choice(lasts)}@{h}" for _ in range(4)] for h in ("a.test", "b.test")}
    site = spark.createDataFrame([(i, f"http://{h}/", " ".join(m)) for i, (h, m) in enumerate(html.items())], "page_id long, url string, html string")
    accounts = spark.createDataFrame([(1, "a.test", "{f}.{last}"), (2, "b.test", None)], "account_id long, website string, email_format string")
    people = [(i, 1 + i % 2, random.choice(firsts).title(), random.choice(lasts).title(), None) for i in range(30)]
    contacts = spark.createDataFrame(people, "contact_id long, linked_account_id long, first_name string, last_name string, email string")
    got = {r.contact_id: (r.email, r.email_generated) for r in emails.fill_emails(contacts, accounts, site).collect()}
    for cid, acc, first, last, _ in people:
        listed = list(dict.fromkeys(html["a.test" if acc == 1 else "b.test"]))
        hit = next((m for m in listed if first.lower() in m.split("@")[0] or last.lower() in m.split("@")[0]), None)
        made = f"{first[0].lower()}.{last.lower()}@a.test" if acc == 1 and hit is None else None
        assert got[cid][0] == (hit or made), (first, last, listed)


def test_mined_pattern(spark):
    from bizdata.operators import emails

    site = spark.createDataFrame([(1, "http://a.test/", "Ann Lee alee@a.test, John Doe jdoe@a.test, info@a.test, Mary Poe mary.poe@a.test")],
                                 "page_id long, url string, html string")
    accounts = spark.createDataFrame([(1, "a.test", None), (2, "a.test", "{first}@a.test"), (3, "b.test", None)],
                                     "account_id long, website string, email_format string")
    got = [(r.account_id, r.email_format, r.n_addresses) for r in emails.mine_patterns(accounts, site).collect()]
    assert got == [(1, "{f}{last}@a.test", 2)]


def test_page_contacts_prefers_people_and_country_codes(spark):
    site = spark.createDataFrame([(1, "http://a.test/", "info@a.test 212-555-1000"), (2, "http://a.test/team", "ann.lee@a.test +1 212-555-2000")],
                                 "page_id long, url string, html string")
    got = pages.page_contacts(site).first()
    assert (got.domain, got.n_pages, got.email, got.phone) == ("a.test", 2, "ann.lee@a.test", "+1 212-555-2000")


def test_queue_transitions(spark):
    q = spark.createDataFrame([(1, "processing", 1, 3), (2, "processing", 3, 3), (3, "pending", 0, 3)], "queue_id long, status string, attempts int, max_attempts int")
    for c in ("started_at", "completed_at", "scheduled_for", "updated_at"):
        q = q.withColumn(c, F.lit(None).cast("timestamp_ntz"))
    q = q.withColumn("error_message", F.lit(None).cast("string"))
    r = spark.createDataFrame([(1, "failed", "e"), (2, "failed", "e"), (3, "started", None)], "queue_id long, result string, error string")
    got = {x.queue_id: (x.status, x.attempts) for x in queue.apply_results(q, r, AS_OF).collect()}
    assert got == {1: ("pending", 1), 2: ("failed", 3), 3: ("processing", 1)}


def test_order_column_must_be_permitted(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a")], "account_id long, company_name string").withColumn("created_at", F.col("account_id"))
    assert [r.account_id for r in search.ordered(df, search.ACCOUNT_ORDERS, "company_name", "ASC", "account_id").collect()] == [2, 1]
    assert [r.account_id for r in search.ordered(df, search.ACCOUNT_ORDERS, "1; drop", "ASC", "account_id").collect()] == [1, 2]


def test_registry_file(spark, tmp_path):
    (tmp_path / "f.csv").write_text(
        ' CompanyNumber,CompanyName,CompanyCategory,CompanyStatus,IncorporationDate,RegAddress.Country,SICCode.SicText_1\n'
        '00012,"Acme, Ltd",Private,Active,31/12/2001,,62012 - Software\n13,Other Ltd,Private,Dissolved,,France,\n')
    got = {r.company_number: r for r in registry.read_registry_csv(spark, str(tmp_path)).collect()}
    assert got["00012"].name == "Acme, Ltd" and str(got["00012"].incorporation_date) == "2001-12-31"
    assert (got["00012"].country, got["00012"].industry, got["13"].industry) == ("United Kingdom", "Technology", "Other")
    assert [r.company_number for r in registry.read_registry_csv(spark, str(tmp_path), active_only=True).collect()] == ["00012"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'He said "hi"\nthere, ok ', None)], "a int, b string, c string").coalesce(1)
    export.write_csv(df, str(tmp_path / "o"))
    text = next((tmp_path / "o").glob("part-*.csv")).read_bytes().decode()
    assert text == 'a,b,c\r\n1,"He said ""hi"" there, ok",\r\n'


def test_load_uses_the_declared_schema(spark, tmp_path):
    spark.createDataFrame([(5, "x")], "account_id long, company_name string").write.parquet(str(tmp_path / "a"))
    got = tables.load(spark, "accounts", str(tmp_path / "a"))
    assert got.first().company_name == "x" and got.first().city is None


def test_import_metrics_are_observed(spark):
    from pyspark.sql import Observation

    df = spark.createDataFrame([("1", "Active"), ("", "Active"), ("2", "Closed")], "number string, status string")
    seen = Observation("run")
    df.observe(seen, F.count(F.lit(1)).alias("total")).collect()
    assert seen.get["total"] == 3
    assert metrics.with_metrics(df, "m", F.col("status") == "Active", F.col("number") == "").count() == 3


def test_a_page_is_as_long_as_asked_for(spark):
    rows = spark.range(6000)
    assert search.page(rows.orderBy("id"), 5000).count() == 5000
    assert [r["id"] for r in search.page_after(rows, "id", 41, 3).collect()] == [42, 43, 44]
    for limit, offset in ((0, 0), (5, -1)):
        with pytest.raises(ValueError):
            search.page(rows, limit, offset)

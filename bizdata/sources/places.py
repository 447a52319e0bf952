"""Places, businesses and leads (S-06 … S-10)."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.company import place_priority, split_location
from ..functions.names import clean_name
from ..functions.presence import blank_to_null, present


def _tag(name: str) -> Column:
    return blank_to_null(F.try_element_at("tags", F.lit(name)))


def places_to_queue(df: DataFrame, country: str, country_code: str) -> DataFrame:
    """S-06: named place nodes (id, lat, lon, tags) as pending queue rows."""
    digits = F.regexp_extract(_tag("population"), r"^\s*(\d+)", 1)
    population = F.coalesce(digits.try_cast("bigint"), F.lit(0))
    region = F.coalesce(_tag("addr:state"), _tag("is_in:state"), _tag("addr:county"), _tag("is_in:county"),
                        _tag("addr:region"), F.lit(country))
    return df.filter(_tag("name").isNotNull()).select(
        F.col("id").alias("queue_id"), F.lit(country).alias("country"), F.lit(country_code).alias("country_code"),
        region.alias("state_region"), F.lit(None).cast("string").alias("state_code"), _tag("name").alias("city"),
        F.coalesce(_tag("place"), F.lit("locality")).alias("place_type"), population.alias("population"),
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
        place_priority(_tag("place"), population).alias("priority"), F.lit("pending").alias("status"))


def osm_to_accounts(df: DataFrame, country: str, region: str, city: str, source: str = "OpenStreetMap") -> DataFrame:
    """S-07: business nodes as account rows."""
    address = blank_to_null(F.concat_ws(", ", _tag("addr:housenumber"), _tag("addr:street"), _tag("addr:postcode")))
    return df.select(
        F.col("id").alias("node_id"), _tag("name").alias("company_name"), address.alias("address"),
        F.coalesce(_tag("website"), _tag("contact:website")).alias("website"),
        F.coalesce(_tag("phone"), _tag("contact:phone")).alias("phone_number"),
        F.coalesce(_tag("addr:city"), F.lit(city)).alias("city"), F.lit(region).alias("state_region"),
        F.lit(country).alias("country"),
        F.coalesce(_tag("amenity"), _tag("shop"), _tag("office"), F.lit("Business")).alias("industry"),
        F.lit(source).alias("data_source"))


LOCATION_TREE = """
    countries array<struct<code string, name string,
        states array<struct<code string, name string,
            cities array<struct<name string, districts array<string>>>>>>>
"""


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """S-08: the nested country -> state -> city -> district file as flat rows."""
    return flatten_locations(spark.read.schema(LOCATION_TREE).json(path, multiLine=True))


def flatten_locations(tree: DataFrame) -> DataFrame:
    """Rows of (country, state, city, district); a level without children gives one row with NULLs."""
    c = tree.select(F.explode("countries").alias("c"))
    s = c.select("c.code", "c.name", F.explode_outer("c.states").alias("s"))
    t = s.select(F.col("code").alias("country_code"), F.col("name").alias("country"), F.col("s.code").alias("state_code"),
                 F.col("s.name").alias("state_region"), F.explode_outer("s.cities").alias("t"))
    return t.select("country_code", "country", "state_code", "state_region", F.col("t.name").alias("city"),
                    F.explode_outer("t.districts").alias("district"))


LEAD = """name string, subtitle string, profileUrl string, location string, email string, phone string,
          website string, company string, industry string, rawText string"""


def parse_leads(df: DataFrame, payload: str = "payload", key: str = "lead_id", strategy: str | None = None,
                filter_industry: str | None = None, filter_location: str | None = None) -> DataFrame:
    """S-10: lead blocks (JSON) as contact rows.

    The company comes only from the block itself or from "Title at Company"; it is never guessed from free
    text.  E-mail, phone and name fall back to the free text.  The optional arguments name columns of what the page
    said beside its blocks: where `strategy` is 'maps' the name of a block without a company is the company and no
    person; `filter_industry` fills a missing industry unless it is a code; `filter_location` fills city and country where
    both are missing.
    """
    def beside(column: str | None, name: str) -> Column:
        return (F.lit(None).cast("string") if column is None else F.col(column)).alias(name)

    rows = df.select(key, F.from_json(payload, LEAD).alias("b"), beside(strategy, "_strategy"), beside(filter_industry, "_industry"), beside(filter_location, "_location")
                     ).select(key, "b.*", "_strategy", "_industry", "_location")
    raw, sub = F.col("rawText"), F.trim("subtitle")
    lines = F.filter(F.transform(F.split(raw, r"[·\n]"), lambda p: F.trim(p)), lambda x: x != "")
    usable = F.filter(lines, lambda x: (F.length(x) >= 3) & ~x.rlike(rules.LEAD_WEB_WORDS)
                      & (F.lower(x) != F.lower(F.coalesce(F.trim("name"), F.lit("")))))
    telling = F.get(F.filter(usable, lambda x: x.rlike(rules.LEAD_LINE_AT) | (x.rlike("^[A-Z]") & F.length(x).between(4, 99))), F.lit(0))
    sub_title = F.when(sub.rlike(rules.LEAD_AT), F.trim(F.regexp_extract(sub, rules.LEAD_AT, 1))).otherwise(blank_to_null(sub))
    sub_company = blank_to_null(F.trim(F.get(F.split(F.regexp_extract(sub, rules.LEAD_AT, 2), r"[·•\n]"), F.lit(0))))
    line_title = F.when(telling.rlike(rules.LEAD_LINE_AT), F.trim(F.regexp_extract(telling, rules.LEAD_LINE_AT, 1))).otherwise(telling)
    line_company = blank_to_null(F.trim(F.get(F.split(F.regexp_extract(telling, rules.LEAD_LINE_AT, 2), r"[·•,]"), F.lit(0))))
    own_company = blank_to_null(F.trim("company"))
    raw_name = blank_to_null(F.regexp_extract(raw, rules.LEAD_NAME, 1))
    company = F.coalesce(sub_company, own_company, F.when(~F.coalesce(present(sub), F.lit(False)), line_company))
    named = rows.withColumn("_full", F.coalesce(blank_to_null(clean_name("name")), raw_name)).withColumn("_company", company)
    business = F.coalesce((F.col("_strategy") == "maps") & F.col("_full").isNotNull() & F.col("_company").isNull(), F.lit(False))
    marked = named.withColumn("company", F.when(business, F.col("_full")).otherwise(F.col("_company"))).withColumn(
        "full_name", F.when(~business, F.col("_full")))
    said = F.trim(F.regexp_replace("_industry", rules.LEAD_FILTER_BRACKETS, ""))
    asked = F.when((F.length(said) > 1) & ~said.rlike(r"^\d+$"), said)
    own, area = split_location("location"), split_location("_location")
    unplaced = own["city"].isNull() & own["country"].isNull()
    return marked.select(
        key, "full_name", blank_to_null(F.regexp_extract("full_name", r"^(\S+)", 1)).alias("first_name"),
        blank_to_null(F.regexp_extract("full_name", r"^\S+\s+(.*)$", 1)).alias("last_name"),
        F.coalesce(sub_title, line_title).alias("job_title"), "company",
        F.coalesce(blank_to_null("email"), blank_to_null(F.regexp_extract(raw, rules.LEAD_EMAIL, 0))).alias("email"),
        F.coalesce(blank_to_null("phone"), blank_to_null(F.trim(F.regexp_extract(raw, rules.LEAD_PHONE, 0)))).alias("phone_number"),
        F.col("profileUrl").alias("linkedin_url"), "website",
        F.when(unplaced, area["city"]).otherwise(own["city"]).alias("city"),
        F.when(unplaced, area["country"]).otherwise(own["country"]).alias("country"),
        F.coalesce(blank_to_null(F.trim("industry")), asked).alias("industry"))

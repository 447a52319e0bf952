"""Company-registry files and payloads (S-01 … S-05)."""

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.company import norm_country, parse_address, uk_date
from ..functions.industry import sic_prefix_industry, sic_text_industry
from ..functions.presence import blank_to_null, present

# file header -> canonical column                                            fixed values
CSV_COLUMNS = {
    "CompanyNumber": "company_number", "CompanyName": "name", "CompanyCategory": "company_type",
    "CompanyStatus": "status", "IncorporationDate": "incorporation_date",
    "RegAddress.AddressLine1": "address_line_1", "RegAddress.AddressLine2": "address_line_2",
    "RegAddress.PostTown": "locality", "RegAddress.County": "region",
    "RegAddress.PostCode": "postal_code", "RegAddress.Country": "country", "SICCode.SicText_1": "sic_text",
}
SOURCE_TAG = "companies_house_bulk"


def raw_columns(df: DataFrame) -> DataFrame:
    """Registry columns under their canonical names.  Header names may carry spaces; absent ones are NULL."""
    found = {c.strip(): c for c in df.columns}
    return df.select(*[
        (F.col(f"`{found[header]}`") if header in found else F.lit(None).cast("string")).alias(name)
        for header, name in CSV_COLUMNS.items()])


def map_registry_rows(raw: DataFrame, active_only: bool = False, source: str = SOURCE_TAG) -> DataFrame:
    """S-01: registry rows as companies.  S-02 (`active_only`): quotes and spaces are stripped, and only
    numbered rows with status 'Active' pass."""
    if active_only:
        cleaned = raw.select(*[blank_to_null(F.trim(F.regexp_replace(F.trim(c), '^"+|"+$', ""))).alias(c) for c in raw.columns])
        cleaned = cleaned.filter(F.col("company_number").isNotNull() & (F.col("status") == "Active"))
        country: Column = norm_country("country")
        industry: Column = F.col("sic_text")
        name: Column = F.coalesce("name", F.lit(""))
    else:
        cleaned = raw
        country = F.coalesce(blank_to_null("country"), F.lit("United Kingdom"))
        industry = F.when(blank_to_null("sic_text").isNull(), F.lit("Other")).otherwise(sic_text_industry("sic_text"))
        name = F.col("name")
    return cleaned.select(
        "company_number", name.alias("name"), name.alias("legal_name"), F.lit("gb").alias("jurisdiction"),
        "company_type", "status", uk_date("incorporation_date").alias("incorporation_date"),
        "address_line_1", "address_line_2", "locality", "region", "postal_code", country.alias("country"),
        industry.alias("industry"), F.lit(source).alias("data_source"))


def count_skipped(raw: DataFrame, counts: Observation | str) -> DataFrame:
    """S-02: the rows, with `read`, `imported`, `no_number` and `not_active` counted while whatever is made of them runs (no
    extra pass; a row without a number counts as that, whatever its status)."""
    def clean(c: str) -> Column:
        return blank_to_null(F.trim(F.regexp_replace(F.trim(c), '^"+|"+$', "")))

    numbered, active = clean("company_number").isNotNull(), F.coalesce(clean("status") == "Active", F.lit(False))
    return raw.observe(counts, F.count(F.lit(1)).alias("read"), F.count_if(numbered & active).alias("imported"),
                       F.count_if(~numbered).alias("no_number"), F.count_if(numbered & ~active).alias("not_active"))


def read_registry_csv(spark: SparkSession, path: str, active_only: bool = False, source: str = SOURCE_TAG,
                      counts: Observation | None = None) -> DataFrame:
    """S-01, S-02.  Every column is read as text; types come from the mapping. `counts` receives those of count_skipped."""
    raw = raw_columns(spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=False))
    return map_registry_rows(raw if counts is None else count_skipped(raw, counts), active_only, source)


# --- JSON payloads ----------------------------------------------------------------------------

def _struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


_ADDRESS = _struct("address_line_1", "addressLine1", "line1", "address_line_2", "addressLine2", "line2", "locality",
                   "region", "postal_code", "postalCode", "country", "street_address", "premises")
REGISTRY_PAYLOAD = T.StructType([
    *_struct("company_number", "registrationNumber", "id", "company_name", "name", "title", "type", "company_type",
             "company_status", "status", "date_of_creation", "dateOfCreation", "incorporationDate").fields,
    T.StructField("registered_office_address", _ADDRESS), T.StructField("addressParsed", _ADDRESS),
    T.StructField("registeredOffice", _ADDRESS), T.StructField("sic_codes", T.ArrayType(T.StringType()))])
_OPEN = T.StructType([
    *_struct("company_number", "registrationNumber", "name", "jurisdiction_code", "jurisdiction", "company_type", "type",
             "current_status", "status", "incorporation_date", "incorporationDate", "registered_address_in_full").fields,
    T.StructField("registered_address", _ADDRESS)])
OPEN_PAYLOAD = T.StructType([*_OPEN.fields, T.StructField("company", _OPEN)])
_DATE = T.StructType([T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType())])
OFFICERS_PAYLOAD = T.StructType([T.StructField("items", T.ArrayType(T.StructType([
    *_struct("name", "officer_role", "appointed_on", "resigned_on", "nationality", "occupation").fields,
    T.StructField("date_of_birth", _DATE), T.StructField("address", _ADDRESS),
    T.StructField("links", T.StructType([T.StructField("officer", _struct("appointments")), T.StructField("self", T.StringType())])),
])))])


def _first(*columns: str) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in columns])


def map_registry_json(df: DataFrame, payload: str = "payload") -> DataFrame:
    """S-03: one JSON company per row; the first filled spelling of every field counts."""
    rows = df.select(F.from_json(payload, REGISTRY_PAYLOAD).alias("d")).select("d.*")
    rows = rows.withColumn("a", F.coalesce("registered_office_address", "addressParsed", "registeredOffice"))
    code = F.get("sic_codes", F.lit(0))
    return rows.select(
        _first("company_number", "registrationNumber", "id").alias("company_number"),
        _first("company_name", "name", "title").alias("name"), _first("company_name", "name", "title").alias("legal_name"),
        F.lit("gb").alias("jurisdiction"), _first("type", "company_type").alias("company_type"),
        _first("company_status", "status").alias("status"),
        F.try_to_date(_first("date_of_creation", "dateOfCreation", "incorporationDate")).alias("incorporation_date"),
        _first("a.address_line_1", "a.addressLine1", "a.line1").alias("address_line_1"),
        _first("a.address_line_2", "a.addressLine2", "a.line2").alias("address_line_2"),
        F.col("a.locality").alias("locality"), F.col("a.region").alias("region"),
        _first("a.postal_code", "a.postalCode").alias("postal_code"),
        F.coalesce(blank_to_null("a.country"), F.lit("United Kingdom")).alias("country"),
        F.when(F.size("sic_codes") > 0, F.concat(F.lit("SIC: "), F.array_join("sic_codes", ", "))).alias("description"),
        F.when(F.size("sic_codes") > 0, sic_prefix_industry(code)).alias("industry"),
        F.lit("companies_house").alias("data_source"))


def map_open_registry_json(df: DataFrame, payload: str = "payload") -> DataFrame:
    """S-04: payloads of the open registry; the company may be wrapped in a `company` object.

    Parts that the structured address lacks come from the address in full (X-16); such rows without a country are
    those of the United States.
    """
    rows = df.select(F.from_json(payload, OPEN_PAYLOAD).alias("d")).select(
        F.coalesce("d.company", F.struct(*[F.col(f"d.{f.name}") for f in _OPEN.fields])).alias("c")).select("c.*")
    a, full = "registered_address.", parse_address("registered_address_in_full")
    home = F.when(present("registered_address_in_full"), F.lit("United States"))
    return rows.select(
        _first("company_number", "registrationNumber").alias("company_number"), F.col("name"),
        F.col("name").alias("legal_name"),
        F.coalesce(_first("jurisdiction_code", "jurisdiction"), F.lit("unknown")).alias("jurisdiction"),
        _first("company_type", "type").alias("company_type"), _first("current_status", "status").alias("status"),
        F.try_to_date(_first("incorporation_date", "incorporationDate")).alias("incorporation_date"),
        F.coalesce(a + "street_address", full["line1"]).alias("address_line_1"), F.coalesce(a + "locality", full["locality"]).alias("locality"),
        F.coalesce(a + "region", full["region"]).alias("region"), F.coalesce(a + "postal_code", full["postal_code"]).alias("postal_code"),
        F.coalesce(F.col(a + "country"), home).alias("country"), F.lit("opencorporates").alias("data_source"))


def map_officers_json(df: DataFrame, company: str = "company_id", payload: str = "payload") -> DataFrame:
    """S-05: one row per officer of a payload; a birth date of year and month is the first of that month."""
    rows = df.select(company, F.explode(F.from_json(payload, OFFICERS_PAYLOAD)["items"]).alias("o"))
    born = F.col("o.date_of_birth")
    link = F.coalesce("o.links.officer.appointments", "o.links.self")
    address = blank_to_null(F.trim(F.concat_ws(" ", "o.address.premises", "o.address.address_line_1")))
    return rows.select(
        F.col(company).alias("company_id"),
        blank_to_null(F.regexp_extract(link, r"/officers/([^/]+)", 1)).alias("officer_id"),
        F.col("o.name").alias("name"), F.coalesce(blank_to_null("o.officer_role"), F.lit("director")).alias("role"),
        F.try_to_date("o.appointed_on").alias("appointed_date"), F.try_to_date("o.resigned_on").alias("resigned_date"),
        F.col("o.nationality").alias("nationality"), F.col("o.occupation").alias("occupation"),
        F.when(born["year"].isNotNull() & born["month"].between(1, 12), F.make_date(born["year"], born["month"], F.lit(1)))
        .alias("date_of_birth"), address.alias("address"), F.to_json("o.links").alias("ch_links"))

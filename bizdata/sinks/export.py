"""Exports (K-01 … K-05) and append-only logs (K-06).  The builders return frames; write_csv writes them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.company import as_time
from ..functions.presence import icontains, present
from ..operators.joins import contacts_with_account, with_contact_count

# output heading -> account column                                           fixed values
COMPANY_HEADINGS = {
    "Company Name": "company_name", "Industry": "industry", "City": "city", "Address": "address",
    "Phone": "phone_number", "Website": "website", "Email Format": "email_format", "LinkedIn": "linkedin_url",
    "Twitter": "twitter_url", "Facebook": "facebook_url", "Instagram": "instagram_url",
    "Employee Count": "employee_count", "Quality Score": "quality_score", "Contact Count": "contact_count",
}


def _yes_no(c: str) -> Column:
    return F.when(F.col(c), F.lit("Yes")).otherwise(F.lit("No"))


def _select_existing(df: DataFrame, headings: dict[str, str]) -> list[Column]:
    return [(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(h) for h, c in headings.items()]


def export_companies(accounts: DataFrame, contacts: DataFrame, min_quality: int = 0, city: str | None = None,
                     industry: str | None = None, limit: int | None = None) -> DataFrame:
    """K-01: best scores first, rows without a score last."""
    rows = accounts
    if min_quality > 0:
        rows = rows.filter(F.col("quality_score") >= min_quality)
    if city:
        rows = rows.filter(icontains("city", city))
    if industry:
        rows = rows.filter(icontains("industry", industry))
    order = [F.desc_nulls_last("quality_score"), F.asc("account_id")]
    # counts are joined after the limit when there is one, so only exported rows are looked up
    picked = rows.orderBy(*order)
    picked = picked if limit is None else picked.limit(limit)
    counted = with_contact_count(picked, contacts)
    return counted.orderBy(*order).select("account_id", *_select_existing(counted, COMPANY_HEADINGS))


def export_companies_full(accounts: DataFrame, contacts: DataFrame) -> DataFrame:
    """K-02: all accounts with contact counts, by name."""
    per_account = contacts.filter(F.col("linked_account_id").isNotNull()).groupBy("linked_account_id").agg(
        F.count(F.lit(1)).alias("contact_count"), F.count("email").alias("contacts_with_email"))
    out = accounts.join(per_account, F.col("account_id") == F.col("linked_account_id"), "left").drop("linked_account_id")
    return (out.withColumn("contact_count", F.coalesce("contact_count", F.lit(0)))
            .withColumn("contacts_with_email", F.coalesce("contacts_with_email", F.lit(0)))
            .withColumn("verified", _yes_no("verified")).orderBy(F.asc_nulls_last("company_name"), F.asc("account_id")))


def export_contacts(contacts: DataFrame, accounts: DataFrame, has_email: bool = False, has_phone: bool = False,
                    country: str | None = None, industry: str | None = None) -> DataFrame:
    """K-03: contacts with company columns."""
    out = contacts_with_account(contacts, accounts)
    if has_email:
        out = out.filter(present("email"))
    if has_phone:
        out = out.filter(present("phone_number"))
    if country:
        out = out.filter(F.col("account_country") == country)
    if industry:
        out = out.filter(icontains("account_industry", industry))
    return out.withColumn("verified", _yes_no("verified"))


def export_combined(contacts: DataFrame, accounts: DataFrame) -> DataFrame:
    """K-04: one flat row per contact, NULL full name when a part is NULL, plain dates."""
    joined = contacts_with_account(contacts, accounts)
    return joined.select(
        "contact_id", F.concat("first_name", F.lit(" "), "last_name").alias("full_name"), "job_title", "email",
        "phone_number", "linkedin_url", "company_name", "website", F.col("account_industry").alias("industry"),
        F.col("account_city").alias("city"), F.col("account_country").alias("country"),
        _yes_no("verified").alias("verified"), F.date_format("created_at", "yyyy-MM-dd").alias("created_date"))


def flat_text(df: DataFrame) -> DataFrame:
    """K-05: text cells on one line without outer spaces."""
    return df.select(*[
        F.trim(F.regexp_replace(F.col(f"`{name}`"), r"[\r\n]+", " ")).alias(name) if kind == "string" else F.col(f"`{name}`")
        for name, kind in df.dtypes])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K-05: quotes only where needed, inner quotes doubled, header in every part file."""
    (flat_text(df).write.mode(mode).options(header=True, quote='"', escape='"', quoteAll=False, emptyValue="", nullValue="",
                                            lineSep="\r\n").csv(path))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


# --- logs -------------------------------------------------------------------------------------

def log_rows(df: DataFrame, as_of: str, time_column: str, json_column: str | None = None,
             json_fields: tuple[str, ...] = ()) -> DataFrame:
    """K-06: log rows with the run time and, if asked, some fields packed as JSON."""
    out = df.withColumn(time_column, as_time(as_of))
    if json_column:
        out = out.withColumn(json_column, F.to_json(F.struct(*json_fields))).drop(*json_fields)
    return out


def append_log(df: DataFrame, path: str) -> None:
    """K-06."""
    df.write.mode("append").parquet(path)


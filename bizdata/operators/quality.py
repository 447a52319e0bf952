"""Cleaning and scoring (P-15 … P-20, X-34, X-42).  Nothing is deleted: refused rows carry a reason."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.company import gibberish, headline_name, spam_reasons
from ..functions.email import fake_email
from ..functions.names import has_role, person_shape_ok, plausible_first, plausible_person, valid_title
from ..functions.phone import phone_valid
from ..functions.presence import missing, present
from ..functions.scores import quality_score
from .joins import with_contact_count


def score_accounts(accounts: DataFrame, contacts: DataFrame) -> DataFrame:
    """X-42 for every account."""
    return with_contact_count(accounts, contacts).withColumn("quality_score", quality_score())


def backfill_scores(accounts: DataFrame, contacts: DataFrame) -> DataFrame:
    """P-20: score the rows that have none; other scores stay."""
    old = F.col("_old_score")
    scored = score_accounts(accounts.withColumn("_old_score", F.col("quality_score")), contacts)
    return scored.withColumn("quality_score", F.coalesce(old, F.col("quality_score"))).select(*accounts.columns)


def average_score(accounts: DataFrame) -> DataFrame:
    return accounts.agg(F.count("quality_score").alias("scored"), F.round(F.avg("quality_score"), 6).alias("avg_score"))


def account_reasons(accounts: DataFrame) -> DataFrame:
    """P-15: accounts with `reason`, the first clean-up step that refuses them, or NULL.

    Steps: the six name rules in order, then duplicates of (name, city) among the rest.
    """
    first = F.get(spam_reasons("company_name"), F.lit(0))
    named = accounts.withColumn("_name_reason", first)
    name, city = F.lower(F.trim("company_name")), F.lower(F.coalesce("city", F.lit("")))
    keepers = (named.filter(F.col("_name_reason").isNull()).groupBy(name.alias("_name"), city.alias("_city"))
               .agg(F.min("account_id").alias("_keep")))
    joined = named.join(keepers, (name == F.col("_name")) & (city == F.col("_city")), "left")
    reason = F.coalesce(F.col("_name_reason"), F.when(F.col("account_id") != F.col("_keep"), F.lit("duplicate")))
    return joined.withColumn("reason", reason).drop("_name_reason", "_name", "_city", "_keep")


def clean_accounts(accounts: DataFrame, contacts: DataFrame) -> dict[str, DataFrame]:
    """P-15: kept and rejected accounts, kept and orphaned contacts."""
    judged = account_reasons(accounts)
    kept = judged.filter(F.col("reason").isNull()).drop("reason")
    ids = kept.select(F.col("account_id").alias("linked_account_id"))
    linked = contacts.filter(F.col("linked_account_id").isNotNull())
    orphaned = linked.join(ids, "linked_account_id", "left_anti")
    held = linked.join(ids, "linked_account_id", "left_semi")
    free = contacts.filter(F.col("linked_account_id").isNull())
    return {"accounts": kept, "rejected": judged.filter(F.col("reason").isNotNull()),
            "contacts": held.select(*contacts.columns).unionByName(free),
            "orphans": orphaned.select(*contacts.columns)}


def clean_counts(accounts: DataFrame) -> DataFrame:
    """P-15: accounts per refusing step, 'kept' for the rest."""
    return (account_reasons(accounts).groupBy(F.coalesce("reason", F.lit("kept")).alias("step"))
            .agg(F.count(F.lit(1)).alias("n")))


def headline_accounts(accounts: DataFrame) -> DataFrame:
    """X-50 as a filter: accounts whose name is a scraped headline."""
    return accounts.filter(headline_name("company_name", "country"))


def fake_account() -> Column:
    """P-16: made-up source, unverified row without a source, synthetic or listed name; protected
    sources are exempt.  Conditions are NULL-safe."""
    source = F.coalesce("data_source", F.lit(""))
    fake_source = F.exists(F.array(*[F.lit(s) for s in rules.FAKE_SOURCES]), lambda s: F.contains(source, s))
    protected = F.exists(F.array(*[F.lit(s) for s in rules.PROTECTED_SOURCES]), lambda s: F.contains(source, s))
    no_source = F.col("data_source").isNull()
    fake = (fake_source | (no_source & ~F.coalesce("verified", F.lit(True)))
            | (no_source & F.coalesce(F.col("company_name").rlike(rules.SYNTHETIC_NAME), F.lit(False)))
            | F.coalesce(F.col("company_name").isin(*rules.FAKE_NAMES), F.lit(False)))
    return fake & ~protected


def purge_fake(accounts: DataFrame, contacts: DataFrame) -> dict[str, DataFrame]:
    """P-16: accounts and contacts without the fake ones, and the fake ones."""
    fake = accounts.filter(fake_account())
    gone = fake.select(F.col("account_id").alias("linked_account_id"))
    return {"accounts": accounts.filter(~fake_account()), "fake": fake,
            "contacts": contacts.join(gone, "linked_account_id", "left_anti").select(*contacts.columns)}


# --- people -----------------------------------------------------------------------------------

def in_dictionary(df: DataFrame, column: Column, words: DataFrame, name: str) -> DataFrame:
    """Mark rows whose word is in a one-column dictionary frame (column `word`, lower case)."""
    known = words.select(F.lower("word").alias("_word")).distinct().withColumn(name, F.lit(True))
    out = df.withColumn("_key", column).join(known, F.col("_key") == F.col("_word"), "left")
    return out.withColumn(name, F.coalesce(name, F.lit(False))).drop("_word", "_key")


def valid_person(df: DataFrame, first_names: DataFrame, not_names: DataFrame | None = None,
                 first: str = "first_name", last: str = "last_name") -> DataFrame:
    """X-34: strict person-name test; adds `person_ok`.

    The first name must be in the first-name dictionary, and neither part in the not-a-name one.
    """
    f, l = F.lower(F.trim(first)), F.lower(F.trim(last))
    out = in_dictionary(df, f, first_names, "_known")
    ok = person_shape_ok(first, last) & F.col("_known")
    if not_names is not None:
        out = in_dictionary(in_dictionary(out, f, not_names, "_bad1"), l, not_names, "_bad2")
        ok = ok & ~F.col("_bad1") & ~F.col("_bad2")
    return out.withColumn("person_ok", ok).drop("_known", "_bad1", "_bad2")


def plausible_first_names(df: DataFrame, first_names: DataFrame, ordinary_words: DataFrame, first: str = "first_name") -> DataFrame:
    """X-35: lenient test of first names against two dictionaries of any size (column `word`); adds `first_why` and `first_score`.

    known (100): in the first-name dictionary.  plausible (60): in neither, with the shape of a name.  ordinary_word (20): in
    the dictionary of ordinary words and not of names.  malformed (0): the rest, missing ones too.  From 60 on a name passes.
    """
    name = F.lower(F.trim(first))
    out = in_dictionary(in_dictionary(df, name, first_names, "_known"), name, ordinary_words, "_plain")
    why = (F.when(F.col("_known"), F.lit("known")).when(F.col("_plain"), F.lit("ordinary_word"))
           .when(plausible_first(first), F.lit("plausible")).otherwise(F.lit("malformed")))
    score = F.create_map(*[F.lit(x) for pair in rules.FIRST_NAME_SCORES.items() for x in pair])
    return out.withColumn("first_why", why).withColumn("first_score", F.try_element_at(score, F.col("first_why"))).drop("_known", "_plain")


def contact_reasons(contacts: DataFrame, first_names: DataFrame, not_names: DataFrame) -> DataFrame:
    """P-17: contacts with `reason` (missing_name, short_name, not_a_person) or NULL."""
    f, l = F.lower(F.trim("first_name")), F.lower(F.trim("last_name"))
    out = in_dictionary(contacts, f, first_names, "_known")
    out = in_dictionary(in_dictionary(out, f, not_names, "_bad1"), l, not_names, "_bad2")
    person = plausible_person("first_name", "last_name", F.col("_known"), F.col("_bad1") | F.col("_bad2"))
    reason = (F.when(missing("first_name") | missing("last_name"), F.lit("missing_name"))
              .when((F.length("first_name") < 2) | (F.length("last_name") < 2), F.lit("short_name"))
              .when(~person, F.lit("not_a_person")))
    return out.withColumn("reason", reason).drop("_known", "_bad1", "_bad2")


def nullify_bad(df: DataFrame, email: str = "email", phone: str = "phone_number", industry: str | None = None,
                title: str | None = None, name: str | None = None, vote: str | None = None) -> DataFrame:
    """P-18: blank out unusable fields, keep the row, list what was blanked in `nullified`.

    `vote` is an optional supplied column naming one more field to blank.  `name` is only flagged.
    """
    bad = {email: present(email) & fake_email(email), phone: present(phone) & ~phone_valid(phone)}
    if industry:
        bad[industry] = present(industry) & ((F.length(F.trim(industry)) < 2) | gibberish(F.trim(industry)))
    if title:
        bad[title] = present(title) & ~valid_title(title)
    if vote:
        bad = {c: cond | F.coalesce(F.col(vote) == c, F.lit(False)) for c, cond in bad.items()}
    listed = F.array_compact(F.array(*[F.when(cond, F.lit(c)) for c, cond in bad.items()]))
    out = df.withColumn("nullified", F.array_join(listed, ","))
    if name:
        out = out.withColumn("name_flag", gibberish(name))
    for c, cond in bad.items():
        # the flags were computed on the original values
        out = out.withColumn(c, F.when(~F.array_contains(F.split("nullified", ","), c), F.col(c)))
    return out


def enforce_title(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P-19: rows with an acceptable job title, and the others with the reason."""
    t = F.trim("job_title")
    reason = (F.when(F.col("job_title").isNull() | (t == ""), F.lit("missing title"))
              .when(F.length(t) < 3, F.lit("title too short"))
              .when(~has_role("job_title"), F.lit("no valid role")))
    judged = df.withColumn("title_reason", reason)
    return (judged.filter(F.col("title_reason").isNull()).drop("title_reason"),
            judged.filter(F.col("title_reason").isNotNull()))

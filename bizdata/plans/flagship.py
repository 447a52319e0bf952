"""Flagship: de-duplicate accounts by website, score them, and rank the places of every country."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.presence import count_present
from ..operators.dedup import dedup_accounts
from ..operators.quality import score_accounts
from .columns import QUALITY
from .registry import query
from .views import Tables

SITES = """SELECT account_id, MIN(account_id) OVER (PARTITION BY REGEXP_REPLACE(REGEXP_REPLACE(LOWER(website), '^https?://', ''), '^www\\.', '')) AS keep_id
    FROM accounts_v WHERE website <> ''"""
SQL = f"""
    WITH m AS (SELECT account_id AS was, keep_id FROM ({SITES}) WHERE account_id <> keep_id),
      k AS (SELECT COALESCE(m.keep_id, linked_account_id) AS aid, COUNT(*) AS n FROM contacts_v LEFT JOIN m ON linked_account_id = m.was GROUP BY 1),
      s AS (SELECT a.*, LEAST({QUALITY} + 4 * LEAST(COALESCE(n, 0), 5), 100) AS score FROM accounts_v a LEFT JOIN k ON a.account_id = k.aid
        WHERE a.account_id NOT IN (SELECT was FROM m) AND a.state_region IS NOT NULL)
    SELECT country, state_region AS state, COUNT(*) AS companies, COUNT(*) FILTER (WHERE website <> '') AS enriched_count,
      ROUND(AVG(score), 6) AS avg_score, RANK() OVER (PARTITION BY country ORDER BY COUNT(*) DESC, state_region) AS rank
    FROM s GROUP BY country, state_region"""


def report(t: Tables) -> DataFrame:
    accounts, contacts = dedup_accounts(t.accounts, t.contacts)
    scored = score_accounts(accounts, contacts).filter(F.col("state_region").isNotNull())
    places = scored.groupBy("country", F.col("state_region").alias("state")).agg(
        F.count(F.lit(1)).alias("companies"), count_present("website").alias("enriched_count"),
        F.round(F.avg("quality_score"), 6).alias("avg_score"))
    # one row per place is left here, so the window is small whatever the size of the tables
    order = Window.partitionBy("country").orderBy(F.desc("companies"), F.asc("state"))
    return places.withColumn("rank", F.rank().over(order))


def places_report(spark: SparkSession, folder: str) -> DataFrame:
    return report(Tables(spark, folder))


query("flagship_places", SQL)(report)

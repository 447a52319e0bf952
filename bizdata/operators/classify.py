"""Industry classification over tables (J-19, P-21)."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.industry import industry_by_name, industry_by_text, norm_industry
from ..functions.presence import as_col
from ..functions.web import domain, html_text


def prefix_table(df: DataFrame, prefixes: Mapping[str, Sequence[str]]) -> DataFrame:
    """(prefix, ord, category) of a category dictionary; a prefix of several categories keeps the first."""
    first: dict[str, tuple[int, str]] = {}
    for order, (category, codes) in enumerate(prefixes.items()):
        for code in codes:
            first.setdefault(code, (order, category))
    rows = [(code, order, category) for code, (order, category) in first.items()]
    return df.sparkSession.createDataFrame(rows, "prefix string, ord int, category string")


def naics_category(df: DataFrame, column: str, prefixes: Mapping[str, Sequence[str]], name: str = "category") -> DataFrame:
    """J-19: category whose declared prefix starts the leading digits of the code; the first declared
    category wins; no digits or no match leaves the text as it is.

    One equi-join per prefix length instead of a LIKE join; Spark broadcasts the dictionary if it is small.
    """
    table = prefix_table(df, prefixes)
    code = F.regexp_extract(column, r"^(\d+)", 1)
    out, hits = df, []
    for size in sorted({len(c) for codes in prefixes.values() for c in codes}):
        part = table.filter(F.length("prefix") == size).select(
            F.col("prefix").alias("_p"), F.struct("ord", "category").alias(f"_hit{size}"))
        out = out.join(part, (F.length(code) >= size) & (F.substring(code, 1, size) == F.col("_p")), "left").drop("_p")
        hits.append(f"_hit{size}")
    best = F.array_min(F.array_compact(F.array(*hits)))["category"]
    return out.withColumn(name, F.coalesce(best, as_col(column))).drop(*hits)


def main_pages(pages: DataFrame) -> DataFrame:
    """One page per host: the one with the shortest address. It is chosen by ids and lengths; its html is fetched after."""
    hosted = pages.select(domain("url").alias("host"), F.length("url").alias("_size"), "page_id").dropna(subset=["host"])
    chosen = hosted.groupBy("host").agg(F.min(F.struct("_size", "page_id"))["page_id"].alias("page_id"))
    return pages.dropDuplicates(["page_id"]).join(chosen, "page_id")


def classify_accounts(accounts: DataFrame, pages: DataFrame) -> DataFrame:
    """P-21: industry from the name, else from the site's main page, else from the old industry text.

    Every host has one main page, so the join is many-to-one; pages are scored once per host.
    """
    sites = main_pages(pages).select(F.col("host").alias("_host"), industry_by_text(html_text("html")).alias("_by_page"))
    named = accounts.withColumn("_by_name", industry_by_name("company_name")).withColumn("_by_old", norm_industry("industry"))
    joined = named.join(sites, domain("website") == F.col("_host"), "left")
    found = F.coalesce("_by_name", "_by_page", "_by_old", F.col("industry"))
    method = (F.when(F.col("_by_name").isNotNull(), F.lit("name")).when(F.col("_by_page").isNotNull(), F.lit("page"))
              .when(F.col("_by_old").isNotNull(), F.lit("normalised")).otherwise(F.lit("unchanged")))
    return joined.withColumn("new_industry", found).withColumn("method", method).drop("_host", "_by_page", "_by_name", "_by_old")

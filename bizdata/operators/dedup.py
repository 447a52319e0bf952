"""Duplicate companies: pairs, groups, connected components and merges.

Pairs are stars: the lowest id of a group with every other member.  That is linear in the rows, holds
the same information as all pairs of the group (same components, same survivor), and keeps working when
one website or name is shared by a third of the table.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.company import as_time, registration_key
from ..functions.presence import blank_to_null, missing, present
from ..functions.web import site_key
from ..session import cut_lineage


def star_pairs(df: DataFrame, keys: Sequence[Column], id_column: str = "id",
               carry: Sequence[str] = ()) -> DataFrame:
    """(id1, id2) with id1 the lowest id of the rows that share the keys; `carry` columns come from id1."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    on = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select(F.col(id_column).alias("_id"), *named, *carry).dropna(subset=on)
    groups = keyed.groupBy(*on).agg(
        F.min(F.struct("_id", *carry)).alias("_keep"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    members = keyed.select("_id", *on).join(groups, on)
    return members.filter(F.col("_id") != F.col("_keep._id")).select(
        F.col("_keep._id").alias("id1"), F.col("_id").alias("id2"),
        *[F.col(f"_keep.{c}").alias(c) for c in carry])


def dup_by_website(df: DataFrame) -> DataFrame:
    """J-12: same website text."""
    rows = df.filter(present("website"))
    return star_pairs(rows, [F.col("website")], carry=["website"]).select(
        "id1", "id2", F.lit("same_website").alias("match_reason"), F.col("website").alias("match_field"),
        F.lit(0.95).alias("confidence"))


def dup_by_name_address(df: DataFrame) -> DataFrame:
    """J-13: same trimmed lower-case name, address and locality."""
    def key(c: str) -> Column:
        return F.lower(F.trim(F.coalesce(c, F.lit(""))))

    rows = df.filter((F.length("name") > 3) & (F.col("address_line_1").isNotNull() | F.col("locality").isNotNull()))
    pairs = star_pairs(rows, [key("name"), key("address_line_1"), key("locality")],
                       carry=["name", "locality", "address_line_1"])
    where = F.coalesce(blank_to_null("locality"), F.col("address_line_1"))
    return pairs.select(
        "id1", "id2", F.lit("same_name_and_address").alias("match_reason"),
        F.concat(F.col("name"), F.lit(" @ "), where).alias("match_field"), F.lit(0.90).alias("confidence"))


def dup_by_registration(df: DataFrame) -> DataFrame:
    """J-14: same registration number apart from case, '-' and ' '."""
    rows = df.filter(F.length("company_number") > 3)
    return star_pairs(rows, [registration_key("company_number")], carry=["company_number"]).select(
        "id1", "id2", F.lit("same_registration_number").alias("match_reason"),
        F.col("company_number").alias("match_field"), F.lit(1.00).alias("confidence"))


def find_duplicates(df: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """U-03: one row per pair; of several reasons the first in the order website, name, registration stays."""
    strategies = [dup_by_website(df), dup_by_name_address(df), dup_by_registration(df)]
    found = None
    for order, pairs in enumerate(strategies):
        ranked = pairs.filter(F.col("confidence") >= min_confidence).withColumn("_order", F.lit(order))
        found = ranked if found is None else found.unionByName(ranked)
    best = found.groupBy("id1", "id2").agg(
        F.min(F.struct("_order", "match_reason", "match_field", "confidence")).alias("_best"))
    return best.select("id1", "id2", "_best.match_reason", "_best.match_field", "_best.confidence")


# --- groups -----------------------------------------------------------------------------------

def dup_groups(accounts: DataFrame) -> DataFrame:
    """A-30: websites used by more than one account, with the account to keep."""
    return (accounts.filter(present("website")).groupBy(site_key("website").alias("site"))
            .agg(F.min("account_id").alias("keep_id"), F.count(F.lit(1)).alias("n_accounts"))
            .filter(F.col("n_accounts") > 1))


def dup_members(accounts: DataFrame) -> DataFrame:
    """A-30: one row per account of such a group, with the account to keep."""
    keyed = accounts.filter(present("website")).select("account_id", site_key("website").alias("site"))
    return keyed.join(dup_groups(accounts), "site").select("account_id", "keep_id")


def dedup_accounts(accounts: DataFrame, contacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P-14: keep one account per website and point its contacts to it. The accounts that go are found once and written,
    since both outputs need them."""
    losers = cut_lineage(dup_members(accounts).filter(F.col("account_id") != F.col("keep_id")))
    kept = accounts.join(losers.select("account_id"), "account_id", "left_anti")
    moves = losers.select(F.col("account_id").alias("_from"), "keep_id")
    moved = contacts.join(moves, F.col("linked_account_id") == F.col("_from"), "left")
    moved = moved.withColumn("linked_account_id", F.coalesce("keep_id", "linked_account_id"))
    return kept, moved.drop("_from", "keep_id")


# --- components -------------------------------------------------------------------------------

def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, and a fingerprint of them that the write itself observes."""
    seen = Observation()
    out = cut_lineage(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")))
    return out, (seen.get["n"], seen.get["x"])


def connected_components(pairs: DataFrame, a: str = "id1", b: str = "id2", max_rounds: int = 60) -> DataFrame:
    """P-13: (id, component) with component = lowest id reachable over the pairs.

    Alternating large-star / small-star rounds (Kiveris et al., SoCC 2014).  Each round is two
    aggregations with map-side minima and two joins against one row per node; its result is written to
    the checkpoint folder, and a two-number fingerprint comes back with the write; the rounds end when it stays the same.
    """
    edges = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges, seen = _written(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, now = _written(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots).distinct()


# --- merges -----------------------------------------------------------------------------------

def _mergeable(df: DataFrame) -> list[str]:
    return [f for f in rules.MERGE_FIELDS if f in df.columns]


def merge_preview(pairs: DataFrame, companies: DataFrame) -> DataFrame:
    """P-11: names of the fields that the duplicate would fill."""
    fields = _mergeable(companies)
    left = companies.select(F.col("id").alias("id1"), *[F.col(f).alias(f"_1_{f}") for f in fields])
    right = companies.select(F.col("id").alias("id2"), *[F.col(f).alias(f"_2_{f}") for f in fields])
    changes = F.array_compact(F.array(*[
        F.when(missing(f"_1_{f}") & present(f"_2_{f}"), F.lit(f)) for f in fields]))
    out = pairs.select("id1", "id2").join(left, "id1").join(right, "id2")
    return out.select("id1", "id2", F.array_join(changes, ",").alias("changes"), F.size(changes).alias("will_update"))


def merge_members(members: DataFrame, companies: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Merge every component into its lowest id; returns (companies, log).

    Empty fields of the survivor are filled from the member with the lowest id that has a value.  A
    newer completed enrichment of a member replaces the survivor's.  Merged rows stay, marked and noted.
    """
    fields = _mergeable(companies)
    mapped = companies.join(members.select("id", "component"), "id")
    others = mapped.filter(F.col("id") != F.col("component"))
    donated = others.groupBy(F.col("component").alias("id")).agg(
        *[F.min(F.when(present(f), F.struct("id", f)))[f].alias(f"_{f}") for f in fields],
        F.max(F.when(F.col("enrichment_status") == "completed",
                     F.col("last_enriched"))).alias("_enriched"))
    absorbed = others.select("id", F.col("component").alias("_into"))
    out = companies.join(donated, "id", "left").join(absorbed, "id", "left")
    filled = F.lit(False)
    for f in fields:
        filled = filled | (missing(f) & present(f"_{f}"))
    newer = F.col("_enriched").isNotNull() & (F.col("last_enriched").isNull() | (F.col("_enriched") > F.col("last_enriched")))
    survivor = F.col("_into").isNull()
    merged = F.col("_into").isNotNull()
    note = F.concat(F.lit("Merged into company ID "), F.col("_into").cast("string"), F.lit(f" on {as_of}"))
    new = {f: F.when(survivor, F.coalesce(blank_to_null(f), F.col(f"_{f}"), F.col(f))).otherwise(F.col(f)) for f in fields}
    new["last_enriched"] = (F.when(survivor & newer, F.col("_enriched"))
                            .when(survivor & filled, as_time(as_of)).otherwise(F.col("last_enriched")))
    new["enrichment_status"] = F.when(survivor & newer, F.lit("completed")).otherwise(F.col("enrichment_status"))
    new["status"] = F.when(merged, F.lit("merged")).otherwise(F.col("status"))
    new["notes"] = F.when(merged, F.concat_ws("\n", "notes", note)).otherwise(F.col("notes"))
    result = out.select(*[new.get(c, F.col(c)).alias(c) for c in companies.columns])
    log = others.select(
        F.col("component").alias("company_id"), F.lit("merged").alias("status"),
        F.concat(F.lit("Merged duplicate company ID "), F.col("id").cast("string"), F.lit(" ("),
                 F.coalesce("name", F.lit("no name")), F.lit(")")).alias("notes"))
    return result, log


def merge_pairs(pairs: DataFrame, companies: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """P-12: merge the given pairs (id1 stays); chains are resolved to their components first."""
    return merge_members(connected_components(pairs), companies, as_of)


def auto_merge(companies: DataFrame, as_of: str, min_confidence: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """P-13."""
    return merge_pairs(find_duplicates(companies, min_confidence), companies, as_of)

"""Per-key selection and counting, the building blocks of the other operators.

Hot keys: `first_n` filters on row_number, which Spark also applies before the shuffle
(WindowGroupLimit), so a task never receives more than n rows per key and input partition.  Counts and
minima are combined on the map side.  Joins have a unique key on one side, so a hot key of the other
side can be split by adaptive skew handling.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns so that each is evaluated once per row.

    A later filter on a column made by select() is pushed down by copying the whole expression into
    the filter, once per use.  A generator is not copied, so the columns come from a one-element explode.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.explode_outer(F.array(made)).alias("_made")).select(*df.columns, *[
        F.col(f"_made.{name}").alias(name) for name in columns])


def first_n(df: DataFrame, keys: Sequence[str | Column], n: int, order: Sequence[Column]) -> DataFrame:
    """W-05: the first n rows of every key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """W-01: the first row of every key."""
    return first_n(df, keys, 1, order)


def best_per_key(df: DataFrame, keys: Sequence[str], score: str, order: Sequence[str]) -> DataFrame:
    """W-03: the row with the highest score per key; the earlier one wins a tie."""
    return keep_first(df, keys, [F.col(score).desc_nulls_last(), *[F.col(o).asc() for o in order]])


def top_groups(df: DataFrame, keys: Sequence[str | Column], n: int, **aggregates: Column) -> DataFrame:
    """The n largest groups by row count, ties by key, with further aggregates."""
    named = [k if isinstance(k, Column) else F.col(k) for k in keys]
    grouped = df.groupBy(*named).agg(
        F.count(F.lit(1)).alias("count"), *[c.alias(name) for name, c in aggregates.items()])
    group_columns = grouped.columns[:len(keys)]
    return grouped.orderBy(F.desc("count"), *[F.asc_nulls_last(c) for c in group_columns]).limit(n)


def counts(df: DataFrame, key: str, name: str) -> DataFrame:
    """One row per non-NULL key with its number of rows."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))


def nest(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, fields: Sequence[str],
         order: Sequence[str], name: str, parts: int = 1) -> DataFrame:
    """Parent rows with their children as an array sorted by `order`; `[]` when there are none.

    `parts` deals the children of every parent, by a hash of `order`, over so many rows with the same parent and
    `part` = 0, 1, …; a part without children gives no row, but a parent without any gives one. The shape follows
    from `parts` alone, never from the data; callers with large groups pass more parts, or work on child rows.
    """
    member = F.struct(*order, *[f for f in fields if f not in order])
    part = F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int")
    grouped = (child.filter(F.col(child_key).isNotNull())
               .groupBy(F.col(child_key).alias("_k"), part.alias("part")).agg(F.sort_array(F.collect_list(member)).alias(name)))
    wanted = F.transform(F.col(name), lambda m: F.struct(*[m[f].alias(f) for f in fields]))
    joined = parent.join(grouped, F.col(parent_key) == F.col("_k"), "left").drop("_k")
    return joined.withColumn(name, F.coalesce(wanted, F.array().cast(
        joined.select(wanted).schema[0].dataType))).withColumn("part", F.coalesce("part", F.lit(0)))

"""Canonical tables from files and databases (S-11, S-12)."""

from pyspark.sql import DataFrame, SparkSession

from ..schema import TABLES


def load(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """S-12: a canonical table; the schema is the declared one, columns absent from the files are NULL."""
    return spark.read.schema(TABLES[name]).options(**options).format(fmt).load(path)


def read_table(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int,
               partitions: int, **options: str) -> DataFrame:
    """S-11: database table in key ranges read in parallel; `lower`/`upper` only shape the ranges, every row
    is read."""
    return (spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=lower, upperBound=upper,
        numPartitions=partitions, **options).load())


def copy_table(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int,
               target: str, **options: str) -> None:
    """S-11: database table to Parquet without paging."""
    read_table(spark, url, table, key, lower, upper, partitions, **options).write.mode("overwrite").parquet(target)


def write_table(df: DataFrame, url: str, table: str, partitions: int, **options: str) -> None:
    """S-11: frame to a database over a bounded number of connections."""
    df.coalesce(partitions).write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()

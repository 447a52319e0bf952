"""A keyed table of Parquet files that batches change bucket by bucket (R-01), and tables of the most frequent (R-06)."""

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.presence import present


class BucketTable:
    """Rows dealt over a fixed number of buckets by a hash of their key: `data/v=<batch>/_bucket=<k>`.

    A batch rewrites the buckets that its keys fall in and no others. Which version of each bucket counts is a manifest,
    one small file a batch, written after the buckets; it is what commits a batch. Batch n starts from the last manifest
    before n, so a batch that is repeated after a failure gives the same table again, whatever its first try has left.
    Rows without a key are spread by a hash of the columns `spread`, those that no merge changes in such rows.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, schema, spread: list[str], buckets: int = 64) -> None:
        self.spark, self.folder, self.key, self.schema, self.spread, self.buckets = spark, folder.rstrip("/"), key, schema, spread, buckets

    def bucketed(self, rows: DataFrame) -> DataFrame:
        place = F.when(present(self.key), F.xxhash64(self.key)).otherwise(F.xxhash64(*self.spread))
        return rows.withColumn("_bucket", F.pmod(place, F.lit(self.buckets)).cast("int"))

    def versions(self, before: int | None = None) -> dict[int, int]:
        """Bucket -> version of the last manifest (before a batch)."""
        system, path = pyarrow.fs.FileSystem.from_uri(self.folder)
        found = system.get_file_info(pyarrow.fs.FileSelector(f"{path}/manifest", allow_not_found=True))
        batches = [int(f.base_name[2:]) for f in found if f.base_name.startswith("v=") and system.get_file_info(f"{f.path}/_SUCCESS").is_file]
        batches = [b for b in batches if before is None or b < before]
        if not batches:
            return {}
        rows = self.spark.read.schema("bucket int, version bigint").parquet(f"{self.folder}/manifest/v={max(batches)}")
        return {r["bucket"]: r["version"] for r in rows.collect()}  # at most `buckets` rows

    def read(self, versions: dict[int, int] | None = None) -> DataFrame:
        versions = self.versions() if versions is None else versions
        paths = [f"{self.folder}/data/v={v}/_bucket={b}" for b, v in sorted(versions.items())]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def change(self, batch: DataFrame, number: int, merge) -> list[int]:
        """Rewrite the buckets of the batch's keys as merge(old rows, batch rows); returns their numbers."""
        dealt = self.bucketed(batch)
        touched = sorted(r[0] for r in dealt.select("_bucket").distinct().collect())  # at most `buckets` rows
        versions = self.versions(number)
        old = self.read({b: v for b, v in versions.items() if b in touched})
        if touched:
            new = self.bucketed(merge(old, batch))
            new.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/data/v={number}")
        versions |= dict.fromkeys(touched, number)
        listed = self.spark.createDataFrame(sorted(versions.items()), "bucket int, version bigint")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/v={number}")
        return touched

    def vacuum(self, before: int) -> int:
        """Drop the bucket versions that no manifest from batch `before` on names, and older manifests. The last manifest
        before it stays, as the next batch may start from it. Returns how many folders went."""
        system, path = pyarrow.fs.FileSystem.from_uri(self.folder)

        def numbers(folder: str) -> list[int]:
            found = system.get_file_info(pyarrow.fs.FileSelector(f"{path}/{folder}", allow_not_found=True))
            return sorted(int(f.base_name[2:]) for f in found if f.base_name.startswith("v="))

        manifests = numbers("manifest")
        kept = [m for m in manifests if m >= before] + [m for m in manifests if m < before][-1:]
        used = {(b, v) for m in kept for b, v in self.versions(m + 1).items()}
        gone = 0
        for v in numbers("data"):
            for f in system.get_file_info(pyarrow.fs.FileSelector(f"{path}/data/v={v}")):
                if f.base_name.startswith("_bucket=") and v < before and (int(f.base_name[8:]), v) not in used:
                    system.delete_dir(f.path)
                    gone += 1
        for m in set(manifests) - set(kept):
            system.delete_dir(f"{path}/manifest/v={m}")
        return gone


class TopTable:
    """The n most frequent values of each window, kept up to date by batches of counts that only grow.

    A batch brings the new counts of the values it has seen. Together with the n kept ones of the same windows they hold the new n:
    a value in neither has not grown and was not among them. Windows that a batch does not touch are not read or written;
    a window's last version counts.
    """

    def __init__(self, spark: SparkSession, folder: str, n: int, window: str, value: str, schema: str) -> None:
        self.spark, self.folder, self.n, self.window, self.value = spark, folder.rstrip("/"), n, window, value
        self.schema = f"{schema}, rank int"

    def latest(self, rows: DataFrame) -> DataFrame:
        last = rows.groupBy(self.window).agg(F.max("v").alias("v"))
        return rows.join(last, [self.window, "v"])

    def read(self, before: int | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{self.schema}, v bigint").option("recursiveFileLookup", False).parquet(self.folder)
        return self.latest(rows if before is None else rows.where(F.col("v") < before)).drop("v")

    def change(self, counts: DataFrame, number: int) -> None:
        """Ties go to the smaller value. A repeated batch overwrites its own version."""
        every = counts
        if number:
            kept = self.read(number).drop("rank").join(counts.select(self.window).distinct(), self.window, "left_semi")
            every = counts.unionByName(kept).groupBy(self.window, self.value).agg(F.max("n").alias("n"))
        order = Window.partitionBy(self.window).orderBy(F.desc("n"), F.asc(self.value))
        top = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.n)
        top.write.mode("overwrite").parquet(f"{self.folder}/v={number}")

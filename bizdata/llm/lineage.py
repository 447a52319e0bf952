"""Lineage cuts that also give back the disk of finished shuffles."""

from pyspark.sql import DataFrame

from ..session import cut_lineage


def settle(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back. Shuffle files go once the driver has collected what refers to them;
    a collection after each cut keeps the disk at what one step needs."""
    out = cut_lineage(df)
    del df  # the last reference to the plan that has run
    context = getattr(out.sparkSession, "_sc", None)  # a remote session has none; its server cleans up by itself
    if context is not None:
        context._jvm.System.gc()
    return out

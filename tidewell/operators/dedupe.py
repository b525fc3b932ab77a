"""First-wins deduplication, merges and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: Column, order: list[str], log: bool = False) -> DataFrame:
    """The first row of each key; with log, all rows with `kept`, the key and the number of earlier rows.

    The kept rows come from one aggregation with partial sums before the shuffle, so a hot key is no hot task.
    """
    keyed = df.withColumn("__key", key)
    if log:
        n = F.row_number().over(Window.partitionBy("__key").orderBy(*order))
        return keyed.withColumn("earlier", n - 1).withColumn("kept", F.col("earlier") == 0).withColumnRenamed("__key", "dedupe_key")
    rest = F.struct(*df.columns)
    return keyed.groupBy("__key").agg(F.min_by(rest, F.struct(*order)).alias("r")).select("r.*")


def merge_first(base: DataFrame, extra: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Base and extra, the first row of each key with base before extra."""
    both = base.withColumn("origin", F.lit(0)).unionByName(extra.withColumn("origin", F.lit(1)))
    return first_wins(both, key, ["origin", *order])


def upsert_groups(current: DataFrame, batch: DataFrame, group: str) -> DataFrame:
    """Rows of the current table but for the groups that the batch replaces, and the batch."""
    return current.join(batch.select(group).distinct(), group, "left_anti").unionByName(batch)


def append_unseen(current: DataFrame, delta: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The current table and the delta's rows with unseen keys, the first of each key."""
    new = first_wins(delta.join(current.select(key), key, "left_anti"), F.col(key), order)
    return current.unionByName(new.select(*current.columns))


def risky_keys(df: DataFrame, key: Column, out: str = "duplicate_risk") -> DataFrame:
    """df with whether its key occurs more than once; counted apart so that a hot key isn't one window."""
    keyed = df.withColumn("__key", key)
    often = keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__key", F.lit(True).alias(out))
    return keyed.join(often, "__key", "left").withColumn(out, F.coalesce(out, F.lit(False))).drop("__key")

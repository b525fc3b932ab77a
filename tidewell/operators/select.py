"""Ranking and selection; every order ends in a unique column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 1. Catalyst limits each partition before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns, in one aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def best_of(df: DataFrame, keys: list[str], score: Column, tie: Column) -> DataFrame:
    """The row with the highest score for each key; ties to the lowest `tie`."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(-score, tie)).alias("r")).select(*keys, "r.*")


def capped_select(df: DataFrame, group: str, sub: str, score: str, order: list[Column], threshold: float, cap: int, most: int, least: int) -> DataFrame:
    """Rows of each group by order: those at the threshold, at most `cap` of one sub and `most` in all.

    If fewer than `least` were taken, the rest fills up within the same caps. Columns added: selected, reason
    (`selected`, `backfill`, `domain_limit`, `low_quality`). A row counts as limited by its sub only if it comes before
    the selection was full.
    """
    sub_null_safe = F.coalesce(F.col(sub), F.lit(""))
    base = df.withColumns({"__sub": sub_null_safe, "__good": F.col(score) >= threshold})
    base = base.withColumn("__pos", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    in_sub = Window.partitionBy(group, "__sub", "__good").orderBy("__pos")
    base = base.withColumn("__nth", F.row_number().over(in_sub))
    base = base.withColumn("__fit", F.col("__good") & (F.col("__nth") <= cap))
    before = Window.partitionBy(group).orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    base = base.withColumn("__taken", F.sum(F.col("__fit").cast("int")).over(before))
    base = base.withColumn("__first", F.col("__fit") & (F.col("__taken") <= most))
    whole = Window.partitionBy(group)
    base = base.withColumns({"__n1": F.sum(F.col("__first").cast("int")).over(whole), "__sub1": F.sum(F.col("__first").cast("int")).over(Window.partitionBy(group, "__sub"))})
    # what is left fills up, best first, within each sub's residual cap
    rest = Window.partitionBy(group, "__sub", "__first").orderBy("__pos")
    base = base.withColumn("__room", ~F.col("__first") & (F.row_number().over(rest) + F.col("__sub1") <= cap))
    base = base.withColumn("__fill", F.sum(F.col("__room").cast("int")).over(before))
    base = base.withColumn("__second", F.col("__room") & (F.col("__n1") < least) & (F.col("__n1") + F.col("__fill") <= least))
    limited = F.col("__good") & (F.col("__nth") > cap) & (F.col("__taken") < most)
    reason = F.when(F.col("__first"), "selected").when(F.col("__second"), "backfill").when(limited, "domain_limit").otherwise("low_quality")
    out = base.withColumns({"selected": F.col("__first") | F.col("__second"), "reason": reason})
    return out.drop(*(c for c in out.columns if c.startswith("__")))


def diverse_pick(df: DataFrame, group: str, source: str, score: str, tie: str, bonus: float, k: int) -> DataFrame:
    """The k best of each group where the first pick of each source earns a bonus.

    Each source's rows are taken in falling order, so only its best can earn the bonus: sorting by score plus bonus
    equals the greedy choice. Needs unique, non-null ties.
    """
    nth = F.row_number().over(Window.partitionBy(group, source).orderBy(F.desc(score), F.asc(tie)))
    adjusted = F.round(F.col(score) + F.when(nth == 1, bonus).otherwise(0.0), 6)
    out = df.withColumn("adjusted", adjusted)
    return top_k(out, [group], [F.desc("adjusted"), F.desc(score), F.asc(tie)], k)


def numbered(df: DataFrame, group: str, order: list[Column], prefix: Column, width: int = 3, out: str = "seq_id") -> DataFrame:
    """Sequential ids within each group."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn(out, F.concat(prefix, F.lpad(n.cast("string"), F.greatest(F.lit(width), F.length(n.cast("string"))), F.lit("0"))))


def fill_ids(df: DataFrame, group: str, number: str, order: list[Column], out: str = "number_filled") -> DataFrame:
    """Rows without a number get, in order, the smallest numbers of their group that no row uses."""
    empty = df.where(F.col(number).isNull())
    used = df.where(F.col(number).isNotNull())
    asked = empty.withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    free = sizes.select(group, F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("__free")).join(used.select(group, F.col(number).cast("int").alias("__free")), [group, "__free"], "left_anti")
    free = free.withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy("__free")))
    given = asked.join(free, [group, "__k"]).select(*df.columns, F.col("__free").alias(out))
    return given.unionByName(used.withColumn(out, F.col(number).cast("int")))


def hash_order(*parts: Column, seed: str) -> Column:
    """A reproducible pseudo-random order, the same in any engine that has MD5."""
    return F.md5(F.concat_ws("|", *parts, F.lit(seed)))


def split_by_group(df: DataFrame, group: str, shares: dict[str, float], seed: str) -> DataFrame:
    """(group, split): groups in hash order, the first round(n x share) to each split, the rest to the last."""
    groups = df.select(group).distinct()
    # ranks by range: one count for each leading hash digit pair, so no single task sorts all groups
    h = groups.withColumn("__h", hash_order(F.col(group), seed=seed)).withColumn("__b", F.left("__h", F.lit(2)))
    sizes = h.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 256 rows
    total = sizes.agg(F.sum("__n").alias("__total"))
    ranked = h.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("__h"))).join(F.broadcast(starts), "__b").join(F.broadcast(total))
    position = F.col("__r") + F.col("__start")
    names = list(shares)
    out, edge = None, F.lit(0)
    for name in names[:-1]:
        edge = edge + F.round(F.col("__total") * shares[name]).cast("long")
        out = F.when(position <= edge, name) if out is None else out.when(position <= edge, name)
    return ranked.select(group, out.otherwise(names[-1]).alias("split"))


def negative_samples(df: DataFrame, group: str, id_col: str, own: str, pool: DataFrame, pool_id: str, k: int, seed: str) -> DataFrame:
    """(id, negative): for each row k items of its group's pool, in hash order, that it doesn't own."""
    pairs = df.select(group, F.col(id_col).alias("id"), F.col(own).alias("__own")).join(pool.select(group, F.col(pool_id).alias("negative")).distinct(), group)
    pairs = pairs.where(~F.array_contains("__own", F.col("negative")))
    return top_k(pairs, ["id"], [hash_order(F.col("id"), F.col("negative"), seed=seed), F.col("negative")], k).select("id", "negative")

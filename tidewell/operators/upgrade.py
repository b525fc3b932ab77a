"""Schema upgrades with a count of each change."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.validate import is_missing


@dataclass(frozen=True)
class Upgrade:
    """What changes: old to new names, defaults for missing values, dropped columns, and the final order."""

    renames: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)
    drops: list[str] = field(default_factory=list)
    order: list[str] = field(default_factory=list)


def upgraded(df: DataFrame, upgrade: Upgrade) -> tuple[DataFrame, DataFrame]:
    """(table, changes): the upgraded table, and one row with how many values each default filled.

    A value under an old name is kept unless the new name already has one; absent columns are added.
    """
    for old, new in upgrade.renames.items():
        if old in df.columns:
            df = df.withColumn(new, F.when(is_missing(df, new), F.col(old)).otherwise(F.col(new))).drop(old) if new in df.columns else df.withColumnRenamed(old, new)
    counts = []
    for c, value in upgrade.defaults.items():
        lit = F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)
        missing = is_missing(df, c) if c in df.columns else F.lit(True)
        counts.append(F.count(F.when(missing, 1)).alias(f"filled_{c}"))
        df = df.withColumn(f"__{c}", F.when(missing, lit).otherwise(F.col(c)) if c in df.columns else lit)
    changes = df.agg(*counts) if counts else df.limit(0).agg(F.count(F.lit(1)).alias("filled"))
    for c in upgrade.defaults:
        df = (df.drop(c) if c in df.columns else df).withColumnRenamed(f"__{c}", c)
    df = df.drop(*upgrade.drops)
    rest = [c for c in df.columns if c not in upgrade.order]
    return df.select(*(c for c in upgrade.order if c in df.columns), *rest), changes

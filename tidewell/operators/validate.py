"""Validation: every check yields rows of violations, none stops at the first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import blank


def violations(df: DataFrame, id_col: str, checks: dict[str, Column]) -> DataFrame:
    """(id, check) for each row and each check whose condition is true; null conditions count as false."""
    hits = F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in checks.items()))
    return df.select(F.col(id_col).alias("id"), F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("check"))


def is_missing(df: DataFrame, column: str) -> Column:
    """Null, blank, or an empty list or map."""
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    if kind == "string":
        return blank(c)
    if kind in ("array", "map"):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def missing_fields(df: DataFrame, id_col: str, fail: list[str], warn: list[str] = ()) -> DataFrame:
    """(id, field, severity): one row for each missing field."""
    fields = [(f, "FAIL") for f in fail] + [(f, "WARN") for f in warn]
    hits = F.array(*(F.when(is_missing(df, f), F.struct(F.lit(f).alias("field"), F.lit(s).alias("severity"))) for f, s in fields))
    return df.select(F.col(id_col).alias("id"), F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("h")).select("id", "h.*")


def all_strings(c: Column) -> Column:
    """A non-empty list of non-blank strings."""
    return F.coalesce((F.size(c) > 0) & F.forall(c, lambda x: ~blank(x)), F.lit(False))


def factual_window(window: Column) -> Column:
    """A time window whose start and end aren't blank."""
    return ~blank(window["start"]) & ~blank(window["end"])


def sound_entities(entities: Column) -> Column:
    """A map with non-blank keys and lists of non-blank strings."""
    return F.coalesce((F.size(entities) > 0) & F.forall(F.map_entries(entities), lambda e: ~blank(e["key"]) & all_strings(e["value"])), F.lit(False))


def holds_marker(df: DataFrame, columns: list[str], markers: list[str]) -> Column:
    """Whether any value, at any depth, holds a marker word, without regard to case; keys don't count."""
    texts = [F.lower(F.to_json(F.struct(c)) if df.schema[c].dataType.typeName() != "map" else F.to_json(F.map_values(c))) for c in columns]
    names = "|".join(f'"{c}":' for c in columns)
    values = [F.regexp_replace(t, names.lower(), "") for t in texts]
    return reduce(lambda a, b: a | b, (F.contains(F.coalesce(v, F.lit("")), F.lit(m.lower())) for v in values for m in markers))


def missing_parents(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(key, n): keys of the child without a parent, with their rows. Without any parent nothing is checked."""
    lost = child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
    some = parent.limit(1).select(F.lit(1).alias("__some"))
    return lost.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(some)).drop("__some")


def bad_references(df: DataFrame, id_col: str, group_col: str, refs_col: str, targets: DataFrame, target_id: str, target_group: str) -> DataFrame:
    """(id, ref, problem): references to nothing (`unknown`), or to a target of another group (`other_group`)."""
    refs = df.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), F.explode(refs_col).alias("ref"))
    known = targets.groupBy(F.col(target_id).alias("ref")).agg(F.collect_set(target_group).alias("groups"))
    problem = F.when(F.col("groups").isNull(), "unknown").when(~F.array_contains("groups", F.col("grp")), "other_group")
    return refs.join(known, "ref", "left").select("id", "ref", problem.alias("problem")).where("problem IS NOT NULL")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def first_reason(reasons: list[tuple[str, Column]], fine: str = "ok") -> Column:
    """The first reason whose condition holds; `fine` for none."""
    out = None
    for name, cond in reasons:
        cond = F.coalesce(cond, F.lit(False))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(fine)


def gate(df: DataFrame, fatal: list[str], warning: list[str]) -> DataFrame:
    """One row with status `failed` if any fatal count is above 0, else `warning`, else `passed`."""
    any_of = lambda cs: reduce(lambda a, b: a | b, (F.col(c) > 0 for c in cs), F.lit(False))
    return df.withColumn("status", F.when(any_of(fatal), "failed").when(any_of(warning), "warning").otherwise("passed"))

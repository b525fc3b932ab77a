"""Query planning as relational expansion of small arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import blank
from tidewell.operators.dedupe import first_wins
from tidewell.operators.select import top_k


def expand_queries(events: DataFrame, templates: list[tuple[str, str]], sources: list[str], seeds: int = 2, hints: int = 2) -> DataFrame:
    """(event_id, query, source, kind, position): seeds by source and template, then seeds with hints; first of equals.

    templates: (kind, pattern with {seed}).
    """
    first = lambda c, n: F.slice(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: ~blank(x)), 1, n)
    base = events.select("event_id", F.posexplode(first("query_seeds", seeds)).alias("seed_no", "seed"), first("stakeholder_hints", hints).alias("people"), first("stance_hints", hints).alias("stances"), first("temporal_stages", hints).alias("stages"))
    plain = base.select("event_id", "seed_no", "seed", F.posexplode(F.array(*map(F.lit, sources))).alias("source_no", "source"))
    made = F.array(*(F.struct(F.lit(i).alias("n"), F.lit(kind).alias("kind"), F.replace(F.lit(pattern), F.lit("{seed}"), F.col("seed")).alias("query")) for i, (kind, pattern) in enumerate(templates)))
    plain = plain.select("event_id", "source", F.explode(made).alias("q"), (F.col("seed_no") * 100 + F.col("source_no") * 10).alias("p")).select("event_id", "q.query", "source", "q.kind", (F.col("p") + F.col("q.n")).cast("long").alias("position"))
    more = F.concat(F.transform("people", lambda x: F.struct(F.lit("stakeholder").alias("kind"), x.alias("x"))), F.transform("stances", lambda x: F.struct(F.lit("stance").alias("kind"), x.alias("x"))), F.transform("stages", lambda x: F.struct(F.lit("stage").alias("kind"), x.alias("x"))))
    wide = base.select("event_id", "seed", "seed_no", F.posexplode(more).alias("n", "m")).select("event_id", F.concat_ws(" ", "seed", "m.x").alias("query"), F.lit("any").alias("source"), "m.kind", (F.lit(1000) + F.col("seed_no") * 100 + F.col("n")).cast("long").alias("position"))
    both = plain.unionByName(wide)
    return first_wins(both, F.struct("event_id", "query", "source"), ["position"])


def budgeted(queries: DataFrame, budget: int) -> DataFrame:
    """The first `budget` queries of each event."""
    return top_k(queries, ["event_id"], [F.asc("position"), F.asc("query"), F.asc("source")], budget)


def repair_gap(report: DataFrame) -> DataFrame:
    """(event_id, gap): what to repair first: official source, then other sources, then content, then volume."""
    gap = F.when(~F.col("has_official"), "official").when(~F.col("has_interaction"), "source").when((F.col("n_stakeholders") < 2) | (F.col("n_stances") < 2) | (F.col("n_stages") < 3), "semantic").when(F.col("n_rows") < 20, "low_volume").otherwise("none")
    return report.select("event_id", gap.alias("gap"))


def site_queries(events: DataFrame, hosts: DataFrame, per_event: int = 2) -> DataFrame:
    """(event_id, query): the first seed of each event on each of its commonest hosts."""
    ranked = top_k(hosts, ["event_id"], [F.desc("n"), F.asc("host")], per_event)
    seed = events.select("event_id", F.try_element_at("query_seeds", F.lit(1)).alias("seed"))
    return ranked.join(seed, "event_id").where(F.contains("host", F.lit("."))).select("event_id", F.concat(F.lit("site:"), "host", F.lit(" "), "seed").alias("query"))


def round_budget(items: DataFrame, group: str, source: str, order: str, per_source: int, total: int) -> DataFrame:
    """Items within `per_source` of each source and `total` of each group, in order."""
    first = top_k(items, [group, source], [F.asc(order)], per_source, "source_rank")
    return top_k(first, [group], [F.asc("source_rank"), F.asc(order)], total, "group_rank")

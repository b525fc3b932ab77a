"""Additive scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.cells import clamped
from tidewell.functions.text import matched_terms


def rounded(c: Column, places: int = 4) -> Column:
    """Rounded with a billionth added, so that halves go up whatever the last bit of the sum."""
    return F.round(c + 1e-9, places)


def additive(base: float, terms: dict[str, tuple[Column, float]], places: int = 4) -> tuple[Column, Column]:
    """(score, flags): base plus the weight of each condition that holds, within [0, 1]; flags name those below 0."""
    parts = [F.when(F.coalesce(c, F.lit(False)), F.lit(float(w))).otherwise(0.0) for c, w in terms.values()]
    score = F.round(clamped(reduce(lambda a, b: a + b, parts, F.lit(float(base)))), places)
    bad = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, (c, w) in terms.items() if w < 0)), lambda x: x.isNotNull())
    return score, bad


def capped_hits(text: Column, title: Column, terms: Column, each: float, most: float, title_gain: float = 1.35) -> Column:
    """min(most, each x terms in the text), a term in the title counting title_gain times."""
    hit = F.aggregate(terms, F.lit(0.0), lambda s, t: s + F.when(t == "", 0.0).when(F.contains(F.coalesce(title, F.lit("")), t), F.lit(each * title_gain)).when(F.contains(text, t), F.lit(each)).otherwise(0.0))
    return F.least(F.lit(most), F.coalesce(hit, F.lit(0.0)))


def event_relevance(same_event: Column, text: Column, title: Column, name_terms: Column, description_terms: Column, seed_terms: Column, stakeholders: Column, penalty: Column) -> Column:
    """0.20 for the same event, capped term hits, up to 0.08 for stakeholders, less the generic penalty.

    The penalty shrinks to 15 % where a name term matched; a page without any specific term stays at 0.20 at most.
    """
    named = capped_hits(text, title, name_terms, 0.16, 0.34)
    described = capped_hits(text, title, description_terms, 0.10, 0.22)
    seeded = capped_hits(text, title, seed_terms, 0.12, 0.28)
    people = F.least(F.lit(0.08), 0.025 * F.size(F.filter(stakeholders, lambda s: F.contains(text, s))))
    specific = named > 0
    raw = F.when(same_event, 0.20).otherwise(0.0) + named + described + seeded + F.coalesce(people, F.lit(0.0)) - penalty * F.when(specific, 0.15).otherwise(1.0)
    generic_only = (penalty > 0) & ~specific & (seeded == 0)
    return rounded(clamped(F.when(generic_only, F.least(raw, F.lit(0.20))).otherwise(raw)))


def stage_keyword_score(text: Column, strong: list[str], weak: list[str]) -> Column:
    """min(1, 0.32 a strong term + 0.06 a weak one); without a strong term at most 0.18."""
    s, w = F.size(matched_terms(text, strong)), F.size(matched_terms(text, weak))
    raw = F.least(F.lit(1.0), 0.32 * s + 0.06 * w)
    return F.round(F.when(s > 0, raw).otherwise(F.least(raw, F.lit(0.18))), 4)


def stage_keyword_details(text: Column, source: Column, strong: list[str], weak: list[str], capped: float | None = None, official: list[str] | None = None) -> tuple[Column, Column]:
    """(score, terms): min(1, 0.32 a strong hit + 0.06 a weak one), `capped` without a strong hit.

    official: terms of which one in an official text is a strong hit of its own, named official_response_result.
    """
    hits = matched_terms(text, strong)
    if official:
        own = F.when((source == "official") & (F.size(matched_terms(text, official)) > 0), F.array(F.lit("official_response_result"))).otherwise(F.array().cast("array<string>"))
        hits = F.concat(hits, own)
    low = matched_terms(text, weak)
    raw = F.least(F.lit(1.0), 0.32 * F.size(hits) + 0.06 * F.size(low))
    if capped is not None:
        raw = F.when(F.size(hits) > 0, raw).otherwise(F.least(raw, F.lit(capped)))
    return F.round(raw, 4), F.array_distinct(F.concat(hits, low))


def chain_confidence_full(rows: DataFrame, group: str, core: list[str], stages: int) -> DataFrame:
    """(group, core_coverage, generic_ratio, top_domain_ratio, penalty, confidence) of a group's selected stage rows.

    rows: (group, stage, source, domain, final, relevance, generic). Coverage of core and all stages, mean score and
    relevance and up to four sources add; generic pages, a leading domain, missing core stages and low relevance take
    off; below a mean relevance of 0.30 the confidence is 0.60 at most.
    """
    known = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.col(c))
    lead = rows.where(known("domain").isNotNull()).groupBy(group, "domain").agg(F.count(F.lit(1)).alias("n")).groupBy(group).agg(F.max("n").alias("lead"))
    main = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(F.when(F.col("stage").isin(core), F.col("stage"))).alias("n_core"), F.countDistinct("stage").alias("n_stages"), F.avg(F.coalesce("final", F.lit(0.0))).alias("score"),
        F.avg(F.coalesce("relevance", F.lit(0.0))).alias("relevance"), F.countDistinct(known("source")).alias("n_sources"), F.count_if(F.coalesce("generic", F.lit(False))).alias("n_generic"),
    )
    m = main.join(lead, group, "left").withColumns({"core_coverage": F.col("n_core") / len(core), "generic_ratio": F.col("n_generic") / F.col("n"), "top_domain_ratio": F.coalesce(F.col("lead"), F.lit(0)) / F.col("n")})
    penalty = 0.20 * F.col("generic_ratio") + 0.15 * F.greatest(F.lit(0.0), F.col("top_domain_ratio") - 0.5) + 0.20 * (1 - F.col("core_coverage")) + F.when(F.col("relevance") < 0.35, 0.15).otherwise(0.0)
    m = m.withColumn("penalty", penalty)
    raw = clamped(0.28 * F.col("core_coverage") + 0.14 * F.col("n_stages") / stages + 0.22 * F.col("score") + 0.24 * F.col("relevance") + 0.12 * F.least(F.lit(1.0), F.col("n_sources") / 4) - F.col("penalty"))
    confidence = F.when(F.col("relevance") < 0.30, F.least(raw, F.lit(0.60))).otherwise(raw)
    return m.select(group, *(F.round(c, 4).alias(c) for c in ("core_coverage", "generic_ratio", "top_domain_ratio", "penalty")), rounded(confidence).alias("confidence"))


def final_stage_score(keyword: Column, relevance: Column, quality: Column, prior: Column, stakeholder: Column, generic: Column) -> Column:
    """Weighted sum; quality 0.5 where unknown, and at most 0.24 below a relevance of 0.30."""
    raw = 0.40 * keyword + 0.25 * relevance + 0.15 * F.coalesce(quality, F.lit(0.5)) + 0.10 * prior + 0.10 * stakeholder - 0.12 * generic
    return rounded(clamped(F.when(relevance < 0.30, F.least(raw, F.lit(0.24))).otherwise(raw)))


def chain_confidence(rows: DataFrame, group: str, stage: str, score: str, domain: str, stages: int) -> DataFrame:
    """(group, coverage, mean_score, top_domain_share, confidence) from a group's selected stage rows.

    0.5 coverage + 0.4 mean score + 0.1 (1 - top domain share), 4 places.
    """
    per = rows.groupBy(group, domain).agg(F.count(F.lit(1)).alias("n")).groupBy(group).agg((F.max("n") / F.sum("n")).alias("top_domain_share"))
    main = rows.groupBy(group).agg((F.countDistinct(stage) / stages).alias("coverage"), F.avg(score).alias("mean_score"))
    out = main.join(per, group)
    conf = rounded(0.5 * F.col("coverage") + 0.4 * F.col("mean_score") + 0.1 * (1 - F.col("top_domain_share")))
    return out.select(group, F.round("coverage", 4).alias("coverage"), F.round("mean_score", 4).alias("mean_score"), F.round("top_domain_share", 4).alias("top_domain_share"), conf.alias("confidence"))

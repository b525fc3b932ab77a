"""Rule-based classification; rules are data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import contains_any, first_matched, matched_terms
from tidewell.functions.urls import in_domains


@dataclass(frozen=True)
class SourceRule:
    """One step of a source decision list."""

    label: str
    domains: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    confidence: float = 1.0


def decide_source(host: Column, text: Column, rules: list[SourceRule], default: tuple[str, float] = ("public_web", 0.2), given: Column | None = None) -> Column:
    """struct<label, rule, matched, confidence>: what is given stays, else the first rule whose domain or keyword fits."""
    made = lambda label, rule, matched, conf: F.struct(label.alias("label"), F.lit(rule).alias("rule"), matched.alias("matched"), F.lit(float(conf)).alias("confidence"))
    out = F.when(F.coalesce(F.trim(given) != "", F.lit(False)), made(F.trim(given), "given", F.lit(""), 1.0)) if given is not None else F.when(F.lit(False), made(F.lit(""), "", F.lit(""), 0))
    for r in rules:
        if r.domains:
            out = out.when(in_domains(host, r.domains), made(F.lit(r.label), "domain", host, r.confidence))
        if r.keywords:
            hit = first_matched(text, r.keywords)
            out = out.when(hit != "", made(F.lit(r.label), "keyword", hit, r.confidence))
    return out.otherwise(made(F.lit(default[0]), "default", F.lit(""), default[1]))


def rule_rows(df: DataFrame, id_col: str, text_col: str, rules: list[tuple[str, str, list[str], float]], margin: int = 28) -> DataFrame:
    """(id, rule_id, label, term, excerpt, confidence): the first term of each rule (id, label, terms, confidence) in each text."""
    low = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lower(F.col(text_col)).alias("low"))
    rows = []
    for rule_id, label, terms, confidence in rules:
        term = F.lit("")
        for t in reversed(terms):
            term = F.when(F.contains("low", F.lit(t.lower())), t).otherwise(term)
        rows.append(F.struct(F.lit(rule_id).alias("rule_id"), F.lit(label).alias("label"), term.alias("term"), F.lit(confidence).alias("confidence")))
    hits = low.select("id", "text", F.explode(F.filter(F.array(*rows), lambda r: r["term"] != "")).alias("r")).select("id", "text", "r.*")
    at = hits.withColumn("at", F.call_function("instr", F.col("text"), F.col("term")))
    start = F.greatest(F.lit(1), F.col("at") - margin)
    return at.select("id", "rule_id", "label", "term", F.when(F.col("at") > 0, F.substring("text", start, F.col("at") - start + F.length("term") + margin)).otherwise("").alias("excerpt"), "confidence")


def group_hits(text: Column, groups: dict[str, list[str]], most: int | None = None) -> Column:
    """Names of the groups with a term in the text, in order, at most `most`."""
    hits = F.filter(F.array(*(F.when(contains_any(text, terms), F.lit(name)) for name, terms in groups.items())), lambda x: x.isNotNull())
    return hits if most is None else F.slice(hits, 1, most)


def only_group(text: Column, groups: dict[str, list[str]]) -> Column:
    """The one group that has a term in the text; null for none or several."""
    hits = group_hits(text, groups)
    return F.when(F.size(hits) == 1, hits[0])


def generic_penalty(text: Column, patterns: list[str], topics: list[str]) -> Column:
    """0 without a pattern, else min(0.32, 0.10 + 0.08 a pattern + 0.025 a topic)."""
    p, t = F.size(matched_terms(text, patterns)), F.size(matched_terms(text, topics))
    return F.when(p == 0, 0.0).otherwise(F.least(F.lit(0.32), 0.10 + 0.08 * p + 0.025 * t))


def flags(conditions: dict[str, Column]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in conditions.items())), lambda x: x.isNotNull())


def support_label(score: Column, supported: float = 0.7, partial: float = 0.4) -> Column:
    return F.when(score >= supported, "supported").when(score >= partial, "partially_supported").otherwise("insufficient_evidence")

"""Queries that classify, score and select evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text, urls
from tidewell.operators import aggregate, classify, score, select
from tidewell.plans.catalog import CLAIMS, EVENTS, EVIDENCE, query
from tidewell.session import spread
from tidewell.sources.tables import table

OFFICIAL, NEWS, SOCIAL = ["m.gadogi1.example", "news.tufine7.example"], ["m.meteru0.example", "live.siletu6.example"], ["m.razole3.example"]
PLACES, TIMES, DISPUTES, GENERIC, TOPICS = ["小区", "社区", "新村"], ["2023", "2024"], ["质疑", "反对", "争议"], ["工作日", "答复", "公示"], ["停车", "教育", "医院"]
STAGES = {
    "trigger": (["引发", "起初"], ["发现"]),
    "conflict": (["质疑", "反对", "各执一词"], ["争议"]),
    "response": (["回应", "答复"], ["公布"]),
}
PRIORITY = {"trigger": 1, "conflict": 2, "response": 3}
RULES = [("r1", "dispute", DISPUTES, 0.9), ("r2", "reply", ["答复", "回应"], 0.7), ("r3", "safety", ["安全隐患", "泄漏"], 0.8)]


def _ok(c: str) -> Column:
    return ~text.blank(F.col(c))


def quality_terms() -> dict[str, tuple[Column, float]]:
    t = F.col("text")
    return {
        "has_url": (_ok("url"), 0.10), "has_time": (_ok("publish_time"), 0.10), "has_platform": (_ok("platform"), 0.10), "long_text": (F.length(t) >= 400, 0.15), "place": (text.contains_any(t, PLACES), 0.15),
        "time": (text.contains_any(t, TIMES), 0.10), "dispute": (text.contains_any(t, DISPUTES), 0.15), "official": (F.col("source_type") == "official", 0.15),
        "short_text": (F.coalesce(F.length(t), F.lit(0)) < 100, -0.30), "no_title": (~_ok("title"), -0.10), "no_dispute": (~F.coalesce(text.contains_any(t, DISPUTES), F.lit(False)), -0.05), "forum": (F.col("source_type") == "forum", -0.05),
    }


def _any_sql(terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(text, '{t}')" for t in terms) + ")"


_OK = lambda c: f"({c} IS NOT NULL AND trim({c}) <> '')"
_QUALITY = (
    "least(1.0, greatest(0.0, 0.0"
    + "".join(
        f" + CASE WHEN coalesce({c}, false) THEN {w} ELSE 0.0 END"
        for c, w in [
            (_OK("url"), "0.10"), (_OK("publish_time"), "0.10"), (_OK("platform"), "0.10"), ("length(text) >= 400", "0.15"), (_any_sql(PLACES), "0.15"), (_any_sql(TIMES), "0.10"), (_any_sql(DISPUTES), "0.15"), ("source_type = 'official'", "0.15"),
            ("coalesce(length(text), 0) < 100", "-0.30"), (f"NOT {_OK('title')}", "-0.10"), (f"NOT coalesce({_any_sql(DISPUTES)}, false)", "-0.05"), ("source_type = 'forum'", "-0.05"),
        ]
    )
    + "))"
)


def scored_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, bad = score.additive(0.0, quality_terms())
    return table(spark, sf_dir, EVIDENCE).withColumns({"score": value, "flags": bad})


@query(
    f"""SELECT evidence_id, ingested_at, round(({_QUALITY})::DOUBLE, 4) AS score,
      array_to_string(list_filter([CASE WHEN coalesce(length(text), 0) < 100 THEN 'short_text' END, CASE WHEN NOT {_OK('title')} THEN 'no_title' END, CASE WHEN NOT coalesce({_any_sql(DISPUTES)}, false) THEN 'no_dispute' END, CASE WHEN source_type = 'forum' THEN 'forum' END], lambda x: x IS NOT NULL), '|') AS flags
    FROM {EVIDENCE}"""
)
def evidence_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive quality score and the flags that lowered it."""
    return scored_evidence(spark, sf_dir).select("evidence_id", "ingested_at", "score", F.array_join("flags", "|").alias("flags"))


@query(
    f"""WITH b AS (SELECT event_id, evidence_id, ingested_at, coalesce(domain, '') AS d, round(({_QUALITY})::DOUBLE, 4) AS s FROM {EVIDENCE}),
    p AS (SELECT *, s >= 0.5 AS good, row_number() OVER (PARTITION BY event_id ORDER BY s DESC, evidence_id, ingested_at) AS pos FROM b),
    n AS (SELECT *, row_number() OVER (PARTITION BY event_id, d, good ORDER BY pos) AS nth FROM p),
    t AS (SELECT *, good AND nth <= 3 AS fit, sum((good AND nth <= 3)::INT) OVER (PARTITION BY event_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS taken FROM n),
    f AS (SELECT *, fit AND taken <= 10 AS one FROM t),
    g AS (SELECT *, sum(one::INT) OVER (PARTITION BY event_id) AS n1, sum(one::INT) OVER (PARTITION BY event_id, d) AS sub1, row_number() OVER (PARTITION BY event_id, d, one ORDER BY pos) AS rest FROM f),
    h AS (SELECT *, NOT one AND rest + sub1 <= 3 AS room FROM g),
    i AS (SELECT *, sum(room::INT) OVER (PARTITION BY event_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS fill FROM h),
    j AS (SELECT *, room AND n1 < 6 AND n1 + fill <= 6 AS two FROM i)
    SELECT event_id, evidence_id, ingested_at, s AS score, CASE WHEN one THEN 'selected' WHEN two THEN 'backfill' WHEN good AND nth > 3 AND taken < 10 THEN 'domain_limit' ELSE 'low_quality' END AS reason FROM j"""
)
def evidence_quality_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection for each event: by quality, at most 3 of a domain and 10 in all, filled up to 6; with the reason."""
    out = select.capped_select(scored_evidence(spark, sf_dir), "event_id", "domain", "score", [F.desc("score"), F.asc("evidence_id"), F.asc("ingested_at")], 0.5, 3, 10, 6)
    return out.select("event_id", "evidence_id", "ingested_at", "score", "reason")


@query(
    f"""WITH h AS (SELECT evidence_id, ingested_at, coalesce(trim(source), '') AS given, regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), '^www[.]', '') AS host, coalesce(title, '') AS title FROM {EVIDENCE})
    SELECT evidence_id, ingested_at,
      CASE WHEN given <> '' THEN given WHEN host IN ('m.razole3.example') THEN 'public_social' WHEN host IN ('m.gadogi1.example', 'news.tufine7.example') THEN 'official' WHEN contains(title, '回应') THEN 'official' WHEN host IN ('m.meteru0.example', 'live.siletu6.example') THEN 'mainstream_news' ELSE 'public_web' END AS label,
      CASE WHEN given <> '' THEN 'given' WHEN host IN ('m.razole3.example', 'm.gadogi1.example', 'news.tufine7.example') THEN 'domain' WHEN contains(title, '回应') THEN 'keyword' WHEN host IN ('m.meteru0.example', 'live.siletu6.example') THEN 'domain' ELSE 'default' END AS rule
    FROM h"""
)
def source_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source type by a decision list over given values, domains and title words."""
    rules = [classify.SourceRule("public_social", SOCIAL, [], 0.9), classify.SourceRule("official", OFFICIAL, ["回应"], 0.75), classify.SourceRule("mainstream_news", NEWS, [], 0.8)]
    got = classify.decide_source(urls.host_of(F.col("url")), F.coalesce("title", F.lit("")), rules, given=F.col("source"))
    return table(spark, sf_dir, EVIDENCE).select("evidence_id", "ingested_at", got.alias("g")).select("evidence_id", "ingested_at", "g.label", "g.rule")


@query(
    f"""WITH r AS (SELECT evidence_id AS id, ingested_at, text, unnest([{{'rule_id': 'r1', 'label': 'dispute', 'terms': {DISPUTES}}}, {{'rule_id': 'r2', 'label': 'reply', 'terms': ['答复', '回应']}}, {{'rule_id': 'r3', 'label': 'safety', 'terms': ['安全隐患', '泄漏']}}]) AS r FROM {EVIDENCE} WHERE text IS NOT NULL),
    t AS (SELECT id, r.rule_id, r.label, list_filter(r.terms, lambda t: contains(text, t))[1] AS term, text FROM r)
    SELECT id, rule_id, label, term, substring(text, greatest(1, instr(text, term) - 28), instr(text, term) - greatest(1, instr(text, term) - 28) + len(term) + 28) AS excerpt FROM t WHERE term IS NOT NULL"""
)
def rule_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First matching term of each rule in each page, with its surroundings."""
    return classify.rule_rows(spread(table(spark, sf_dir, EVIDENCE).where("text IS NOT NULL").select("evidence_id", "text")), "evidence_id", "text", RULES).drop("confidence")


@query(
    f"""WITH p AS (SELECT evidence_id, ingested_at, text, len(list_filter({GENERIC}, lambda t: contains(text, t))) AS p, len(list_filter({TOPICS}, lambda t: contains(text, t))) AS t FROM {EVIDENCE} WHERE text IS NOT NULL),
    s AS (SELECT *, list_filter([CASE WHEN contains(text, '引发') OR contains(text, '起初') THEN 'trigger' END, CASE WHEN contains(text, '质疑') OR contains(text, '反对') OR contains(text, '各执一词') THEN 'conflict' END, CASE WHEN contains(text, '回应') OR contains(text, '答复') THEN 'response' END], lambda x: x IS NOT NULL) AS g FROM p)
    SELECT evidence_id, ingested_at, CASE WHEN p = 0 THEN 0.0 ELSE round(least(0.32, 0.10 + 0.08 * p + 0.025 * t)::DOUBLE, 6) END AS penalty, array_to_string(list_slice(g, 1, 2), '|') AS stages, CASE WHEN len(g) = 1 THEN g[1] END AS only_stage, p > 0 AND NOT (contains(text, '质疑') OR contains(text, '反对') OR contains(text, '争议')) AS policy_only FROM s"""
)
def rule_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generic penalty, first two stages, the only stage, and whether a page speaks of policy alone."""
    t = F.col("text")
    groups = {k: v[0] for k, v in STAGES.items()}
    policy = text.contains_any(t, GENERIC) & ~text.contains_any(t, DISPUTES)
    return table(spark, sf_dir, EVIDENCE).where(t.isNotNull()).select("evidence_id", "ingested_at", F.round(classify.generic_penalty(t, GENERIC, TOPICS), 6).alias("penalty"), F.array_join(classify.group_hits(t, groups, 2), "|").alias("stages"), classify.only_group(t, groups).alias("only_stage"), policy.alias("policy_only"))


def relevance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence with the relevance to its event."""
    none = F.array().cast("array<string>")
    events = table(spark, sf_dir, EVENTS).select("event_id", F.coalesce(F.transform("query_seeds", lambda s: F.substring_index(s, " ", 1)), none).alias("seeds"), F.coalesce(F.filter("stakeholder_hints", lambda s: s.isNotNull() & (F.trim(s) != "")), none).alias("people"), F.coalesce(F.map_values("location"), none).alias("places"))
    e = table(spark, sf_dir, EVIDENCE).where("text IS NOT NULL").join(events, "event_id")
    penalty = classify.generic_penalty(F.col("text"), GENERIC, TOPICS)
    value = score.event_relevance(F.lit(True), F.col("text"), F.col("title"), F.col("seeds"), F.col("places"), none, F.col("people"), penalty)
    return e.select("event_id", "evidence_id", "ingested_at", "text", "domain", "source_type", "quality_score", value.alias("relevance"))


def _capped_sql(terms: str, each: float, most: float) -> str:
    return f"least({most}e0, list_sum(list_transform(list_prepend('', {terms}), lambda t: CASE WHEN t = '' THEN 0e0 WHEN contains(coalesce(title, ''), t) THEN {each * 1.35!r}e0 WHEN contains(text, t) THEN {each}e0 ELSE 0e0 END)))"


_RELEVANCE = f"""
    ev AS (SELECT event_id, coalesce(list_transform(query_seeds, lambda s: split_part(s, ' ', 1)), []) AS seeds, coalesce(list_filter(stakeholder_hints, lambda s: s IS NOT NULL AND trim(s) <> ''), []) AS people, coalesce(map_values(location), []) AS places FROM {EVENTS}),
    a AS (SELECT e.*, ev.* EXCLUDE (event_id), len(list_filter({GENERIC}, lambda t: contains(text, t))) AS p, len(list_filter({TOPICS}, lambda t: contains(text, t))) AS tt FROM {EVIDENCE} e JOIN ev ON e.event_id = ev.event_id WHERE text IS NOT NULL),
    b AS (SELECT *, {_capped_sql('seeds', 0.16, 0.34)} AS named, {_capped_sql('places', 0.10, 0.22)} AS described, coalesce(least(0.08e0, 0.025e0 * len(list_filter(people, lambda s: contains(text, s)))), 0e0) AS ppl, CASE WHEN p = 0 THEN 0e0 ELSE least(0.32e0, 0.10e0 + 0.08e0 * p + 0.025e0 * tt) END AS penalty FROM a),
    c AS (SELECT *, 0.20e0 + named + described + ppl - penalty * CASE WHEN named > 0 THEN 0.15e0 ELSE 1e0 END AS raw FROM b),
    rel AS (SELECT event_id, evidence_id, ingested_at, text, domain, source_type, quality_score, round(greatest(0e0, least(1e0, CASE WHEN penalty > 0 AND NOT named > 0 THEN least(raw, 0.20e0) ELSE raw END)) + 1e-9, 4) AS relevance FROM c)"""


@query(f"WITH {_RELEVANCE} SELECT event_id, evidence_id, ingested_at, relevance FROM rel")
def event_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance of each page to its event."""
    return relevance_rows(spark, sf_dir).select("event_id", "evidence_id", "ingested_at", "relevance")


def stage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event, evidence, stage) with final scores that pass the gates."""
    rel = relevance_rows(spark, sf_dir).where("relevance >= 0.30")
    prior = F.when(F.col("source_type") == "official", 1.0).when(F.col("source_type") == "mainstream_news", 0.8).otherwise(0.5)
    stages = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(PRIORITY[s]).alias("priority"), score.stage_keyword_score(F.col("text"), *STAGES[s]).alias("keyword")) for s in STAGES))
    rows = rel.select("*", F.explode(stages).alias("s")).select("*", "s.*").where("keyword > 0")
    rows = rows.withColumn("final", score.final_stage_score(F.col("keyword"), F.col("relevance"), F.col("quality_score"), prior, F.lit(0.0), F.lit(0.0)))
    return rows.where("final >= 0.25").select("event_id", "evidence_id", "ingested_at", "domain", "stage", "priority", "keyword", "relevance", "final")


def _keyword_sql(s: str) -> str:
    strong, weak = STAGES[s]
    n = f"len(list_filter({strong}, lambda t: contains(text, t)))"
    raw = f"least(1e0, 0.32e0 * {n} + 0.06e0 * len(list_filter({weak}, lambda t: contains(text, t))))"
    return f"round((CASE WHEN {n} > 0 THEN {raw} ELSE least({raw}, 0.18e0) END)::DOUBLE, 4)"


_STAGE = f"""{_RELEVANCE},
    st AS (SELECT *, unnest([{', '.join(f"{{'stage': '{s}', 'priority': {PRIORITY[s]}, 'keyword': {_keyword_sql(s)}}}" for s in STAGES)}]) AS s FROM rel WHERE relevance >= 0.30),
    sr AS (SELECT event_id, evidence_id, ingested_at, domain, s.stage AS stage, s.priority AS priority, s.keyword AS keyword, relevance, round(greatest(0e0, least(1e0, 0.40e0 * s.keyword + 0.25e0 * relevance + 0.15e0 * coalesce(quality_score, 0.5e0) + 0.10e0 * CASE source_type WHEN 'official' THEN 1e0 WHEN 'mainstream_news' THEN 0.8e0 ELSE 0.5e0 END)) + 1e-9, 4) AS final FROM st WHERE s.keyword > 0),
    sf AS (SELECT * FROM sr WHERE final >= 0.25)"""


@query(f"WITH {_STAGE} SELECT * FROM (SELECT event_id, stage, evidence_id, ingested_at, final, row_number() OVER (PARTITION BY event_id, stage ORDER BY final DESC, evidence_id, ingested_at) AS rank FROM sf) WHERE rank <= 3")
def stage_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best pages of each stage of each event."""
    out = select.top_k(stage_rows(spark, sf_dir), ["event_id", "stage"], [F.desc("final"), F.asc("evidence_id"), F.asc("ingested_at")], 3)
    return out.select("event_id", "stage", "evidence_id", "ingested_at", "final", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_STAGE} SELECT evidence_id, ingested_at, stage, final FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id, ingested_at ORDER BY final DESC, priority) AS r FROM sf) WHERE r = 1")
def best_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best stage of each page; ties by the stages' order."""
    return select.best_of(stage_rows(spark, sf_dir).select("evidence_id", "ingested_at", "stage", "final", "priority"), ["evidence_id", "ingested_at"], F.col("final"), F.col("priority")).select("evidence_id", "ingested_at", "stage", "final")


@query(
    f"""WITH {_STAGE}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, stage ORDER BY final DESC, evidence_id, ingested_at) AS r FROM sf) WHERE r <= 3),
    d AS (SELECT event_id, max(n)::DOUBLE / sum(n) AS share FROM (SELECT event_id, domain, count(*) AS n FROM top GROUP BY event_id, domain) GROUP BY event_id),
    m AS (SELECT event_id, count(DISTINCT stage) / 3e0 AS cov, avg(final) AS mean FROM top GROUP BY event_id)
    SELECT m.event_id, round(cov::DOUBLE, 4) AS coverage, round(mean, 4) AS mean_score, round(share, 4) AS top_domain_share, round(0.5e0 * cov::DOUBLE + 0.4e0 * mean + 0.1e0 * (1 - share) + 1e-9, 4) AS confidence FROM m JOIN d ON m.event_id = d.event_id"""
)
def chain_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of each event's chain of stages."""
    top = select.top_k(stage_rows(spark, sf_dir), ["event_id", "stage"], [F.desc("final"), F.asc("evidence_id"), F.asc("ingested_at")], 3)
    return score.chain_confidence(top, "event_id", "stage", "final", "domain", len(STAGES))


@query(
    f"""SELECT event_id, evidence_id, ingested_at, adjusted FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY adjusted DESC, q DESC, evidence_id) AS r FROM (
      SELECT event_id, evidence_id, ingested_at, q, round(q + CASE WHEN row_number() OVER (PARTITION BY event_id, source_type ORDER BY q DESC, evidence_id) = 1 THEN 0.2 ELSE 0.0 END, 6) AS adjusted
      FROM (SELECT event_id, evidence_id, min(ingested_at) AS ingested_at, min(source_type) AS source_type, min(coalesce(quality_score, 0.0)) AS q FROM {EVIDENCE} GROUP BY event_id, evidence_id))) WHERE r <= 5"""
)
def diversity_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five pages of each event, the first of each source type preferred."""
    once = table(spark, sf_dir, EVIDENCE).groupBy("event_id", "evidence_id").agg(F.min("ingested_at").alias("ingested_at"), F.min("source_type").alias("source_type"), F.min(F.coalesce("quality_score", F.lit(0.0))).alias("q"))
    return select.diverse_pick(once, "event_id", "source_type", "q", "evidence_id", 0.2, 5).select("event_id", "evidence_id", "ingested_at", "adjusted")


@query(
    f"""SELECT event_id, evidence_id, ingested_at, left(regexp_replace(text, '[\\s\\x{{00a0}}\\x{{3000}}]+', ' ', 'g'), 80) AS clip, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY quality_score DESC NULLS LAST, collected_at, evidence_id, ingested_at) AS rank FROM {EVIDENCE} WHERE text IS NOT NULL) WHERE rank <= 4"""
)
def evidence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four clipped pages of each event, best first, then earliest."""
    out = select.top_k(table(spark, sf_dir, EVIDENCE).where("text IS NOT NULL"), ["event_id"], [F.desc_nulls_last("quality_score"), F.asc("collected_at"), F.asc("evidence_id"), F.asc("ingested_at")], 4)
    return out.select("event_id", "evidence_id", "ingested_at", F.left(F.regexp_replace("text", "[\\s\\u00a0\\u3000]+", " "), F.lit(80)).alias("clip"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {_STAGE}, r AS (SELECT *, row_number() OVER (PARTITION BY event_id, stage ORDER BY final DESC, evidence_id, ingested_at) AS sr FROM sf),
    two AS (SELECT event_id, evidence_id, 0 AS class, min(priority) AS priority, max(final) AS s FROM r WHERE sr <= 2 GROUP BY event_id, evidence_id),
    fb AS (SELECT event_id, evidence_id, 1 AS class, 99 AS priority, max(coalesce(quality_score, 0.0)) AS s FROM {EVIDENCE} GROUP BY event_id, evidence_id),
    u AS (SELECT event_id, evidence_id, min(class) AS class, min(priority) AS priority, max(CASE WHEN k = 1 THEN s END) AS s FROM (SELECT *, row_number() OVER (PARTITION BY event_id, evidence_id ORDER BY class) AS k FROM (SELECT * FROM two UNION ALL SELECT * FROM fb)) GROUP BY event_id, evidence_id)
    SELECT event_id, evidence_id, class, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY class, priority, s DESC, evidence_id) AS rank FROM u) WHERE rank <= 8"""
)
def prompt_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight pages for an event's prompt: two of each stage in stage order, then the best of the rest."""
    two = select.top_k(stage_rows(spark, sf_dir), ["event_id", "stage"], [F.desc("final"), F.asc("evidence_id"), F.asc("ingested_at")], 2)
    two = two.groupBy("event_id", "evidence_id").agg(F.min("priority").alias("priority"), F.max("final").alias("s")).withColumn("class", F.lit(0))
    rest = table(spark, sf_dir, EVIDENCE).groupBy("event_id", "evidence_id").agg(F.lit(99).alias("priority"), F.max(F.coalesce("quality_score", F.lit(0.0))).alias("s")).withColumn("class", F.lit(1))
    both = two.unionByName(rest).groupBy("event_id", "evidence_id").agg(F.min_by(F.struct("class", "priority", "s"), "class").alias("r")).select("event_id", "evidence_id", "r.*")
    out = select.top_k(both, ["event_id"], [F.asc("class"), F.asc("priority"), F.desc("s"), F.asc("evidence_id")], 8)
    return out.select("event_id", "evidence_id", "class", F.col("rank").cast("long").alias("rank"))


@query(
    f"""SELECT event_id, count(*) AS n_rows, count(DISTINCT stakeholder_hint) AS n_stakeholders, count(DISTINCT stance_hint) AS n_stances, count(DISTINCT CASE WHEN stance_hint <> '回应' THEN stance_hint END) AS n_pointed_stances, count(DISTINCT temporal_stage) AS n_stages,
      coalesce(bool_or(source_type = 'official'), false) AS has_official, coalesce(bool_or(source_type = 'public_interaction'), false) AS has_interaction,
      round(avg(CASE WHEN url IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS traceability, round(1 - count(DISTINCT url)::DOUBLE / greatest(count(url), 1), 4) AS redundancy,
      count(DISTINCT stakeholder_hint) >= 2 AND count(DISTINCT stance_hint) >= 2 AND count(DISTINCT CASE WHEN stance_hint <> '回应' THEN stance_hint END) >= 1 AND count(DISTINCT temporal_stage) >= 3 AND coalesce(bool_or(source_type = 'official'), false) AND coalesce(bool_or(source_type = 'public_interaction'), false) AS covered
    FROM {EVIDENCE} GROUP BY event_id"""
)
def coverage_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage gates of each event."""
    return aggregate.coverage(table(spark, sf_dir, EVIDENCE), "event_id", "stakeholder_hint", "stance_hint", "temporal_stage", "source_type", "url", neutral="回应")


@query(
    f"""WITH e AS (SELECT evidence_id, string_agg(DISTINCT text, '') AS text FROM (SELECT evidence_id, min(text) AS text FROM {EVIDENCE} GROUP BY evidence_id) GROUP BY evidence_id),
    c AS (SELECT tuple_id, loaded_at, stakeholder, opinion, confidence, unnest(evidence_ids) AS evidence_id FROM {CLAIMS}),
    j AS (SELECT tuple_id, loaded_at, any_value(stakeholder) AS stakeholder, any_value(opinion) AS opinion, any_value(confidence) AS confidence, count(text) AS n_found, coalesce(bool_or(contains(text, stakeholder)), false) AS named FROM c LEFT JOIN e USING (evidence_id) GROUP BY tuple_id, loaded_at)
    SELECT tuple_id, loaded_at, array_to_string(list_filter([CASE WHEN stakeholder IS NULL OR trim(stakeholder) = '' THEN 'no_stakeholder' END, CASE WHEN opinion IS NULL OR trim(opinion) = '' THEN 'no_opinion' END, CASE WHEN n_found = 0 THEN 'no_evidence' END, CASE WHEN NOT named THEN 'stakeholder_not_in_evidence' END, CASE WHEN confidence < 0.5 THEN 'low_confidence' END], lambda x: x IS NOT NULL), '|') AS issue_flags,
      CASE WHEN confidence >= 0.7 THEN 'supported' WHEN confidence >= 0.4 THEN 'partially_supported' ELSE 'insufficient_evidence' END AS label FROM j"""
)
def verifier_precheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule flags and score label of each claim before any model is asked."""
    e = table(spark, sf_dir, EVIDENCE).groupBy("evidence_id").agg(F.min("text").alias("text"))
    c = table(spark, sf_dir, CLAIMS).select("tuple_id", "loaded_at", "stakeholder", "opinion", "confidence", F.explode("evidence_ids").alias("evidence_id"))
    j = c.join(e, "evidence_id", "left").groupBy("tuple_id", "loaded_at").agg(F.first("stakeholder").alias("stakeholder"), F.first("opinion").alias("opinion"), F.first("confidence").alias("confidence"), F.count("text").alias("n_found"), F.coalesce(F.bool_or(F.contains("text", F.col("stakeholder"))), F.lit(False)).alias("named"))
    flags = classify.flags({"no_stakeholder": ~_ok("stakeholder"), "no_opinion": ~_ok("opinion"), "no_evidence": F.col("n_found") == 0, "stakeholder_not_in_evidence": ~F.col("named"), "low_confidence": F.col("confidence") < 0.5})
    return j.select("tuple_id", "loaded_at", F.array_join(flags, "|").alias("issue_flags"), classify.support_label(F.col("confidence")).alias("label"))

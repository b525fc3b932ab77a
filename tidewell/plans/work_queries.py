"""Queries that flatten, map, summarise and plan annotation work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.operators import classify, dedupe, graph, select
from tidewell.plans.catalog import CLAIMS, EVENTS, EVIDENCE, GOLD, query
from tidewell.plans.evidence_queries import _STAGE, STAGES, stage_rows
from tidewell.sources.tables import table

GROUPS = {"residents": ["居民", "业主"], "officials": ["有关部门", "区随后"], "workers": ["施工方", "物业经理"]}
STANCE_SENTIMENT = {"支持": "positive", "反对": "negative", "质疑": "negative", "回应": "neutral"}
_CASE = lambda c: f"CASE {c} WHEN '支持' THEN 'positive' WHEN '反对' THEN 'negative' WHEN '质疑' THEN 'negative' WHEN '回应' THEN 'neutral' ELSE 'unclear' END"


@query(
    f"""WITH b AS (SELECT DISTINCT event_id, lower(trim(stakeholder)) AS s FROM {CLAIMS} WHERE model_name = 'moss-base' AND stakeholder IS NOT NULL), d AS (SELECT event_id, lower(trim(stakeholder)) AS s FROM {CLAIMS} WHERE model_name = 'pine-chat' AND stakeholder IS NOT NULL)
    SELECT 'overlap_with_base' AS "check", count(*) AS n FROM d JOIN b USING (event_id, s) UNION ALL SELECT 'repeated_within', count(*) FROM (SELECT event_id, s FROM d GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'events_below_minimum', count(*) FROM (SELECT event_id FROM (SELECT * FROM b UNION ALL SELECT * FROM d) GROUP BY event_id HAVING count(*) < 3)"""
)
def delta_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of one model's claims as an addition to another's."""
    c = table(spark, sf_dir, CLAIMS).where("stakeholder IS NOT NULL").select("event_id", F.lower(F.trim("stakeholder")).alias("s"), "model_name")
    b, d = c.where("model_name = 'moss-base'").select("event_id", "s").distinct(), c.where("model_name = 'pine-chat'").select("event_id", "s")
    checks = {"overlap_with_base": d.join(b, ["event_id", "s"]), "repeated_within": d.groupBy("event_id", "s").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "events_below_minimum": b.unionByName(d).groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).where("n < 3")}
    return reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("check"), "n") for k, df in checks.items()))


@query(
    f"""WITH f AS (SELECT DISTINCT event_id FROM {GOLD} ORDER BY event_id LIMIT 5) SELECT CASE WHEN support_label = 'supported' THEN 'supported' WHEN suspected_issue IS NOT NULL AND trim(suspected_issue) <> '' THEN 'issue' ELSE 'rest' END AS part, count(*) AS n FROM {GOLD} WHERE event_id IN (SELECT event_id FROM f) GROUP BY 1"""
)
def first_events_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed rows of the first five events by part."""
    g = table(spark, sf_dir, GOLD)
    first = g.select("event_id").distinct().orderBy("event_id").limit(5)
    part = F.when(F.col("support_label") == "supported", "supported").when(~text.blank(F.col("suspected_issue")), "issue").otherwise("rest")
    return g.join(first, "event_id", "left_semi").groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_STAGE} SELECT event_id, stage, string_agg(DISTINCT evidence_id, '|' ORDER BY evidence_id) AS evidence, count(DISTINCT evidence_id) AS n FROM sf GROUP BY event_id, stage")
def chain_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each event and stage, joined."""
    return stage_rows(spark, sf_dir).groupBy("event_id", "stage").agg(F.array_join(F.array_sort(F.collect_set("evidence_id")), "|").alias("evidence"), F.countDistinct("evidence_id").alias("n"))


@query(
    f"""WITH e AS (SELECT evidence_id, min(title) AS title FROM {EVIDENCE} GROUP BY 1), ch AS (SELECT event_id, event_chain_stage AS last_stage FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY tuple_id DESC, loaded_at DESC) AS r FROM {CLAIMS}) WHERE r = 1)
    SELECT c.tuple_id, c.loaded_at, r.event_name, e.title AS first_title, ch.last_stage, '' AS decision FROM {CLAIMS} c LEFT JOIN {EVENTS} r ON r.event_id = c.event_id LEFT JOIN e ON e.evidence_id = c.evidence_ids[1] LEFT JOIN ch ON ch.event_id = c.event_id"""
)
def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review rows: each claim with its event, first evidence and the event's last stage."""
    c = table(spark, sf_dir, CLAIMS)
    e = table(spark, sf_dir, EVIDENCE).groupBy("evidence_id").agg(F.min("title").alias("first_title"))
    chain = select.latest(c.select("event_id", "tuple_id", "loaded_at", F.col("event_chain_stage").alias("last_stage")), ["event_id"], ["tuple_id", "loaded_at"]).select("event_id", "last_stage")
    rows = c.select("tuple_id", "loaded_at", "event_id", F.try_element_at("evidence_ids", F.lit(1)).alias("evidence_id"))
    return rows.join(table(spark, sf_dir, EVENTS).select("event_id", "event_name"), "event_id", "left").join(e, "evidence_id", "left").join(chain, "event_id", "left").select("tuple_id", "loaded_at", "event_name", "first_title", "last_stage", F.lit("").alias("decision"))


@query(f"SELECT event_id, event_name, slot::INT AS slot, '' AS stakeholder FROM {EVENTS} e, (SELECT unnest([1, 2, 3]) AS slot) WHERE NOT EXISTS (SELECT 1 FROM {GOLD} g WHERE g.event_id = e.event_id)")
def blank_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three blank rows for each event without reviewed rows."""
    e = table(spark, sf_dir, EVENTS).select("event_id", "event_name").join(table(spark, sf_dir, GOLD).select("event_id"), "event_id", "left_anti")
    return e.select("event_id", "event_name", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("slot"), F.lit("").alias("stakeholder"))


@query(f"SELECT evidence_id, ingested_at, {_CASE('stance_hint')} AS sentiment, CASE temporal_stage WHEN 'trigger' THEN '起因' WHEN 'conflict' THEN '争议' WHEN 'response' THEN '回应' ELSE '其他' END AS stage_text FROM {EVIDENCE}")
def case_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment of each stance and text of each stage."""
    mapped = lambda c, m, d: reduce(lambda out, kv: F.when(F.col(c) == kv[0], kv[1]).otherwise(out), m.items(), F.lit(d))
    return table(spark, sf_dir, EVIDENCE).select("evidence_id", "ingested_at", mapped("stance_hint", STANCE_SENTIMENT, "unclear").alias("sentiment"), mapped("temporal_stage", {"trigger": "起因", "conflict": "争议", "response": "回应"}, "其他").alias("stage_text"))


@query(
    f"""WITH e AS (SELECT evidence_id, ingested_at, coalesce(text, '') AS t, stakeholder_hints AS h FROM {EVIDENCE} e JOIN {EVENTS} r ON r.event_id = e.event_id), g AS (SELECT *, list_filter([CASE WHEN contains(t, '居民') OR contains(t, '业主') THEN 'residents' END, CASE WHEN contains(t, '有关部门') OR contains(t, '区随后') THEN 'officials' END, CASE WHEN contains(t, '施工方') OR contains(t, '物业经理') THEN 'workers' END], lambda x: x IS NOT NULL) AS gr,
      list_distinct(list_filter(coalesce(h, []), lambda x: x IS NOT NULL AND trim(x) <> '' AND contains(t, x))) AS hits FROM e)
    SELECT evidence_id, ingested_at, array_to_string(gr, '|') AS groups, CASE WHEN len(gr) = 1 THEN gr[1] END AS only_group, len(hits)::BIGINT AS n_hints FROM g"""
)
def stakeholder_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stakeholder groups of each page and the event's hints found in it."""
    e = table(spark, sf_dir, EVIDENCE).select("evidence_id", "ingested_at", "event_id", F.coalesce("text", F.lit("")).alias("t")).join(table(spark, sf_dir, EVENTS).select("event_id", "stakeholder_hints"), "event_id")
    hits = F.array_distinct(F.filter(F.coalesce("stakeholder_hints", F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != "") & F.contains(F.col("t"), x)))
    return e.select("evidence_id", "ingested_at", F.array_join(classify.group_hits(F.col("t"), GROUPS), "|").alias("groups"), classify.only_group(F.col("t"), GROUPS).alias("only_group"), F.size(hits).cast("long").alias("n_hints"))


@query(
    f"""WITH s AS (SELECT event_id, evidence_id, CASE WHEN contains(text, '引发') OR contains(text, '起初') THEN 'trigger' WHEN contains(text, '质疑') OR contains(text, '反对') OR contains(text, '各执一词') THEN 'conflict' WHEN contains(text, '回应') OR contains(text, '答复') THEN 'response' END AS stage FROM (SELECT event_id, evidence_id, min(text) AS text FROM {EVIDENCE} GROUP BY ALL)),
    a AS (SELECT *, row_number() OVER (PARTITION BY event_id, stage ORDER BY evidence_id) AS k FROM s WHERE stage IS NOT NULL) SELECT event_id, stage, evidence_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY CASE stage WHEN 'trigger' THEN 1 WHEN 'conflict' THEN 2 ELSE 3 END, evidence_id) AS r FROM a WHERE k <= 2) WHERE r <= 5"""
)
def baseline_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule baseline: the first stage each page matches, two pages a stage and five an event."""
    e = table(spark, sf_dir, EVIDENCE).groupBy("event_id", "evidence_id").agg(F.min("text").alias("text"))
    stage = F.try_element_at(classify.group_hits(F.col("text"), {k: v[0] for k, v in STAGES.items()}), F.lit(1))
    rows = e.select("event_id", "evidence_id", stage.alias("stage")).where("stage IS NOT NULL")
    two = select.top_k(rows, ["event_id", "stage"], [F.asc("evidence_id")], 2, "k")
    order = F.when(F.col("stage") == "trigger", 1).when(F.col("stage") == "conflict", 2).otherwise(3)
    return select.top_k(two, ["event_id"], [order, F.asc("evidence_id")], 5).select("event_id", "stage", "evidence_id")


@query(f"SELECT 'event:' || event_id AS source, count(DISTINCT temporal_stage) AS n_stages FROM {EVIDENCE} WHERE trim(temporal_stage) <> '' GROUP BY 1")
def graph_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages that each event's evidence reaches in the graph."""
    edges = graph.evidence_graph(table(spark, sf_dir, EVENTS), table(spark, sf_dir, EVIDENCE))[1]
    has = edges.where("relation = 'has_evidence'").select("source", F.col("target").alias("e"))
    return has.join(edges.where("relation = 'in_stage'").select(F.col("source").alias("e"), F.col("target").alias("stage")), "e").groupBy("source").agg(F.countDistinct("stage").alias("n_stages"))


@query(
    f"""WITH {_STAGE}, p AS (SELECT event_id, count(DISTINCT stage) AS k, array_to_string(list_filter(['trigger', 'conflict', 'response'], lambda s: NOT list_contains(list(DISTINCT stage), s)), '|') AS missing FROM sf GROUP BY event_id) SELECT k AS n_stages, missing, count(*) AS n_events FROM p GROUP BY ALL"""
)
def retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the number of stages found and the stages missing."""
    p = stage_rows(spark, sf_dir).groupBy("event_id").agg(F.collect_set("stage").alias("s"))
    missing = F.filter(F.array(*map(F.lit, STAGES)), lambda x: ~F.array_contains("s", x))
    return p.select(F.size("s").cast("long").alias("n_stages"), F.array_join(missing, "|").alias("missing")).groupBy("n_stages", "missing").agg(F.count(F.lit(1)).alias("n_events"))


@query(f"SELECT source_type, count(*) AS n_before, count(CASE WHEN quality_score >= 0.5 THEN 1 END) AS n_after, round(count(CASE WHEN quality_score >= 0.5 THEN 1 END) / count(*) + 1e-9, 4) AS kept FROM {EVIDENCE} GROUP BY source_type")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each source type before and after the quality threshold."""
    good = F.count(F.when(F.col("quality_score") >= 0.5, 1))
    return table(spark, sf_dir, EVIDENCE).groupBy("source_type").agg(F.count(F.lit(1)).alias("n_before"), good.alias("n_after"), F.round(good / F.count(F.lit(1)) + 1e-9, 4).alias("kept"))


@query(
    f"""WITH b AS (SELECT event_id, coalesce(location['city'], '') AS city, coalesce(location['district'], '') AS district FROM {EVENTS}), x AS (SELECT event_id, d.p || t.s AS query, (d.n * 10 + t.n)::BIGINT AS position FROM b, LATERAL (SELECT unnest([district, city]) AS p, unnest([0, 1]) AS n) d, (VALUES (0, ' 通报'), (1, ' 情况说明'), (2, ' 回应')) t(n, s) WHERE d.p <> '')
    SELECT event_id, query, position FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY position, query) AS r FROM (SELECT event_id, query, min(position) AS position FROM x GROUP BY ALL)) WHERE r <= 4"""
)
def official_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries for official notices of each event: place by template, four at most."""
    places = F.array(F.struct(F.lit(0).alias("n"), F.coalesce(F.col("location")["district"], F.lit("")).alias("p")), F.struct(F.lit(1).alias("n"), F.coalesce(F.col("location")["city"], F.lit("")).alias("p")))
    suffix = F.array(*(F.struct(F.lit(i).alias("m"), F.lit(s).alias("s")) for i, s in enumerate([" 通报", " 情况说明", " 回应"])))
    rows = table(spark, sf_dir, EVENTS).select("event_id", F.explode(places).alias("x")).select("event_id", "x.*", F.explode(suffix).alias("t")).where("p <> ''")
    rows = rows.select("event_id", F.concat("p", "t.s").alias("query"), (F.col("n") * 10 + F.col("t.m")).cast("long").alias("position")).groupBy("event_id", "query").agg(F.min("position").alias("position"))
    return select.top_k(rows, ["event_id"], [F.asc("position"), F.asc("query")], 4).drop("rank")


@query(f"SELECT lower(trim(coalesce(stakeholder, ''))) AS s, lower(trim(coalesce(opinion, ''))) AS o, event_id, min(tuple_id) AS tuple_id FROM {CLAIMS} GROUP BY 1, 2, 3")
def candidate_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first claim of each event, stakeholder and opinion, without regard to case."""
    low = lambda c: F.lower(text.strip(F.coalesce(c, F.lit(""))))
    c = table(spark, sf_dir, CLAIMS).select(low("stakeholder").alias("s"), low("opinion").alias("o"), "event_id", "tuple_id")
    return dedupe.first_wins(c, F.struct("s", "o", "event_id"), ["tuple_id"])


@query(f"SELECT coalesce(c.event_id, g.event_id) AS event_id, coalesce(c.plan, g.plan) AS plan FROM (SELECT event_id, min(model_name) AS plan FROM {CLAIMS} WHERE model_name <> 'moss-base' GROUP BY 1) c FULL OUTER JOIN (SELECT event_id, 'gold' AS plan FROM {GOLD} GROUP BY 1) g ON g.event_id = c.event_id")
def plan_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of each event where the existing one wins."""
    c = table(spark, sf_dir, CLAIMS).where("model_name <> 'moss-base'").groupBy("event_id").agg(F.min("model_name").alias("plan"))
    g = table(spark, sf_dir, GOLD).select("event_id", F.lit("gold").alias("new_plan")).distinct()
    return c.join(g, "event_id", "full_outer").select("event_id", F.coalesce("plan", "new_plan").alias("plan"))


@query("WITH t AS (SELECT event_type, min(event_id) AS template FROM events WHERE value > 50 GROUP BY event_type) SELECT e.event_id, t.template FROM events e LEFT JOIN t USING (event_type)")
def attempt_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first template that fits each attempt."""
    e = table(spark, sf_dir, "events")
    t = e.where("value > 50").groupBy("event_type").agg(F.min("event_id").alias("template"))
    return e.select("event_id", "event_type").join(t, "event_type", "left").select("event_id", "template")


@query(
    f"""SELECT g.event_id, count(*) AS n_gold, count(DISTINCT lower(trim(stakeholder))) AS n_stakeholders, round(count(CASE WHEN support_label = 'supported' THEN 1 END) / count(*) + 1e-9, 4) AS supported_share, max(length(opinion)) AS longest, CASE WHEN count(*) < 3 THEN 'thin' WHEN count(CASE WHEN support_label = 'supported' THEN 1 END) = 0 THEN 'unsupported' ELSE 'fine' END AS quality FROM {GOLD} g GROUP BY g.event_id"""
)
def gold_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each event's reviewed rows."""
    ok = F.count(F.when(F.col("support_label") == "supported", 1))
    n = F.count(F.lit(1))
    return table(spark, sf_dir, GOLD).groupBy("event_id").agg(n.alias("n_gold"), F.countDistinct(F.lower(text.strip(F.col("stakeholder")))).alias("n_stakeholders"), F.round(ok / n + 1e-9, 4).alias("supported_share"), F.max(F.length("opinion")).cast("long").alias("longest"), F.when(n < 3, "thin").when(ok == 0, "unsupported").otherwise("fine").alias("quality"))


@query(f"SELECT model_name, support_status, count(*) AS n, round(avg(confidence) + 1e-9, 4) AS mean_confidence, count(DISTINCT event_id) AS n_events FROM {CLAIMS} GROUP BY ALL")
def verification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of each model by status."""
    return table(spark, sf_dir, CLAIMS).groupBy("model_name", "support_status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence") + 1e-9, 4).alias("mean_confidence"), F.countDistinct("event_id").alias("n_events"))


@query(
    f"""WITH a AS (SELECT event_id, model_name, count(*) AS n FROM {CLAIMS} GROUP BY ALL) SELECT event_id, coalesce(sum(CASE WHEN model_name = 'qx-small-1' THEN n END), 0)::BIGINT AS qx_small_1, coalesce(sum(CASE WHEN model_name = 'qx-large-2' THEN n END), 0)::BIGINT AS qx_large_2, coalesce(sum(CASE WHEN model_name = 'orchid-7' THEN n END), 0)::BIGINT AS orchid_7 FROM a GROUP BY event_id"""
)
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of each event by run, as a pivot."""
    p = table(spark, sf_dir, CLAIMS).groupBy("event_id").pivot("model_name", ["qx-small-1", "qx-large-2", "orchid-7"]).agg(F.count(F.lit(1)))
    return p.select("event_id", *(F.coalesce(F.col(f"`{m}`"), F.lit(0)).alias(m.replace("-", "_")) for m in ("qx-small-1", "qx-large-2", "orchid-7")))

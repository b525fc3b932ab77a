"""Queries for audits, reviews, planning of work and comparisons of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.operators import classify, dedupe, metrics, select, similarity
from tidewell.plans.catalog import CLAIMS, EVENTS, EVIDENCE, GOLD, query
from tidewell.plans.evidence_queries import _STAGE, stage_rows
from tidewell.plans.relation_queries import _SET, _claims, _greedy, _sides
from tidewell.sources.tables import table

SCOPE_ALIAS = {"social_media": "public_social", "news": "mainstream_news", "gov": "official"}
VAGUE = ["有关", "相关", "部分"]


@query(
    f"""WITH s AS (SELECT event_id, unnest(CASE WHEN source_scope IS NULL OR len(source_scope) = 0 THEN ['official', 'mainstream_news'] ELSE source_scope END) AS s FROM {EVENTS})
    SELECT event_id, string_agg(DISTINCT CASE s WHEN 'social_media' THEN 'public_social' WHEN 'news' THEN 'mainstream_news' WHEN 'gov' THEN 'official' ELSE s END, '|' ORDER BY CASE s WHEN 'social_media' THEN 'public_social' WHEN 'news' THEN 'mainstream_news' WHEN 'gov' THEN 'official' ELSE s END) AS scope FROM s GROUP BY event_id"""
)
def scope_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source scope of each event under its canonical names, with defaults."""
    given = F.when(F.coalesce(F.size("source_scope"), F.lit(0)) <= 0, F.array(F.lit("official"), F.lit("mainstream_news"))).otherwise(F.col("source_scope"))
    mapped = F.transform(given, lambda s: reduce(lambda out, kv: F.when(s == kv[0], kv[1]).otherwise(out), SCOPE_ALIAS.items(), s))
    return table(spark, sf_dir, EVENTS).select("event_id", F.array_join(F.array_sort(F.array_distinct(mapped)), "|").alias("scope"))


@query(
    f"""SELECT 'only_gold' AS side, count(*) AS n FROM (SELECT DISTINCT event_id FROM {GOLD} EXCEPT SELECT DISTINCT event_id FROM {CLAIMS}) UNION ALL SELECT 'only_claims', count(*) FROM (SELECT DISTINCT event_id FROM {CLAIMS} EXCEPT SELECT DISTINCT event_id FROM {GOLD}) UNION ALL SELECT 'both', count(*) FROM (SELECT DISTINCT event_id FROM {CLAIMS} INTERSECT SELECT DISTINCT event_id FROM {GOLD})"""
)
def event_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the event sets of reviewed rows and claims differ."""
    g, c = (table(spark, sf_dir, t).select("event_id").distinct() for t in (GOLD, CLAIMS))
    part = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n")
    return part(g.exceptAll(c), "only_gold").unionByName(part(c.exceptAll(g), "only_claims")).unionByName(part(c.intersect(g), "both"))


@query(
    f"""SELECT 'duplicate_id' AS "check", count(*) AS n FROM (SELECT candidate_id FROM {GOLD} GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'bad_label', count(*) FROM {GOLD} WHERE NOT coalesce(support_label IN ('supported','partially_supported','insufficient_evidence','contradicted'), false)
    UNION ALL SELECT 'unknown_event', count(*) FROM {GOLD} g WHERE NOT EXISTS (SELECT 1 FROM {EVENTS} e WHERE e.event_id = g.event_id) UNION ALL SELECT 'few_tuples', count(*) FROM (SELECT event_id FROM {GOLD} GROUP BY 1 HAVING count(*) < 3) UNION ALL SELECT 'no_rationale', count(*) FROM {GOLD} WHERE rationale IS NULL OR trim(rationale) = ''"""
)
def gold_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the reviewed rows: violations of each check."""
    g = table(spark, sf_dir, GOLD)
    checks = {
        "duplicate_id": g.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "bad_label": g.where(~F.coalesce(F.col("support_label").isin("supported", "partially_supported", "insufficient_evidence", "contradicted"), F.lit(False))),
        "unknown_event": g.join(table(spark, sf_dir, EVENTS).select("event_id"), "event_id", "left_anti"), "few_tuples": g.groupBy("event_id").agg(F.count(F.lit(1)).alias("c")).where("c < 3"), "no_rationale": g.where(text.blank(F.col("rationale"))),
    }
    return reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("check"), "n") for k, df in checks.items()))


@query(
    f"""WITH n AS (SELECT event_id, count(*) AS n FROM {EVIDENCE} GROUP BY event_id), m AS (SELECT quantile_disc(n, 0.5) AS mid FROM n), t AS (SELECT event_id FROM n ORDER BY n DESC, event_id LIMIT 3), c AS (SELECT event_id FROM n, m WHERE event_id NOT IN (SELECT event_id FROM t) ORDER BY abs(n - mid), event_id LIMIT 3)
    SELECT event_id, 'largest' AS why FROM t UNION ALL SELECT event_id, 'median' FROM c"""
)
def probe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to probe: the three largest and the three closest to the median."""
    n = table(spark, sf_dir, EVIDENCE).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    largest = n.orderBy(F.desc("n"), "event_id").limit(3)
    middle = n.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").alias("mid"))
    rest = n.join(largest.select("event_id"), "event_id", "left_anti").join(F.broadcast(middle)).orderBy(F.abs(F.col("n") - F.col("mid")), "event_id").limit(3)
    return largest.select("event_id", F.lit("largest").alias("why")).unionByName(rest.select("event_id", F.lit("median").alias("why")))


@query("SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS tasks FROM events WHERE value < 5 GROUP BY user_id")
def retry_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of each user that have to be tried again."""
    return table(spark, sf_dir, "events").where("value < 5").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("tasks"))


@query(
    f"""SELECT event_id, count(*) AS n, count(CASE WHEN support_label = 'supported' THEN 1 END) AS n_supported, count(CASE WHEN support_label = 'partially_supported' THEN 1 END) AS n_partial, count(CASE WHEN suspected_issue IS NOT NULL AND trim(suspected_issue) <> '' THEN 1 END) AS n_issue, count(CASE WHEN sentiment = 'negative' THEN 1 END) AS n_negative FROM {GOLD} GROUP BY event_id"""
)
def event_review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, issues and sentiments of each event's reviewed rows."""
    hit = lambda c, a: F.count(F.when(c, 1)).alias(a)
    return table(spark, sf_dir, GOLD).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), hit(F.col("support_label") == "supported", "n_supported"), hit(F.col("support_label") == "partially_supported", "n_partial"), hit(~text.blank(F.col("suspected_issue")), "n_issue"), hit(F.col("sentiment") == "negative", "n_negative"))


@query(
    f"""WITH g AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY coalesce(opinion, ''), coalesce(rationale, '')) AS k FROM {GOLD})
    SELECT candidate_id, CASE support_label WHEN 'supported' THEN 'accept' WHEN 'partially_supported' THEN 'revise' WHEN 'contradicted' THEN 'drop' ELSE 'uncertain' END AS decision, CASE WHEN support_label IN ('supported', 'partially_supported') THEN coalesce(nullif(trim(opinion), ''), trim(rationale)) END AS gold_opinion, CASE WHEN support_label = 'partially_supported' THEN 'human_revised' WHEN support_label = 'supported' THEN 'human_accepted' END AS provenance FROM g WHERE k = 1"""
)
def adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed rows turned into decisions, gold values and provenance."""
    g = dedupe.first_wins(table(spark, sf_dir, GOLD).withColumns({"o": F.coalesce("opinion", F.lit("")), "r": F.coalesce("rationale", F.lit(""))}), F.col("candidate_id"), ["o", "r"])
    label = F.col("support_label")
    decision = F.when(label == "supported", "accept").when(label == "partially_supported", "revise").when(label == "contradicted", "drop").otherwise("uncertain")
    return g.select("candidate_id", decision.alias("decision"), F.when(decision.isin("accept", "revise"), F.coalesce(F.when(~text.blank(F.col("opinion")), F.trim("opinion")), F.trim("rationale"))).alias("gold_opinion"), F.when(decision == "revise", "human_revised").when(decision == "accept", "human_accepted").alias("provenance"))


@query(
    f"""WITH c AS (SELECT tuple_id AS id, min(event_id) AS event_id, {_SET('min(opinion)')} AS a FROM {CLAIMS} WHERE opinion IS NOT NULL GROUP BY tuple_id)
    SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.a, y.a))::DOUBLE / len(list_distinct(list_concat(x.a, y.a))), 6) AS similarity FROM c x JOIN c y ON x.event_id = y.event_id AND x.id < y.id WHERE len(x.a) > 0 AND len(y.a) > 0 AND round(len(list_intersect(x.a, y.a))::DOUBLE / len(list_distinct(list_concat(x.a, y.a))), 6) >= 0.85"""
)
def near_duplicate_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of one event with nearly the same opinion."""
    return similarity.near_pairs(_claims(spark, sf_dir), "event_id", "id", "opinion", 0.85).drop("grp")


@query(
    f"""SELECT tuple_id, loaded_at, array_to_string(list_filter([CASE WHEN contains(stakeholder, '有关') OR contains(stakeholder, '相关') OR contains(stakeholder, '部分') THEN 'vague_stakeholder' END, CASE WHEN rationale IS NULL OR trim(rationale) = '' THEN 'missing_rationale' END, CASE WHEN length(opinion) > 60 THEN 'too_long' END, CASE WHEN support_status <> 'supported' OR confidence < 0.4 THEN 'weak_support' END, CASE WHEN contains(opinion, '，并') THEN 'not_atomic' END], lambda x: x IS NOT NULL), '|') AS issues FROM {CLAIMS}"""
)
def suspected_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspected issues of each claim."""
    o = F.col("opinion")
    got = classify.flags({"vague_stakeholder": text.contains_any(F.col("stakeholder"), VAGUE), "missing_rationale": text.blank(F.col("rationale")), "too_long": F.length(o) > 60, "weak_support": (F.col("support_status") != "supported") | (F.col("confidence") < 0.4), "not_atomic": F.contains(o, F.lit("，并"))})
    return table(spark, sf_dir, CLAIMS).select("tuple_id", "loaded_at", F.array_join(got, "|").alias("issues"))


@query(
    f"""WITH g AS (SELECT event_id, count(*) AS n_gold FROM {GOLD} GROUP BY event_id), e AS (SELECT event_id, count(DISTINCT evidence_id) AS n_evidence FROM {EVIDENCE} GROUP BY event_id)
    SELECT r.event_id, CASE WHEN coalesce(n_gold, 0) = 0 THEN 'P0' WHEN n_gold < 3 THEN 'P1' ELSE 'none' END AS priority, greatest(0, 3 - coalesce(n_gold, 0))::BIGINT AS needed, CASE WHEN coalesce(n_evidence, 0) < 5 THEN 'recollect' ELSE 'annotate' END AS task FROM {EVENTS} r LEFT JOIN g ON g.event_id = r.event_id LEFT JOIN e ON e.event_id = r.event_id"""
)
def expansion_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event still needs."""
    g = table(spark, sf_dir, GOLD).groupBy("event_id").agg(F.count(F.lit(1)).alias("n_gold"))
    e = table(spark, sf_dir, EVIDENCE).groupBy("event_id").agg(F.countDistinct("evidence_id").alias("n_evidence"))
    n = F.coalesce("n_gold", F.lit(0))
    return table(spark, sf_dir, EVENTS).select("event_id").join(g, "event_id", "left").join(e, "event_id", "left").select("event_id", F.when(n == 0, "P0").when(n < 3, "P1").otherwise("none").alias("priority"), F.greatest(F.lit(0), 3 - n).cast("long").alias("needed"), F.when(F.coalesce("n_evidence", F.lit(0)) < 5, "recollect").otherwise("annotate").alias("task"))


@query(
    f"""WITH r AS (SELECT event_id, evidence_id, min(CASE source_type WHEN 'official' THEN 0 WHEN 'mainstream_news' THEN 1 WHEN 'public_interaction' THEN 2 WHEN 'public_social' THEN 3 ELSE 4 END) AS class, min(coalesce(url, '')) AS url FROM {EVIDENCE} GROUP BY ALL)
    SELECT event_id, evidence_id, class::INT AS class, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY class, url, evidence_id) AS rank FROM r) WHERE rank <= 3"""
)
def official_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three results of each event, official ones first."""
    s = F.col("source_type")
    order = F.when(s == "official", 0).when(s == "mainstream_news", 1).when(s == "public_interaction", 2).when(s == "public_social", 3).otherwise(4)
    r = table(spark, sf_dir, EVIDENCE).groupBy("event_id", "evidence_id").agg(F.min(order).alias("class"), F.min(F.coalesce("url", F.lit(""))).alias("url"))
    return select.top_k(r, ["event_id"], [F.asc("class"), F.asc("url"), F.asc("evidence_id")], 3).select("event_id", "evidence_id", "class", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH g AS (SELECT event_id, last_ AS items FROM (SELECT event_id, string_split(evidence_ids, '|') AS last_, row_number() OVER (PARTITION BY event_id ORDER BY candidate_id DESC, evidence_ids DESC) AS r FROM {GOLD}) WHERE r = 1), p AS (SELECT event_id, list(DISTINCT evidence_id) AS items FROM (SELECT event_id, unnest(evidence_ids) AS evidence_id FROM {CLAIMS}) GROUP BY event_id)
    SELECT event_id, len(list_intersect(list_distinct(g.items), p.items))::BIGINT AS hits, len(list_distinct(g.items))::BIGINT AS n_gold, len(p.items)::BIGINT AS n_pred FROM g JOIN p USING (event_id)"""
)
def last_chain_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of each event's last reviewed chain with all cited evidence."""
    g = select.latest(table(spark, sf_dir, GOLD).select("event_id", "candidate_id", "evidence_ids"), ["event_id"], ["candidate_id", "evidence_ids"]).select("event_id", F.array_distinct(F.split("evidence_ids", "[|]")).alias("g"))
    p = table(spark, sf_dir, CLAIMS).select("event_id", F.explode("evidence_ids").alias("e")).groupBy("event_id").agg(F.collect_set("e").alias("p"))
    return g.join(p, "event_id").select("event_id", F.size(F.array_intersect("g", "p")).cast("long").alias("hits"), F.size("g").cast("long").alias("n_gold"), F.size("p").cast("long").alias("n_pred"))


@query(
    f"""WITH a AS (SELECT event_id, avg(confidence) AS a FROM {CLAIMS} WHERE model_name = 'qx-small-1' GROUP BY 1), b AS (SELECT event_id, avg(confidence) AS b FROM {CLAIMS} WHERE model_name = 'qx-large-2' GROUP BY 1), d AS (SELECT coalesce(a.event_id, b.event_id) AS event_id, a, b, round(coalesce(b, 0.0) - coalesce(a, 0.0), 4) AS delta FROM a FULL OUTER JOIN b ON a.event_id = b.event_id)
    SELECT event_id, delta, CASE WHEN a IS NULL THEN 'only_new' WHEN b IS NULL THEN 'only_old' WHEN delta >= 0.08 THEN 'primary_gain' WHEN delta >= 0.03 THEN 'contributing_gain' WHEN delta <= -0.03 THEN 'loss' ELSE 'not_material' END AS reason FROM d"""
)
def run_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of mean confidence between two models, by event, with its reason."""
    c = table(spark, sf_dir, CLAIMS).groupBy("event_id").agg(F.avg(F.when(F.col("model_name") == "qx-small-1", F.col("confidence"))).alias("a"), F.avg(F.when(F.col("model_name") == "qx-large-2", F.col("confidence"))).alias("b")).where("a IS NOT NULL OR b IS NOT NULL")
    d = F.round(F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0)), 4)
    return c.select("event_id", d.alias("delta"), F.when(F.col("a").isNull(), "only_new").when(F.col("b").isNull(), "only_old").when(d >= 0.08, "primary_gain").when(d >= 0.03, "contributing_gain").when(d <= -0.03, "loss").otherwise("not_material").alias("reason"))


@query(
    f"""WITH {_STAGE}, top AS (SELECT DISTINCT event_id, evidence_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id, stage ORDER BY final DESC, evidence_id, ingested_at) AS r FROM sf) WHERE r <= 3), g AS (SELECT DISTINCT event_id, unnest(string_split(evidence_ids, '|')) AS evidence_id FROM {GOLD}),
    held AS (SELECT g.event_id, count(*) AS n_gold, count(t.evidence_id) AS n_in FROM g LEFT JOIN top t ON t.event_id = g.event_id AND t.evidence_id = g.evidence_id GROUP BY g.event_id)
    SELECT event_id, n_gold, n_in, round(n_in / n_gold, 4) AS share FROM held"""
)
def gold_in_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each event's reviewed evidence its chain holds."""
    top = select.top_k(stage_rows(spark, sf_dir), ["event_id", "stage"], [F.desc("final"), F.asc("evidence_id"), F.asc("ingested_at")], 3).select("event_id", "evidence_id").distinct().withColumn("here", F.lit(1))
    g = table(spark, sf_dir, GOLD).select("event_id", F.explode(F.split("evidence_ids", "[|]")).alias("evidence_id")).distinct()
    return g.join(top, ["event_id", "evidence_id"], "left").groupBy("event_id").agg(F.count(F.lit(1)).alias("n_gold"), F.count("here").alias("n_in")).withColumn("share", F.round(F.col("n_in") / F.col("n_gold"), 4))


@query(f"SELECT candidate_id FROM (SELECT DISTINCT candidate_id FROM {GOLD}) ORDER BY md5(candidate_id || '|50'), candidate_id LIMIT 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty reviewed rows in hash order: a sample that any engine repeats."""
    return table(spark, sf_dir, GOLD).select("candidate_id").distinct().orderBy(select.hash_order(F.col("candidate_id"), seed="50"), "candidate_id").limit(50)


@query(
    f"""WITH o AS (SELECT event_id, e AS evidence_id, 0 AS class, min(p) AS pos, 0e0 AS q FROM (SELECT event_id, unnest(string_split(evidence_ids, '|')) AS e, generate_subscripts(string_split(evidence_ids, '|'), 1) AS p FROM {GOLD}) GROUP BY event_id, e), f AS (SELECT event_id, evidence_id, 1 AS class, 0 AS pos, max(coalesce(quality_score, 0e0)) AS q FROM {EVIDENCE} GROUP BY ALL),
    u AS (SELECT *, row_number() OVER (PARTITION BY event_id, evidence_id ORDER BY class) AS k FROM (SELECT * FROM o UNION ALL SELECT * FROM f))
    SELECT event_id, evidence_id, class::INT AS class, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY class, pos, q DESC, evidence_id) AS rank FROM u WHERE k = 1) WHERE rank <= 6"""
)
def oracle_first_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six pages of each event: the cited ones in cited order, then the best of the rest."""
    o = table(spark, sf_dir, GOLD).select("event_id", F.posexplode(F.split("evidence_ids", "[|]")).alias("p", "evidence_id")).groupBy("event_id", "evidence_id").agg(F.min("p").alias("pos")).select("event_id", "evidence_id", F.lit(0).alias("class"), "pos", F.lit(0.0).alias("q"))
    f = table(spark, sf_dir, EVIDENCE).groupBy("event_id", "evidence_id").agg(F.max(F.coalesce("quality_score", F.lit(0.0))).alias("q")).select("event_id", "evidence_id", F.lit(1).alias("class"), F.lit(-1).alias("pos"), "q")
    u = dedupe.first_wins(o.unionByName(f), F.struct("event_id", "evidence_id"), ["class"])
    return select.top_k(u, ["event_id"], [F.asc("class"), F.asc("pos"), F.desc("q"), F.asc("evidence_id")], 6).select("event_id", "evidence_id", "class", F.col("rank").cast("long").alias("rank"))


@query(
    f"""SELECT r.event_id, coalesce(e.n, 0) AS n_evidence, coalesce(c.n, 0) AS n_claims, coalesce(g.n, 0) AS n_gold, coalesce(len(r.temporal_stages), 0)::BIGINT AS chain_length FROM {EVENTS} r LEFT JOIN (SELECT event_id, count(*) AS n FROM {EVIDENCE} GROUP BY 1) e ON e.event_id = r.event_id LEFT JOIN (SELECT event_id, count(*) AS n FROM {CLAIMS} GROUP BY 1) c ON c.event_id = r.event_id LEFT JOIN (SELECT event_id, count(*) AS n FROM {GOLD} GROUP BY 1) g ON g.event_id = r.event_id"""
)
def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table for each event."""
    out = table(spark, sf_dir, EVENTS).select("event_id", F.greatest(F.coalesce(F.size("temporal_stages"), F.lit(0)), F.lit(0)).cast("long").alias("chain_length"))
    for t, name in ((EVIDENCE, "n_evidence"), (CLAIMS, "n_claims"), (GOLD, "n_gold")):
        out = out.join(table(spark, sf_dir, t).groupBy("event_id").agg(F.count(F.lit(1)).alias(name)), "event_id", "left")
    return out.select("event_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("n_evidence", "n_claims", "n_gold")), "chain_length")


@query(
    f"""WITH a AS (SELECT tuple_id, model_name, prompt_version, unnest(evidence_ids) AS e, generate_subscripts(evidence_ids, 1) AS n FROM {CLAIMS}) SELECT model_name, prompt_version, count(*) AS n_attempts, count(DISTINCT tuple_id) AS n_tasks, max(n)::BIGINT AS most FROM a GROUP BY ALL"""
)
def provider_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested attempts of each model and prompt, unnested and counted."""
    a = table(spark, sf_dir, CLAIMS).select("tuple_id", "model_name", "prompt_version", F.posexplode("evidence_ids").alias("n", "e"))
    return a.groupBy("model_name", "prompt_version").agg(F.count(F.lit(1)).alias("n_attempts"), F.countDistinct("tuple_id").alias("n_tasks"), (F.max("n") + 1).cast("long").alias("most"))


@query(
    f"""WITH r AS (SELECT tuple_id, loaded_at, event_chain_stage, row_number() OVER (PARTITION BY event_chain_stage ORDER BY confidence, tuple_id, loaded_at) AS k, confidence < 0.35 AS p FROM {CLAIMS}) SELECT tuple_id, loaded_at, event_chain_stage, p AS is_priority FROM r WHERE k <= 20 OR p"""
)
def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty claims of each stage, least sure first, and all priority claims."""
    c = table(spark, sf_dir, CLAIMS).select("tuple_id", "loaded_at", "event_chain_stage", "confidence", (F.col("confidence") < 0.35).alias("is_priority"))
    first = select.top_k(c, ["event_chain_stage"], [F.asc("confidence"), F.asc("tuple_id"), F.asc("loaded_at")], 20)
    return first.where("NOT is_priority").drop("rank").unionByName(c.where("is_priority")).drop("confidence")


@query(f"SELECT event_id, count(*) AS n_rows, count(DISTINCT coalesce(nullif(trim(stakeholder), ''), 'none')) AS n_stakeholders, CASE WHEN count(*) = 0 THEN 'no_rows' WHEN bool_and(stakeholder IS NULL OR trim(stakeholder) = '') THEN 'no_stakeholder' WHEN max(confidence) < 0.5 THEN 'unsure' ELSE 'fine' END AS status FROM {CLAIMS} GROUP BY event_id")
def generation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of what was generated for each event."""
    s = F.when(~text.blank(F.col("stakeholder")), F.trim("stakeholder"))
    return table(spark, sf_dir, CLAIMS).groupBy("event_id").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.coalesce(s, F.lit("none"))).alias("n_stakeholders"), F.when(F.bool_and(s.isNull()), "no_stakeholder").when(F.max("confidence") < 0.5, "unsure").otherwise("fine").alias("status"))


@query(
    f"""WITH RECURSIVE {_sides(GOLD, CLAIMS, 'stakeholder')}, {_greedy('event_id', 'x', 'similarity >= 0.6')}, n AS (SELECT (SELECT coalesce(sum(len(gs)), 0)::BIGINT FROM taken) AS tp, (SELECT count(*) FROM g) AS n_gold) SELECT tp, n_gold, round(tp / n_gold, 4) AS recall FROM n"""
)
def stakeholder_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of reviewed stakeholders that a claim of the event names, matched one to one."""
    g = table(spark, sf_dir, GOLD).where("stakeholder IS NOT NULL").groupBy("candidate_id").agg(F.min("event_id").alias("event_id"), F.min("stakeholder").alias("s")).withColumnRenamed("candidate_id", "id")
    p = table(spark, sf_dir, CLAIMS).where("stakeholder IS NOT NULL").groupBy("tuple_id").agg(F.min("event_id").alias("event_id"), F.min("stakeholder").alias("s")).withColumnRenamed("tuple_id", "id")
    return metrics.soft_f1(g, p, "event_id", "id", "s", 0.6).select("tp", "n_gold", "recall")



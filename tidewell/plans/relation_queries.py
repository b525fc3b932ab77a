"""Queries that validate, join, deduplicate, aggregate, plan, review and evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import cells, text, urls
from tidewell.operators import aggregate, dedupe, graph, metrics, payload, planning, review, select, validate
from tidewell.plans.catalog import CLAIMS, EVENTS, EVIDENCE, GOLD, query
from tidewell.sources.tables import table

_BLANK = lambda c: f"({c} IS NULL OR trim({c}) = '')"


# --- validation

@query(
    f"""SELECT evidence_id AS id, field, severity, count(*) AS n FROM (
      SELECT evidence_id, unnest([CASE WHEN {_BLANK('event_id')} THEN 'event_id' END, CASE WHEN {_BLANK('source')} THEN 'source' END, CASE WHEN {_BLANK('text')} THEN 'text' END]) AS field, 'FAIL' AS severity FROM {EVIDENCE}
      UNION ALL SELECT evidence_id, unnest([CASE WHEN {_BLANK('url')} THEN 'url' END, CASE WHEN {_BLANK('title')} THEN 'title' END]), 'WARN' FROM {EVIDENCE}) WHERE field IS NOT NULL GROUP BY ALL"""
)
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing fields of each page by severity."""
    return validate.missing_fields(table(spark, sf_dir, EVIDENCE), "evidence_id", ["event_id", "source", "text"], ["url", "title"]).groupBy("id", "field", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT event_id AS id, "check" FROM (SELECT event_id, unnest([
        CASE WHEN time_window IS NULL OR {_BLANK('time_window.start')} OR {_BLANK('time_window."end"')} THEN 'time_window' END,
        CASE WHEN NOT coalesce(len(query_seeds) > 0 AND len(list_filter(query_seeds, lambda x: x IS NULL OR trim(x) = '')) = 0, false) THEN 'query_seeds' END,
        CASE WHEN NOT coalesce(len(stakeholder_hints) > 0 AND len(list_filter(stakeholder_hints, lambda x: x IS NULL OR trim(x) = '')) = 0, false) THEN 'stakeholder_hints' END,
        CASE WHEN NOT coalesce(len(map_keys(anchor_entities)) > 0 AND len(list_filter(map_keys(anchor_entities), lambda x: trim(x) = '')) = 0 AND len(list_filter(map_values(anchor_entities), lambda v: v IS NULL OR len(v) = 0 OR len(list_filter(v, lambda x: x IS NULL OR trim(x) = '')) > 0)) = 0, false) THEN 'anchor_entities' END,
        CASE WHEN event_type NOT IN ('concrete_event', 'policy_event') THEN 'event_type' END]) AS "check" FROM {EVENTS}) WHERE "check" IS NOT NULL"""
)
def event_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed checks of each event."""
    checks = {
        "time_window": F.col("time_window").isNull() | ~F.coalesce(validate.factual_window(F.col("time_window")), F.lit(False)), "query_seeds": ~validate.all_strings(F.col("query_seeds")), "stakeholder_hints": ~validate.all_strings(F.col("stakeholder_hints")),
        "anchor_entities": ~validate.sound_entities(F.col("anchor_entities")), "event_type": ~F.col("event_type").isin("concrete_event", "policy_event"),
    }
    return validate.violations(table(spark, sf_dir, EVENTS), "event_id", checks)


@query(f"SELECT event_id, count(*) AS n FROM {GOLD} WHERE event_id IS NOT NULL AND event_id NOT IN (SELECT event_id FROM {EVIDENCE} WHERE event_id IS NOT NULL) AND EXISTS (SELECT 1 FROM {EVIDENCE}) GROUP BY event_id")
def missing_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed events without any evidence."""
    return validate.missing_parents(table(spark, sf_dir, GOLD), "event_id", table(spark, sf_dir, EVIDENCE), "event_id")


@query(
    f"""WITH k AS (SELECT evidence_id AS ref, list(DISTINCT event_id) AS groups FROM {EVIDENCE} GROUP BY evidence_id), r AS (SELECT candidate_id AS id, event_id, unnest(string_split(evidence_ids, '|')) AS ref FROM {GOLD})
    SELECT id, r.ref, CASE WHEN groups IS NULL THEN 'unknown' ELSE 'other_group' END AS problem FROM r LEFT JOIN k ON r.ref = k.ref WHERE groups IS NULL OR NOT list_contains(groups, r.event_id)"""
)
def bad_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited evidence that is unknown or of another event."""
    gold = table(spark, sf_dir, GOLD).withColumn("refs", F.split("evidence_ids", "[|]"))
    return validate.bad_references(gold, "candidate_id", "event_id", "refs", table(spark, sf_dir, EVIDENCE), "evidence_id", "event_id")


@query(f"SELECT evidence_id, count(*) AS n FROM {EVIDENCE} GROUP BY evidence_id HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence ids that occur more than once."""
    return validate.duplicates(table(spark, sf_dir, EVIDENCE), ["evidence_id"])


@query(f"SELECT event_id, count(url) - count(DISTINCT url) AS surplus FROM {EVIDENCE} GROUP BY event_id HAVING count(url) - count(DISTINCT url) > 0")
def url_surplus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated URLs of each event."""
    return aggregate.surplus(table(spark, sf_dir, EVIDENCE), ["event_id"], "url")


@query(
    f"""SELECT candidate_id, CASE WHEN {_BLANK('stakeholder')} THEN 'missing_stakeholder' WHEN {_BLANK('opinion')} THEN 'missing_opinion' WHEN NOT coalesce(sentiment IN ('positive','negative','neutral','mixed','unclear'), false) THEN 'bad_sentiment' WHEN {_BLANK('rationale')} THEN 'missing_rationale'
      WHEN len(list_filter(regexp_split_to_array(coalesce(evidence_ids, ''), '[;|,]'), lambda x: trim(x) <> '')) = 0 THEN 'no_evidence' WHEN NOT coalesce(support_label IN ('supported','partially_supported','insufficient_evidence','contradicted'), false) THEN 'bad_label' ELSE 'ok' END AS reason FROM {GOLD}"""
)
def gold_entry_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a reviewed row can't enter the gold set."""
    return review.entry_gate(table(spark, sf_dir, GOLD)).select("candidate_id", "reason")


@query(
    f"""WITH c AS (SELECT (SELECT count(*) FROM {EVIDENCE} WHERE {_BLANK('text')}) AS no_text, (SELECT count(*) FROM {EVIDENCE} WHERE {_BLANK('url')}) AS no_url, (SELECT count(*) FROM {EVIDENCE}) AS n)
    SELECT no_text, no_url, CASE WHEN no_text * 100 > n THEN 'failed' WHEN no_url > 0 THEN 'warning' ELSE 'passed' END AS status FROM c"""
)
def readiness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: counts of gaps and the gate's status; more than a hundredth of the pages without text is fatal."""
    e = table(spark, sf_dir, EVIDENCE)
    n = e.agg(F.count(F.when(text.blank(F.col("text")), 1)).alias("no_text"), F.count(F.when(text.blank(F.col("url")), 1)).alias("no_url"), F.count(F.lit(1)).alias("n"))
    return validate.gate(n.withColumn("fatal", F.when(F.col("no_text") * 100 > F.col("n"), 1).otherwise(0)), ["fatal"], ["no_url"]).drop("fatal", "n")


# --- joins and set operations

@query(f"SELECT DISTINCT e.evidence_id FROM {EVIDENCE} e WHERE EXISTS (SELECT 1 FROM {EVENTS} r WHERE r.event_id = e.event_id AND r.domain = 'public_safety')")
def boundary_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of the events of one domain."""
    events = table(spark, sf_dir, EVENTS).where("domain = 'public_safety'").select("event_id")
    return table(spark, sf_dir, EVIDENCE).join(events, "event_id", "left_semi").select("evidence_id").distinct()


@query(f"SELECT event_id FROM {EVENTS} WHERE event_id NOT IN (SELECT event_id FROM {CLAIMS} WHERE event_id IS NOT NULL)")
def pending_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without claims: what a resumed run still has to do."""
    return table(spark, sf_dir, EVENTS).select("event_id").join(table(spark, sf_dir, CLAIMS).select("event_id"), "event_id", "left_anti")


@query(
    f"""WITH g AS (SELECT event_id, count(*) AS n_gold FROM {GOLD} GROUP BY event_id), c AS (SELECT event_id, count(*) AS n_claims FROM {CLAIMS} GROUP BY event_id)
    SELECT coalesce(g.event_id, c.event_id) AS event_id, coalesce(n_gold, 0) AS n_gold, coalesce(n_claims, 0) AS n_claims, coalesce(n_gold, 0) - coalesce(n_claims, 0) AS delta FROM g FULL OUTER JOIN c ON g.event_id = c.event_id"""
)
def full_outer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and claim counts of every event."""
    g = table(spark, sf_dir, GOLD).groupBy("event_id").agg(F.count(F.lit(1)).alias("n_gold"))
    c = table(spark, sf_dir, CLAIMS).groupBy("event_id").agg(F.count(F.lit(1)).alias("n_claims"))
    n = lambda x: F.coalesce(x, F.lit(0))
    return g.join(c, "event_id", "full_outer").select("event_id", n("n_gold").alias("n_gold"), n("n_claims").alias("n_claims"), (n("n_gold") - n("n_claims")).alias("delta"))


@query(
    f"""WITH e AS (SELECT evidence_id AS ref, min(title) AS title FROM {EVIDENCE} GROUP BY evidence_id), c AS (SELECT candidate_id, unnest(string_split(evidence_ids, '|')) AS ref, generate_subscripts(string_split(evidence_ids, '|'), 1) AS pos FROM (SELECT DISTINCT candidate_id, evidence_ids FROM {GOLD}))
    SELECT candidate_id AS id, count(e.ref) AS n_found, coalesce(string_agg(CASE WHEN e.ref IS NULL THEN c.ref END, '|' ORDER BY pos), '') AS missing, coalesce(string_agg(CASE WHEN e.ref IS NOT NULL THEN coalesce(title, '') END, ' ||| ' ORDER BY pos), '') AS titles FROM c LEFT JOIN e ON c.ref = e.ref GROUP BY candidate_id"""
)
def resolved_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited evidence of each reviewed row, in cited order."""
    gold = table(spark, sf_dir, GOLD).select("candidate_id", "evidence_ids").distinct().withColumn("refs", F.split("evidence_ids", "[|]"))
    return review.resolved_evidence(gold, "candidate_id", "refs", table(spark, sf_dir, EVIDENCE))


@query(
    f"""WITH c AS (SELECT DISTINCT tuple_id, event_id, unnest(evidence_ids) AS e FROM {CLAIMS}), g AS (SELECT DISTINCT candidate_id, event_id, unnest(string_split(evidence_ids, '|')) AS e FROM {GOLD})
    SELECT tuple_id, candidate_id, count(*) AS shared FROM c JOIN g ON c.event_id = g.event_id AND c.e = g.e GROUP BY tuple_id, candidate_id"""
)
def evidence_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims and reviewed rows of one event that share evidence, and how much."""
    c = table(spark, sf_dir, CLAIMS).select("tuple_id", "event_id", F.explode("evidence_ids").alias("e")).distinct()
    g = table(spark, sf_dir, GOLD).select("candidate_id", "event_id", F.explode(F.split("evidence_ids", "[|]")).alias("e")).distinct()
    return c.join(g, ["event_id", "e"]).groupBy("tuple_id", "candidate_id").agg(F.count(F.lit(1)).alias("shared"))


@query(
    f"""WITH g AS (SELECT list(DISTINCT stance_hint) AS all_ FROM {EVIDENCE} WHERE source_type = 'official' AND stance_hint IS NOT NULL), e AS (SELECT event_id, list(DISTINCT stance_hint) AS own FROM {EVIDENCE} WHERE stance_hint IS NOT NULL GROUP BY event_id)
    SELECT event_id, array_to_string(list_sort(list_distinct(list_concat(own, all_))), '|') AS candidates FROM e, g"""
)
def candidates_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stances of each event together with those of all official pages."""
    e = table(spark, sf_dir, EVIDENCE).where("stance_hint IS NOT NULL")
    everywhere = e.where("source_type = 'official'").agg(F.collect_set("stance_hint").alias("all_"))  # one row of a closed vocabulary
    own = e.groupBy("event_id").agg(F.collect_set("stance_hint").alias("own"))
    return own.join(F.broadcast(everywhere)).select("event_id", F.array_join(F.array_sort(F.array_union("own", "all_")), "|").alias("candidates"))


# --- deduplication and merging

@query(
    f"""WITH k AS (SELECT evidence_id, ingested_at, event_id, coalesce(nullif(regexp_replace(coalesce(url, ''), '[?#].*$', ''), ''), 'id:' || evidence_id) AS key FROM {EVIDENCE}),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_id, key ORDER BY ingested_at, evidence_id) AS n FROM k) SELECT evidence_id, ingested_at, n = 1 AS kept, (n - 1)::BIGINT AS earlier FROM r"""
)
def url_dedupe_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of each event and address, with a log of the rest."""
    key = F.struct("event_id", F.coalesce(F.when(F.coalesce("url", F.lit("")) != "", F.regexp_replace("url", "[?#].*$", "")), F.concat(F.lit("id:"), "evidence_id")))
    out = dedupe.first_wins(table(spark, sf_dir, EVIDENCE).select("evidence_id", "ingested_at", "event_id", "url"), key, ["ingested_at", "evidence_id"], log=True)
    return out.select("evidence_id", "ingested_at", "kept", F.col("earlier").cast("long").alias("earlier"))


@query(
    f"""WITH b AS (SELECT evidence_id, ingested_at, 0 AS origin, sha1(left(regexp_replace(coalesce(text, ''), '[\\s\\x{{00a0}}\\x{{3000}}]+', '', 'g'), 300)) AS key FROM {EVIDENCE} WHERE source_type = 'official'
      UNION ALL SELECT evidence_id, ingested_at, 1, sha1(left(regexp_replace(coalesce(text, ''), '[\\s\\x{{00a0}}\\x{{3000}}]+', '', 'g'), 300)) FROM {EVIDENCE} WHERE source_type = 'forum')
    SELECT evidence_id, origin FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY origin, ingested_at, evidence_id) AS n FROM b) WHERE n = 1"""
)
def merge_base_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official pages and those forum pages whose text is new."""
    e = table(spark, sf_dir, EVIDENCE).select("evidence_id", "ingested_at", "source_type", "text")
    out = dedupe.merge_first(e.where("source_type = 'official'"), e.where("source_type = 'forum'"), text.content_sha1(F.col("text")), ["ingested_at", "evidence_id"])
    return out.select("evidence_id", "origin")


@query(f"WITH k AS (SELECT evidence_id, ingested_at, sha1(left(regexp_replace(coalesce(text, ''), '[\\s\\x{{00a0}}\\x{{3000}}]+', '', 'g'), 300)) AS key FROM {EVIDENCE}) SELECT evidence_id, ingested_at, count(*) OVER (PARTITION BY key) > 1 AS duplicate_risk FROM k")
def duplicate_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's beginning occurs elsewhere."""
    return dedupe.risky_keys(table(spark, sf_dir, EVIDENCE).select("evidence_id", "ingested_at", "text"), text.content_sha1(F.col("text"))).select("evidence_id", "ingested_at", "duplicate_risk")


@query(
    f"""WITH b AS (SELECT event_id, tuple_id FROM {CLAIMS} WHERE model_name = 'orchid-7'), c AS (SELECT event_id, tuple_id FROM {CLAIMS} WHERE model_name <> 'orchid-7')
    SELECT event_id, tuple_id, count(*) AS n FROM (SELECT * FROM c WHERE event_id NOT IN (SELECT event_id FROM b) UNION ALL SELECT * FROM b) GROUP BY event_id, tuple_id"""
)
def upsert_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims after one model's batch replaced the events it covers."""
    c = table(spark, sf_dir, CLAIMS).select("event_id", "tuple_id", "model_name")
    batch = c.where("model_name = 'orchid-7'").drop("model_name")
    return dedupe.upsert_groups(c.where("model_name <> 'orchid-7'").drop("model_name"), batch, "event_id").groupBy("event_id", "tuple_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT stakeholder, min(tuple_id) AS tuple_id FROM {CLAIMS} WHERE model_name <> 'orchid-7' AND stakeholder IS NOT NULL AND stakeholder NOT IN (SELECT stakeholder FROM {CLAIMS} WHERE model_name = 'orchid-7' AND stakeholder IS NOT NULL) GROUP BY stakeholder")
def delta_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First claim of each stakeholder that one model didn't name."""
    c = table(spark, sf_dir, CLAIMS).where("stakeholder IS NOT NULL").select("stakeholder", "tuple_id", "model_name")
    base = c.where("model_name = 'orchid-7'").select("stakeholder", "tuple_id")
    both = dedupe.append_unseen(base.limit(0).unionByName(base).withColumn("old", F.lit(1)), c.where("model_name <> 'orchid-7'").select("stakeholder", "tuple_id").withColumn("old", F.lit(0)), "stakeholder", ["tuple_id"])
    return both.where("old = 0").select("stakeholder", "tuple_id")


@query(
    f"""WITH k AS (SELECT candidate_id, event_id || '|' || lower(trim(regexp_replace(coalesce(stakeholder, ''), '[\\s\\x{{00a0}}\\x{{3000}}]+', ' ', 'g'))) || '|' || lower(trim(regexp_replace(coalesce(opinion, ''), '[\\s\\x{{00a0}}\\x{{3000}}]+', ' ', 'g'))) || '|' || coalesce(sentiment, '') || '|' || array_to_string(list_sort(string_split(evidence_ids, '|')), ',') AS key FROM {GOLD})
    SELECT key, count(*) AS n, min(candidate_id) AS first_id FROM k GROUP BY key HAVING count(*) > 1"""
)
def content_key_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed rows with equal content."""
    key = review.content_key(refs=F.split("evidence_ids", "[|]"))
    return table(spark, sf_dir, GOLD).select("candidate_id", key.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("candidate_id").alias("first_id")).where("n > 1")


# --- aggregates

@query(f"SELECT source_type, coalesce(nullif(trim(stance_hint), ''), 'unknown') AS value, count(*) AS n FROM {EVIDENCE} GROUP BY ALL")
def hint_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stances by source type."""
    return aggregate.distribution(table(spark, sf_dir, EVIDENCE), "stance_hint", keys=["source_type"])


@query(f"SELECT value, count(*) AS n FROM (SELECT unnest(quality_flags) AS value FROM {EVIDENCE}) GROUP BY value")
def flag_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each quality flag occurs."""
    return aggregate.element_distribution(table(spark, sf_dir, EVIDENCE), "quality_flags")


@query("SELECT grouping(lang)::INT AS is_total, lang AS grp, event_domain AS value, count(*) AS n FROM documents GROUP BY GROUPING SETS ((event_domain), (lang, event_domain))")
def distribution_global_and_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by domain, overall and by language."""
    return aggregate.global_and_groups(table(spark, sf_dir, "documents"), "lang", "event_domain")


@query(
    f"""SELECT event_id, value, n FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, f, value) AS r FROM (SELECT event_id, platform AS value, count(*) AS n, min(ingested_at) AS f FROM {EVIDENCE} WHERE platform IS NOT NULL GROUP BY event_id, platform)) WHERE r = 1"""
)
def commonest_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commonest platform of each event; ties to the one seen first."""
    return aggregate.most_common(table(spark, sf_dir, EVIDENCE), ["event_id"], "platform", "ingested_at")


@query("SELECT l_returnflag, count(l_quantity) AS n, min(l_quantity) AS low, round(median(l_quantity), 4) AS median, round(avg(l_quantity), 4) AS mean, max(l_quantity) AS high FROM lineitem GROUP BY l_returnflag")
def quantity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, median, mean and greatest quantity by flag."""
    return aggregate.describe(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")


@query(f"SELECT model_name, round(avg(CASE WHEN coalesce(support_status = 'supported', false) THEN 1.0 ELSE 0.0 END), 4) AS support_rate, round(avg(CASE WHEN coalesce(confidence < 0.5, false) THEN 1.0 ELSE 0.0 END), 4) AS low_rate FROM {CLAIMS} GROUP BY model_name")
def support_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of supported and of unsure claims by model."""
    return table(spark, sf_dir, CLAIMS).groupBy("model_name").agg(aggregate.rate(F.col("support_status") == "supported").alias("support_rate"), aggregate.rate(F.col("confidence") < 0.5).alias("low_rate"))


@query(f"WITH n AS (SELECT event_id, source_type, count(*) AS n FROM {EVIDENCE} GROUP BY ALL) SELECT event_id, source_type, n, round(n / sum(n) OVER (PARTITION BY event_id), 4) AS share FROM n")
def source_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each source type in each event."""
    return aggregate.shares(table(spark, sf_dir, EVIDENCE), "event_id", "source_type")


@query(f"WITH n AS (SELECT event_id, source_type, count(*) AS n FROM {EVIDENCE} GROUP BY ALL), s AS (SELECT event_id, source_type, round(n / sum(n) OVER (PARTITION BY event_id), 4) AS share FROM n) SELECT *, CASE WHEN share < 0.05 THEN 'under' ELSE 'over' END AS risk FROM s WHERE share < 0.05 OR share > 0.4")
def source_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source types with too small or too large a share of an event."""
    s = aggregate.shares(table(spark, sf_dir, EVIDENCE), "event_id", "source_type")
    return s.where((F.col("share") < 0.05) | (F.col("share") > 0.4)).select("event_id", "source_type", "share", F.when(F.col("share") < 0.05, "under").otherwise("over").alias("risk"))


@query(f"SELECT event_id, evidence_id, ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ingested_at DESC, evidence_id DESC) AS r FROM {EVIDENCE}) WHERE r = 1")
def latest_per_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of each event that arrived last."""
    return select.latest(table(spark, sf_dir, EVIDENCE).select("event_id", "evidence_id", "ingested_at"), ["event_id"], ["ingested_at", "evidence_id"])


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total, max(ts) AS last_ts FROM events GROUP BY user_id, event_type")
def attempts_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of each user and type."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("ts").alias("last_ts"))


@query(
    f"""WITH a AS (SELECT event_id, count(*) AS n FROM {EVIDENCE} WHERE collected_at < TIMESTAMP '2024-06-01' GROUP BY event_id), b AS (SELECT event_id, count(*) AS n FROM {EVIDENCE} GROUP BY event_id)
    SELECT b.event_id, coalesce(a.n, 0) AS before, b.n AS after, b.n - coalesce(a.n, 0) AS delta, CASE WHEN b.n - coalesce(a.n, 0) = 0 THEN 'same' WHEN a.n IS NULL THEN 'new' ELSE 'grown' END AS reason FROM b LEFT JOIN a ON a.event_id = b.event_id"""
)
def before_after_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each event before and after a date."""
    e = table(spark, sf_dir, EVIDENCE)
    both = e.groupBy("event_id").agg(F.count(F.when(F.col("collected_at") < F.lit("2024-06-01").cast("timestamp"), 1)).alias("before"), F.count(F.lit(1)).alias("after"))
    delta = F.col("after") - F.col("before")
    return both.select("event_id", "before", "after", delta.alias("delta"), F.when(delta == 0, "same").when(F.col("before") == 0, "new").otherwise("grown").alias("reason"))


# --- ordering and sampling

@query(f"SELECT tuple_id, loaded_at, event_id || '_G_' || lpad(row_number() OVER (PARTITION BY event_id ORDER BY tuple_id, loaded_at)::VARCHAR, greatest(3, len((row_number() OVER (PARTITION BY event_id ORDER BY tuple_id, loaded_at))::VARCHAR))::INT, '0') AS seq_id FROM {CLAIMS}")
def sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential ids of the claims of each event."""
    return select.numbered(table(spark, sf_dir, CLAIMS), "event_id", [F.asc("tuple_id"), F.asc("loaded_at")], F.concat("event_id", F.lit("_G_"))).select("tuple_id", "loaded_at", "seq_id")


@query(
    """WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS num, l_shipdate FROM lineitem),
    d AS (SELECT * FROM l), e AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS k FROM d WHERE num IS NULL),
    s AS (SELECT l_orderkey, unnest(range(1, count(*) + 1)) AS free FROM d GROUP BY l_orderkey), f AS (SELECT l_orderkey, free, row_number() OVER (PARTITION BY l_orderkey ORDER BY free) AS k FROM s WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.l_orderkey = s.l_orderkey AND d.num = s.free))
    SELECT l_orderkey, l_linenumber, free::INT AS filled FROM e JOIN f USING (l_orderkey, k) UNION ALL SELECT l_orderkey, l_linenumber, num::INT FROM d WHERE num IS NOT NULL"""
)
def fill_missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free numbers of each order for the lines without one."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber")).alias("num"))
    out = select.fill_ids(lines, "l_orderkey", "num", [F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_shipdate")], "filled")
    return out.select("l_orderkey", "l_linenumber", "filled")


@query(f"WITH g AS (SELECT DISTINCT event_id FROM {EVENTS}), r AS (SELECT event_id, row_number() OVER (ORDER BY md5(event_id || '|42')) AS p, count(*) OVER () AS n FROM g) SELECT event_id, CASE WHEN p <= round(n * 0.8) THEN 'train' WHEN p <= round(n * 0.8) + round(n * 0.1) THEN 'dev' ELSE 'test' END AS split FROM r")
def split_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, dev and test events."""
    return select.split_by_group(table(spark, sf_dir, EVENTS), "event_id", {"train": 0.8, "dev": 0.1, "test": 0.1}, "42")


@query(
    f"""WITH c AS (SELECT tuple_id AS id, min(event_id) AS event_id, min(evidence_ids) AS own FROM {CLAIMS} GROUP BY tuple_id), p AS (SELECT DISTINCT event_id, evidence_id FROM {EVIDENCE})
    SELECT id, negative FROM (SELECT id, evidence_id AS negative, row_number() OVER (PARTITION BY id ORDER BY md5(id || '|' || evidence_id || '|7'), evidence_id) AS r FROM c JOIN p USING (event_id) WHERE NOT list_contains(own, evidence_id)) WHERE r <= 2"""
)
def negative_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages of its event that a claim doesn't cite."""
    c = table(spark, sf_dir, CLAIMS).groupBy("tuple_id").agg(F.min("event_id").alias("event_id"), F.min("evidence_ids").alias("own"))
    return select.negative_samples(c, "event_id", "tuple_id", "own", table(spark, sf_dir, EVIDENCE), "evidence_id", 2, "7")


@query(
    f"""WITH e AS (SELECT event_id, evidence_id, min(source_type) AS source_type FROM {EVIDENCE} GROUP BY ALL), a AS (SELECT *, row_number() OVER (PARTITION BY event_id, source_type ORDER BY evidence_id) AS sr FROM e)
    SELECT event_id, evidence_id, gr AS group_rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY sr, evidence_id) AS gr FROM a WHERE sr <= 3) WHERE gr <= 10"""
)
def round_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages within a budget of three a source and ten an event."""
    e = table(spark, sf_dir, EVIDENCE).groupBy("event_id", "evidence_id").agg(F.min("source_type").alias("source_type"))
    return planning.round_budget(e, "event_id", "source_type", "evidence_id", 3, 10).select("event_id", "evidence_id", F.col("group_rank").cast("long").alias("group_rank"))


# --- graph

@query(
    f"""WITH n AS (SELECT 'event' AS k, count(DISTINCT event_id) AS n FROM {EVENTS} WHERE trim(event_name) <> '' UNION ALL SELECT 'evidence', count(DISTINCT evidence_id) FROM {EVIDENCE} WHERE trim(coalesce(title, evidence_id)) <> '' UNION ALL SELECT 'source', count(DISTINCT source_type) FROM {EVIDENCE} WHERE trim(source_type) <> ''
      UNION ALL SELECT 'stage', count(DISTINCT temporal_stage) FROM {EVIDENCE} WHERE trim(temporal_stage) <> '' UNION ALL SELECT 'stance', count(DISTINCT stance_hint) FROM {EVIDENCE} WHERE trim(stance_hint) <> '' UNION ALL SELECT 'stakeholder', count(DISTINCT (event_id, stakeholder_hint)) FROM {EVIDENCE} WHERE trim(stakeholder_hint) <> ''),
    r AS (SELECT 'has_evidence' AS k, count(DISTINCT (event_id, evidence_id)) AS n FROM {EVIDENCE} UNION ALL SELECT 'from_source', count(DISTINCT (evidence_id, source_type)) FROM {EVIDENCE} WHERE trim(source_type) <> '' UNION ALL SELECT 'in_stage', count(DISTINCT (evidence_id, temporal_stage)) FROM {EVIDENCE} WHERE trim(temporal_stage) <> ''
      UNION ALL SELECT 'takes_stance', count(DISTINCT (evidence_id, stance_hint)) FROM {EVIDENCE} WHERE trim(stance_hint) <> '' UNION ALL SELECT 'involves', count(DISTINCT (event_id, stakeholder_hint)) FROM {EVIDENCE} WHERE trim(stakeholder_hint) <> '' UNION ALL SELECT 'mentions', count(DISTINCT (event_id, evidence_id, stakeholder_hint)) FROM {EVIDENCE} WHERE trim(stakeholder_hint) <> '')
    SELECT 'node' AS part, k AS kind, n FROM n WHERE n > 0 UNION ALL SELECT 'edge', k, n FROM r WHERE n > 0"""
)
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of the evidence graph by kind."""
    return graph.graph_summary(*graph.evidence_graph(table(spark, sf_dir, EVENTS), table(spark, sf_dir, EVIDENCE)))


@query(
    f"""SELECT 'event:' || regexp_replace(event_id, '[^\\p{{L}}\\p{{N}}_.-]', '_', 'g') AS source, 'stakeholder:' || regexp_replace(event_id, '[^\\p{{L}}\\p{{N}}_.-]', '_', 'g') || ':' || regexp_replace(stakeholder_hint, '[^\\p{{L}}\\p{{N}}_.-]', '_', 'g') AS target, min(evidence_id) AS evidence_id FROM {EVIDENCE} WHERE trim(stakeholder_hint) <> '' GROUP BY 1, 2"""
)
def graph_involves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from events to stakeholders, with the first evidence."""
    return graph.evidence_graph(table(spark, sf_dir, EVENTS), table(spark, sf_dir, EVIDENCE))[1].where("relation = 'involves'").drop("relation")


@query(f"SELECT event_id, event_chain_stage, string_agg(tuple_id, '->' ORDER BY tuple_id, loaded_at) AS chain, count(*) AS n FROM {CLAIMS} GROUP BY event_id, event_chain_stage")
def stage_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of each event and stage as a chain."""
    c = table(spark, sf_dir, CLAIMS).select("event_id", "event_chain_stage", "tuple_id", "loaded_at")
    rows = c.groupBy("event_id", "event_chain_stage").agg(F.array_sort(F.collect_list(F.struct("tuple_id", "loaded_at"))).alias("i"), F.count(F.lit(1)).alias("n"))
    return rows.select("event_id", "event_chain_stage", F.array_join("i.tuple_id", "->").alias("chain"), "n")


# --- planning

@query(
    f"""WITH b AS (SELECT event_id, unnest(list_slice(list_filter(query_seeds, lambda x: x IS NOT NULL AND trim(x) <> ''), 1, 2)) AS seed, generate_subscripts(list_slice(list_filter(query_seeds, lambda x: x IS NOT NULL AND trim(x) <> ''), 1, 2), 1) - 1 AS sn, stakeholder_hints, stance_hints, temporal_stages FROM {EVENTS}),
    p AS (SELECT event_id, s.source, replace(t.p, '{{seed}}', seed) AS query, t.kind AS kind, sn * 100 + s.n * 10 + t.n AS position FROM b, (VALUES (0, 'news'), (1, 'official')) s(n, source), (VALUES (0, 'plain', '{{seed}}'), (1, 'notice', '{{seed}} 通报')) t(n, kind, p)),
    w AS (SELECT event_id, 'any' AS source, seed || ' ' || m.x AS query, m.kind AS kind, 1000 + sn * 100 + m.n AS position FROM (SELECT event_id, seed, sn, unnest(list_transform(l, lambda x, i: {{'kind': x.kind, 'x': x.x, 'n': i - 1}})) AS m FROM (SELECT event_id, seed, sn, list_concat(
        list_transform(list_slice(list_filter(coalesce(stakeholder_hints, []), lambda x: x IS NOT NULL AND trim(x) <> ''), 1, 2), lambda x: {{'kind': 'stakeholder', 'x': x}}), list_transform(list_slice(list_filter(coalesce(stance_hints, []), lambda x: x IS NOT NULL AND trim(x) <> ''), 1, 2), lambda x: {{'kind': 'stance', 'x': x}}), list_transform(list_slice(list_filter(coalesce(temporal_stages, []), lambda x: x IS NOT NULL AND trim(x) <> ''), 1, 2), lambda x: {{'kind': 'stage', 'x': x}})) AS l FROM b))),
    u AS (SELECT event_id, source, query, kind, position FROM p UNION ALL SELECT * FROM w)
    SELECT event_id, query, source, kind, position::BIGINT AS position FROM (SELECT *, row_number() OVER (PARTITION BY event_id, query, source ORDER BY position) AS r FROM u) WHERE r = 1"""
)
def query_plan_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned queries of each event."""
    return planning.expand_queries(table(spark, sf_dir, EVENTS), [("plain", "{seed}"), ("notice", "{seed} 通报")], ["news", "official"])


@query(
    f"""WITH c AS (SELECT event_id, count(*) AS n_rows, count(DISTINCT stakeholder_hint) AS a, count(DISTINCT stance_hint) AS b, count(DISTINCT temporal_stage) AS s, coalesce(bool_or(source_type = 'official'), false) AS o, coalesce(bool_or(source_type = 'public_interaction'), false) AS i FROM {EVIDENCE} GROUP BY event_id)
    SELECT event_id, CASE WHEN NOT o THEN 'official' WHEN NOT i THEN 'source' WHEN a < 2 OR b < 2 OR s < 3 THEN 'semantic' WHEN n_rows < 20 THEN 'low_volume' ELSE 'none' END AS gap FROM c"""
)
def repair_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to repair first for each event."""
    return planning.repair_gap(aggregate.coverage(table(spark, sf_dir, EVIDENCE), "event_id", "stakeholder_hint", "stance_hint", "temporal_stage", "source_type", "url", neutral="回应"))


@query(
    f"""WITH h AS (SELECT event_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), '^www[.]', '') AS host, count(*) AS n FROM {EVIDENCE} WHERE url IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, host) AS k FROM h)
    SELECT r.event_id, 'site:' || host || ' ' || query_seeds[1] AS query FROM r JOIN {EVENTS} e ON r.event_id = e.event_id WHERE k <= 2 AND contains(host, '.')"""
)
def site_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site-scoped queries on the commonest hosts of each event."""
    hosts = table(spark, sf_dir, EVIDENCE).where("url IS NOT NULL").groupBy("event_id", urls.host_of(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    return planning.site_queries(table(spark, sf_dir, EVENTS), hosts)


# --- evaluation

@query(
    f"""WITH g AS (SELECT DISTINCT lower(trim(coalesce(event_id, ''))) AS e, lower(trim(coalesce(opinion, ''))) AS o, lower(trim(coalesce(sentiment, ''))) AS s FROM {GOLD}), p AS (SELECT DISTINCT lower(trim(coalesce(event_id, ''))) AS e, lower(trim(coalesce(opinion, ''))) AS o, lower(trim(coalesce(sentiment, ''))) AS s FROM {CLAIMS}),
    n AS (SELECT (SELECT count(*) FROM g JOIN p USING (e, o, s)) AS tp, (SELECT count(*) FROM g) AS n_gold, (SELECT count(*) FROM p) AS n_pred)
    SELECT tp, n_gold, n_pred, round(tp / n_pred, 4) AS precision, round(tp / n_gold, 4) AS recall, CASE WHEN tp = 0 THEN 0.0 ELSE round(2 * (tp / n_pred) * (tp / n_gold) / (tp / n_pred + tp / n_gold), 4) END AS f1 FROM n"""
)
def exact_tuple_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact F1 of claims against reviewed rows."""
    return metrics.exact_f1(table(spark, sf_dir, GOLD), table(spark, sf_dir, CLAIMS), ["event_id", "opinion", "sentiment"]).select(F.col("tp").cast("long").alias("tp"), F.col("n_gold").cast("long").alias("n_gold"), F.col("n_pred").cast("long").alias("n_pred"), "precision", "recall", "f1")


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, GOLD).where("opinion IS NOT NULL").groupBy("candidate_id").agg(F.min("event_id").alias("event_id"), F.min("opinion").alias("opinion"), F.min("sentiment").alias("sentiment")).withColumnRenamed("candidate_id", "id")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, CLAIMS).where("opinion IS NOT NULL").groupBy("tuple_id").agg(F.min("event_id").alias("event_id"), F.min("opinion").alias("opinion"), F.min("sentiment").alias("sentiment")).withColumnRenamed("tuple_id", "id")


_SET = lambda c: f"list_distinct(list_filter(string_split(regexp_replace({c}, '[\\s\\x{{00a0}}\\x{{3000}}]+', '', 'g'), ''), lambda x: x <> ''))"


@query(
    f"""WITH g AS (SELECT candidate_id AS id, min(event_id) AS event_id, {_SET('min(opinion)')} AS a FROM {GOLD} WHERE opinion IS NOT NULL GROUP BY candidate_id), p AS (SELECT tuple_id AS pid, min(event_id) AS event_id, {_SET('min(opinion)')} AS b FROM {CLAIMS} WHERE opinion IS NOT NULL GROUP BY tuple_id),
    s AS (SELECT g.event_id, id, coalesce(max(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) END), 0.0) AS best FROM g LEFT JOIN p ON g.event_id = p.event_id GROUP BY g.event_id, id)
    SELECT event_id, count(*) AS n_gold, sum((best >= 0.5)::INT)::BIGINT AS n_matched FROM s GROUP BY event_id"""
)
def best_soft_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed rows whose best claim of the event is similar enough."""
    return metrics.best_match(_gold(spark, sf_dir), _claims(spark, sf_dir), "event_id", "id", "opinion", 0.5)


def _sides(gold: str, claims: str, value: str) -> str:
    """CTEs g and p: ids with their event and set of characters."""
    side = lambda t, i, a: f"(SELECT {i} AS id, min(event_id) AS event_id, {_SET(f'min({value})')} AS {a} FROM {t} WHERE {value} IS NOT NULL GROUP BY {i})"
    return f"g AS {side(gold, 'candidate_id', 'a')}, p AS {side(claims, 'tuple_id', 'b')}"


def _greedy(cell: str, source: str, condition: str) -> str:
    """Recursive CTEs that go through the pairs of each cell from the most similar down; `taken` has each side's ids."""
    similarity = "round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6)"
    return f"""x AS (SELECT g.event_id, g.id AS g, p.id AS p, {similarity} AS similarity FROM g JOIN p ON g.event_id = p.event_id WHERE len(a) > 0 AND len(b) > 0), y AS (SELECT {cell} AS cell, g, p, similarity FROM {source} WHERE {condition}),
    r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY similarity DESC, g, p) AS k FROM y),
    w AS (SELECT cell, 0::BIGINT AS k, []::VARCHAR[] AS gs, []::VARCHAR[] AS ps FROM (SELECT DISTINCT cell FROM r) UNION ALL SELECT w.cell, r.k, CASE WHEN list_contains(gs, r.g) OR list_contains(ps, r.p) THEN gs ELSE list_append(gs, r.g) END, CASE WHEN list_contains(gs, r.g) OR list_contains(ps, r.p) THEN ps ELSE list_append(ps, r.p) END FROM w JOIN r ON r.cell = w.cell AND r.k = w.k + 1),
    taken AS (SELECT cell, arg_max(gs, k) AS gs, arg_max(ps, k) AS ps FROM w GROUP BY cell)"""


_SCORES = """round(CASE WHEN n_pred = 0 THEN 0.0 ELSE tp / n_pred END, 4) AS precision, round(CASE WHEN n_gold = 0 THEN 0.0 ELSE tp / n_gold END, 4) AS recall, CASE WHEN tp = 0 THEN 0.0 ELSE round(2 * (tp / n_pred) * (tp / n_gold) / (tp / n_pred + tp / n_gold), 4) END AS f1"""


@query(
    f"""WITH RECURSIVE {_sides(GOLD, CLAIMS, 'opinion')}, {_greedy('event_id', 'x', 'similarity >= 0.5')},
    n AS (SELECT (SELECT coalesce(sum(len(gs)), 0)::BIGINT FROM taken) AS tp, (SELECT count(*) FROM g) AS n_gold, (SELECT count(*) FROM p) AS n_pred) SELECT tp, n_gold, n_pred, {_SCORES} FROM n"""
)
def greedy_match_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one soft F1, pairs taken from the most similar down."""
    return metrics.soft_f1(_gold(spark, sf_dir), _claims(spark, sf_dir), "event_id", "id", "opinion")


@query(
    f"""WITH RECURSIVE {_sides(GOLD, CLAIMS, 'opinion')}, t AS (SELECT unnest([0.3e0, 0.5e0, 0.7e0]) AS threshold), {_greedy("event_id || '|' || threshold", 'x, t', 'similarity >= threshold')}
    SELECT string_split(cell, '|')[2]::DOUBLE AS threshold, sum(len(gs))::BIGINT AS tp FROM taken GROUP BY 1"""
)
def metric_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one matches at several thresholds."""
    return metrics.sensitivity(_gold(spark, sf_dir), _claims(spark, sf_dir), "event_id", "id", "opinion", [0.3, 0.5, 0.7])


@query(
    f"""WITH RECURSIVE {_sides(GOLD, CLAIMS, 'opinion')}, {_greedy('event_id', 'x', 'similarity >= 0.5')}, m AS (SELECT unnest(gs) AS g, unnest(ps) AS p FROM taken),
    s AS (SELECT candidate_id AS id, min(sentiment) AS s FROM {GOLD} WHERE opinion IS NOT NULL GROUP BY 1), q AS (SELECT tuple_id AS id, min(sentiment) AS s FROM {CLAIMS} WHERE opinion IS NOT NULL GROUP BY 1)
    SELECT count(*) AS n, count(*) FILTER (s.s IS NOT DISTINCT FROM q.s) AS n_right, round(CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (s.s IS NOT DISTINCT FROM q.s) / count(*) END, 4) AS sentiment_accuracy FROM m JOIN s ON s.id = m.g JOIN q ON q.id = m.p"""
)
def matched_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the sentiments of one-to-one matched rows agree."""
    g, p = _gold(spark, sf_dir), _claims(spark, sf_dir)
    matched = metrics.greedy_pairs(metrics.similar_pairs(g, p, "event_id", "id", "opinion", 0.5), "grp").select("g", "p")
    return metrics.sentiment_accuracy(matched, g, p, "id", "sentiment")


_LABELS = ["supported", "partially_supported", "insufficient_evidence"]


@query(
    f"""WITH l AS (SELECT unnest({_LABELS}) AS l), c AS (SELECT support_status AS gold, CASE WHEN confidence >= 0.7 THEN 'supported' WHEN confidence >= 0.4 THEN 'partially_supported' ELSE 'insufficient_evidence' END AS predicted, count(*) AS n FROM {CLAIMS} GROUP BY ALL)
    SELECT a.l AS gold, b.l AS predicted, coalesce(c.n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN c ON c.gold = a.l AND c.predicted = b.l"""
)
def support_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion of given and scored support labels."""
    c = table(spark, sf_dir, CLAIMS).withColumn("p", F.when(F.col("confidence") >= 0.7, "supported").when(F.col("confidence") >= 0.4, "partially_supported").otherwise("insufficient_evidence"))
    return metrics.confusion(c, "support_status", "p", _LABELS)


@query(
    f"""WITH c AS (SELECT support_status AS g, CASE WHEN confidence >= 0.7 THEN 'supported' WHEN confidence >= 0.4 THEN 'partially_supported' ELSE 'insufficient_evidence' END AS p FROM {CLAIMS} WHERE support_status IN ('supported', 'partially_supported', 'insufficient_evidence')),
    l AS (SELECT unnest({_LABELS}) AS label), s AS (SELECT label, (SELECT count(*) FROM c WHERE g = label AND p = label) AS tp, (SELECT count(*) FROM c WHERE p = label) AS np, (SELECT count(*) FROM c WHERE g = label) AS ng FROM l),
    r AS (SELECT label, tp, CASE WHEN np = 0 THEN 0.0 ELSE tp / np END AS pr, CASE WHEN ng = 0 THEN 0.0 ELSE tp / ng END AS re FROM s)
    SELECT label, tp, round(pr, 4) AS precision, round(re, 4) AS recall, CASE WHEN pr + re = 0 THEN 0.0 ELSE round(2 * pr * re / (pr + re), 4) END AS f1 FROM r"""
)
def support_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of each support label."""
    return metrics.class_scores(support_confusion(spark, sf_dir))


@query(
    f"""WITH g AS (SELECT DISTINCT event_id, unnest(string_split(evidence_ids, '|')) AS i FROM {GOLD}), p AS (SELECT DISTINCT event_id, unnest(evidence_ids) AS i FROM {CLAIMS}), n AS (SELECT (SELECT count(*) FROM g JOIN p USING (event_id, i)) AS tp, (SELECT count(*) FROM g) AS n_gold, (SELECT count(*) FROM p) AS n_pred)
    SELECT tp, n_gold, n_pred, round(tp / n_pred, 4) AS precision, round(tp / n_gold, 4) AS recall, CASE WHEN tp = 0 THEN 0.0 ELSE round(2 * (tp / n_pred) * (tp / n_gold) / (tp / n_pred + tp / n_gold), 4) END AS f1 FROM n"""
)
def set_overlap_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro scores of cited evidence by event."""
    g = table(spark, sf_dir, GOLD).select("event_id", F.split("evidence_ids", "[|]").alias("items"))
    return metrics.set_overlap(g, table(spark, sf_dir, CLAIMS).select("event_id", F.col("evidence_ids").alias("items")), "event_id", "items")


# --- tasks, sheets, payloads

@query(f"WITH c AS (SELECT event_id, count(*) AS n_gold, array_to_string(list_sort(list(DISTINCT coalesce(stakeholder, ''))), ';') AS stakeholders FROM {CLAIMS} GROUP BY event_id) SELECT 'tuple_' || e.event_id AS task_id, e.event_id, event_name, n_gold, stakeholders FROM {EVENTS} e JOIN c ON e.event_id = c.event_id")
def tuple_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identification tasks."""
    return review.tuple_tasks(table(spark, sf_dir, EVENTS), table(spark, sf_dir, CLAIMS))


@query(
    f"""WITH c AS (SELECT tuple_id AS id, min(event_id) AS event_id, min(evidence_ids) AS own FROM {CLAIMS} GROUP BY tuple_id), p AS (SELECT DISTINCT event_id, evidence_id FROM {EVIDENCE}),
    n AS (SELECT id, evidence_id FROM (SELECT id, evidence_id, row_number() OVER (PARTITION BY id ORDER BY md5(id || '|' || evidence_id || '|7'), evidence_id) AS r FROM c JOIN p USING (event_id) WHERE NOT list_contains(own, evidence_id)) WHERE r <= 2)
    SELECT 'support_' || id || '_' || evidence_id AS task_id, evidence_id, 'not_enough_info' AS label FROM n UNION ALL SELECT 'support_' || id || '_' || e, e, 'supported' FROM (SELECT id, unnest(list_distinct(own)) AS e FROM c)"""
)
def support_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support classification tasks with sampled negatives."""
    c = table(spark, sf_dir, CLAIMS).groupBy("tuple_id").agg(F.min("event_id").alias("event_id"), F.min("evidence_ids").alias("own"))
    return review.support_tasks(c, negative_sampling(spark, sf_dir), "tuple_id", "own")


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers made from the claims of each event, some without JSON and some for the wrong event."""
    c = table(spark, sf_dir, CLAIMS).groupBy("tuple_id").agg(*(F.min(x).alias(x) for x in ("event_id", "stakeholder", "opinion", "sentiment", "rationale", "evidence_ids", "confidence")))
    t = F.array_sort(F.collect_list(F.struct("tuple_id", "stakeholder", "opinion", "sentiment", "rationale", "evidence_ids", "confidence")))
    answers = c.groupBy("event_id").agg(t.alias("t"))
    number = F.substring("event_id", 2, 20).cast("int")
    body = F.to_json(F.struct(F.when(number % 7 == 0, "E0").otherwise(F.col("event_id")).alias("event_id"), F.transform("t", lambda x: F.struct(*(x[f].alias(f) for f in ("stakeholder", "opinion", "sentiment", "rationale", "evidence_ids", "confidence")))).alias("tuples")))
    raw = F.when(number % 11 == 0, "sorry").otherwise(F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```")))
    return answers.select("event_id", raw.alias("raw"), F.flatten(F.transform("t", lambda x: x["evidence_ids"])).alias("known"))


@query(f"SELECT event_id, CASE WHEN substring(event_id, 2)::INT % 11 = 0 THEN 'no_json' WHEN substring(event_id, 2)::INT % 7 = 0 THEN 'wrong_event' ELSE 'ok' END AS error FROM (SELECT DISTINCT event_id FROM {CLAIMS})")
def payload_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error code of each model answer."""
    return payload.parsed(_payloads(spark, sf_dir), "raw").select("event_id", F.coalesce("error", F.lit("ok")).alias("error"))


@query(
    f"""WITH c AS (SELECT tuple_id, min(event_id) AS event_id, min(stakeholder) AS s, min(opinion) AS o, min(sentiment) AS m, min(evidence_ids) AS e FROM {CLAIMS} GROUP BY tuple_id), k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY tuple_id) AS n FROM c WHERE substring(event_id, 2)::INT % 11 <> 0 AND substring(event_id, 2)::INT % 7 <> 0 AND NOT {_BLANK('s')} AND NOT {_BLANK('o')} AND len(e) > 0 AND lower(trim(m)) IN ('positive','negative','neutral','mixed','unclear'))
    SELECT event_id || '_SOA_' || lpad(n::VARCHAR, 3, '0') AS tuple_id, lower(trim(m)) AS sentiment, len(list_distinct(e))::BIGINT AS n_ids FROM k WHERE n <= 4"""
)
def payload_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims read back from model answers, four at most for each event."""
    p = payload.parsed(_payloads(spark, sf_dir), "raw")
    return payload.payload_tuples(p, "event_id", "known").select("tuple_id", "sentiment", F.size("evidence_ids").cast("long").alias("n_ids"))


@query(
    """SELECT event_type, CASE WHEN try_cast(props->>'$.k' AS INT) % 5 = 0 THEN 'timeout' WHEN try_cast(props->>'$.k' AS INT) % 5 = 1 THEN 'rate_limit' WHEN try_cast(props->>'$.k' AS INT) % 5 = 2 THEN 'parse' ELSE 'none' END AS kind, count(*) AS n FROM events GROUP BY ALL"""
)
def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each attempt type by kind."""
    k = F.get_json_object("props", "$.k").try_cast("int") % 5
    message = F.when(k == 0, "Request timed out").when(k == 1, "HTTP 429 rate limit").when(k == 2, "Expecting value: JSON").otherwise("")
    return table(spark, sf_dir, "events").groupBy("event_type", payload.error_kind(message).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT candidate_id, evidence_id, support_label FROM (SELECT candidate_id, unnest(CASE WHEN len(string_split(evidence_ids, '|')) > 0 THEN string_split(evidence_ids, '|') ELSE [NULL] END) AS evidence_id, support_label FROM {GOLD})")
def review_sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review row for each reviewed claim and cited id."""
    g = table(spark, sf_dir, GOLD).select("candidate_id", "support_label", F.split("evidence_ids", "[|]").alias("refs"))
    return review.sheet_rows(g, "refs").select("candidate_id", "evidence_id", "support_label")


@query(f"SELECT evidence_id, ingested_at, CASE WHEN regexp_matches(publish_time, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[ T][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') AND try_cast(left(publish_time, 19) AS TIMESTAMP) IS NOT NULL THEN 1 END AS has_time FROM {EVIDENCE}")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages have an ISO-like time that can be read; null for all others."""
    like = F.col("publish_time").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}")
    return table(spark, sf_dir, EVIDENCE).select("evidence_id", "ingested_at", F.when(like & cells.iso_time(F.left("publish_time", F.lit(19))).isNotNull(), 1).alias("has_time"))

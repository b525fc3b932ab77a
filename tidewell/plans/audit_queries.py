"""Queries that project records for sheets and prompts, audit runs and gold data, and name what went wrong."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import cells, text
from tidewell.operators import classify, metrics, score, select, similarity, validate
from tidewell.plans.catalog import CLAIMS, EVENTS, EVIDENCE, GOLD, query
from tidewell.plans.evidence_queries import _RELEVANCE, _STAGE, STAGES, relevance_rows, stage_rows
from tidewell.plans.relation_queries import _BLANK, _SET, _claims, _gold
from tidewell.plans.text_queries import _STRIP
from tidewell.session import ensure_checkpoint_dir
from tidewell.sources.tables import table
from tidewell.streaming.ingest import ingest_new, windowed_counts

POSITIVE, INFERRED, MEDIA, OFFICIAL = ["支持", "认可", "满意"], ["担心", "质疑", "希望"], ["媒体", "日报", "晚报"], ["政府", "局", "委员会"]
ALIASES = {"住建": ["住房建设局", "住建局"], "教育": ["教育局", "学校"], "监管": ["市场监管", "监管部门"], "官方": ["通报", "部门"], "学生": ["同学", "学生"]}
GENERIC_TOPICS, STOP = ["停车", "教育", "医院"], ["记者", "关于", "the", "and"]
TRUSTED = ["官方", "政府网", "日报"]
CORE = ["trigger", "response"]

_LIST = lambda terms: str(list(terms))
_ANY = lambda c, terms: "(" + " OR ".join(f"contains({c}, '{t}')" for t in terms) + ")"
_FIRST = lambda t, k, cols, order: f"(SELECT {k}, " + ", ".join(f"arg_min({c}, {order}) AS {c}" for c in cols) + f" FROM {t} GROUP BY {k})"


# --- projections


@query(
    f"""SELECT tuple_id, loaded_at, coalesce(event_id, '') AS event_id, coalesce(stakeholder, '') AS stakeholder, coalesce(opinion, '') AS opinion, coalesce(sentiment, 'unknown') AS sentiment, coalesce(array_to_string(evidence_ids, '|'), '') AS evidence_ids,
      CASE coalesce(support_status, 'candidate_unclear') WHEN 'supported' THEN 'supported' WHEN 'partially_supported' THEN 'partially_supported' ELSE 'insufficient_evidence' END AS support_label, coalesce(confidence, 0.5) AS support_score, false AS verified FROM {CLAIMS}"""
)
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates as predictions, with defaults for what they lack."""
    or_ = lambda c, d: F.coalesce(c, F.lit(d)).alias(c)
    label = F.when(F.col("support_status").isin("supported", "partially_supported"), F.col("support_status")).otherwise("insufficient_evidence")
    return table(spark, sf_dir, CLAIMS).select("tuple_id", "loaded_at", or_("event_id", ""), or_("stakeholder", ""), or_("opinion", ""), or_("sentiment", "unknown"), F.coalesce(F.array_join("evidence_ids", "|"), F.lit("")).alias("evidence_ids"), label.alias("support_label"), F.coalesce("confidence", F.lit(0.5)).alias("support_score"), F.lit(False).alias("verified"))


@query(
    f"""SELECT evidence_id, ingested_at, to_json({{'evidence_id': evidence_id, 'event_id': event_id, 'source_type': coalesce(source_type, ''), 'title': coalesce(title, ''), 'url': coalesce(url, ''), 'n': length(left(coalesce(text, ''), 200))}})::VARCHAR AS compact FROM {EVIDENCE}"""
)
def compact_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a compact record for tasks, its text cut to 200 characters (shown by its length)."""
    or_ = lambda c: F.coalesce(c, F.lit("")).alias(c)
    record = F.struct("evidence_id", "event_id", or_("source_type"), or_("title"), or_("url"), F.length(F.left(F.coalesce("text", F.lit("")), F.lit(200))).alias("n"))
    return table(spark, sf_dir, EVIDENCE).select("evidence_id", "ingested_at", F.to_json(record, {"ignoreNullFields": "false"}).alias("compact"))


@query(
    f"""WITH {_STAGE}, e AS (SELECT evidence_id, ingested_at, source, url, title, text FROM {EVIDENCE})
    SELECT f.event_id, f.evidence_id, f.ingested_at, f.stage, coalesce(e.source, '') AS source, coalesce(e.url, '') AS url, coalesce(e.title, '') AS title, left(coalesce(e.text, ''), 500) AS text_excerpt, f.final, f.relevance FROM sf f LEFT JOIN e ON e.evidence_id = f.evidence_id AND e.ingested_at = f.ingested_at"""
)
def prompt_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain items with the fields of their pages, ready for a prompt."""
    e = table(spark, sf_dir, EVIDENCE).select("evidence_id", "ingested_at", "source", "url", "title", "text")
    or_ = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return stage_rows(spark, sf_dir).join(e, ["evidence_id", "ingested_at"], "left").select("event_id", "evidence_id", "ingested_at", "stage", or_("source"), or_("url"), or_("title"), F.left(F.coalesce("text", F.lit("")), F.lit(500)).alias("text_excerpt"), "final", "relevance")


_GROUPS = {"residents": ["居民", "业主", "住户"], "officials": ["政府", "住建", "城管"], "schools": ["学校", "老师", "家长"], "companies": ["公司", "企业", "开发商"]}
_SENTIMENTS = {"negative": ["反对", "质疑", "投诉"], "positive": ["支持", "认可", "满意"]}
_HITS = lambda groups, c: "list_filter([" + ", ".join(f"CASE WHEN {_ANY(c, t)} THEN '{n}' END" for n, t in groups.items()) + "], lambda x: x IS NOT NULL)"


@query(
    f"""SELECT evidence_id, ingested_at, coalesce(event_id, '') AS event_id, coalesce(platform, '') AS platform, coalesce(array_to_string({_HITS(_GROUPS, "coalesce(text, '')")}, ';'), '') AS candidate_stakeholder, CASE WHEN len({_HITS(_SENTIMENTS, "coalesce(text, '')")}) = 1 THEN {_HITS(_SENTIMENTS, "coalesce(text, '')")}[1] ELSE '' END AS candidate_sentiment, '' AS candidate_opinion, '' AS support_label, '' AS notes FROM {EVIDENCE}"""
)
def annotation_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet row of each page: what is inferred, and blank cells for the annotator."""
    t = F.coalesce("text", F.lit(""))
    blanks = [F.lit("").alias(c) for c in ("candidate_opinion", "support_label", "notes")]
    return table(spark, sf_dir, EVIDENCE).select("evidence_id", "ingested_at", F.coalesce("event_id", F.lit("")).alias("event_id"), F.coalesce("platform", F.lit("")).alias("platform"), F.array_join(classify.group_hits(t, _GROUPS), ";").alias("candidate_stakeholder"), F.coalesce(classify.only_group(t, _SENTIMENTS), F.lit("")).alias("candidate_sentiment"), *blanks)


@query(
    f"""WITH c AS (SELECT tuple_id, arg_min(event_id, loaded_at) AS event_id, arg_min(stakeholder, loaded_at) AS stakeholder, arg_min(support_status, loaded_at) AS support_status FROM {CLAIMS} GROUP BY tuple_id)
    SELECT r.event_id, coalesce(r.event_name, '') AS event_name, coalesce(c.tuple_id, '') AS tuple_id, coalesce(c.stakeholder, '') AS stakeholder, CASE WHEN c.tuple_id IS NULL THEN 'no_candidates' ELSE coalesce(c.support_status, 'unknown') END AS status FROM {EVENTS} r LEFT JOIN c ON c.event_id = r.event_id"""
)
def pilot_audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's candidates for an audit; a blank row for an event without any."""
    c = table(spark, sf_dir, CLAIMS).groupBy("tuple_id").agg(*(F.min_by(x, "loaded_at").alias(x) for x in ("event_id", "stakeholder", "support_status")))
    j = table(spark, sf_dir, EVENTS).select("event_id", "event_name").join(c, "event_id", "left")
    return j.select("event_id", F.coalesce("event_name", F.lit("")).alias("event_name"), F.coalesce("tuple_id", F.lit("")).alias("tuple_id"), F.coalesce("stakeholder", F.lit("")).alias("stakeholder"), F.when(F.col("tuple_id").isNull(), "no_candidates").otherwise(F.coalesce("support_status", F.lit("unknown"))).alias("status"))


@query(
    f"""WITH {_STAGE}, l AS (SELECT evidence_id, arg_max(stage, priority) AS chain_stage FROM sf GROUP BY evidence_id), e AS (SELECT evidence_id, arg_min(event_id, ingested_at) AS event_id, arg_min(title, ingested_at) AS title FROM {EVIDENCE} GROUP BY evidence_id)
    SELECT e.event_id, e.evidence_id, coalesce(title, '') AS title, coalesce(chain_stage, 'unknown') AS chain_stage FROM e LEFT JOIN l ON l.evidence_id = e.evidence_id"""
)
def evidence_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its stage in the event's chain; the last stage of several."""
    last = stage_rows(spark, sf_dir).groupBy("evidence_id").agg(F.max_by("stage", "priority").alias("chain_stage"))
    e = table(spark, sf_dir, EVIDENCE).groupBy("evidence_id").agg(F.min_by("event_id", "ingested_at").alias("event_id"), F.min_by("title", "ingested_at").alias("title"))
    return e.join(last, "evidence_id", "left").select("event_id", "evidence_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("chain_stage", F.lit("unknown")).alias("chain_stage"))


_ONCE = f"(SELECT DISTINCT candidate_id, event_id, stakeholder, opinion, sentiment, rationale, evidence_ids, support_label, suspected_issue FROM {GOLD})"


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, GOLD).select("candidate_id", "event_id", "stakeholder", "opinion", "sentiment", "rationale", "evidence_ids", "support_label", "suspected_issue").distinct()


@query(
    f"""SELECT candidate_id, coalesce(nullif({_STRIP('stakeholder')}, ''), 'unknown') AS gold_stakeholder, coalesce(nullif({_STRIP('opinion')}, ''), nullif({_STRIP('rationale')}, ''), '') AS gold_opinion, coalesce(nullif({_STRIP('sentiment')}, ''), 'neutral') AS gold_sentiment, 'accept' AS human_decision, 'auto' AS reviewer FROM {_ONCE} WHERE support_label = 'supported' AND coalesce(trim(suspected_issue), '') = ''"""
)
def auto_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supported rows without an issue, their gold columns filled from the candidate."""
    rows = _reviewed(spark, sf_dir).where((F.col("support_label") == "supported") & (F.coalesce(F.trim("suspected_issue"), F.lit("")) == ""))
    full = lambda c: F.when(text.strip(F.col(c)) != "", text.strip(F.col(c)))
    return rows.select("candidate_id", F.coalesce(full("stakeholder"), F.lit("unknown")).alias("gold_stakeholder"), F.coalesce(full("opinion"), full("rationale"), F.lit("")).alias("gold_opinion"), F.coalesce(full("sentiment"), F.lit("neutral")).alias("gold_sentiment"), F.lit("accept").alias("human_decision"), F.lit("auto").alias("reviewer"))


@query(
    f"""SELECT candidate_id, trim(coalesce(event_id, '')) AS event_id, array_to_string(list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce(evidence_ids, ''), '[;|,]'), lambda x: trim(x)), lambda x: x <> '')), '|') IS NOT NULL AS has_list, len(list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce(evidence_ids, ''), '[;|,]'), lambda x: trim(x)), lambda x: x <> '')))::INT AS n_evidence,
      to_json({{'source': 'human_reviewed_llm_assisted', 'human_decision': CASE support_label WHEN 'supported' THEN 'accept' ELSE 'revise' END, 'review_status': 'reviewed', 'notes': coalesce(suspected_issue, '')}})::VARCHAR AS provenance FROM {_ONCE} WHERE support_label IN ('supported', 'partially_supported')"""
)
def gold_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed rows as gold records, with where they come from."""
    ids = F.array_distinct(cells.cell_list(F.col("evidence_ids")))
    made = F.struct(F.lit("human_reviewed_llm_assisted").alias("source"), F.when(F.col("support_label") == "supported", "accept").otherwise("revise").alias("human_decision"), F.lit("reviewed").alias("review_status"), F.coalesce("suspected_issue", F.lit("")).alias("notes"))
    return _reviewed(spark, sf_dir).where(F.col("support_label").isin("supported", "partially_supported")).select("candidate_id", F.trim(F.coalesce("event_id", F.lit(""))).alias("event_id"), ids.isNotNull().alias("has_list"), F.size(ids).alias("n_evidence"), F.to_json(made).alias("provenance"))


@query(
    f"""SELECT evidence_id, ingested_at, event_id, coalesce(nullif(trim(stakeholder_hint), ''), nullif(trim(platform), ''), nullif(trim(source), ''), 'unknown') AS stakeholder, 'unknown' AS sentiment, 0.5::DOUBLE AS support_score, stage FROM (WITH {_STAGE} SELECT sf.stage, e.* FROM sf JOIN {EVIDENCE} e ON e.evidence_id = sf.evidence_id AND e.ingested_at = sf.ingested_at)"""
)
def rule_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tuple of each chain item, named by the page's hint, platform or source."""
    e = table(spark, sf_dir, EVIDENCE).select("evidence_id", "ingested_at", "stakeholder_hint", "platform", "source")
    full = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return stage_rows(spark, sf_dir).select("event_id", "evidence_id", "ingested_at", "stage").join(e, ["evidence_id", "ingested_at"]).select("evidence_id", "ingested_at", "event_id", F.coalesce(full("stakeholder_hint"), full("platform"), full("source"), F.lit("unknown")).alias("stakeholder"), F.lit("unknown").alias("sentiment"), F.lit(0.5).alias("support_score"), "stage")


@query(
    f"""SELECT tuple_id, loaded_at, coalesce(opinion, '') AS answer, CASE WHEN length(coalesce(raw_response_id, '')) <= 8 THEN left(coalesce(raw_response_id, ''), 1) || '***' || right(coalesce(raw_response_id, ''), 1) ELSE left(raw_response_id, 4) || '***' || right(raw_response_id, 4) END AS masked_id FROM {CLAIMS}"""
)
def chat_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of chat payloads in three shapes, made from the opinions; ids masked like secrets."""
    said = F.coalesce("opinion", F.lit(""))
    choices = F.to_json(F.struct(F.array(F.struct(F.struct(said.alias("content")).alias("message"))).alias("choices")))
    shape = F.pmod(F.xxhash64("tuple_id"), F.lit(3))
    payload = F.when(shape == 0, choices).when(shape == 1, F.to_json(F.struct(said.alias("content")))).otherwise(said)
    return table(spark, sf_dir, CLAIMS).withColumn("payload", payload).select("tuple_id", "loaded_at", cells.answer_text(F.col("payload")).alias("answer"), cells.masked(F.col("raw_response_id")).alias("masked_id"))


@query(
    f"""WITH s AS (SELECT event_id, unnest(query_seeds) AS seed FROM {EVENTS}), r AS (SELECT event_id, unnest(list_concat(list_filter(regexp_extract_all(trim(seed), '[\\x{{4e00}}-\\x{{9fff}}A-Za-z0-9]{{2,}}'), lambda t: t NOT IN ({', '.join(f"'{t}'" for t in STOP)}) AND len(t) <= 12), CASE WHEN length(trim(seed)) BETWEEN 1 AND 20 THEN [trim(seed)] ELSE [] END)) AS term FROM s WHERE seed IS NOT NULL)
    SELECT DISTINCT event_id, term, length(term) >= 2 AND term NOT IN ({', '.join(f"'{t}'" for t in STOP)}) AND NOT {_ANY('term', GENERIC_TOPICS)} AS specific FROM r"""
)
def seed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of up to twelve letters and short values of each event's seeds, and whether they are specific to it."""
    e = table(spark, sf_dir, EVENTS).select("event_id", F.explode(text.term_list(F.col("query_seeds"), STOP)).alias("term"), "query_seeds")
    # windows of longer runs are left to event_terms: here only whole runs and whole values count
    whole = F.exists("query_seeds", lambda s: (F.trim(s) == F.col("term")) | F.array_contains(F.regexp_extract_all(F.trim(s), F.lit("[\\x{4e00}-\\x{9fff}A-Za-z0-9]{2,}"), 0), F.col("term")))
    return e.where(whole).select("event_id", "term", text.is_specific(F.col("term"), STOP, GENERIC_TOPICS).alias("specific")).distinct()


# --- classifiers and checks


_CITED = f"""e AS (SELECT evidence_id, arg_min(text, ingested_at) AS text, arg_min(title, ingested_at) AS title, arg_min(temporal_stage, ingested_at) AS stage, arg_min(event_id, ingested_at) AS event_id FROM {EVIDENCE} GROUP BY evidence_id),
    c AS (SELECT tuple_id, arg_min(event_id, loaded_at) AS event_id, arg_min(stakeholder, loaded_at) AS stakeholder, arg_min(opinion, loaded_at) AS opinion, arg_min(rationale, loaded_at) AS rationale, arg_min(sentiment, loaded_at) AS sentiment, arg_min(event_chain_stage, loaded_at) AS stage, arg_min(evidence_ids, loaded_at) AS evidence_ids FROM {CLAIMS} GROUP BY tuple_id)"""


def _once_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, CLAIMS).groupBy("tuple_id").agg(*(F.min_by(x, "loaded_at").alias(x) for x in ("event_id", "stakeholder", "opinion", "rationale", "sentiment", "event_chain_stage", "evidence_ids")))


def _once_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, EVIDENCE).groupBy("evidence_id").agg(*(F.min_by(x, "ingested_at").alias(x) for x in ("event_id", "text", "title", "source_type", "platform", "domain", "temporal_stage", "stance_hint", "stakeholder_hint")))


_LOOSE_SQL = lambda t, n: f"(length({n}) > 0 AND (contains({t}, {n}) OR (length({n}) >= 4 AND contains({t}, left({n}, 4)))))"
_ALIAS_SQL = lambda n, t: "(" + " OR ".join(f"(contains({n}, '{w}') AND {_ANY(t, f)})" for w, f in ALIASES.items()) + ")"


@query(
    f"""WITH {_CITED}, i AS (SELECT tuple_id, unnest(evidence_ids) AS id FROM c), j AS (SELECT i.tuple_id, count(*) AS n, count(e.evidence_id) AS n_found, count(CASE WHEN e.evidence_id IS NOT NULL AND coalesce(trim(e.text), '') = '' THEN 1 END) AS n_blank, coalesce(string_agg(coalesce(e.text, ''), chr(10) ORDER BY id) FILTER (e.evidence_id IS NOT NULL), '') AS t FROM i LEFT JOIN e ON e.evidence_id = i.id GROUP BY i.tuple_id),
    k AS (SELECT event_id, list(DISTINCT stage) FILTER (coalesce(trim(stage), '') <> '') AS known FROM e GROUP BY event_id),
    f AS (SELECT c.tuple_id, coalesce(stakeholder, '') AS s, coalesce(opinion, '') AS o, coalesce(rationale, '') AS r, coalesce(sentiment, '') AS m, coalesce(c.stage, '') AS st, coalesce(n, 0) AS n, coalesce(n_found, 0) AS n_found, coalesce(n_blank, 0) AS n_blank, coalesce(t, '') AS t, known FROM c LEFT JOIN j ON j.tuple_id = c.tuple_id LEFT JOIN k ON k.event_id = c.event_id)
    SELECT tuple_id, coalesce(nullif(array_to_string(list_filter([CASE WHEN n_found < n THEN 'missing_evidence' END, CASE WHEN n_blank > 0 THEN 'weak_evidence' END,
      CASE WHEN n_found > 0 AND s <> '' AND NOT ({_LOOSE_SQL('t', 's')} OR {_ALIAS_SQL('s', 't')}) THEN 'stakeholder_not_supported' END, CASE WHEN n_found > 0 AND r <> '' AND NOT {_LOOSE_SQL('t', 'r')} THEN 'rationale_not_supported' END,
      CASE WHEN m = 'positive' AND NOT {_ANY('t', POSITIVE)} AND {_ANY('s', MEDIA)} THEN 'media_comment_should_be_neutral' END, CASE WHEN m = 'positive' AND NOT {_ANY('t', POSITIVE)} AND {_ANY('s', OFFICIAL)} THEN 'official_action_should_be_neutral' END, CASE WHEN m = 'positive' AND NOT {_ANY('t', POSITIVE)} AND {_ANY('s', MEDIA + OFFICIAL)} THEN 'sentiment_not_supported' END,
      CASE WHEN {_ANY('o', INFERRED)} AND NOT {_ANY('t', INFERRED)} THEN 'opinion_overgeneralized' END, CASE WHEN len(known) > 0 AND st NOT IN ('', 'unknown') AND NOT list_contains(known, st) THEN 'stage_mismatch' END], lambda x: x IS NOT NULL), '|'), ''), 'no_issue') AS issue_flags FROM f"""
)
def precheck_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rule flags of each claim against the evidence it cites, before any model is asked."""
    e, c = _once_pages(spark, sf_dir), _once_claims(spark, sf_dir)
    cited = c.select("tuple_id", F.explode("evidence_ids").alias("evidence_id")).join(e.select("evidence_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("here")), "evidence_id", "left")
    j = cited.groupBy("tuple_id").agg(F.count(F.lit(1)).alias("n"), F.count("here").alias("n_found"), F.count_if(F.col("here").isNotNull() & (F.trim("text") == "")).alias("n_blank"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("here").isNotNull(), F.struct("evidence_id", "text")))), lambda x: x["text"]), "\n").alias("t"))
    known = e.where(~text.blank(F.col("temporal_stage"))).groupBy("event_id").agg(F.collect_set("temporal_stage").alias("known"))
    rows = c.join(j, "tuple_id", "left").join(known, "event_id", "left").withColumns({"t": F.coalesce("t", F.lit("")), "n_found": F.coalesce("n_found", F.lit(0)), **{x: F.coalesce(x, F.lit("")) for x in ("stakeholder", "opinion", "rationale", "sentiment", "event_chain_stage")}})
    s, o, r, t = (F.col(x) for x in ("stakeholder", "opinion", "rationale", "t"))
    loose = lambda n: (F.length(n) > 0) & (F.contains(t, n) | ((F.length(n) >= 4) & F.contains(t, F.left(n, F.lit(4)))))
    alias = text.contains_any(s, [])
    for word, forms in ALIASES.items():
        alias = alias | (F.contains(s, F.lit(word)) & text.contains_any(t, forms))
    praised = (F.col("sentiment") == "positive") & ~text.contains_any(t, POSITIVE)
    conditions = {
        "missing_evidence": F.col("n_found") < F.coalesce("n", F.lit(0)), "weak_evidence": F.col("n_blank") > 0, "stakeholder_not_supported": (F.col("n_found") > 0) & (s != "") & ~(loose(s) | alias), "rationale_not_supported": (F.col("n_found") > 0) & (r != "") & ~loose(r),
        "media_comment_should_be_neutral": praised & text.contains_any(s, MEDIA), "official_action_should_be_neutral": praised & text.contains_any(s, OFFICIAL), "sentiment_not_supported": praised & text.contains_any(s, MEDIA + OFFICIAL),
        "opinion_overgeneralized": text.contains_any(o, INFERRED) & ~text.contains_any(t, INFERRED), "stage_mismatch": (F.size("known") > 0) & ~F.col("event_chain_stage").isin("", "unknown") & ~F.array_contains("known", F.col("event_chain_stage")),
    }
    flags = classify.flags(conditions)
    return rows.select("tuple_id", F.when(F.size(flags) == 0, "no_issue").otherwise(F.array_join(flags, "|")).alias("issue_flags"))


@query(
    f"""WITH {_CITED} SELECT tuple_id, CASE WHEN length(s) >= 2 AND (contains(t, substring(s, 1, 1)) OR contains(t, substring(s, 2, 1)) OR (length(s) >= 3 AND contains(t, substring(s, 3, 1)))) THEN 'partially_supported' ELSE 'not_enough_info' END AS support_label FROM (SELECT tuple_id, lower(coalesce(c.stakeholder, '')) AS s, lower(coalesce(e.text, '')) AS t FROM c LEFT JOIN e ON e.evidence_id = c.evidence_ids[1])"""
)
def baseline_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support of each claim by its first page, by the first characters of the name alone.

    Single characters of an opinion are too short to count as its words, so no claim gets more than partial support.
    """
    c = _once_claims(spark, sf_dir).select("tuple_id", F.lower(F.coalesce("stakeholder", F.lit(""))).alias("s"), F.try_element_at("evidence_ids", F.lit(1)).alias("evidence_id"))
    j = c.join(_once_pages(spark, sf_dir).select("evidence_id", "text"), "evidence_id", "left").withColumn("t", F.lower(F.coalesce("text", F.lit(""))))
    named = (F.length("s") >= 2) & F.exists(F.split(F.left("s", F.lit(3)), ""), lambda ch: (ch != "") & F.contains("t", ch))
    return j.select("tuple_id", F.when(named, "partially_supported").otherwise("not_enough_info").alias("support_label"))


@query(f"SELECT evidence_id, ingested_at, coalesce(source_type IN ('official', 'public_interaction', 'mainstream_news'), false) OR {_ANY(chr(34) + 'j' + chr(34), TRUSTED)} AS trusted FROM (SELECT *, coalesce(platform, '') || ' ' || coalesce(domain, '') || ' ' || coalesce(text, '') AS j FROM {EVIDENCE})")
def trusted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page is of a trusted type, or its platform, domain or text speaks of one."""
    said = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("platform", "domain", "text")))
    return table(spark, sf_dir, EVIDENCE).select("evidence_id", "ingested_at", (F.coalesce(F.col("source_type").isin("official", "public_interaction", "mainstream_news"), F.lit(False)) | text.contains_any(said, TRUSTED)).alias("trusted"))


_GAPS = f"""p AS (SELECT evidence_id, arg_min(event_id, ingested_at) AS event_id, arg_min(text, ingested_at) AS text, arg_min(stance_hint, ingested_at) AS stance, arg_min(temporal_stage, ingested_at) AS stage FROM {EVIDENCE} GROUP BY evidence_id),
    g AS (SELECT r.event_id, count(p.evidence_id) AS n, count(DISTINCT p.stance) AS n_stances, count(DISTINCT p.stage) AS n_stages, coalesce(bool_or(p.stance IS NULL AND {_ANY('p.text', ['质疑', '反对', '支持'])}), false) AS stance_miss, coalesce(bool_or(p.stage IS NULL AND {_ANY('p.text', ['起初', '引发', '回应'])}), false) AS stage_miss FROM {EVENTS} r LEFT JOIN p ON p.event_id = r.event_id GROUP BY r.event_id)"""


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _once_pages(spark, sf_dir).select("event_id", "evidence_id", "stance_hint", "temporal_stage", text.contains_any(F.col("text"), ["质疑", "反对", "支持"]).alias("stance_word"), text.contains_any(F.col("text"), ["起初", "引发", "回应"]).alias("stage_word"))
    return table(spark, sf_dir, EVENTS).select("event_id").join(p, "event_id", "left").groupBy("event_id").agg(
        F.count("evidence_id").alias("n"), F.countDistinct("stance_hint").alias("n_stances"), F.countDistinct("temporal_stage").alias("n_stages"),
        F.coalesce(F.bool_or(F.col("stance_hint").isNull() & F.col("stance_word")), F.lit(False)).alias("stance_miss"), F.coalesce(F.bool_or(F.col("temporal_stage").isNull() & F.col("stage_word")), F.lit(False)).alias("stage_miss"),
    )


@query(f"WITH {_GAPS} SELECT event_id, n, CASE WHEN n < 15 AND n_stances = 0 THEN 'provider_instability' WHEN n < 15 THEN 'query_hit_shortfall' WHEN (n_stances < 3 AND stance_miss) OR (n_stages < 3 AND stage_miss) THEN 'extractor_miss_or_qc_threshold_mismatch' WHEN n_stances < 3 OR n_stages < 3 THEN 'true_evidence_missing' ELSE 'unknown' END AS failure FROM g")
def collection_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an event's collection may have fallen short."""
    few, stances, stages = F.col("n") < 15, F.col("n_stances") < 3, F.col("n_stages") < 3
    why = F.when(few & (F.col("n_stances") == 0), "provider_instability").when(few, "query_hit_shortfall").when((stances & F.col("stance_miss")) | (stages & F.col("stage_miss")), "extractor_miss_or_qc_threshold_mismatch").when(stances | stages, "true_evidence_missing").otherwise("unknown")
    return _gaps(spark, sf_dir).select("event_id", "n", why.alias("failure"))


@query(f"WITH {_GAPS} SELECT event_id, CASE WHEN NOT stance_miss AND NOT stage_miss THEN 'no_unmapped_candidate' ELSE concat_ws('; ', CASE WHEN stance_miss THEN 'stance_candidate_not_counted' END, CASE WHEN stage_miss THEN 'temporal_candidate_not_counted' END) END AS reason FROM g")
def extractor_debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by their words that no rule has labelled."""
    why = F.concat_ws("; ", F.when(F.col("stance_miss"), "stance_candidate_not_counted"), F.when(F.col("stage_miss"), "temporal_candidate_not_counted"))
    return _gaps(spark, sf_dir).select("event_id", F.when(why == "", "no_unmapped_candidate").otherwise(why).alias("reason"))


_IDS = f"""g AS (SELECT event_id, list(DISTINCT i) AS gold FROM (SELECT event_id, trim(unnest(string_split(evidence_ids, '|'))) AS i FROM {GOLD}) WHERE i <> '' GROUP BY event_id), s AS (SELECT event_id, list(DISTINCT i) AS selected FROM (SELECT event_id, unnest(evidence_ids) AS i FROM {CLAIMS}) GROUP BY event_id)"""


def _ids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    gold = table(spark, sf_dir, GOLD).select("event_id", F.explode(F.transform(F.split("evidence_ids", "[|]"), text.strip)).alias("i")).where("i <> ''").distinct()
    return gold, table(spark, sf_dir, CLAIMS).select("event_id", F.explode("evidence_ids").alias("i")).distinct()


@query(
    f"""WITH {_STAGE}, {_IDS}, h AS (SELECT event_id, list(DISTINCT evidence_id) AS chain FROM sf GROUP BY event_id)
    SELECT r.event_id, CASE WHEN selected IS NULL THEN 'no_prompt_evidence' WHEN gold IS NULL THEN 'no_gold_evidence_refs' WHEN len(list_intersect(gold, selected)) = 0 THEN 'gold_evidence_absent_from_prompt' WHEN len(list_intersect(gold, coalesce(chain, []))) = 0 THEN 'gold_evidence_absent_from_event_chain' ELSE 'llm_or_prompt_declined_extraction_despite_some_gold_prompt_overlap' END AS reason FROM {EVENTS} r LEFT JOIN g ON g.event_id = r.event_id LEFT JOIN s ON s.event_id = r.event_id LEFT JOIN h ON h.event_id = r.event_id"""
)
def zero_prediction_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an event's gold may not come out: where its evidence was lost on the way."""
    gold, selected = _ids(spark, sf_dir)
    chain = stage_rows(spark, sf_dir).select("event_id", F.col("evidence_id").alias("i")).distinct()
    found = lambda df, a: df.groupBy("event_id").agg(F.count(F.lit(1)).alias(a))
    e = table(spark, sf_dir, EVENTS).select("event_id")
    for df, a in ((selected, "n_selected"), (gold, "n_gold"), (gold.join(selected, ["event_id", "i"], "left_semi"), "n_prompt"), (gold.join(chain, ["event_id", "i"], "left_semi"), "n_chain")):
        e = e.join(found(df, a), "event_id", "left")
    why = F.when(F.col("n_selected").isNull(), "no_prompt_evidence").when(F.col("n_gold").isNull(), "no_gold_evidence_refs").when(F.col("n_prompt").isNull(), "gold_evidence_absent_from_prompt").when(F.col("n_chain").isNull(), "gold_evidence_absent_from_event_chain").otherwise("llm_or_prompt_declined_extraction_despite_some_gold_prompt_overlap")
    return e.select("event_id", why.alias("reason"))


_KEYS = lambda t, i: f"(SELECT DISTINCT event_id, lower(trim(coalesce(opinion, ''))) AS o, lower(trim(coalesce(sentiment, ''))) AS s FROM {t})"
_EXACT = f"""n AS (SELECT event_id, count(*) FILTER (g) AS n_gold, count(*) FILTER (p) AS n_pred, count(*) FILTER (g AND p) AS tp FROM (SELECT coalesce(a.event_id, b.event_id) AS event_id, a.o IS NOT NULL AS g, b.o IS NOT NULL AS p FROM {_KEYS(GOLD, 0)} a FULL OUTER JOIN {_KEYS(CLAIMS, 0)} b ON a.event_id = b.event_id AND a.o = b.o AND a.s = b.s) GROUP BY event_id)"""


def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, n_gold, n_pred, tp) by exact opinion and sentiment."""
    keys = lambda t: table(spark, sf_dir, t).select("event_id", *(F.lower(F.trim(F.coalesce(c, F.lit("")))).alias(a) for c, a in (("opinion", "o"), ("sentiment", "s")))).distinct()
    both = keys(GOLD).withColumn("side", F.lit(1)).unionByName(keys(CLAIMS).withColumn("side", F.lit(2))).groupBy("event_id", "o", "s").agg(F.sum("side").alias("side"))
    return both.groupBy("event_id").agg(F.count_if(F.col("side") != 2).alias("n_gold"), F.count_if(F.col("side") != 1).alias("n_pred"), F.count_if(F.col("side") == 3).alias("tp"))


@query(f"WITH {_EXACT} SELECT event_id, CASE WHEN n_pred = 0 THEN 'zero_prediction' WHEN n_gold = 0 OR tp / n_gold < 0.25 THEN 'low_recall' WHEN tp / n_pred < 0.5 THEN 'low_precision' ELSE 'ok' END AS category FROM n")
def event_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each event's predictions, if anything."""
    r, p = metrics.ratio(F.col("tp"), F.col("n_gold")), metrics.ratio(F.col("tp"), F.col("n_pred"))
    return _exact(spark, sf_dir).select("event_id", F.when(F.col("n_pred") == 0, "zero_prediction").when(r < 0.25, "low_recall").when(p < 0.5, "low_precision").otherwise("ok").alias("category"))


@query(f"WITH {_EXACT} SELECT event_id, n_gold, n_pred, tp AS n_matched, n_gold - tp AS n_missed, n_pred - tp AS n_spurious FROM n")
def error_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched, missed and spurious rows of each event."""
    return _exact(spark, sf_dir).select("event_id", "n_gold", "n_pred", F.col("tp").alias("n_matched"), (F.col("n_gold") - F.col("tp")).alias("n_missed"), (F.col("n_pred") - F.col("tp")).alias("n_spurious"))


@query(
    f"""WITH m AS (SELECT model_name, avg(CASE WHEN support_status = 'supported' THEN 1.0 ELSE 0.0 END) AS rate FROM {CLAIMS} WHERE model_name IS NOT NULL GROUP BY model_name), b AS (SELECT min(rate) AS base FROM m)
    SELECT model_name, CASE WHEN round(rate - base, 9) >= 0.08 THEN 'primary' WHEN round(rate - base, 9) >= 0.03 THEN 'contributing' ELSE 'not_material' END AS band FROM m, b"""
)
def gain_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each model's support rate gains on the lowest."""
    m = table(spark, sf_dir, CLAIMS).where("model_name IS NOT NULL").groupBy("model_name").agg(F.avg(F.when(F.col("support_status") == "supported", 1.0).otherwise(0.0)).alias("rate"))
    gain = F.round(F.col("rate") - F.col("base"), 9)
    return m.join(F.broadcast(m.agg(F.min("rate").alias("base")))).select("model_name", F.when(gain >= 0.08, "primary").when(gain >= 0.03, "contributing").otherwise("not_material").alias("band"))  # one row


_NAMES = f"""g AS (SELECT DISTINCT event_id, {_STRIP('stakeholder')} AS s, {_SET('stakeholder')} AS a FROM {GOLD} WHERE {_STRIP('stakeholder')} <> ''), c AS (SELECT DISTINCT event_id, {_STRIP('stakeholder')} AS s, {_SET('stakeholder')} AS b FROM {CLAIMS} WHERE {_STRIP('stakeholder')} <> '')"""


@query(f"WITH {_NAMES} SELECT DISTINCT g.event_id, g.s AS stakeholder FROM g JOIN c ON g.event_id = c.event_id WHERE contains(g.s, c.s) OR contains(c.s, g.s) OR (len(a) > 0 AND len(b) > 0 AND round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) >= 0.45)")
def stakeholder_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed stakeholders that a candidate of the event holds, is held by, or resembles."""
    names = lambda t: table(spark, sf_dir, t).select("event_id", text.strip(F.col("stakeholder")).alias("s")).where("s <> ''").distinct().withColumn("id", F.col("s"))
    g, c = names(GOLD), names(CLAIMS)
    near = similarity.similar_pairs(g, c, "event_id", "id", "s", 0.45).select("grp", "g").unionByName(similarity.containing_pairs(g, c, "event_id", "id", "s").select("grp", "g"))
    return near.distinct().select(F.col("grp").alias("event_id"), F.col("g").alias("stakeholder"))


# --- scores in full


_OFFICIAL_STAGE, _WEAK_CAP = {"response": ["公布", "结果"]}, {"trigger": 0.20, "response": 0.16}


def _details_sql(s: str) -> str:
    strong, weak = STAGES[s]
    n = f"len(list_filter({strong}, lambda t: contains(text, t)))"
    if s in _OFFICIAL_STAGE:
        n = f"({n} + CASE WHEN source_type = 'official' AND {_ANY('text', _OFFICIAL_STAGE[s])} THEN 1 ELSE 0 END)"
    raw = f"least(1e0, 0.32e0 * {n} + 0.06e0 * len(list_filter({weak}, lambda t: contains(text, t))))"
    if s in _WEAK_CAP:
        raw = f"CASE WHEN {n} > 0 THEN {raw} ELSE least({raw}, {_WEAK_CAP[s]}e0) END"
    return f"round(({raw})::DOUBLE, 4)"


_FULL = f"""{_RELEVANCE}, x AS (SELECT event_id, evidence_id, ingested_at, domain, source_type, quality_score, relevance, {_ANY('text', ['工作日', '公示'])} AS generic, {_ANY('text', ['居民', '业主', '家长'])} AS people, unnest([{', '.join(f"{{'stage': '{s}', 'keyword': {_details_sql(s)}}}" for s in STAGES)}]) AS s FROM rel WHERE text IS NOT NULL),
    y AS (SELECT event_id, evidence_id, ingested_at, domain, source_type, generic, relevance, s.stage AS stage, s.keyword AS keyword, greatest(0e0, least(1e0, CASE WHEN relevance < 0.30 THEN least(raw, 0.24e0) ELSE raw END)) AS f FROM (SELECT *, 0.40e0 * s.keyword + 0.25e0 * relevance + 0.15e0 * coalesce(quality_score, 0.5e0) + 0.10e0 * CASE source_type WHEN 'official' THEN 1e0 WHEN 'mainstream_news' THEN 0.8e0 ELSE 0.5e0 END + 0.10e0 * CASE WHEN people THEN 1e0 ELSE 0e0 END - 0.12e0 * CASE WHEN generic THEN 1e0 ELSE 0e0 END AS raw FROM x) WHERE s.keyword > 0)"""


def full_stage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event, evidence, stage) with scores from all terms: official bonus, source prior, stakeholders, generic penalty."""
    rel = relevance_rows(spark, sf_dir).where("text IS NOT NULL")
    t, prior = F.col("text"), F.when(F.col("source_type") == "official", 1.0).when(F.col("source_type") == "mainstream_news", 0.8).otherwise(0.5)
    stages = F.array(*(F.struct(F.lit(s).alias("stage"), score.stage_keyword_details(t, F.col("source_type"), *STAGES[s], _WEAK_CAP.get(s), _OFFICIAL_STAGE.get(s))[0].alias("keyword")) for s in STAGES))
    rows = rel.withColumns({"generic": text.contains_any(t, ["工作日", "公示"]), "people": text.contains_any(t, ["居民", "业主", "家长"])}).select("*", F.explode(stages).alias("s")).select("*", "s.*").where("keyword > 0")
    final = score.final_stage_score(F.col("keyword"), F.col("relevance"), F.col("quality_score"), prior, F.when(F.col("people"), 1.0).otherwise(0.0), F.when(F.col("generic"), 1.0).otherwise(0.0))
    return rows.select("event_id", "evidence_id", "ingested_at", "domain", F.col("source_type").alias("source"), "stage", "keyword", "relevance", "generic", final.alias("final"))


@query(f"WITH {_FULL} SELECT event_id, evidence_id, ingested_at, stage, keyword, round(f + 1e-9, 4) AS final FROM y")
def stage_scores_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage scores of every page from all their terms."""
    return full_stage_rows(spark, sf_dir).select("event_id", "evidence_id", "ingested_at", "stage", "keyword", "final")


@query(
    f"""WITH {_FULL}, z AS (SELECT *, round(f + 1e-9, 4) AS final, row_number() OVER (PARTITION BY event_id, stage ORDER BY round(f + 1e-9, 4) DESC, evidence_id, ingested_at) AS k FROM y), t AS (SELECT * FROM z WHERE k <= 3),
    l AS (SELECT event_id, max(n) AS lead FROM (SELECT event_id, domain, count(*) AS n FROM t WHERE coalesce(trim(domain), '') <> '' GROUP BY ALL) GROUP BY event_id),
    m AS (SELECT t.event_id, count(*) AS n, count(DISTINCT CASE WHEN stage IN ('trigger', 'response') THEN stage END) / 2e0 AS core, count(DISTINCT stage) / 3e0 AS cov, avg(final) AS sc, avg(relevance) AS re, least(1e0, count(DISTINCT nullif(trim(source_type), '')) / 4e0) AS div, count(*) FILTER (generic) / count(*)::DOUBLE AS gen FROM t GROUP BY t.event_id),
    q AS (SELECT m.*, coalesce(lead, 0) / n::DOUBLE AS top, 0.20e0 * gen + 0.15e0 * greatest(0e0, coalesce(lead, 0) / n::DOUBLE - 0.5e0) + 0.20e0 * (1 - core) + CASE WHEN re < 0.35 THEN 0.15e0 ELSE 0e0 END AS pen FROM m LEFT JOIN l ON l.event_id = m.event_id),
    r AS (SELECT *, greatest(0e0, least(1e0, 0.28e0 * core + 0.14e0 * cov + 0.22e0 * sc + 0.24e0 * re + 0.12e0 * div - pen)) AS raw FROM q)
    SELECT event_id, round(core, 4) AS core_coverage, round(gen, 4) AS generic_ratio, round(top, 4) AS top_domain_ratio, round(pen, 4) AS penalty, round(CASE WHEN re < 0.30 THEN least(raw, 0.60e0) ELSE raw END + 1e-9, 4) AS confidence FROM r"""
)
def chain_confidence_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of each event's chain with all penalties and the cap."""
    top = select.top_k(full_stage_rows(spark, sf_dir), ["event_id", "stage"], [F.desc("final"), F.asc("evidence_id"), F.asc("ingested_at")], 3)
    return score.chain_confidence_full(top, "event_id", CORE, len(STAGES))


# --- streams


@query(f"SELECT evidence_id, min(ingested_at) AS ingested_at FROM {EVIDENCE} GROUP BY evidence_id")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages taken in by a stream, each the first time it comes."""
    pages = table(spark, sf_dir, EVIDENCE).select("evidence_id", "ingested_at")
    folder = f"{ensure_checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}"
    pages.write.parquet(f"{folder}/source")
    ingest_new(spark, f"{folder}/source", pages.schema, f"{folder}/target", f"{folder}/checkpoint", F.col("evidence_id"), ["ingested_at"])
    return spark.read.parquet(f"{folder}/target").select("evidence_id", "ingested_at")


@query(f"SELECT source_type, time_bucket(INTERVAL 30 DAY, ingested_at, TIMESTAMP '1970-01-01 00:00:00') AS begins, count(*) AS n FROM {EVIDENCE} WHERE ingested_at IS NOT NULL GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by source type and window of thirty days, counted by a stream with a watermark that no row is later than."""
    pages = table(spark, sf_dir, EVIDENCE).select("source_type", F.col("ingested_at").cast("timestamp").alias("ingested_at")).where("ingested_at IS NOT NULL")
    folder = f"{ensure_checkpoint_dir(spark)}/windows-{uuid.uuid4().hex}"
    pages.write.parquet(f"{folder}/source")
    counts = windowed_counts(spark.readStream.schema(pages.schema).parquet(f"{folder}/source"), "ingested_at", ["source_type"], "30 days", "3650 days")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/counts")

    counts.select("source_type", F.col("window.start").alias("begins"), "n").writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/counts").withColumn("begins", F.col("begins").cast("timestamp_ntz"))


# --- metrics, graphs and audits


@query(f"SELECT model_name, count(*) AS n, round(count(*) FILTER (support_status = 'supported' AND confidence >= 0.5) / count(*), 4) AS supported_rate, round(count(*) FILTER (support_status IN ('unsupported', 'insufficient_evidence')) / count(*), 4) AS unsupported_rate FROM {CLAIMS} GROUP BY model_name")
def evidence_support_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supported and unsupported rates of each model."""
    return metrics.support_rates(table(spark, sf_dir, CLAIMS), (F.col("support_status") == "supported") & (F.col("confidence") >= 0.5), F.col("support_status"), "model_name")


@query(
    f"""WITH g AS (SELECT candidate_id AS id, min(event_id) AS event_id, min(opinion) AS opinion FROM {GOLD} WHERE opinion IS NOT NULL GROUP BY candidate_id), p AS (SELECT tuple_id AS id, min(event_id) AS event_id, min(opinion) AS opinion FROM {CLAIMS} WHERE opinion IS NOT NULL GROUP BY tuple_id), b AS (SELECT event_id FROM g INTERSECT SELECT event_id FROM p),
    x AS (SELECT event_id, opinion, least(max(ng), max(np)) AS k FROM (SELECT event_id, opinion, count(*) AS ng, 0 AS np FROM g GROUP BY ALL UNION ALL SELECT event_id, opinion, 0, count(*) FROM p GROUP BY ALL) GROUP BY ALL),
    n AS (SELECT (SELECT coalesce(sum(k), 0) FROM x)::BIGINT AS tp, (SELECT count(*) FROM g WHERE event_id IN (FROM b)) AS n_gold, (SELECT count(*) FROM p WHERE event_id IN (FROM b)) AS n_pred)
    SELECT tp, n_gold, n_pred, round(tp / n_pred, 4) AS precision, round(tp / n_gold, 4) AS recall, CASE WHEN tp = 0 THEN 0.0 ELSE round(2 * (tp / n_pred) * (tp / n_gold) / (tp / n_pred + tp / n_gold), 4) END AS f1 FROM n"""
)
def judged_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 by a judge that accepts equal opinions, the offline stand-in of a model; one match a row at most."""
    g, p = _gold(spark, sf_dir), _claims(spark, sf_dir)
    turn = lambda d, a: d.select("event_id", "opinion", F.row_number().over(Window.partitionBy("event_id", "opinion").orderBy("id")).alias("rank"), F.col("id").alias(a))
    return metrics.judged_f1(g, p, "event_id", turn(g, "g").join(turn(p, "p"), ["event_id", "opinion", "rank"]).select("g", "p"))


@query(f"SELECT kind, n FROM (SELECT 'event' AS kind, count(DISTINCT event_id) AS n FROM {EVENTS} UNION ALL SELECT 'evidence', count(DISTINCT evidence_id) FROM {EVIDENCE} UNION ALL SELECT 'supports', count(*) FROM (SELECT DISTINCT evidence_id, event_id FROM {EVIDENCE} WHERE event_id IS NOT NULL))")
def minimal_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the graph of events and evidence alone."""
    n = lambda df, kind: df.distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    e = table(spark, sf_dir, EVIDENCE)
    return n(table(spark, sf_dir, EVENTS).select("event_id"), "event").unionByName(n(e.select("evidence_id"), "evidence")).unionByName(n(e.where("event_id IS NOT NULL").select("evidence_id", "event_id"), "supports"))


@query("SELECT '' AS node_id, '' AS node_type, '' AS label WHERE false")
def disabled_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of a run without one: no rows, the same columns."""
    return spark.createDataFrame([], "node_id string, node_type string, label string")


@query(
    f"""WITH p AS (SELECT evidence_id, arg_min(event_id, ingested_at) AS event_id, arg_min(temporal_stage, ingested_at) AS stage, arg_min(stakeholder_hint, ingested_at) AS who FROM {EVIDENCE} GROUP BY evidence_id)
    SELECT r.event_id, count(p.evidence_id) AS n_evidence, count(DISTINCT nullif(trim(stage), '')) AS n_stages, count(DISTINCT nullif(trim(who), '')) AS n_stakeholders, count(p.evidence_id) > 0 AND count(DISTINCT nullif(trim(stage), '')) >= 2 AS connected FROM {EVENTS} r LEFT JOIN p ON p.event_id = r.event_id GROUP BY r.event_id"""
)
def graph_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the graph holds for each event."""
    full = lambda c: F.when(F.trim(c) != "", F.trim(c))
    j = table(spark, sf_dir, EVENTS).select("event_id").join(_once_pages(spark, sf_dir), "event_id", "left").groupBy("event_id").agg(F.count("evidence_id").alias("n_evidence"), F.countDistinct(full("temporal_stage")).alias("n_stages"), F.countDistinct(full("stakeholder_hint")).alias("n_stakeholders"))
    return j.withColumn("connected", (F.col("n_evidence") > 0) & (F.col("n_stages") >= 2))


@query(f"SELECT model_name, prompt_version, count(DISTINCT event_id) AS n_events, count(DISTINCT tuple_id) AS n_tuples, count(*) AS n_rows, max(len(evidence_ids))::INT AS most_evidence, count(DISTINCT event_id) = max(count(DISTINCT event_id)) OVER () AS all_events FROM {CLAIMS} GROUP BY model_name, prompt_version")
def fairness_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every setting has run over the same events with the same evidence."""
    s = table(spark, sf_dir, CLAIMS).groupBy("model_name", "prompt_version").agg(F.countDistinct("event_id").alias("n_events"), F.countDistinct("tuple_id").alias("n_tuples"), F.count(F.lit(1)).alias("n_rows"), F.max(F.size("evidence_ids")).alias("most_evidence"))
    return s.join(F.broadcast(s.agg(F.max("n_events").alias("most")))).withColumn("all_events", F.col("n_events") == F.col("most")).drop("most")  # one row


@query(
    f"""WITH {_STAGE}, h AS (SELECT event_id, count(*) AS n FROM (SELECT DISTINCT event_id, stage FROM sf) GROUP BY event_id), g AS (SELECT event_id, count(DISTINCT candidate_id) AS n FROM {GOLD} GROUP BY event_id)
    SELECT 'orphan_chain' AS "check", h.event_id FROM h LEFT JOIN g ON g.event_id = h.event_id WHERE g.n IS NULL UNION ALL SELECT 'few_chain_stages', event_id FROM h WHERE n < 2 UNION ALL SELECT 'no_chain', g.event_id FROM g LEFT JOIN h ON h.event_id = g.event_id WHERE h.n IS NULL UNION ALL SELECT 'few_tuples', event_id FROM g WHERE n < 3"""
)
def human_gold_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains without reviewed rows, reviewed events without a chain, and too few of either."""
    h = stage_rows(spark, sf_dir).groupBy("event_id").agg(F.countDistinct("stage").alias("n"))
    g = table(spark, sf_dir, GOLD).groupBy("event_id").agg(F.countDistinct("candidate_id").alias("n"))
    part = lambda df, name: df.select(F.lit(name).alias("check"), "event_id")
    return part(h.join(g, "event_id", "left_anti"), "orphan_chain").unionByName(part(h.where("n < 2"), "few_chain_stages")).unionByName(part(g.join(h, "event_id", "left_anti"), "no_chain")).unionByName(part(g.where("n < 3"), "few_tuples"))


@query(
    f"""SELECT candidate_id, "check" FROM (SELECT candidate_id, unnest([CASE WHEN {_BLANK('stakeholder')} THEN 'no_stakeholder' END, CASE WHEN {_BLANK('opinion')} THEN 'no_opinion' END, CASE WHEN NOT coalesce(sentiment IN ('positive', 'negative', 'neutral', 'mixed'), false) THEN 'bad_sentiment' END, CASE WHEN {_BLANK('evidence_ids')} THEN 'no_evidence' END, CASE WHEN NOT coalesce(support_label IN ('supported', 'partially_supported', 'insufficient_evidence', 'contradicted'), false) THEN 'bad_label' END, CASE WHEN {_BLANK('stakeholder')} AND {_BLANK('opinion')} AND {_BLANK('rationale')} THEN 'nothing_said' END]) AS "check" FROM {_ONCE}) WHERE "check" IS NOT NULL"""
)
def gold_row_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed checks of each reviewed row, the at-least-one-of check included."""
    blank, among = (lambda c: text.blank(F.col(c))), (lambda c, *v: ~F.coalesce(F.col(c).isin(*v), F.lit(False)))
    checks = {
        "no_stakeholder": blank("stakeholder"), "no_opinion": blank("opinion"), "bad_sentiment": among("sentiment", "positive", "negative", "neutral", "mixed"), "no_evidence": blank("evidence_ids"),
        "bad_label": among("support_label", "supported", "partially_supported", "insufficient_evidence", "contradicted"), "nothing_said": blank("stakeholder") & blank("opinion") & blank("rationale"),
    }
    return validate.violations(_reviewed(spark, sf_dir), "candidate_id", checks).withColumnRenamed("id", "candidate_id")


@query(f"SELECT CASE WHEN query_seeds IS NULL OR len(query_seeds) = 0 THEN 'incomplete' WHEN coalesce(time_window.start, '') = '' THEN 'no_time' ELSE 'ready' END AS status, count(*) AS n FROM {EVENTS} GROUP BY 1")
def registry_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of the registry are ready."""
    status = F.when(F.coalesce(F.size("query_seeds"), F.lit(0)) <= 0, "incomplete").when(F.coalesce("time_window.start", F.lit("")) == "", "no_time").otherwise("ready")
    return table(spark, sf_dir, EVENTS).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH t AS (SELECT event_id, count(*) AS n FROM {GOLD} GROUP BY event_id ORDER BY n DESC, event_id LIMIT 3), s AS (SELECT event_id, string_agg(sentiment || ': ' || n, ', ' ORDER BY n DESC, sentiment) AS said FROM (SELECT event_id, coalesce(sentiment, 'unknown') AS sentiment, count(*) AS n FROM {GOLD} GROUP BY ALL) GROUP BY event_id)
    SELECT t.event_id, '## ' || coalesce(r.event_name, t.event_id) || chr(10) || 'rows: ' || t.n || chr(10) || s.said AS report FROM t JOIN s ON s.event_id = t.event_id LEFT JOIN {EVENTS} r ON r.event_id = t.event_id"""
)
def case_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short report on each of the three events with most reviewed rows."""
    g = table(spark, sf_dir, GOLD)
    top = g.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_id").limit(3)
    per = g.groupBy("event_id", F.coalesce("sentiment", F.lit("unknown")).alias("sentiment")).agg(F.count(F.lit(1)).alias("k"))
    said = per.groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("o"), "sentiment", "k"))), lambda x: F.concat(x["sentiment"], F.lit(": "), x["k"].cast("string"))), ", ").alias("said"))
    j = top.join(said, "event_id").join(table(spark, sf_dir, EVENTS).select("event_id", "event_name"), "event_id", "left")
    return j.select("event_id", F.concat(F.lit("## "), F.coalesce("event_name", "event_id"), F.lit("\nrows: "), F.col("n").cast("string"), F.lit("\n"), "said").alias("report"))


@query(f"SELECT event_id, evidence_id, ingested_at FROM (SELECT *, row_number() OVER (ORDER BY ingested_at, evidence_id) AS k FROM {EVIDENCE} WHERE event_id IN (SELECT event_id FROM {EVENTS} WHERE event_type = 'policy_event')) WHERE k > 5 AND k <= 25")
def selected_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of listed events in order of their coming, after an offset: the paging of a run."""
    ids = table(spark, sf_dir, EVENTS).where("event_type = 'policy_event'").select("event_id")
    return table(spark, sf_dir, EVIDENCE).join(ids, "event_id", "left_semi").orderBy("ingested_at", "evidence_id").offset(5).limit(20).select("event_id", "evidence_id", "ingested_at")

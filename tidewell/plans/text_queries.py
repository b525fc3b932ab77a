"""Queries over text, URL and cell functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import cells, text, urls
from tidewell.plans.catalog import CLAIMS, EVIDENCE, EVENTS, GOLD, query
from tidewell.session import spread
from tidewell.sources.tables import table

_SPACE = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = lambda c: f"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_COMPACT = lambda c: f"regexp_replace({c}, '{_SPACE}+', '', 'g')"
_COLLAPSE = lambda c: _STRIP(f"regexp_replace({c}, '{_SPACE}+', ' ', 'g')")

TERMS = ["费用", "公示", "投诉", "安全", "Cookie", "council"]
STOP = ["记者", "关于", "the", "and"]


@query(
    f"""SELECT evidence_id, ingested_at,
      CASE WHEN regexp_matches(url, '{"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"}') THEN
        lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) ||
        regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ||
        CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END
      ELSE split_part(url, '#', 1) END AS normal_url
    FROM (SELECT evidence_id, ingested_at, url,
        list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'),
          lambda p: p <> '' AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_') AND lower(split_part(p, '=', 1)) NOT IN ('spm','from','pvid','share_from','scene')) AS kept
      FROM {EVIDENCE})"""
)
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised URL of every page."""
    return table(spark, sf_dir, EVIDENCE).select("evidence_id", "ingested_at", urls.normalized_url(F.col("url")).alias("normal_url"))


@query(
    f"""SELECT evidence_id, ingested_at,
      regexp_replace(coalesce(nullif(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), ''), nullif(lower(trim(platform)), ''), 'unknown'), '^www[.]', '') AS host_or_platform,
      regexp_replace(coalesce(nullif(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), ''), ''), '^www[.]', '') AS host,
      regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), '^www[.]', '') IN ('siletu6.example', 'live.siletu6.example')
        OR ends_with(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), '.siletu6.example') AS in_site
    FROM {EVIDENCE}"""
)
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts by the extraction variants, and a domain test."""
    host = urls.host_of(F.col("url"))
    return table(spark, sf_dir, EVIDENCE).select("evidence_id", "ingested_at", urls.host_of(F.col("url"), F.col("platform"), "unknown").alias("host_or_platform"), host.alias("host"), urls.in_domains(host, ["siletu6.example", "live.siletu6.example"]).alias("in_site"))


@query(
    f"""SELECT tuple_id, loaded_at, {_STRIP('opinion')} AS stripped, lower({_COMPACT('rationale')}) AS compacted,
      CASE WHEN len({_COLLAPSE('rationale')}) > 20 THEN left({_COLLAPSE('rationale')}, 20) || '...' ELSE {_COLLAPSE('rationale')} END AS clipped,
      sha1(left({_COMPACT("coalesce(rationale, '')")}, 300)) AS content_sha1,
      'raw_' || left(sha1(tuple_id || '|' || coalesce(stakeholder, '') || '|' || coalesce(opinion, '')), 16) AS raw_id,
      regexp_replace(coalesce(stakeholder, ''), '[^\\p{{L}}\\p{{N}}_.-]', '_', 'g') AS node_token,
      CASE WHEN contains(rationale, '公示') THEN substring(rationale, greatest(1, instr(rationale, '公示') - 28), instr(rationale, '公示') - greatest(1, instr(rationale, '公示') - 28) + 2 + 28) ELSE '' END AS around
    FROM {CLAIMS} WHERE rationale IS NOT NULL"""
)
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stripping, compaction, clipping, hashes, tokens and excerpts of claims."""
    r = F.col("rationale")
    return table(spark, sf_dir, CLAIMS).where(r.isNotNull()).select(
        "tuple_id", "loaded_at", text.strip(F.col("opinion")).alias("stripped"), text.compact(r).alias("compacted"), text.collapse(r, 20, "...").alias("clipped"),
        text.content_sha1(r).alias("content_sha1"), text.short_hash_id("raw_", F.col("tuple_id"), F.col("stakeholder"), F.col("opinion")).alias("raw_id"),
        text.safe_id(F.coalesce("stakeholder", F.lit(""))).alias("node_token"), text.excerpt_of(r, "公示").alias("around"),
    )


def _chars(c: str) -> str:
    return f"list_distinct(list_filter(string_split({_COMPACT(f'coalesce({c}, chr(32))')}, ''), lambda x: x <> ''))"


def _pairs(c: str) -> str:
    t = _COMPACT(f"coalesce({c}, chr(32))")
    return f"CASE WHEN len({t}) > 2 THEN list_distinct(list_transform(range(1, len({t})), lambda i: substring({t}, i, 2))) WHEN len({t}) > 0 THEN [{t}] ELSE [] END"


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


@query(
    f"""WITH t AS (SELECT tuple_id, loaded_at, {_chars('opinion')} AS a, {_chars('rationale')} AS b, {_pairs('opinion')} AS c, {_pairs('rationale')} AS d FROM {CLAIMS})
    SELECT tuple_id, loaded_at, round({_jaccard('a', 'b')}, 6) AS char_similarity, round({_jaccard('c', 'd')}, 6) AS pair_similarity FROM t"""
)
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character and character-pair Jaccard similarity of opinion and rationale."""
    o, r = F.col("opinion"), F.col("rationale")
    return spread(table(spark, sf_dir, CLAIMS).select("tuple_id", "loaded_at", "opinion", "rationale")).select("tuple_id", "loaded_at", F.round(text.char_jaccard(o, r), 6).alias("char_similarity"), F.round(text.bigram_jaccard(o, r), 6).alias("pair_similarity"))


@query(
    f"""SELECT evidence_id, ingested_at, list_filter({TERMS}, lambda t: contains(text, t)) IS NOT NULL AND len(list_filter({TERMS}, lambda t: contains(text, t))) > 0 AS any_term,
      array_to_string(list_filter({TERMS}, lambda t: contains(text, t)), '|') AS terms,
      coalesce(list_filter({TERMS}, lambda t: contains(lower(text), lower(t)))[1], '') AS first_term
    FROM {EVIDENCE} WHERE text IS NOT NULL"""
)
def term_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any, all and the first of a list of terms in every page."""
    t = F.col("text")
    return table(spark, sf_dir, EVIDENCE).where(t.isNotNull()).select("evidence_id", "ingested_at", text.contains_any(t, TERMS).alias("any_term"), F.array_join(text.matched_terms(t, TERMS), "|").alias("terms"), text.first_matched(t, TERMS).alias("first_term"))


@query(
    f"""WITH r AS (SELECT event_id, list_filter(regexp_extract_all(event_name || ' ' || event_description, '[\\x{{4e00}}-\\x{{9fff}}A-Za-z0-9]{{2,}}'), lambda t: t NOT IN ('记者','关于','the','and')) AS runs FROM {EVENTS}),
    w AS (SELECT event_id, flatten(list_transform(runs, lambda t: CASE WHEN len(t) > 12 THEN
        list_slice(list_concat(list_transform(range(1, len(t) - 4), lambda i: substring(t, i, 6)), list_transform(range(1, len(t) - 3), lambda i: substring(t, i, 5)), list_transform(range(1, len(t) - 2), lambda i: substring(t, i, 4))), 1, 8)
        ELSE [t] END)) AS terms FROM r)
    SELECT event_id, count(DISTINCT term)::BIGINT AS n_terms, string_agg(DISTINCT term, '|' ORDER BY term) AS terms FROM (SELECT event_id, unnest(terms) AS term FROM w) GROUP BY event_id"""
)
def event_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of each event's name and description."""
    words = text.word_terms(F.concat_ws(" ", "event_name", "event_description"), STOP)
    return table(spark, sf_dir, EVENTS).select("event_id", F.size(words).cast("long").alias("n_terms"), F.array_join(F.array_sort(words), "|").alias("terms")).where("n_terms > 0")


@query(
    f"""WITH t AS (SELECT candidate_id, list_filter(list_transform(regexp_split_to_array(coalesce(evidence_ids, ''), '[;|,]'), lambda x: trim(x)), lambda x: x <> '') AS ids,
        list_filter(list_transform(regexp_split_to_array(coalesce(suspected_issue, ''), '[;|,]'), lambda x: trim(x)), lambda x: x <> '') AS issues FROM {GOLD})
    SELECT candidate_id, len(ids)::BIGINT AS n_ids, coalesce(ids[1], '') AS first_id, array_to_string(issues, ';') AS issues FROM t"""
)
def cell_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List cells of review rows."""
    ids = cells.cell_list(F.col("evidence_ids"))
    return table(spark, sf_dir, GOLD).select("candidate_id", F.size(ids).cast("long").alias("n_ids"), F.coalesce(F.try_element_at(ids, F.lit(1)), F.lit("")).alias("first_id"), F.array_join(cells.cell_list(F.col("suspected_issue")), ";").alias("issues"))


@query(
    f"""SELECT tuple_id, loaded_at, coalesce(nullif({_STRIP('stakeholder')}, ''), nullif({_STRIP('opinion')}, ''), tuple_id) AS shown,
      greatest(0.0, least(1.0, coalesce(confidence, 0.5))) AS sure, regexp_extract(tuple_id, '^(.*?)([0-9]*)$', 1) AS id_prefix, coalesce(try_cast(regexp_extract(tuple_id, '([0-9]+)$', 1) AS BIGINT), -1) AS id_number
    FROM {CLAIMS}"""
)
def coalesced_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First non-blank field, clamped number and natural sort key of each claim."""
    prefix, number = text.natural_key(F.col("tuple_id"))
    shown = text.first_non_blank(F.col("stakeholder"), F.col("opinion"), F.col("tuple_id"))
    return table(spark, sf_dir, CLAIMS).select("tuple_id", "loaded_at", shown.alias("shown"), cells.clamped(F.coalesce("confidence", F.lit(0.5))).alias("sure"), prefix.alias("id_prefix"), number.alias("id_number"))

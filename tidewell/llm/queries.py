"""The registered queries of this subpackage and, where one exists, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.boilerplate import boilerplate_lines
from tidewell.llm.canonical import map_to_reference, misses
from tidewell.llm.lines import NARROW, WIDE, once, site_of
from tidewell.llm.lookalike import canonical_texts, lookalike_pairs
from tidewell.llm.nearduplicates import near_duplicate_groups, near_duplicates
from tidewell.llm.packing import pack
from tidewell.llm.repeats import repeat_tests, repeated_lines, without_lines
from tidewell.llm.tokenize import encode_texts
from tidewell.llm.truncation import judged_values, truncated, truncation_rates
from tidewell.session import cut_lineage
from tidewell.sources.tables import table


EVIDENCE = "evidence_v3_repaired_plus_low37"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence with its site and the site's name, where known."""
    pages = table(spark, sf_dir, EVIDENCE).withColumn("site", site_of(F.col("domain")))
    sites = table(spark, sf_dir, "web_sites").select(F.col("domain").alias("site"), "site_name")  # a fixed table of 38 rows
    return pages.join(F.broadcast(sites), "site", "left").withColumn("name", F.coalesce("site_name", "platform"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages that are not main body."""
    pages = _pages(spark, sf_dir)
    return boilerplate_lines(pages, "evidence_id", "text", "title", F.col("site"), F.col("name"), "ingested_at").withColumnRenamed("id", "evidence_id")


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's text with its main body only."""
    pages = _pages(spark, sf_dir)
    found = boilerplate_lines(pages, "evidence_id", "text", "title", F.col("site"), F.col("name"), "ingested_at")
    return without_lines(once(pages, "evidence_id", ["text"], "ingested_at"), "evidence_id", "text", found)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that their site repeats excessively."""
    return repeated_lines(table(spark, sf_dir, EVIDENCE), "evidence_id", "text", site_of(F.col("domain")), "ingested_at").withColumnRenamed("id", "evidence_id")


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's text without the lines its site repeats excessively."""
    pages = table(spark, sf_dir, EVIDENCE)
    found = repeated_lines(pages, "evidence_id", "text", site_of(F.col("domain")), "ingested_at")
    return without_lines(once(pages, "evidence_id", ["text"], "ingested_at"), "evidence_id", "text", found)


def p3_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many (site, line) hypotheses were tested, are significant, and go."""
    tests = repeat_tests(table(spark, sf_dir, EVIDENCE), "evidence_id", "text", site_of(F.col("domain")), "ingested_at")
    return tests.groupBy("tested", "significant", "excess").agg(F.count(F.lit(1)).alias("n"), F.min("k1").alias("least_records"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records that are nearly the same."""
    found = near_duplicates(table(spark, sf_dir, EVIDENCE), "evidence_id", "title", "text", "ingested_at", 0.6)
    return found.withColumnsRenamed({"id_a": "evidence_id_a", "id_b": "evidence_id_b"})


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with a text, its group of nearly equal records, and how many other texts it is near to."""
    return near_duplicate_groups(table(spark, sf_dir, EVIDENCE), "evidence_id", "title", "text", "ingested_at", 0.6).withColumnRenamed("id", "evidence_id")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids; empty list for empty and null text."""
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with tokens, or each part of one over 8,192 tokens, with its container."""
    counts = encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text", counts_only=True)
    return pack(counts, "id", "n_tokens", 8_192).withColumnsRenamed({"id": "doc_id", "start": "start_token", "size": "n_tokens"})


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that look the same and are not identical."""
    return lookalike_pairs(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnsRenamed({"id_a": "doc_id_a", "id_b": "doc_id_b"})


def p9_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in its consistent form."""
    return canonical_texts(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def _stakeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, id, pos, value) of candidates' stakeholders and events' stakeholder hints, ids once."""
    claims = once(table(spark, sf_dir, "candidate_soa_tuples").select("tuple_id", "stakeholder", "loaded_at"), "tuple_id", ["stakeholder"], "loaded_at")
    claims = claims.select(F.lit("tuple").alias("kind"), F.col("tuple_id").alias("id"), F.lit(1).cast("long").alias("pos"), F.col("stakeholder").alias("value"))
    events = once(table(spark, sf_dir, "event_registry"), "event_id", ["stakeholder_hints"])
    events = events.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.posexplode("stakeholder_hints").alias("at", "value"))
    return claims.unionByName(events.select("kind", "id", (F.col("at") + 1).cast("long").alias("pos"), "value"))


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_to_reference(_stakeholders(spark, sf_dir), table(spark, sf_dir, "stakeholder_reference"), "ref_id", "canonical_name")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stakeholder value with the entry it names, 0 for none."""
    return _mapped(spark, sf_dir).select(F.col("kind").alias("record_kind"), F.col("id").alias("record_id"), F.col("pos").alias("value_pos"), "ref_id")


def p4_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values without an entry and how often they occur."""
    return misses(_mapped(spark, sf_dir))


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, id, field, value, grp, ref) of candidates' opinions and rationales and of review excerpts, ids once."""
    claims = once(table(spark, sf_dir, "candidate_soa_tuples").select("tuple_id", "opinion", "rationale", "model_name", "loaded_at"), "tuple_id", ["opinion", "rationale", "model_name"], "loaded_at")
    fields = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("opinion", "rationale"))))
    claims = claims.select(F.lit("candidate").alias("kind"), F.col("tuple_id").alias("id"), "model_name", fields.alias("f"))
    claims = claims.select("kind", "id", "f.field", "f.value", F.col("model_name").alias("grp"), F.lit(None).cast("string").alias("ref"))
    gold = once(table(spark, sf_dir, "gold_tuple_sample_for_human_review"), "candidate_id", ["evidence_text_excerpt", "evidence_ids"])
    ref = F.trim(F.split("evidence_ids", "[|]")[0])
    gold = gold.select(F.lit("gold").alias("kind"), F.col("candidate_id").alias("id"), F.lit("evidence_text_excerpt").alias("field"), F.col("evidence_text_excerpt").alias("value"), F.lit(None).cast("string").alias("grp"), F.when(ref != "", ref).alias("ref"))
    return claims.unionByName(gold)


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref, text) of the evidence that review excerpts cite first."""
    pages = table(spark, sf_dir, EVIDENCE).select(F.col("evidence_id").alias("ref"), "text", "ingested_at")
    cited = table(spark, sf_dir, "gold_tuple_sample_for_human_review").select(F.trim(F.split("evidence_ids", "[|]")[0]).alias("ref")).distinct()
    return once(pages.join(cited, "ref", "left_semi"), "ref", ["text"], "ingested_at")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that were cut."""
    out = truncated(_statements(spark, sf_dir), _sources(spark, sf_dir))
    return out.select(F.col("kind").alias("record_kind"), F.col("id").alias("record_id"), F.col("field").alias("field_name"))


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many open values of each field each path judged, and how many of these it found cut."""
    judged = judged_values(_statements(spark, sf_dir), _sources(spark, sf_dir))
    return judged.groupBy("field", "path").agg(F.count(F.lit(1)).alias("n_open"), F.count_if("cut").alias("n_cut"))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each model's statements, and each site's excerpts, are cut."""
    values = _statements(spark, sf_dir)
    sites = table(spark, sf_dir, EVIDENCE).groupBy(F.col("evidence_id").alias("ref")).agg(F.min(site_of(F.col("domain"))).alias("site"))
    values = values.join(sites, "ref", "left").withColumn("grp", F.when(F.col("kind") == "gold", F.col("site")).otherwise(F.col("grp"))).drop("site")
    values = cut_lineage(values)
    return truncation_rates(values, truncated(values, _sources(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_clean": p1_clean,
    "p3_found": p3_found,
    "p3_clean": p3_clean,
    "p3_tests": p3_tests,
    "p4_found": p4_found,
    "p4_misses": p4_misses,
    "p5_found": p5_found,
    "p5_rates": p5_rates,
    "p5_paths": p5_paths,
    "p6_found": p6_found,
    "p6_groups": p6_groups,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p9_found": p9_found,
    "p9_canonical": p9_canonical,
}

#: The defined lines of problem 3; the other problems are tested against brute force, round trips and definitions.
_P3 = f"""WITH e AS (SELECT evidence_id, min_by(text, ingested_at) AS text, regexp_replace(lower(trim(min_by(domain, ingested_at))), '^www[.]', '') AS site FROM {EVIDENCE} GROUP BY evidence_id),
    n AS (SELECT site, count(*) AS n FROM e WHERE site <> '' GROUP BY site),
    l AS (SELECT evidence_id, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM e WHERE site <> ''),
    k AS (SELECT evidence_id, site, line_no, regexp_replace(translate(line, '{WIDE}' || ' ' || chr(9) || chr(13) || chr(160) || chr(12288), '{NARROW.replace("'", "''")}'), '[0-9]+', '0', 'g') AS key FROM l),
    c AS (SELECT site, key, count(DISTINCT evidence_id) AS c FROM k WHERE key <> '' GROUP BY site, key)
    SELECT evidence_id, line_no::BIGINT AS line_no FROM k JOIN c USING (site, key) JOIN n USING (site) WHERE c >= 5 AND c >= 0.05 * n - 1e-9"""

SQL: dict[str, str] = {"p3_found": _P3}

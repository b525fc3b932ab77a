"""Review sheets, their conversion, and benchmark tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.cells import cell_list
from tidewell.functions.text import blank, collapse
from tidewell.operators.validate import first_reason


def resolved_evidence(claims: DataFrame, id_col: str, refs: str, evidence: DataFrame) -> DataFrame:
    """(id, n_found, missing, titles): the evidence of each claim in cited order; what is unknown is kept apart."""
    cited = claims.select(F.col(id_col).alias("id"), F.posexplode_outer(refs).alias("pos", "ref"))
    known = evidence.groupBy(F.col("evidence_id").alias("ref")).agg(F.min_by(F.struct(F.lit(True).alias("here"), "title"), F.struct("ingested_at", F.xxhash64("title"))).alias("e"))
    joined = cited.join(known, "ref", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "ref", F.coalesce("e.here", F.lit(False)).alias("here"), F.coalesce("e.title", F.lit("")).alias("title")))).alias("c"))
    here = F.filter("c", lambda x: x["here"])
    gone = F.filter("c", lambda x: ~x["here"] & x["ref"].isNotNull())
    return joined.select("id", F.size(here).cast("long").alias("n_found"), F.array_join(F.transform(gone, lambda x: x["ref"]), "|").alias("missing"), F.array_join(F.transform(here, lambda x: x["title"]), " ||| ").alias("titles"))


def sheet_rows(claims: DataFrame, refs: str) -> DataFrame:
    """One row for each claim and cited id; a claim without ids gets one row without."""
    return claims.select("*", F.explode_outer(refs).alias("evidence_id")).drop(refs)


def entry_gate(rows: DataFrame) -> DataFrame:
    """rows with `reason`: why a reviewed row can't enter the gold set, the first that holds, or ok."""
    ids = cell_list(F.col("evidence_ids"))
    reasons = [
        ("missing_stakeholder", blank(F.col("stakeholder"))), ("missing_opinion", blank(F.col("opinion"))), ("bad_sentiment", ~F.coalesce(F.col("sentiment").isin("positive", "negative", "neutral", "mixed", "unclear"), F.lit(False))),
        ("missing_rationale", blank(F.col("rationale"))), ("no_evidence", F.size(ids) == 0), ("bad_label", ~F.coalesce(F.col("support_label").isin("supported", "partially_supported", "insufficient_evidence", "contradicted"), F.lit(False))),
    ]
    return rows.withColumn("reason", first_reason(reasons))


def content_key(event: str = "event_id", refs=None):
    """Key of a claim's content: event, lower-case stakeholder and opinion, sentiment, sorted evidence."""
    low = lambda c: F.lower(collapse(F.coalesce(c, F.lit(""))))
    ids = F.array_join(F.array_sort(refs if refs is not None else F.col("evidence_ids")), ",")
    return F.concat_ws("|", event, low("stakeholder"), low("opinion"), F.coalesce("sentiment", F.lit("")), ids)


def tuple_tasks(events: DataFrame, claims: DataFrame) -> DataFrame:
    """(task_id, event_id, event_name, n_gold, stakeholders): one identification task for each event with claims."""
    gold = claims.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_gold"), F.array_join(F.array_sort(F.collect_set(F.coalesce("stakeholder", F.lit("")))), ";").alias("stakeholders"))
    return events.join(gold, "event_id").select(F.concat(F.lit("tuple_"), "event_id").alias("task_id"), "event_id", "event_name", "n_gold", "stakeholders")


def support_tasks(claims: DataFrame, negatives: DataFrame, id_col: str, refs: str) -> DataFrame:
    """(task_id, evidence_id, label): each claim with its own evidence (supported) and with sampled other evidence."""
    own = claims.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(refs)).alias("evidence_id"), F.lit("supported").alias("label"))
    other = negatives.select("id", F.col("negative").alias("evidence_id"), F.lit("not_enough_info").alias("label"))
    return own.unionByName(other).select(F.concat_ws("_", F.lit("support"), "id", "evidence_id").alias("task_id"), "evidence_id", "label")

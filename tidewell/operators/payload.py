"""Reading model payloads: tolerant, strict and repairing parsers over one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.cells import clamped, json_object_text, known_flags
from tidewell.functions.text import blank, strip

SENTIMENTS = ["positive", "negative", "neutral", "mixed", "unclear"]
SCHEMA = "struct<event_id string, tuples array<struct<stakeholder string, opinion string, sentiment string, rationale string, evidence_ids array<string>, confidence double>>>"


def parsed(df: DataFrame, raw: str) -> DataFrame:
    """df with `payload` (null where there is none) and `error`: no_json, bad_json, wrong_event, no_tuples or null."""
    text = json_object_text(F.col(raw))
    out = df.withColumn("payload", F.from_json(text, SCHEMA, {"mode": "PERMISSIVE"}))
    empty = F.col("payload.event_id").isNull() & F.col("payload.tuples").isNull()
    error = F.when(text.isNull(), "no_json").when(F.col("payload").isNull() | empty, "bad_json").when(F.col("payload.event_id") != F.col("event_id"), "wrong_event").when(F.coalesce(F.size("payload.tuples"), F.lit(0)) <= 0, "no_tuples")
    return out.withColumn("error", error)


def _usable(t: Column, known: Column) -> dict[str, Column]:
    ids = F.array_distinct(F.filter(F.coalesce(t["evidence_ids"], F.array().cast("array<string>")), lambda e: F.array_contains(known, e)))
    return {"stakeholder": strip(t["stakeholder"]), "opinion": strip(t["opinion"]), "sentiment": F.lower(strip(t["sentiment"])), "rationale": strip(t["rationale"]), "evidence_ids": ids, "confidence": clamped(F.coalesce(t["confidence"], F.lit(0.0)))}


def payload_tuples(df: DataFrame, id_col: str, known: str, mode: str = "drop", most: int = 4, name_length: int = 40, text_length: int = 60) -> DataFrame:
    """(id, tuple_id, stakeholder, opinion, sentiment, rationale, evidence_ids, confidence) of parsed payloads.

    mode `drop` leaves bad rows out, `strict` the whole payload with any bad row, `repair` puts neutral and unclear in.
    """
    rows = df.where("error IS NULL").select(F.col(id_col).alias("id"), "event_id", F.col(known).alias("__known"), F.posexplode("payload.tuples").alias("pos", "t"))
    rows = rows.select("id", "event_id", "pos", *(c.alias(n) for n, c in _usable(F.col("t"), F.col("__known")).items()))
    bad_enum = ~F.coalesce(F.col("sentiment").isin(SENTIMENTS), F.lit(False))
    bad = blank(F.col("stakeholder")) | blank(F.col("opinion")) | (F.size("evidence_ids") == 0)
    if mode == "repair":
        rows = rows.withColumn("sentiment", F.when(bad_enum, "neutral").otherwise(F.col("sentiment"))).where(~bad)
    elif mode == "strict":
        good = rows.groupBy("id").agg(F.bool_and(~(bad | bad_enum)).alias("good")).where("good").select("id")
        rows = rows.join(good, "id", "left_semi")
    else:
        rows = rows.where(~(bad | bad_enum))
    # a payload is one row's array, so ranking within it is local
    kept = rows.groupBy("id", "event_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "stakeholder", "opinion", "sentiment", "rationale", "evidence_ids", "confidence"))), 1, most).alias("ts"))
    out = kept.select("id", "event_id", F.posexplode("ts").alias("n", "t"))
    return out.select("id", F.concat("event_id", F.lit("_SOA_"), F.lpad((F.col("n") + 1).cast("string"), 3, "0")).alias("tuple_id"), F.left("t.stakeholder", F.lit(name_length)).alias("stakeholder"), F.left("t.opinion", F.lit(text_length)).alias("opinion"), "t.sentiment", F.left("t.rationale", F.lit(text_length)).alias("rationale"), "t.evidence_ids", "t.confidence")


def verdict(raw: Column, flags: list[str]) -> Column:
    """struct<label, score, issue_flags> of a verifier's answer; score 0.5 and flag parse_error where it can't be read."""
    p = F.from_json(json_object_text(raw), "struct<label string, score double, issue_flags array<string>>")
    bad = p.isNull() | (p["label"].isNull() & p["score"].isNull())
    return F.struct(F.when(bad, "insufficient_evidence").otherwise(F.coalesce(p["label"], F.lit("insufficient_evidence"))).alias("label"), F.when(bad, 0.5).otherwise(clamped(F.coalesce(p["score"], F.lit(0.5)))).alias("score"), F.when(bad, F.array(F.lit("parse_error"))).otherwise(known_flags(p["issue_flags"], flags, "no_issue")).alias("issue_flags"))


def error_kind(message: Column) -> Column:
    """Kind of an API or parse error by its words."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.when(m == "", "none").when(m.rlike("timeout|timed out"), "timeout").when(m.rlike("429|rate.?limit|quota"), "rate_limit").when(m.rlike("401|403|api.?key|unauthor"), "auth").when(m.rlike("json|parse|decode|expecting"), "parse").when(m.rlike("connect|network|dns|reset"), "network").otherwise("other")

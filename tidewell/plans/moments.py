"""Queries on written moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.timestamps import normalise_moments
from tidewell.sources.tables import table


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, id, value, source, place_zone, date_order): each evidence record and event once."""
    site = F.regexp_replace(F.lower(F.trim("domain")), r"^www\.", "")
    sites = table(spark, sf_dir, "web_sites").select(F.col("domain").alias("source"), F.col("time_zone").alias("place_zone"), "date_order")  # fixed, 38 rows
    pages = table(spark, sf_dir, "evidence_v3_repaired_plus_low37").where("evidence_id IS NOT NULL")
    pages = pages.groupBy(F.col("evidence_id").alias("id")).agg(F.min_by(F.struct(F.col("publish_time").alias("value"), site.alias("source")), F.struct("ingested_at", F.xxhash64("publish_time", "domain"))).alias("v"))
    pages = pages.select(F.lit("evidence").alias("kind"), "id", "v.value", "v.source").join(F.broadcast(sites), "source", "left")
    events = table(spark, sf_dir, "event_registry").where("event_id IS NOT NULL").dropDuplicates(["event_id"])
    events = events.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("time_window.start").alias("value"), F.lit(None).cast("string").alias("source"), F.col("location")["time_zone"].alias("place_zone"), F.lit(None).cast("string").alias("date_order"))
    columns = ["kind", "id", "value", "source", "place_zone", "date_order"]
    return pages.select(*columns).unionByName(events.select(*columns))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record and event whose value names exactly one instant."""
    out = normalise_moments(moments(spark, sf_dir)).where("utc_second IS NOT NULL")
    return out.select(F.col("kind").alias("record_kind"), F.col("id").alias("record_id"), "utc_second")


def p2_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each kind were resolved, or why not, and whether their form or the mixture told their order."""
    return normalise_moments(moments(spark, sf_dir)).groupBy("kind", "status", "order_by").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p2_found": p2_found, "p2_status": p2_status}

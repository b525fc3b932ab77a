"""Evidence graphs as node and edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import safe_id


def node_id(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.concat_ws(":", *(safe_id(p) for p in parts)))


def _nodes(df: DataFrame, kind: str, ident: Column, label: Column, order: str, last: bool = False) -> DataFrame:
    pick = F.max_by if last else F.min_by
    rows = df.select(ident.alias("node_id"), F.lit(kind).alias("node_type"), label.alias("label"), F.struct(order, label.alias("l")).alias("__o")).where(label.isNotNull() & (F.trim(label) != ""))
    return rows.groupBy("node_id", "node_type").agg(pick("label", "__o").alias("label"))


def evidence_graph(events: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of events, evidence, sources, stages, stances and stakeholders.

    Event and evidence nodes keep their last row, the others their first; stakeholder nodes are kept apart by event.
    Edges keep the first evidence that shows them.
    """
    ev, e = F.col("event_id"), F.col("evidence_id")
    nodes = [
        _nodes(events, "event", node_id("event", ev), F.col("event_name"), "event_id", last=True),
        _nodes(evidence, "evidence", node_id("evidence", e), F.coalesce("title", e), "ingested_at", last=True),
        _nodes(evidence, "source", node_id("source", F.col("source_type")), F.col("source_type"), "evidence_id"),
        _nodes(evidence, "stage", node_id("stage", F.col("temporal_stage")), F.col("temporal_stage"), "evidence_id"),
        _nodes(evidence, "stance", node_id("stance", F.col("stance_hint")), F.col("stance_hint"), "evidence_id"),
        _nodes(evidence, "stakeholder", node_id("stakeholder", ev, F.col("stakeholder_hint")), F.col("stakeholder_hint"), "evidence_id"),
    ]
    link = lambda a, b, relation, cond: evidence.where(cond).select(a.alias("source"), b.alias("target"), F.lit(relation).alias("relation"), e.alias("evidence_id"))
    has = lambda c: F.col(c).isNotNull() & (F.trim(c) != "")
    me, it = node_id("evidence", e), node_id("event", ev)
    edges = [
        link(it, me, "has_evidence", F.lit(True)),
        link(me, node_id("source", F.col("source_type")), "from_source", has("source_type")),
        link(me, node_id("stage", F.col("temporal_stage")), "in_stage", has("temporal_stage")),
        link(me, node_id("stance", F.col("stance_hint")), "takes_stance", has("stance_hint")),
        link(it, node_id("stakeholder", ev, F.col("stakeholder_hint")), "involves", has("stakeholder_hint")),
        link(me, node_id("stakeholder", ev, F.col("stakeholder_hint")), "mentions", has("stakeholder_hint")),
    ]
    all_edges = reduce(DataFrame.unionByName, edges).groupBy("source", "target", "relation").agg(F.min("evidence_id").alias("evidence_id"))
    return reduce(DataFrame.unionByName, nodes), all_edges


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, kind, n): nodes by type and edges by relation."""
    a = nodes.groupBy(F.lit("node").alias("part"), F.col("node_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(edges.groupBy(F.lit("edge").alias("part"), F.col("relation").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


def stage_chains(df: DataFrame, group: str, stage: str, item: str, order: list[str]) -> DataFrame:
    """(group, stage, chain, n): the items of each group and stage, joined in order."""
    rows = df.groupBy(group, stage).agg(F.array_sort(F.collect_list(F.struct(*order, item))).alias("__i"), F.count(F.lit(1)).alias("n"))
    return rows.select(group, stage, F.array_join(F.col(f"__i.{item}"), "->").alias("chain"), "n")

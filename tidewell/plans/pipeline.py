"""The claim pipeline as one lazy composition: evidence, stages, prompts, model, payloads, checks, scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.chat import ChatClient, EchoClient, ask
from tidewell.functions.cells import json_object_text
from tidewell.functions.text import collapse
from tidewell.operators import classify, payload, select


def prompts(picked: DataFrame, events: DataFrame, clip: int = 200) -> DataFrame:
    """(event_id, prompt, short_prompt, known): one prompt for each event from its picked evidence, in rank order."""
    line = F.concat(F.lit("["), "evidence_id", F.lit("] "), collapse(F.col("text"), clip, "..."))
    packed = picked.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line"), "evidence_id"))).alias("e"))
    head = F.concat(F.lit("EVENT: "), "event_id", F.lit("\n"), F.coalesce("event_name", F.lit("")), F.lit("\n"))
    return packed.join(events.select("event_id", "event_name"), "event_id").select("event_id", F.concat(head, F.array_join("e.line", "\n")).alias("prompt"), F.concat(head, F.array_join(F.slice("e.line", 1, 3), "\n")).alias("short_prompt"), F.col("e.evidence_id").alias("known"))


def attribute(picked: DataFrame, events: DataFrame, factory: Callable[[], ChatClient] = EchoClient, mode: str = "drop") -> tuple[DataFrame, DataFrame]:
    """(claims, answers): parsed claims of the model's answers, and the answers with their error codes.

    An unreadable answer is asked again with a shorter prompt. Nothing runs before an action.
    """
    answers = payload.parsed(ask(prompts(picked, events), "prompt", factory, "short_prompt").withColumnRenamed("error", "call_error"), "answer")
    return payload.payload_tuples(answers, "event_id", "known", mode), answers.select("event_id", "attempts", "call_error", F.coalesce("error", F.lit("ok")).alias("error"))


def verify(claims: DataFrame, evidence: DataFrame, threshold: float = 0.7) -> DataFrame:
    """claims with issue flags and a label: ids that exist decide first, then the score."""
    cited = claims.select("tuple_id", F.explode_outer("evidence_ids").alias("evidence_id"))
    found = cited.join(evidence.select("evidence_id").distinct().withColumn("here", F.lit(1)), "evidence_id", "left").groupBy("tuple_id").agg(F.count("here").alias("n_found"), F.count("evidence_id").alias("n_cited"))
    out = claims.join(found, "tuple_id", "left")
    flags = classify.flags({"no_evidence": F.coalesce("n_found", F.lit(0)) == 0, "unknown_evidence": F.col("n_found") < F.col("n_cited"), "low_confidence": F.col("confidence") < 0.4})
    label = F.when(F.coalesce("n_found", F.lit(0)) == 0, "insufficient_evidence").otherwise(classify.support_label(F.col("confidence"), threshold))
    return out.withColumns({"issue_flags": flags, "label": label}).drop("n_found", "n_cited")


def verify_by_model(claims: DataFrame, evidence: DataFrame, flags: DataFrame, factory: Callable[[], ChatClient] = EchoClient, known: list[str] | None = None, clip: int = 400) -> DataFrame:
    """(tuple_id, label, score, issue_flags, source): a model's verdict on each claim, after the rules of a precheck.

    flags: (tuple_id, issue_flags array) of the precheck. Claims without any evidence aren't sent to the model: they
    have the fall-back verdict (insufficient evidence, 0.0, source `rules`). An unreadable or failed answer gives
    insufficient evidence, 0.5 and parse_error. The rules' flags are kept beside the model's.
    """
    known = known or ["weak_evidence", "missing_evidence", "stakeholder_not_supported", "rationale_not_supported", "sentiment_not_supported", "opinion_overgeneralized", "stage_mismatch", "parse_error"]
    cited = claims.select("tuple_id", F.posexplode("evidence_ids").alias("pos", "evidence_id")).join(evidence.select("evidence_id", "text"), "evidence_id")
    text = cited.groupBy("tuple_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", collapse(F.coalesce("text", F.lit("")), clip, "...").alias("t")))), lambda x: x["t"]), "\n").alias("cited"))
    rows = claims.select("tuple_id", "event_id", "stakeholder", "opinion", "rationale").join(text, "tuple_id", "left").join(flags, "tuple_id", "left")
    part = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit("")), F.lit("\n"))
    asked = rows.where(F.col("cited").isNotNull()).withColumn("prompt", F.concat(part("EVENT", "event_id"), part("STAKEHOLDER", "stakeholder"), part("OPINION", "opinion"), part("RATIONALE", "rationale"), part("EVIDENCE", "cited")))
    own = F.coalesce("issue_flags", F.array().cast("array<string>"))
    answered = ask(asked, "prompt", factory).withColumn("v", payload.verdict(F.coalesce("answer", F.lit("")), known))
    merged = F.array_distinct(F.filter(F.concat(own, F.col("v.issue_flags")), lambda x: x != "no_issue"))
    by_model = answered.select("tuple_id", F.col("v.label").alias("label"), F.col("v.score").alias("score"), merged.alias("issue_flags"), F.lit("model").alias("source"))
    by_rules = rows.where(F.col("cited").isNull()).select("tuple_id", F.lit("insufficient_evidence").alias("label"), F.lit(0.0).alias("score"), F.array_distinct(F.concat(own, F.array(F.lit("missing_evidence")))).alias("issue_flags"), F.lit("rules").alias("source"))
    return by_model.unionByName(by_rules)


def preannotate(picked: DataFrame, events: DataFrame, existing: DataFrame, factory: Callable[[], ChatClient] = EchoClient) -> tuple[DataFrame, DataFrame]:
    """(claims, audit): an event's existing claims are replaced where the model gives new ones, and kept elsewhere.

    audit: (event_id, attempts, status, n_new, n_kept), one row for each event that was asked.
    """
    new, answers = attribute(picked, events, factory)
    new = new.withColumnRenamed("id", "event_id")
    kept = existing.join(new.select("event_id").distinct(), "event_id", "left_anti")
    count = lambda df, a: df.groupBy("event_id").agg(F.count(F.lit(1)).alias(a))
    audit = answers.join(count(new, "n_new"), "event_id", "left").join(count(kept, "n_kept"), "event_id", "left")
    status = F.when(F.col("call_error").isNotNull(), payload.error_kind(F.col("call_error"))).otherwise(F.col("error"))
    return kept.unionByName(new, allowMissingColumns=True), audit.select("event_id", "attempts", status.alias("status"), F.coalesce("n_new", F.lit(0)).alias("n_new"), F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


def expand(plan: DataFrame, picked: DataFrame, events: DataFrame, existing: DataFrame, by_rule: DataFrame, factory: Callable[[], ChatClient] = EchoClient) -> DataFrame:
    """(event_id, stakeholder, opinion, how): new claims of planned events, by the model, else by rule.

    plan: events to expand. A claim whose stakeholder or opinion the event has already is none; events to which the
    model adds nothing get the rule's claims. Of equal new claims one counts.
    """
    planned = plan.select("event_id").distinct()
    asked, _ = attribute(picked.join(planned, "event_id", "left_semi"), events, factory, "repair")
    known = lambda c: existing.select("event_id", F.lower(F.trim(c)).alias("k")).where("k <> ''").distinct()

    def unseen(df: DataFrame) -> DataFrame:
        for c in ("stakeholder", "opinion"):
            df = df.withColumn("k", F.lower(F.trim(c))).join(known(c), ["event_id", "k"], "left_anti").drop("k")
        return df.select("event_id", "stakeholder", "opinion").distinct()

    model = unseen(asked.withColumnRenamed("id", "event_id")).withColumn("how", F.lit("model"))
    rest = unseen(by_rule.join(planned, "event_id", "left_semi").join(model.select("event_id").distinct(), "event_id", "left_anti"))
    return model.unionByName(rest.withColumn("how", F.lit("rule")))


def run_tasks(tasks: DataFrame, kind: str, factory: Callable[[], ChatClient] = EchoClient) -> DataFrame:
    """(task_id, event_id, prediction, error): answers to benchmark tasks (task_id, event_id, prompt) of one kind.

    kind: `tuples` gives the list of tuples as JSON text, `support` the label, `chain` the ids joined by `|`. An answer
    without what its kind asks for is null with the error `no_answer`; a failed call has its own error kind.
    """
    schema = {"tuples": "tuples array<struct<stakeholder string, opinion string, sentiment string>>", "support": "support_label string", "chain": "evidence_ids array<string>"}[kind]
    answers = ask(tasks.select("task_id", "event_id", "prompt"), "prompt", factory)
    parsed = answers.withColumn("p", F.from_json(json_object_text(F.coalesce("answer", F.lit(""))), f"struct<{schema}>"))
    prediction = F.to_json("p.tuples") if kind == "tuples" else F.col("p.support_label") if kind == "support" else F.array_join("p.evidence_ids", "|")
    error = F.when(F.col("error").isNotNull(), payload.error_kind(F.col("error"))).when(prediction.isNull(), "no_answer")
    return parsed.select("task_id", "event_id", prediction.alias("prediction"), error.alias("error"))


def rerank(results: DataFrame, group: str, order: list[str], k: int = 10) -> DataFrame:
    """The head of each group's results in their given order; the place of a ranking model."""
    return select.top_k(results, [group], [F.asc(c) for c in order], k)


def ranked_evidence(evidence: DataFrame, k: int = 8) -> DataFrame:
    """The k best pages of each event."""
    return select.top_k(evidence.where("text IS NOT NULL"), ["event_id"], [F.desc_nulls_last("quality_score"), F.asc("evidence_id"), F.asc("ingested_at")], k)

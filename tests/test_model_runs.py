import json

from tidewell.plans.pipeline import expand, preannotate, rerank, run_tasks, verify_by_model

CLAIM = {"sentiment": "negative", "rationale": "r", "evidence_ids": ["e1"], "confidence": 0.9}


def model(answers):
    def factory():
        class Model:
            def chat(self, prompt):
                for key, answer in answers.items():
                    if key in prompt:
                        if answer is None:
                            raise TimeoutError("timed out")
                        return answer if isinstance(answer, str) else json.dumps(answer)
                return "no idea"

        return Model()

    return factory


def frames(spark):
    picked = spark.createDataFrame([("E1", "e1", "one", 1), ("E2", "e2", "two", 1), ("E3", "e3", "three", 1)], "event_id string, evidence_id string, text string, rank int")
    events = spark.createDataFrame([("E1", "a"), ("E2", "b"), ("E3", "c")], "event_id string, event_name string")
    old = spark.createDataFrame([("E1", "old_1", "s", "o"), ("E2", "old_2", "s", "o"), ("E9", "old_9", "s", "o")], "event_id string, tuple_id string, stakeholder string, opinion string")
    return picked, events, old


def test_preannotation_merges_and_audits(spark):
    picked, events, old = frames(spark)
    claims, audit = preannotate(picked, events, old, model({"EVENT: E1": {"event_id": "E1", "tuples": [{"stakeholder": "n", "opinion": "p", **CLAIM}]}, "EVENT: E3": None}))
    assert sorted(r["tuple_id"] for r in claims.collect()) == ["E1_SOA_001", "old_2", "old_9"]
    assert {r["event_id"]: (r["status"], r["n_new"], r["n_kept"]) for r in audit.collect()} == {"E1": ("ok", 1, 0), "E2": ("no_json", 0, 1), "E3": ("timeout", 0, 0)}


def test_expansion_by_model_then_by_rule(spark):
    picked, events, old = frames(spark)
    rule = spark.createDataFrame([("E1", "rule", "x"), ("E2", "S ", "y"), ("E2", "rule", "x"), ("E2", "rule", "x"), ("E3", "rule", "x")], "event_id string, stakeholder string, opinion string")
    tuples = [{"stakeholder": "new", "opinion": "q", **CLAIM}, {"stakeholder": "s", "opinion": "q2", **CLAIM}]
    got = expand(events.where("event_id <> 'E3'"), picked, events, old, rule, model({"EVENT: E1": {"event_id": "E1", "tuples": tuples}}))
    assert sorted(map(tuple, got.collect())) == [("E1", "new", "q", "model"), ("E2", "rule", "x", "rule")]


def test_verdicts_of_a_model(spark):
    claims = spark.createDataFrame([("t1", "E1", "s", "o1", "r", ["e1"]), ("t2", "E1", "s", "o2", "r", ["zz"]), ("t3", "E1", "s", "o3", "r", ["e1"])], "tuple_id string, event_id string, stakeholder string, opinion string, rationale string, evidence_ids array<string>")
    flags = spark.createDataFrame([("t1", ["stage_mismatch"])], "tuple_id string, issue_flags array<string>")
    answer = {"label": "supported", "score": 1.7, "issue_flags": ["weak_evidence", "unheard_of"]}
    got = {r["tuple_id"]: (r["label"], r["score"], r["issue_flags"], r["source"]) for r in verify_by_model(claims, frames(spark)[0], flags, model({"OPINION: o1": answer})).collect()}
    assert got == {"t1": ("supported", 1.0, ["stage_mismatch", "weak_evidence"], "model"), "t2": ("insufficient_evidence", 0.0, ["missing_evidence"], "rules"), "t3": ("insufficient_evidence", 0.5, ["parse_error"], "model")}


def test_benchmark_runs(spark):
    tasks = spark.createDataFrame([("a", "E1", "ask a"), ("b", "E1", "ask b"), ("c", "E1", "ask c")], "task_id string, event_id string, prompt string")
    run = lambda kind, answers: {r["task_id"]: (r["prediction"], r["error"]) for r in run_tasks(tasks, kind, model(answers)).collect()}
    assert run("support", {"ask a": {"support_label": "supported"}, "ask c": None}) == {"a": ("supported", None), "b": (None, "no_answer"), "c": (None, "timeout")}
    assert run("chain", {"ask a": {"evidence_ids": ["e1", "e2"]}})["a"] == ("e1|e2", None)
    assert json.loads(run("tuples", {"ask a": {"tuples": [{"stakeholder": "s"}]}})["a"][0]) == [{"stakeholder": "s"}]
    top = rerank(spark.createDataFrame([("q", 2, "b"), ("q", 1, "a"), ("q", 3, "c")], "q string, n int, v string"), "q", ["n"], 2)
    assert sorted(r["v"] for r in top.collect()) == ["a", "b"]

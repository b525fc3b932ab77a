import hashlib
import json

from pyspark.sql import functions as F

from tidewell.operators.upgrade import Upgrade, upgraded
from tidewell.plans.pipeline import attribute, verify
from tidewell.sources import reports, search


def test_search_payloads(spark, tmp_path):
    answers = {"a": {"items": [{"name": "T", "link": "u1", "date": "2024"}, {"title": " ", "headline": "H", "url": "u2"}]}, "b": {"webPages": {"value": [{"title": "W"}]}}, "c": {"title": "alone"}}
    for q, v in answers.items():
        (tmp_path / f"{hashlib.sha1(q.encode()).hexdigest()[:16]}.json").write_text(json.dumps(v))
    folder = str(tmp_path)
    got = search.normalized(search.search(spark.createDataFrame([(q,) for q in "abcd"], "query string"), lambda: search.FolderProvider(folder)))
    assert sorted((r["query"], r["title"], r["url"]) for r in got.collect()) == [("a", "H", "u2"), ("a", "T", "u1"), ("b", "W", None), ("c", "alone", None)]


def test_search_records(spark):
    cases = {
        '[{"a": 1}, 2, {"b": 2}]': ['{"a":1}', '{"b":2}'], '{"data": {"items": [{"a": 1}]}}': ['{"a":1}'], '{"results": {"data": {"results": [{"a": 1}]}}}': ['{"a":1}'], '{"data": {"name": "x"}}': ['{"data": {"name": "x"}}'],
        '{"webPages": {"value": [{"a": 1}]}}': ['{"a":1}'], '{"results": []}': [], '"text"': [], "nothing": [],
    }
    rows = spark.createDataFrame([(c,) for c in cases], "p string").select("p", search.records(F.col("p")).alias("r"))
    assert {r["p"]: r["r"] for r in rows.collect()} == cases
    one = spark.createDataFrame([('{"results": [{"link": "https://A.example/x", "url": "u", "summary": "s", "date": "d", "publish_time": "p"}, {"headline": "H", "source": "S", "type": "T", "body": "B"}]}',)], "payload string")
    a, b = (r.asDict() for r in search.normalized(one).orderBy("position").collect())
    assert (a["url"], a["text"], a["title"], a["platform"], a["source"], a["publish_time"]) == ("https://A.example/x", "s", "", "a.example", "a.example", "d")
    assert (b["text"], b["platform"], b["source"], b["url"]) == ("B", "S", "T", None)


def test_a_failing_provider_is_reported(spark):
    def factory():
        class Down:
            def search(self, query):
                raise ConnectionError("down")

        return Down()

    r = search.search(spark.createDataFrame([("q",)], "query string"), factory, attempts=2).first()
    assert r["payload"] is None and r["attempts"] == 2 and "ConnectionError" in r["error"]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.5), ("c_d", None)], "name string, score double")
    assert reports.markdown_table(df).splitlines() == ["| name | score |", "| --- | --- |", "| a\\|b | 0.5 |", "| c_d |  |"]
    assert r"c\_d" in reports.latex_table(df)
    assert reports.write_manifest(str(tmp_path / "m" / "x.json"), {"t": df}, version=1)["rows"] == {"t": 2}
    assert reports.keep_backup(str(tmp_path / "none")) is None and reports.keep_backup(str(tmp_path / "m" / "x.json"))
    nodes = spark.createDataFrame([("event:1", "event", "a\nb")], "node_id string, node_type string, label string")
    edges = spark.createDataFrame([("event:1", "evidence:2", "has_evidence", "2")], "source string, target string, relation string, evidence_id string")
    reports.export_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.option("header", True).csv(str(tmp_path / "g" / "nodes")).first()["label"] == "a\\nb"
    assert "HAS_EVIDENCE" in reports.graph_script(["event"], ["has_evidence"])


def test_schema_upgrade(spark):
    df = spark.createDataFrame([("1", "old", None, "x"), ("2", None, ["a"], "y")], "id string, seed_keywords string, stages array<string>, junk string")
    out, changes = upgraded(df, Upgrade({"seed_keywords": "query_seeds"}, {"stages": ["trigger"], "scope": "any"}, ["junk"], ["id", "scope"]))
    assert out.columns == ["id", "scope", "query_seeds", "stages"]
    assert sorted((r["id"], r["scope"], r["query_seeds"], r["stages"]) for r in out.collect()) == [("1", "any", "old", ["trigger"]), ("2", "any", None, ["a"])]
    assert changes.first().asDict() == {"filled_stages": 1, "filled_scope": 2}


def test_pipeline_with_a_model(spark):
    picked = spark.createDataFrame([("E1", "e1", "some text", 1), ("E1", "e2", "more text", 2), ("E2", "e3", "text", 1)], "event_id string, evidence_id string, text string, rank int")
    events = spark.createDataFrame([("E1", "one"), ("E2", "two")], "event_id string, event_name string")

    def factory():
        class Model:
            def chat(self, prompt):
                event = prompt.split("EVENT: ")[1].split("\n")[0]
                if event == "E2":
                    return "no idea"
                return json.dumps({"event_id": event, "tuples": [{"stakeholder": "s", "opinion": "o", "sentiment": "negative", "rationale": "r", "evidence_ids": ["e1", "zz"], "confidence": 0.9}, {"stakeholder": "s", "opinion": "o", "sentiment": "neutral", "rationale": "r", "evidence_ids": ["zz"], "confidence": 0.9}]})

        return Model()

    claims, answers = attribute(picked, events, factory)
    assert {(r["event_id"], r["attempts"], r["error"]) for r in answers.collect()} == {("E1", 1, "ok"), ("E2", 2, "no_json")}
    got = verify(claims, picked.select("evidence_id").where(F.lit(True))).collect()
    assert [(r["tuple_id"], r["evidence_ids"], r["label"]) for r in got] == [("E1_SOA_001", ["e1"], "supported")]

import json

import pytest
from pyspark.sql import functions as F

from tidewell.functions import cells, text
from tidewell.sources import config, files


def test_config_and_rules(tmp_path):
    y = tmp_path / "c.yaml"
    y.write_text("search:\n  limit: 5\n  key: null\n", encoding="utf-8")
    assert config.load_config(str(y), {"search": {"key": "k", "limit": 1}, "out": "o"}) == {"search": {"limit": 5, "key": "k"}, "out": "o"}
    assert config.load_config(str(tmp_path / "none.yaml"), {"a": 1}) == {"a": 1}
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(ValueError):
        config.load_config(str(tmp_path / "l.json"))
    (tmp_path / "r.json").write_text(json.dumps({"news": ["a", " a", "", None, "b"]}))
    assert config.load_rules(str(tmp_path / "r.json"), {"news": ["x"], "forum": ["f"]}) == {"news": ["a", "b"], "forum": ["f"]}
    assert (config.masked("short"), config.masked("a-long-secret"), config.masked(None)) == ("s***t", "a-lo***cret", "***")
    assert config.is_placeholder("YOUR-key") and not config.is_placeholder("k1")


def test_snapshots_lines_and_changes(spark, tmp_path):
    d = tmp_path / "s"
    d.mkdir()
    (d / "a.json").write_text('{"n": 1,\n "t": "x"}')
    (d / "b.json").write_text("{broken")
    got = {r["path"].rsplit("/", 1)[1]: (r["n"], r["t"]) for r in files.read_snapshots(spark, str(d), "n int, t string").collect()}
    assert got == {"a.json": (1, "x"), "b.json": (None, None)} and files.read_snapshots(spark, str(d / "none"), "n int").count() == 0
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n[1]\n{"a"\n')
    assert sorted((r["line"], r["text"]) for r in files.bad_lines(spark, str(tmp_path / "l.jsonl")).collect()) == [(3, "[1]"), (4, '{"a"')]
    now = files.fingerprints(spark, str(d))
    before = spark.createDataFrame(now.collect(), now.schema)
    assert before.count() == 2 and files.changed_since(before, files.fingerprints(spark, str(d))).count() == 0
    (d / "a.json").write_text("{}")
    (d / "b.json").unlink()
    (d / "c.json").write_text("{}")
    assert sorted((r["path"].rsplit("/", 1)[1], r["change"]) for r in files.changed_since(before, files.fingerprints(spark, str(d))).collect()) == [("a.json", "changed"), ("b.json", "removed"), ("c.json", "added")]
    assert files.clear_outputs(spark, str(tmp_path), ["s", "gone"]) == ["s"] and not d.exists()
    for bad in ("../x", "/etc", ".", ""):
        with pytest.raises(ValueError):
            files.clear_outputs(spark, str(tmp_path), [bad])


def test_split_sink(spark, tmp_path):
    df = spark.createDataFrame([("e1", 1), ("e2", 2), ("e3", 3)], "event_id string, n int")
    files.write_split(df, spark.createDataFrame([("e1", "train"), ("e2", "dev")], "event_id string, split string"), "event_id", str(tmp_path / "o"))
    assert {(r["split"], r["n"]) for r in spark.read.json(str(tmp_path / "o")).collect()} == {("train", 1), ("dev", 2)}


def test_answers_secrets_and_terms(spark):
    shapes = {None: "", "plain": "plain", '{"choices": [{"message": {"content": "c"}}]}': "c", '{"choices": []}': '{"choices": []}', '{"choices": [{"message": {"content": null}}]}': "", '{"content": "k"}': "k", '{"content": null}': "", '{"x": 1}': '{"x": 1}', "{broken": "{broken"}
    df = spark.createDataFrame([(k,) for k in shapes], "p string").select("p", cells.answer_text(F.col("p")).alias("t"), cells.masked(F.col("p")).alias("m"))
    got = {r["p"]: r for r in df.collect()}
    assert {k: v["t"] for k, v in got.items()} == shapes and got["plain"]["m"] == "p***n" and got[None]["m"] == "***"
    one = spark.range(1).select(cells.now_iso().alias("now"), cells.chain_list(F.lit("a -> b->")).alias("c"), cells.number_or(F.lit("x"), 0.5).alias("n"), cells.bounded_strings(F.array(F.lit(" abc "), F.lit(""), F.lit("d")), 1, 2).alias("b"), cells.known_flags(F.array(F.lit("z"), F.lit("a"), F.lit("a")), ["a"], "none").alias("f")).first()
    assert one["now"].endswith("+00:00") and (one["c"], one["n"], one["b"], one["f"]) == (["a", "b"], 0.5, ["ab"], ["a"])
    t = spark.createDataFrame([(["停车场 收费", "x" * 30, None, " "],)], "v array<string>").select(text.term_list(F.col("v"), ["收费"]).alias("t"), text.is_specific(F.lit("停车收费"), [], ["停车"]).alias("s")).first()
    assert "停车场" in t["t"] and "停车场 收费" in t["t"] and "x" * 30 not in t["t"] and t["s"] is False
    a = spark.createDataFrame([("市住建局", "住房建设局回应"), ("学生家长", "别的")], "n string, t string").select(text.alias_supported(F.col("n"), F.col("t"), {"住建": ["住房建设局"]}).alias("a"))
    assert [r["a"] for r in a.collect()] == [True, False]

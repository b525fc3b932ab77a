import os

import pytest

from tidewell.llm.queries import QUERIES, SQL

SF = os.environ.get("TIDEWELL_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    import oracle

    assert oracle.compare(spark, oracle.connect(SF), QUERIES[name], SQL[name], SF) is None


def test_containers_hold_every_token_once(spark):
    ids = {r["doc_id"]: len(r["ids"]) for r in QUERIES["p7_ids"](spark, SF).collect()}
    load, parts = {}, {}
    for r in QUERIES["p8_containers"](spark, SF).collect():
        load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
        parts[r["doc_id"]] = parts.get(r["doc_id"], 0) + r["n_tokens"]
    assert max(load.values()) <= 8_192 and parts == {d: n for d, n in ids.items() if n}
    assert len(load) == -(-sum(ids.values()) // 8_192)


@pytest.mark.parametrize("name", ["p1_clean", "p3_clean", "p4_found", "p5_rates", "p9_canonical"])
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0

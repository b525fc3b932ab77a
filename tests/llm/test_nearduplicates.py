import itertools
import random

import numpy as np

from tidewell.llm.nearduplicates import _class_pairs, bodies_of, classes_of, near_duplicate_groups, near_duplicates, signatures, sketches


def similarity(a, b):
    x, y = ({t[i : i + 5] for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for g in range(25):
        base = [word() for _ in range(60)]
        for v in range(rng.randint(1, 5)):
            words = [word() if rng.random() < 0.02 * v else w for w in base]
            rows.append((f"d{g:02d}{v}", "T" if v % 2 else None, " ".join(words)))
    rows += [(f"c{i}", None, rows[0][2]) for i in range(6)]  # copies
    rows += [("x1", "t", None), ("x2", "t", ""), ("x3", None, "abc"), ("x4", None, " "), (None, "t", rows[0][2]), ("d000", None, rows[0][2])]
    return rows


def test_all_similar_pairs_and_no_others(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "eid string, ttl string, body string").selectExpr("*", "'x' AS rid", "'y' AS id", "'z' AS bucket")
    got = sorted(tuple(r) for r in near_duplicates(df, "eid", "ttl", "body", None, 0.6).collect())
    whole = {i: ((t or "") + b).replace(" ", "") for i, t, b in rows if i and b and len(((t or "") + b).replace(" ", "")) >= 5}
    want = sorted((a, b) for a, b in itertools.combinations(sorted(whole), 2) if similarity(whole[a], whole[b]) >= 0.6)
    assert len(got) == len(set(got)) and not set(got) - set(want)
    assert len(set(got)) >= 0.99 * len(want)
    assert near_duplicates(df.limit(0), "eid", "ttl", "body", None, 0.6).count() == 0


def test_signatures_estimate_similarity():
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefgh") for _ in range(900))
    b = a[:600] + "".join(rng.choice("abcdefgh") for _ in range(300))
    s = signatures(*bodies_of([None, None], [a, b]), 512)
    assert abs((s[0] == s[1]).mean() - similarity(a, b)) < 0.1
    bits = np.bitwise_count(np.bitwise_xor(*sketches(s))).sum()
    assert abs(1 - bits / 128 - similarity(a, b)) < 0.25
    assert (signatures(*bodies_of([None], ["abcdef"]), 64) != 2**64 - 1).all()


def test_bodies_drop_blanks_and_empty_texts():
    codes, lengths = bodies_of(["t", None, "x", "\u00a0"], [" a\tb\n", None, "", "\u3000\r"])
    assert "".join(map(chr, codes)) == "tab" and lengths.tolist() == [3, 0, 0, 0]


def test_a_chained_class_of_thousands_keeps_every_pair(spark):
    rng = random.Random(3)
    whole = "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(40 * 3000 + 400))
    rows = [(f"d{i:05d}", None, whole[40 * i : 40 * i + 400]) for i in range(3000)]
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "id string, title string, text string"), "id", "title", "text", None, 0.6).collect()}
    want = {(rows[i][0], rows[j][0]) for i in range(3000) for j in (i + 1, i + 2) if j < 3000}  # similarity 0.82 and 0.66; the next is 0.53
    assert not got - want and len(got) >= 0.99 * len(want)


def test_a_class_of_5000_is_compared_in_blocks(spark):
    # one class of 5,000 nodes with random sketches, save 100 pairs of equal ones: no other pair leaves the join
    rng = np.random.default_rng(5)
    words = rng.integers(-(2**63), 2**63 - 1, (5000, 4))
    words[100:200] = words[:100]
    rows = [(i, *map(int, w)) for i, w in enumerate(words)]
    known = spark.createDataFrame(rows, "node long, s0 long, s1 long, s2 long, s3 long")
    labels = known.selectExpr("node AS rid", "0L AS class")
    done = spark.createDataFrame([(0, 100)], "a long, b long")
    assert {tuple(r) for r in _class_pairs(labels, known, done, 60).collect()} == {(i, i + 100) for i in range(1, 100)}


def test_copies_are_one_text_in_groups(spark):
    rows = [(f"h{i}", None, "the same text in very many places " * 3) for i in range(1500)] + [("z", "t", "another text that is not like it"), ("n", None, None)]
    df = spark.createDataFrame(rows, "id string, title string, text string")
    out = {r["id"]: (r["group_id"], r["n_links"]) for r in near_duplicate_groups(df, "id", "title", "text", None, 0.6).collect()}
    assert len(out) == 1501 and out["z"] == ("z", 0) and {v for k, v in out.items() if k != "z"} == {("h0", 0)}
    assert near_duplicates(df, "id", "title", "text", None, 0.6).count() == 1500 * 1499 // 2


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (11, 12)], "a long, b long")
    assert {r["rid"]: r["class"] for r in classes_of(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10, 12: 10}

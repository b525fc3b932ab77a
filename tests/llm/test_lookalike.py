import unicodedata

from tidewell.llm.lookalike import Reader, canonical_texts, lookalike_pairs, skeleton


def test_reading_is_script_consistent():
    counts = {}
    for w in ["Moscow", "con", "co", "москва", "сон", "окно"] * 20:
        for a, c in zip("^" + w, w + "$"):
            counts[a + c] = counts.get(a + c, 0) + 1
    r = Reader(counts)
    assert r.canonical("Mоscоw") == "Moscow"
    assert r.canonical("мoсквa") == "москва"
    assert r.canonical(r.canonical("мoсквa")) == "москва"
    assert r.canonical(None) is None and r.canonical("") == ""


def test_equal_looks_are_equal_and_others_not():
    same = [("é", "é"), ("１２，", "12,"), ("a b", "a b"), ("a　b", "a b"), ("no​tice", "notice"), ("Сafe", "Cafe"), ("Ｔable", "Τable")]
    for a, b in same:
        assert unicodedata.normalize("NFC", skeleton(a)) == unicodedata.normalize("NFC", skeleton(b))
    for a, b in [("m²", "m2"), ("①", "1"), ("㎡", "m2"), ("A", "a"), ("é", "e"), ("a b", "a  b"), ("a\tb", "a b")]:
        assert skeleton(a) != skeleton(b)


def test_pairs(spark):
    rows = [(1, "Notice 12"), (2, "Ｎotice 12"), (3, "Nоtice 12"), (4, "Notice 12"), (5, "notice 12"), (6, None), (7, ""), (8, " "), (9, "　"), (10, "​")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS look", "'y' AS id")
    got = sorted(tuple(r) for r in lookalike_pairs(df, "doc_id", "text").collect())
    assert got == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)]
    forms = {r["id"]: r["canonical"] for r in canonical_texts(df, "doc_id", "text").collect()}
    assert forms[1] == forms[2] == forms[3] == forms[4] == "Notice 12" and forms[5] == "notice 12" and forms[6] is None and forms[7] == ""
    assert lookalike_pairs(df.limit(0), "doc_id", "text").count() == 0


def test_hot_copies_are_paired_in_shares(spark):
    rows = [(i, "a b") for i in range(2300)] + [(5000, "a b"), (5001, "a b"), (5002, "c")]
    got = lookalike_pairs(spark.createDataFrame(rows, "n long, body string"), "n", "body")
    assert got.count() == got.distinct().count() == 2 * 2300


def test_planted_readings(spark):
    """Words with look-alike letters of another script put in are read back, by bigrams of the other words."""
    words = {"L": ["parade", "opera", "cascade", "payer", "copper", "escape"], "C": ["собака", "дорога", "корова", "погода"]}
    clean = [(i, " ".join(ws)) for i, ws in enumerate([words["L"], words["C"]] * 20)]
    mixed = {"раrаde": "parade", "оpеrа": "opera", "coбaкa": "собака", "дopoгa": "дорога", "саsсаdе": "cascade", "кoрoвa": "корова"}
    df = spark.createDataFrame(clean + [(1000 + i, w) for i, w in enumerate(mixed)], "n long, body string")
    got = {r["id"]: r["canonical"] for r in canonical_texts(df, "n", "body").where("id >= 1000").collect()}
    assert [got[1000 + i] for i in range(len(mixed))] == list(mixed.values())

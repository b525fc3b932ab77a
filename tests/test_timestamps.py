from datetime import datetime, timezone

from tidewell.operators.timestamps import normalise_moments

UTC = timezone.utc
ASIA, NY, BERLIN = "Asia/Shanghai", "America/New_York", "Europe/Berlin"


def at(*a):
    return int(datetime(*a, tzinfo=UTC).timestamp())


CASES = [
    ("2023-01-11 23:27", ASIA, None, at(2023, 1, 11, 15, 27)), ("2023-01-15T00:05:44+08:00", None, None, at(2023, 1, 14, 16, 5, 44)), ("2023/01/21 03:10 PM", ASIA, None, at(2023, 1, 21, 7, 10)),
    ("2023/01/21 12:00 AM", ASIA, None, at(2023, 1, 20, 16, 0)), ("Mon, 16 Jan 2023 13:16:32 +0800", None, None, at(2023, 1, 16, 5, 16, 32)), ("1673048814", None, None, 1673048814), ("1673304126999", None, None, 1673304126),
    ("20230123", ASIA, None, at(2023, 1, 22, 16)), ("２０２３年１月１８日 ００:３０", ASIA, None, at(2023, 1, 17, 16, 30)), ("2023年01月28日下午4时45分", ASIA, None, at(2023, 1, 28, 8, 45)), ("2023年05月03日0时31分", ASIA, None, at(2023, 5, 2, 16, 31)),
    ("Sat Jan 14 03:22:29 CST 2023", ASIA, None, at(2023, 1, 13, 19, 22, 29)), ("2023-02-03T01:19:27 Asia/Tokyo", ASIA, None, at(2023, 2, 2, 16, 19, 27)), ("Thu, 19 Jan 2023 12:32:48 GMT", ASIA, None, at(2023, 1, 19, 12, 32, 48)),
    ("03/02/2023 10:42 AM", BERLIN, "dmy", at(2023, 2, 3, 9, 42)), ("03/02/2023 10:42 AM", NY, "mdy", at(2023, 3, 2, 15, 42)), ("27.01.2023 02:04 PM", BERLIN, "dmy", at(2023, 1, 27, 13, 4)), ("　2023.01.17\t", ASIA, None, at(2023, 1, 16, 16)),
    ("2023-10-29 02:30:00 CEST", BERLIN, None, at(2023, 10, 29, 0, 30)), ("2023-10-29 02:30:00 CET", BERLIN, None, at(2023, 10, 29, 1, 30)), ("2023-03-26", BERLIN, None, at(2023, 3, 25, 23)), ("2023-01-09T12:57:55.462Z", None, None, at(2023, 1, 9, 12, 57, 55)),
    # no instant
    ("2023-10-29 02:30:00", BERLIN, None, "repeated"), ("2023-03-26 02:30:00", BERLIN, None, "skipped"), ("2023-01-11 23:27", None, None, "unknown_zone"), ("2023-01-11 23:27 EST", ASIA, None, "unknown_zone"), ("2023-13-05T04:01:00Z", None, None, "impossible"),
    ("2024-02-30 01:19", ASIA, None, "impossible"), ("0000-00-00 00:00:00", ASIA, None, "impossible"), ("13/13/2023 01:00 AM", BERLIN, "dmy", "impossible"), ("01/26/2023 05:32:40", BERLIN, "dmy", "impossible"), ("2023-01-11 25:00", ASIA, None, "impossible"),
    ("昨天 16:49", ASIA, None, "unparsed"), ("N/A", ASIA, None, "unparsed"), ("", ASIA, None, "missing"), (None, ASIA, None, "missing"), (" 　", ASIA, None, "missing"), ("03/02/2023 10:42 AM", BERLIN, None, "ambiguous_order"), ("2023-01-11 23:27 Nowhere/Town", ASIA, None, "unknown_zone"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "kind string, id string, value string, source string, place_zone string, date_order string").selectExpr("*", "'x' AS v", "1 AS family")


def test_cases(spark):
    rows = [("k", str(i), v, f"s{i}", z, o) for i, (v, z, o, _) in enumerate(CASES)]
    got = {r["id"]: r["utc_second"] if r["status"] == "ok" else r["status"] for r in normalise_moments(frame(spark, rows)).collect()}
    assert {CASES[int(i)][0]: x for i, x in got.items() if x != CASES[int(i)][3]} == {}
    assert normalise_moments(frame(spark, rows).limit(0)).count() == 0


def test_em_learns_the_order_of_a_source(spark):
    rows = [("k", f"a{i}", f"{13 + i % 15:02d}/02/2023 10:00:00", "day", BERLIN, None) for i in range(300)] + [("k", "x", "03/02/2023 10:00:00", "day", BERLIN, None)]
    rows += [("k", f"b{i}", f"02/{13 + i % 15:02d}/2023 10:00:00", "month", BERLIN, None) for i in range(300)] + [("k", "y", "03/02/2023 10:00:00", "month", BERLIN, None)]
    got = {r["id"]: r for r in normalise_moments(frame(spark, rows)).where("id IN ('x', 'y')").collect()}
    assert got["x"]["utc_second"] == at(2023, 2, 3, 9) and got["y"]["utc_second"] == at(2023, 3, 2, 9)
    assert got["x"]["order_posterior"] > 0.99


def test_the_mixture_decides(spark):
    """Without EM, no value that reads in two orders comes out; with it, sources with a declared order, or with values that tell it, do."""
    rows = [("k", "p", "03/02/2023 10:00:00", "declared", BERLIN, "dmy"), ("k", "q", "11/11/2023 10:00:00", "none", BERLIN, None), ("k", "r", "04/05/06 10:00:00", "short", BERLIN, None), ("k", "s", "20122010", "none", BERLIN, None)]
    rows += [("k", f"n{i}", f"25/1{i % 3}/{90 + i % 10} 10:00:00", "short", BERLIN, None) for i in range(300)]
    on = {r["id"]: r for r in normalise_moments(frame(spark, rows)).collect()}
    off = {r["id"]: r for r in normalise_moments(frame(spark, rows), rounds=0).collect()}
    assert {i: on[i]["utc_second"] for i in "pqrs"} == {"p": at(2023, 2, 3, 9), "q": at(2023, 11, 11, 9), "r": at(2006, 5, 4, 8), "s": at(2010, 12, 19, 23)}
    assert (on["p"]["order_by"], on["s"]["order_by"]) == ("mixture", "form")
    assert off["p"]["status"] == off["r"]["status"] == "ambiguous_order" and off["q"]["status"] == off["s"]["status"] == "ok"

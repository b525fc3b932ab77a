from pyspark.sql import functions as F

from tidewell.llm.boilerplate import PATH, boilerplate_lines, form_of, is_headline, page_lines
from tidewell.llm.lines import site_of
from tidewell.llm.repeats import repeated_lines, without_lines


def pages(spark):
    rows = []
    for i in range(40):
        site = ["a.example", "www.A.example", "b.example", None][i % 4]
        w, v = (chr(97 + k % 26) + chr(97 + k // 26) + "ox" for k in (i, i + 100))
        body = f"Story {w} begins here with {v}.\nIt goes on for {w} days and nights.\nIt ends at {v} in peace now."
        text = f"Home | News | Jobs\nTitle {w} of {v}\n{body}\nShare this page\nMore stories\nOther story {v} from town {w}\n(c) 20{i:02d} Paper"
        rows.append((f"e{i:03d}", site, f"Title {w} of {v}", text, i))
    rows += [("e000", "a.example", rows[0][2], rows[0][3], 99), ("n1", "a.example", None, None, 1), ("n2", "a.example", "t", "", 1), ("n3", "a.example", "t", " \n\n", 1), (None, "a.example", "t", "Home | News | Jobs", 1)]
    return spark.createDataFrame(rows, "eid string, dom string, ttl string, body string, at int").selectExpr("*", "'x' AS lines", "'y' AS site", "'z' AS id")


def test_repeated_lines_match_the_definition(spark):
    df = pages(spark)
    got = {tuple(r) for r in repeated_lines(df, "eid", "body", site_of(F.col("dom")), "at").collect()}
    want = set()
    seen = {r["eid"]: r for r in df.collect() if r["eid"]}
    site = lambda d: None if d is None else d.lower().removeprefix("www.")
    by_site = {}
    for r in seen.values():
        by_site.setdefault(site(r["dom"]), []).append(r)
    for s, rs in by_site.items():
        if s is None:
            continue
        count = {}
        for r in rs:
            for f in {form_of(x) for x in (r["body"] or "").split("\n")} - {""}:
                count[f] = count.get(f, 0) + 1
        for r in rs:
            for n, x in enumerate((r["body"] or "").split("\n"), 1):
                f = form_of(x)
                if f and count[f] >= 5 and count[f] >= 0.05 * len(rs):
                    want.add((r["eid"], n))
    assert got == want and got
    clean = {r["eid"]: r["body"] for r in without_lines(df.where("eid IS NOT NULL AND at < 99"), "eid", "body", spark.createDataFrame(sorted(got), "id string, line_no long")).collect()}
    assert clean["e000"].split("\n")[0].startswith("Title aaox") and clean["n1"] is None and clean["n2"] == ""
    assert repeated_lines(df.limit(0), "eid", "body", site_of(F.col("dom")), "at").count() == 0


def test_repeated_lines_of_small_tables(spark):
    def table(own, others):
        word = lambda i: chr(97 + i % 26) + chr(97 + i // 26 % 26)
        rows = [(f"a{i:03d}", "a.example", ("Five times\n" if i < 5 else "Four times\n" if i < 9 else "") + f"Line {word(i)} alone") for i in range(own)]
        rows += [(f"b{i:03d}", f"{word(i % 20)}.example", f"Other line {word(i)}") for i in range(others)]
        return spark.createDataFrame(rows, "eid string, dom string, body string")

    for own, others in ((51, 102), (100, 200), (60, 0)):  # a third of 153 and of 300 records, and one site alone
        got = {tuple(r) for r in repeated_lines(table(own, others), "eid", "body", site_of(F.col("dom"))).collect()}
        assert got == {(f"a{i:03d}", 1) for i in range(5 if own * 0.05 <= 5 else 0)}, (own, others, got)


def test_main_body_is_kept(spark):
    df = pages(spark)
    found = boilerplate_lines(df, "eid", "body", "ttl", site_of(F.col("dom")), F.lit(None).cast("string"), "at", least_pages=3)
    by_id = {}
    for r in found.collect():
        by_id.setdefault(r["id"], set()).add(r["line_no"])
    for i in range(40):
        assert by_id[f"e{i:03d}"] == {1, 6, 7, 8, 9}, (i, by_id.get(f"e{i:03d}"))
    assert None not in by_id and "n1" not in by_id and "n3" not in by_id
    assert boilerplate_lines(df.limit(0), "eid", "body", "ttl", F.lit("s"), F.lit("n"), "at").count() == 0


def test_body_of_a_hot_group_is_kept(spark):
    df = pages(spark).where("eid LIKE 'e%'")
    story = "The hot story of the river begins on this page.\nIts second paragraph tells of the bridge.\nIts last paragraph ends at the harbour."
    rows = []
    for i in range(60):  # equal texts on one host; then one body in the frames of several hosts, with comments of their own
        word = chr(97 + i % 26) + chr(97 + i // 26) + "up"
        text = f"Home | News | Jobs\nHot title of the river\n{story}\nShare this page\nMore stories\n" + ("Other story of the river\n(c) 2020 Paper" if i < 30 else f"Other story {word} from town\nSo says {word} too.\n(c) 2020 Paper")
        rows.append((f"h{i:03d}", "a.example" if i < 30 else f"{i % 3}.example", "Hot title of the river", text, i))
    df = df.unionByName(spark.createDataFrame(rows, "eid string, dom string, ttl string, body string, at int").selectExpr("*", "'x' AS lines", "'y' AS site", "'z' AS id"))
    found = boilerplate_lines(df, "eid", "body", "ttl", site_of(F.col("dom")), F.lit(None).cast("string"), "at", least_pages=3)
    by_id = {}
    for r in found.collect():
        by_id.setdefault(r["id"], set()).add(r["line_no"])
    for i in range(60):
        assert not by_id[f"h{i:03d}"] & {2, 3, 4, 5} and {1, 6, 7} <= by_id[f"h{i:03d}"], (i, by_id[f"h{i:03d}"])
    for i in range(40):
        assert by_id[f"e{i:03d}"] == {1, 6, 7, 8, 9}, (i, by_id[f"e{i:03d}"])


def test_a_small_host_is_judged_alike_in_a_large_table(spark):
    rows = []
    for i in range(7):
        w = chr(97 + i) + "ox"
        body = "\n".join(f"Paragraph {k} of story {w} ends here." for k in ("one", "two", "three", "four"))
        text = f"Front | Desk\nTitle {w} of the day\nReporter: {w} Miller\nReporter: {w} Smith\n{body}\nReaders write in\nI never liked the story of {w}."
        rows.append((f"t{i}", "tiny.example", f"Title {w} of the day", text, i))
    kinds = "eid string, dom string, ttl string, body string, at int"
    tiny = spark.createDataFrame(rows, kinds)
    others = spark.range(16_500).selectExpr("concat('o', id) AS eid", "concat(id % 40, '.example') AS dom", "concat('News about ', md5(string(id))) AS ttl", "concat('Home | News\n', 'News about ', md5(string(id)), '\nIt starts with ', md5(string(id + 1)), ' today.\nIt goes on with ', md5(string(id + 2)), ' then.\nIt ends with ', md5(string(id + 3)), ' at last.\n(c) Paper') AS body", "int(id) AS at")
    of = []
    for df in (tiny, tiny.unionByName(others)):
        found = boilerplate_lines(df.selectExpr("*", "'x' AS lines", "'y' AS site", "'z' AS id"), "eid", "body", "ttl", site_of(F.col("dom")), F.lit(None).cast("string"), "at")
        of.append({(r["id"], r["line_no"]) for r in found.where("id LIKE 't%'").collect()})
    assert of[0] == of[1] == {(f"t{i}", n) for i in range(7) for n in (1, 3, 4, 9, 10)}


def test_path_after_a_long_menu(spark):
    rows = []
    for i in range(20):
        w = chr(97 + i) + "ox"
        menu = "\n".join(f"Menu item {chr(97 + k)}" for k in range(14))
        body = "\n".join(f"Paragraph {k} of story {w} ends here." for k in ("one", "two", "three"))
        lead = ("Front", "Start", "Main", "Top", "Here")[i % 5]
        rows.append((f"m{i}", "menu.example", f"Title {w} of the day", f"{menu}\n{lead}/{w}/Title {w} of the day\nTitle {w} of the day\n{body}", i))
    df = spark.createDataFrame(rows, "eid string, dom string, ttl string, body string, at int")
    found = boilerplate_lines(df, "eid", "body", "ttl", site_of(F.col("dom")), F.lit(None).cast("string"), "at")
    assert {(r["id"], r["line_no"]) for r in found.collect()} == {(f"m{i}", n) for i in range(20) for n in range(1, 16)}


def test_page_lines():
    assert form_of("　Ａ １２ b 34") == "A0b0"
    assert is_headline("城区停水通知(更新)", "城区停水通知") and not is_headline("首页/城区停水通知", "城区停水通知")
    assert page_lines(None, None, None)[0] == [] and page_lines("a\n\n b ", None, None)[0] == [1, 3]


def test_a_host_keeps_its_result_among_many_others(spark):
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3)) + "ox"

    def rows(host, n, bar, lead):
        for i in range(n):
            w, v = word(i), word(i + 7000)
            yield f"{host}{i:05d}", host, f"Title {w} of {v}", f"{bar}\n{lead} {w}\nTitle {w} of {v}\nStory {w} begins here with {v}.\nIt goes on for {w} days and nights.\nIt ends at {v} in peace now.\n" + (f"Rate {bar}\nPeople said {w} of {v}." if i % 20 == 0 else f"Copy of {bar}"), i

    schema = "eid string, dom string, ttl string, body string, at int"
    own = list(rows("own", 200, "Home - News", "By"))
    other = [r for k in range(20) for r in rows(f"other{k}", 1000, f"Start - Jobs {word(k)}", "From")]
    run = lambda data: {tuple(r) for r in boilerplate_lines(spark.createDataFrame(data, schema), "eid", "body", "ttl", F.col("dom"), F.lit(None).cast("string"), "at").where("id LIKE 'own%'").collect()}
    alone = run(own)
    assert {n for i, n in alone if i == "own00001"} == {1, 2, 7} and {n for i, n in alone if i == "own00020"} == {1, 2, 7, 8}
    assert run(own + other) == alone


def test_paths_and_long_lines():
    head = "The bridge reopens"
    text = "\n".join(["Menu"] * 30 + [f"Home / City / {head}", head, "A / B / " + "x / " * 5000])
    flags = page_lines(text, None, None)[4]
    assert flags[30] & PATH and not flags[31] & PATH and not flags[32] & PATH

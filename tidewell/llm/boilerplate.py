"""Main body of web pages by a site style tree over page lines.

All pages of one host are merged into one tree. Its content nodes are line forms (numbers, white space and the site's
name masked, the page's headline replaced by a mark); its presentation nodes are line styles (the lead of the form,
alone and with the shape of its beginning). Importance is measured by information:

* A content node's importance is the entropy that is left when it is met: a line on k of a host's m pages has
  1 - log k / log m, the composite importance of a leaf of the site style tree. The bound is set on its numerator,
  -log2(k / m), so that it means the same share of pages on hosts of any size. Below `host_bits` (or `corpus_bits` over
  all hosts, for hosts too small or unknown) it is boilerplate.
* A boilerplate content node after which few of a page's paragraphs follow, averaged over the host's pages, opens a low
  importance branch: share bars, legal notes, teaser and comment headings. The branch goes with everything below it.
* A presentation node's importance is the share of its unrepeated lines that stand between two paragraphs of a page.
  Lines above the first or below the last paragraph whose style is seldom there go: paths, bylines, tags, links.
  Above the first paragraph a line whose style is rare stays (it may be a headline), below the last one it goes. A
  style without a verdict has its parent's: the lead of its lines or, for lines of steps, their shape up to the first.

Branches and styles are judged by the host where it has FEW_ENDS or FEW_LINES of them. A host of OWN stories or more
judges alone, so its result doesn't depend on what else the table holds. What smaller hosts have less of, and unknown
hosts, is judged by all pages; there, forms and styles count that are on a fixed share of all pages.

A paragraph is an unrepeated line that ends like a sentence and stands outside such branches.

All shares and places are counted over stories, not over pages: pages of a host with the same STORY longest sentences
(with the same lines, if they have fewer) count once for the host, and stories of several hosts that agree so without
their hosts' boilerplate count once for the corpus. So the body of a text that was copied or retold verbatim on any
share of the pages stays; the verdict holds for all copies.

Defined cases: rows with null id are left out; redelivered ids count once; null and blank texts have no lines; blank
lines are never reported; pages of unknown host are judged by the corpus alone; an empty table gives an empty table.
Lines meet only their host's array of boilerplate (bounded: every entry is on a fixed share of the host's pages), and
the broadcast sets hold forms and styles that are on a fixed share of all pages. A host's verdicts are arrays too: they
hold its boilerplate, and styles that are on a fixed share of its pages. A task holds at most FLUSH sums at a time.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.lines import BLANK, once
from tidewell.session import cut_lineage, spread

SENTENCE, HEADLINE, PATH, COMMON = 1, 2, 4, 8
#: A path has at most so many steps; a line with more separators is running text or a table.
STEPS = 50
#: Stories of a host that is judged by its own pages alone.
OWN = 50
#: So often, at least, a host has the branch openers and styles that it judges itself.
FEW_ENDS, FEW_LINES = 5, 8
#: Sums that a task holds before it hands them on; Spark adds them up.
FLUSH = 500_000
#: Pages that agree in so many of their longest sentences tell the same story.
STORY = 3
_TABLE = {**{ord(c): None for c in BLANK}, **{c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}}
_TABLE_WIDTH = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
_WORD = re.compile(r"[\s\u3000]*([A-Za-z]+)")
_DIGITS = re.compile("[0-9]+")
_RUN = re.compile("[一-鿿A-Za-zÀ-ɏ'’]+|.", re.DOTALL)
_END = re.compile("[。！？!?.…][”\"』」）)’]*$")
_STEPS = re.compile("[/>»]")
_STEM = re.compile(".*?[/>»]")


def form_of(line: str) -> str:
    """The line without white space, in ASCII width, every number as 0."""
    return _DIGITS.sub("0", line.translate(_TABLE))


def _grams(s: str) -> set[str]:
    return {s[i : i + 2] for i in range(len(s) - 1)}


def is_headline(form: str, title: str) -> bool:
    """Whether the form is the title, perhaps with small additions; a path that holds the title is not."""
    if form == title:
        return True
    if len(title) < 6 or abs(len(form) - len(title)) > 8 or len(_STEPS.findall(form)) > len(_STEPS.findall(title)):
        return False
    a, b = _grams(form), _grams(title)
    return len(a & b) >= 0.8 * min(len(a), len(b))


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - 2**63


def page_lines(text: str | None, title: str | None, name: str | None) -> tuple[list[int], list[int], list[int], list[int], list[int], list[int]]:
    """Line numbers, content nodes, styles, leads and flags of a page's non-blank lines; content nodes of its sentences, longest first."""
    head, site = form_of(title or ""), form_of(name or "")
    nos, keys, styles, leads, flags, forms = [], [], [], [], [], []
    for no, line in enumerate((text or "").split("\n"), 1):
        form = form_of(line)
        if not form:
            continue
        flag = SENTENCE if len(form) >= 15 and _END.search(form) else 0
        if head and is_headline(form, head):
            flag |= HEADLINE
        masked = form.replace(head, "\x01") if len(head) >= 6 else form
        if site:
            masked = masked.replace(site, "§")
        shape = "".join("A" if len(r) > 1 or r.isalpha() else r for r in (m.group() for m in islice(_RUN.finditer(masked), 6)))
        nos.append(no)
        forms.append(form)
        keys.append(_hash(masked))
        word = _WORD.match(line.translate(_TABLE_WIDTH))
        lead = word.group(1) if word else masked[:3] if masked[0].isalnum() or masked[0] in "\x01§" else masked[0]
        stem = _STEM.match(shape)  # the parent of a path's style is the shape up to its first step
        leads.append(_hash("\x02" + stem.group() if stem else lead))
        styles.append(_hash((lead if word else masked[:3]) + "|" + shape))
        flags.append(flag)
    known = set(forms)
    for i, f in enumerate(forms):  # a path ends in the headline or has it as a step, whether or not the title is known
        at = [m.end() for m in islice(_STEPS.finditer(f), STEPS + 1)]
        if 0 < len(at) <= STEPS:
            steps = {f[x:y] for x, y in zip([0, *at], [*(x - 1 for x in at), len(f)])} | {f[x:] for x in at}
            if any(len(g) >= 8 for g in steps & known):
                flags[i] |= PATH
    said = {k: len(f) for k, f, flag in zip(keys, forms, flags) if flag & (SENTENCE | HEADLINE | PATH) == SENTENCE}
    return nos, keys, styles, leads, flags, sorted(said, key=lambda k: (-said[k], k))


_FEATURES = "nos array<int>, keys array<bigint>, styles array<bigint>, leads array<bigint>, flags array<int>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    names = ["nos", "keys", "styles", "leads", "flags", "said"]
    for b in batches:
        for i in range(0, b.num_rows, 1000):
            part = b.slice(i, 1000)
            rows = [page_lines(*r) for r in zip(*(part.column(c).to_pylist() for c in ("text", "title", "name")))]
            lists = [pa.array([r[k] for r in rows], pa.list_(kind)) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("site"), part.column("at"), *lists], names=["id", "site", "at", *names])


def _pages(b: pa.RecordBatch) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Each page's arrays, without copying."""
    cols = {}
    for c in ("nos", "keys", "styles", "leads", "flags"):
        if c in b.schema.names:
            col = b.column(c)
            cols[c] = (col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False))
    for i in range(b.num_rows):
        yield i, {c: values[offsets[i] : offsets[i + 1]] for c, (offsets, values) in cols.items()}


def zones(flags: np.ndarray, branch: np.ndarray) -> tuple[int, int, int]:
    """(first paragraph, last paragraph, start of the low importance branch) of a page; no paragraph: (end, -1, end)."""
    end = int(np.argmax(branch)) if branch.any() else len(flags)
    text = np.flatnonzero((flags[:end] & (SENTENCE | COMMON | HEADLINE)) == SENTENCE)
    path = (flags[text] & PATH) > 0
    text = text[int(np.argmin(path)) :] if not path.all() else text[:0]  # above the first paragraph, a path is none
    return (int(text[0]), int(text[-1]), end) if len(text) else (end, -1, end)


def _story(said: Column, lines: Column) -> Column:
    """What pages of one story have in common: their longest sentences, or all lines if there are fewer."""
    return F.when(F.size(said) >= STORY, F.xxhash64(F.slice(said, 1, STORY))).otherwise(F.xxhash64(lines))


def boilerplate_lines(df: DataFrame, id_col: str, text_col: str, title_col: str, site: Column, name: Column, order_col: str, host_bits: float = math.log2(40), corpus_bits: float = math.log2(100), least_pages: int = 3, seldom: float = 0.15, follow: float = 0.35) -> DataFrame:
    """(id, line_no) of every non-blank line that is not main body."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), site.alias("site"), F.col(order_col).alias("at"), F.col(title_col).alias("title"), name.alias("name"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    lines = ["nos", "keys", "styles", "leads", "flags"]
    feats = spread(rows).mapInArrow(_features, f"id {types['id']}, site string, at {types['at']}, {_FEATURES}, said array<bigint>")
    pages = cut_lineage(once(feats, "id", ["site", *lines, "said"], "at").withColumn("page", F.xxhash64("id")))

    # content nodes: stories of each host, and of all hosts, that carry them
    told = pages.where("size(keys) > 0").groupBy("site", _story(F.col("said"), F.col("keys")).alias("story")).agg(F.min("page").alias("page")).select("page")
    stories = cut_lineage(pages.select("page", "site", "keys", "said").join(told, "page", "left_semi"))
    per = stories.select("site", F.explode(F.array_distinct("keys")).alias("key")).groupBy("site", "key").agg(F.count(F.lit(1)).alias("k"))
    sizes = cut_lineage(stories.groupBy("site").agg(F.count(F.lit(1)).alias("n")))
    hosts = per.where(F.col("site").isNotNull() & (F.col("k") >= least_pages)).join(sizes, "site").where(F.col("k") >= F.col("n") * 2.0**-host_bits).groupBy("site").agg(F.collect_set("key").alias("common"))
    hosts = cut_lineage(hosts)
    own = F.coalesce("common", F.array().cast("array<bigint>"))
    rest = F.array_except("keys", own)
    rest = F.when(F.size(rest) > 0, rest).otherwise(F.col("keys"))
    first = stories.join(hosts, "site", "left").groupBy(_story(F.array_except("said", own), rest).alias("story")).agg(F.min("page").alias("page")).select("page")
    first = cut_lineage(first)
    total = first.count()
    everywhere = stories.join(first, "page", "left_semi").select(F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("k"))
    everywhere = everywhere.where((F.col("k") >= max(5, least_pages)) & (F.col("k") >= total * 2.0**-corpus_bits))
    corpus = np.array(sorted(r["key"] for r in everywhere.select("key").collect()), np.int64)  # at most 2^corpus_bits times the lines of a page
    known = spark.sparkContext.broadcast(corpus)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            common = b.column("common")
            out = []
            for i, p in _pages(b):
                own = common[i].values
                seen = np.isin(p["keys"], known.value) | (np.isin(p["keys"], own.to_numpy()) if own is not None else False)
                out.append(p["flags"] | np.where(seen & ((p["flags"] & HEADLINE) == 0), COMMON, 0).astype(np.int32))
            flags = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(f) for f in out])]).astype(np.int32)), pa.array(np.concatenate(out) if out else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "site", "once", *lines[:4])), flags], names=["id", "site", "once", *lines])

    # once: 1 for pages that stand for a story on their host, 2 for those that do so in the corpus
    counts = stories.select("page").join(first.withColumn("once", F.lit(2)), "page", "left").select("page", F.coalesce("once", F.lit(1)).alias("once"))
    marked = pages.join(counts, "page", "left").join(hosts, "site", "left")
    marked = cut_lineage(marked.select("id", "site", "once", *lines, "common").mapInArrow(mark, f"id {types['id']}, site string, once int, {_FEATURES}"))
    counted = marked.where("once >= 1")

    # branches: what share of the page's paragraphs follows a boilerplate node
    def handed(sums: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int64()), *(pa.array([s[c] for s in sums.values()], pa.float64()) for c in range(4))], names=["site", "key", "n", "after", "all_n", "all_after"])

    def following(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str | None, int], list[float]] = defaultdict(lambda: [0, 0.0, 0, 0.0])
        for b in batches:
            sites, onces = b.column("site").to_pylist(), b.column("once").to_pylist()
            for i, p in _pages(b):
                text = (p["flags"] & (SENTENCE | COMMON | HEADLINE | PATH)) == SENTENCE
                if text.sum() >= 3:
                    after = 1 - np.cumsum(text) / text.sum()
                    at = np.flatnonzero(p["flags"] & COMMON)
                    first = onces[i] == 2
                    for k, a in zip(p["keys"][at].tolist(), after[at].tolist()):
                        s = sums[sites[i], k]
                        s[0] += 1
                        s[1] += a
                        if first:
                            s[2] += 1
                            s[3] += a
            if len(sums) >= FLUSH:
                yield handed(sums)
                sums.clear()
        yield handed(sums)

    ends = cut_lineage(counted.mapInArrow(following, "site string, key long, n double, after double, all_n double, all_after double").groupBy("site", "key").agg(*(F.sum(c).alias(c) for c in ("n", "after", "all_n", "all_after"))))
    general = ends.groupBy("key").agg(F.sum("all_n").alias("n"), F.sum("all_after").alias("after")).where((F.col("n") >= max(FEW_ENDS, total / 2000)) & (F.col("after") <= F.col("n") * follow))
    opens = spark.sparkContext.broadcast(np.array(sorted(r["key"] for r in general.select("key").collect()), np.int64))  # each is on one page in 2000
    hosts_pages = sizes.where(F.col("site").isNotNull()).select("site", F.col("n").alias("pages"))
    low_end = F.col("after") <= F.col("n") * follow
    own_ends = ends.where(F.col("n") >= FEW_ENDS).groupBy("site").agg(F.collect_list(F.when(low_end, F.col("key"))).alias("opening"), F.collect_list(F.when(~low_end, F.col("key"))).alias("closed"))
    own_ends = cut_lineage(hosts_pages.join(own_ends, "site", "left").select("site", (F.col("pages") >= OWN).alias("large"), *(F.coalesce(c, F.array().cast("array<bigint>")).alias(c) for c in ("opening", "closed"))))

    def branch_of(p: dict[str, np.ndarray], large: bool | None, opening: pa.ListScalar, closed: pa.ListScalar) -> np.ndarray:
        if large is None:
            branch = np.isin(p["keys"], opens.value)
        else:
            branch = np.isin(p["keys"], opening.values.to_numpy())
            if not large:
                branch |= np.isin(p["keys"], opens.value) & ~np.isin(p["keys"], closed.values.to_numpy())
        return branch & ((p["flags"] & COMMON) > 0)

    # presentation nodes: how many of their lines stand above, between and below the paragraphs
    def placed(sums: dict) -> pa.RecordBatch:
        rows = list(sums.items())
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.bool_()), pa.array([k[2] for k, _ in rows], pa.int64()), *(pa.array([v[c] for _, v in rows], pa.int64()) for c in range(4))], names=["site", "lead", "key", "n", "between", "all_n", "all_between"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str | None, bool, int], list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        for b in batches:
            sites, onces, large, opening, closed = b.column("site").to_pylist(), b.column("once").to_pylist(), b.column("large").to_pylist(), b.column("opening"), b.column("closed")
            for i, p in _pages(b):
                site, corpus_wide = sites[i], onces[i] == 2
                first, last, end = zones(p["flags"], branch_of(p, large[i], opening[i], closed[i]))
                for j in range(end):
                    f = int(p["flags"][j])
                    if f & HEADLINE or f & (SENTENCE | COMMON | PATH) == SENTENCE:
                        continue
                    between = int(first <= j <= last)
                    for node in ((site, True, int(p["leads"][j])), (site, False, int(p["styles"][j])))[: 1 if f & COMMON else 2]:
                        s = sums[node]
                        s[0] += 1
                        s[1] += between
                        if corpus_wide:
                            s[2] += 1
                            s[3] += between
            if len(sums) >= FLUSH:
                yield placed(sums)
                sums.clear()
        yield placed(sums)

    places_df = counted.join(own_ends, "site", "left").mapInArrow(places, "site string, lead boolean, key long, n long, between long, all_n long, all_between long")
    nodes = cut_lineage(places_df.groupBy("site", "lead", "key").agg(*(F.sum(c).alias(c) for c in ("n", "between", "all_n", "all_between"))))
    often = max(FEW_LINES, total / 500)
    usual = nodes.groupBy("lead", "key").agg(F.sum("all_n").alias("n"), F.sum("all_between").alias("between")).where(F.col("n") >= max(FEW_LINES, total / 2000))
    styles: tuple[dict[int, int], dict[int, int]] = ({}, {})  # 0: stands between paragraphs; 1: seldom; 2: seldom, and often met
    for r in usual.collect():  # each is on one page in 2000
        styles[int(r["lead"])][r["key"]] = (2 if r["n"] >= often else 1) if r["between"] < seldom * r["n"] else 0
    shared = spark.sparkContext.broadcast(styles)
    own = nodes.join(hosts_pages, "site").where((F.col("n") >= FEW_LINES) & (F.col("n") >= F.col("pages") / 500))
    low = F.col("between") < F.col("n") * seldom
    verdicts = {"fine_styles": ~F.col("lead") & ~low, "low_styles": ~F.col("lead") & low, "fine_leads": F.col("lead") & ~low, "low_leads": F.col("lead") & low}
    own_styles = own.groupBy("site").agg(*(F.collect_list(F.when(c, F.col("key"))).alias(n) for n, c in verdicts.items()))
    names = list(verdicts)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str | None, tuple[ChainMap, ChainMap]] = {}
        for b in batches:
            out = []
            sites, large, opening, closed, said = b.column("site").to_pylist(), b.column("large").to_pylist(), b.column("opening"), b.column("closed"), [b.column(c) for c in names]
            for i, p in _pages(b):
                if sites[i] not in of:
                    if len(of) >= 100:
                        of.clear()
                    fine, low, fine_lead, low_lead = (c[i].as_py() or [] for c in said)
                    usual = ({}, {}) if large[i] else shared.value
                    of[sites[i]] = (ChainMap({**dict.fromkeys(fine, 0), **dict.fromkeys(low, 2)}, usual[0]), ChainMap({**dict.fromkeys(fine_lead, 0), **dict.fromkeys(low_lead, 2)}, usual[1]))
                by_style, by_lead = of[sites[i]]
                first, last, end = zones(p["flags"], branch_of(p, large[i], opening[i], closed[i]))
                gone = []
                for j, (no, f) in enumerate(zip(p["nos"].tolist(), p["flags"].tolist())):
                    if j >= end or f & COMMON:
                        gone.append(no)
                    elif f & HEADLINE or first <= j <= last:
                        continue
                    else:
                        lead, style = int(p["leads"][j]), int(p["styles"][j])
                        lead = by_lead.get(lead)
                        style = by_style.get(style, lead)
                        if j < first:
                            if f & PATH or style == 2 or lead == 2:
                                gone.append(no)
                        elif style != 0:
                            gone.append(no)
                out.append(gone)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.int64()))], names=["id", "gone"])

    judged = marked.join(own_ends, "site", "left").join(own_styles, "site", "left")
    return judged.mapInArrow(judge, f"id {types['id']}, gone array<bigint>").select("id", F.explode("gone").alias("line_no"))

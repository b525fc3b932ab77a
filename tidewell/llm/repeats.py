"""Lines repeated across the documents of one source.

Each (source, line) is a hypothesis: does the line occur in more records of the source than chance allows? Its
within-source count is set against two outside rates by log-likelihood ratio: the line's own rate outside the source,
and the rate of an ordinary line outside it. The second is needed because a line that every source repeats is no
excess over other sources and yet has to go. The larger ratio counts, and Benjamini-Hochberg over all hypotheses sets
the bar. Significant lines that also reach `min_records` and `min_share` of the source's records are the excess
lines. Where there is too little outside a source for even its least such line to reach the bar against an ordinary
line's rate (one source alone, or small tables), the test says nothing, and the two exact floors decide. Documents lose them by an anti-join on line position and keep the order of the rest.

Defined cases: rows with null id are left out; records of unknown source keep all their lines; null texts count as
records without lines and stay null; blank lines are never removed; redelivered ids count once (the first by
`order_col`); an empty table gives an empty table. Only one array of excess lines for each source meets the records,
and as each such line is in `min_share` of the source's records, the array has at most 1 / min_share times the mean
number of lines of a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.lines import line_keys, once
from tidewell.session import cut_lineage

#: Width of the bins over which false discoveries are controlled, and the last bin.
BIN, LAST = 0.1, 20_000


def _xlogx(k: Column, of: Column) -> Column:
    return F.when(k > 0, k * F.log(k / of)).otherwise(0.0)


def log_likelihood(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Dunning's ratio of two binomial rates, 0 where the first rate is not the larger."""
    k1, n1, k2, n2 = (c.cast("double") for c in (k1, n1, k2, n2))
    both = (k1 + k2) / (n1 + n2)
    g = _xlogx(k1, n1 * both) + _xlogx(k2, n2 * both) + _xlogx(n1 - k1, n1 * (1 - both)) + _xlogx(n2 - k2, n2 * (1 - both))
    return F.when(k1 * n2 > k2 * n1, F.greatest(F.lit(0.0), 2 * g)).otherwise(0.0)


def _bar(tests: DataFrame, m: int, alpha: float) -> float:
    """The smallest ratio that Benjamini-Hochberg accepts, from counts in bins of bounded number.

    The tail of chi-square with one degree of freedom is bounded by exp(-g / 2), so the bar errs on the strict side.
    """
    bins = tests.groupBy(F.least(F.lit(LAST), F.floor(F.col("g") / BIN)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = bins.select("bin", F.sum("n").over(above).alias("rank"))
    ok = ranked.where(F.exp(-F.col("bin") * BIN / 2) <= alpha * F.col("rank") / max(m, 1))
    least = ok.agg(F.min("bin")).first()[0]
    return float("inf") if least is None else least * BIN


def line_tests(records: DataFrame, min_records: int, min_share: float, alpha: float) -> DataFrame:
    """(source, key, k1, n1, own, usual, tested, significant, excess): the test of each line in min_records records.

    own and usual are the ratios against the line's and an ordinary line's rate outside; tested: whether there is enough
    outside the source for the test; excess: whether the line goes. records: (id, source, lines) with unique ids.
    """
    known = records.where("source IS NOT NULL")
    sizes = known.groupBy("source").agg(F.count(F.lit(1)).alias("n1"))
    n_all = sizes.agg(F.coalesce(F.sum("n1"), F.lit(0))).first()[0]
    seen = known.select("source", F.explode(F.array_distinct(F.col("lines.key"))).alias("key"))
    per = cut_lineage(seen.groupBy("source", "key").agg(F.count(F.lit(1)).alias("k1")))
    m, incidences = per.agg(F.count(F.lit(1)), F.coalesce(F.sum("k1"), F.lit(0))).first()
    ordinary = incidences / max(m, 1)  # records that hold an average line of one source
    often = per.where(F.col("k1") >= min_records)
    totals = per.join(often.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.sum("k1").alias("k"))
    tests = often.join(totals, "key").join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "source")
    n2 = F.greatest(F.lit(n_all) - F.col("n1"), F.lit(1))
    own = log_likelihood(F.col("k1"), F.col("n1"), F.col("k") - F.col("k1"), n2)
    outside = F.least(F.lit(ordinary), n2 * 0.01)
    usual = log_likelihood(F.col("k1"), F.col("n1"), outside, n2)
    least = log_likelihood(F.greatest(F.lit(min_records), F.ceil(F.col("n1") * min_share - 1e-9)), F.col("n1"), outside, n2)
    tests = cut_lineage(tests.select("source", "key", "k1", "n1", own.alias("own"), usual.alias("usual"), F.greatest(own, usual).alias("g"), least.alias("least")))
    bar = _bar(tests, m, alpha)
    floors = F.col("k1") >= F.col("n1") * min_share - 1e-9
    significant, tested = F.col("g") >= bar, F.col("least") >= bar
    return tests.select("source", "key", "k1", "n1", "own", "usual", tested.alias("tested"), significant.alias("significant"), ((significant | ~tested) & floors).alias("excess"))


def excess_lines(records: DataFrame, min_records: int, min_share: float, alpha: float) -> DataFrame:
    """(source, excess array<bigint>): the excess lines of each source. records: (id, source, lines) with unique ids."""
    return line_tests(records, min_records, min_share, alpha).where("excess").groupBy("source").agg(F.collect_set("key").alias("excess"))


def _records(df: DataFrame, id_col: str, text_col: str, source: Column, order_col: str | None) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), source.alias("source"), line_keys(F.col(text_col)).alias("lines"), *([F.col(order_col).alias("at")] if order_col else []))
    return cut_lineage(once(rows, "id", ["source", "lines"], "at" if order_col else None))


def repeat_tests(df: DataFrame, id_col: str, text_col: str, source: Column, order_col: str | None = None, min_records: int = 5, min_share: float = 0.05, alpha: float = 0.01) -> DataFrame:
    """`line_tests` of a table's records."""
    return line_tests(_records(df, id_col, text_col, source, order_col), min_records, min_share, alpha)


def repeated_lines(df: DataFrame, id_col: str, text_col: str, source: Column, order_col: str | None = None, min_records: int = 5, min_share: float = 0.05, alpha: float = 0.01) -> DataFrame:
    """(id, line_no) of every non-blank line that its source repeats excessively."""
    records = _records(df, id_col, text_col, source, order_col)
    hits = records.join(excess_lines(records, min_records, min_share, alpha), "source")
    # what the record has of its source's lines is found by hashing; only these few are sought line by line
    hits = hits.select("id", "lines", F.array_intersect("lines.key", "excess").alias("own")).where(F.size("own") > 0)
    return hits.select("id", F.explode(F.filter("lines", lambda x: F.array_contains("own", x["key"]))["no"]).alias("line_no"))


def without_lines(df: DataFrame, id_col: str, text_col: str, found: DataFrame) -> DataFrame:
    """df with the found (id, line_no) taken out of its texts, the rest reassembled by position."""
    gone = found.groupBy(F.col("id").alias("__id")).agg(F.collect_set("line_no").alias("__gone"))
    lines = F.split(F.col(text_col), "\n", -1)
    # the positions that stay are a difference of sets: the anti-join on (id, position), without exploding the texts
    stay = F.array_except(F.sequence(F.lit(1).cast("long"), F.size(lines).cast("long")), F.col("__gone"))
    rest = F.array_join(F.transform(F.array(F.struct(lines.alias("l"), stay.alias("s"))), lambda x: F.transform(x["s"], lambda i: F.element_at(x["l"], i.cast("int"))))[0], "\n")
    out = df.join(gone, F.col(id_col) == F.col("__id"), "left")
    return out.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(rest)).drop("__id", "__gone")

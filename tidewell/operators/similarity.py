"""Similarity joins within groups without pairing all members of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import SPACE, characters


def _sets(df: DataFrame, group: str, id_col: str, text: str) -> DataFrame:
    """(grp, id, chars, key): rows with a character; key tells their sets apart."""
    chars = characters(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"{SPACE}+", ""))
    sets = df.select(F.col(group).alias("grp"), F.col(id_col).alias("id"), F.array_sort(chars).alias("chars")).where(F.size("chars") > 0)
    return sets.withColumn("key", F.array_join("chars", ""))


def _prefixes(sets: DataFrame, frequency: DataFrame, threshold: float) -> DataFrame:
    """(grp, key, n, char): the rarest characters of each set, as many as two sets this similar can't all lack."""
    ranked = sets.select("grp", "key", F.size("chars").alias("n"), F.explode("chars").alias("char")).join(frequency, "char")
    order = ranked.groupBy("grp", "key", "n").agg(F.array_sort(F.collect_list(F.struct("f", "char"))).alias("c"))
    length = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    return order.select("grp", "key", "n", F.explode(F.slice("c", F.lit(1), length.cast("int"))["char"]).alias("char"))


def similar_pairs(left: DataFrame, right: DataFrame, group: str, id_col: str, text: str, threshold: float) -> DataFrame:
    """(grp, g, p, similarity) of all pairs of one group whose character Jaccard reaches the threshold.

    Rows of one group with the same set of characters are folded first: they meet as one, and are unfolded in the
    result alone. Prefix filtering: characters are ordered from rare to frequent, and two sets of Jaccard t or more
    share one of the first n - ceil(t n) + 1 characters of each. Only sets that share such a character, and whose sizes
    allow t, meet; their sizes and sets come along, so the meeting decides and nothing is joined again. No pair at the
    threshold is lost.
    """
    if threshold <= 0:
        raise ValueError("a similarity join needs a threshold above 0")
    a, b = _sets(left, group, id_col, text), _sets(right, group, id_col, text)
    u, v = (d.select("grp", "key", "chars").distinct() for d in (a, b))
    frequency = u.unionByName(v).select(F.explode("chars").alias("char")).groupBy("char").agg(F.count(F.lit(1)).alias("f"))  # one row for each character
    x = _prefixes(u, frequency, threshold).select("grp", "char", F.col("key").alias("gk"), F.col("n").alias("gn"))
    y = _prefixes(v, frequency, threshold).select("grp", "char", F.col("key").alias("pk"), F.col("n").alias("pn"))
    near = x.join(y, ["grp", "char"]).where((F.col("gn") >= F.col("pn") * threshold - 1e-9) & (F.col("pn") >= F.col("gn") * threshold - 1e-9)).select("grp", "gk", "pk", "gn", "pn").distinct()
    # a key holds each of its characters once, so what is left of it without the other's characters tells the overlap
    shared = F.col("gn") - F.length(F.call_function("translate", F.col("gk"), F.col("pk"), F.lit("")))
    value = F.round(shared / (F.col("gn") + F.col("pn") - shared), 6)
    held = near.select("grp", "gk", "pk", value.alias("similarity")).where(F.col("similarity") >= threshold)
    both = held.join(a.select("grp", F.col("key").alias("gk"), F.col("id").alias("g")), ["grp", "gk"]).join(b.select("grp", F.col("key").alias("pk"), F.col("id").alias("p")), ["grp", "pk"])
    return both.select("grp", "g", "p", "similarity")


def near_pairs(df: DataFrame, group: str, id_col: str, text: str, threshold: float) -> DataFrame:
    """(grp, a, b, similarity), a < b: similar rows of one group, equal texts included."""
    return similar_pairs(df, df, group, id_col, text, threshold).where("g < p").select("grp", F.col("g").alias("a"), F.col("p").alias("b"), "similarity")


def containing_pairs(left: DataFrame, right: DataFrame, group: str, id_col: str, text: str) -> DataFrame:
    """(grp, g, p): pairs of one group of which one text holds the other.

    The rarest pair of characters of the held text has to be in the other, so only rows that share it meet; texts of
    one character are sought by it. Blank texts belong to no pair.
    """

    def grams(df: DataFrame, n: int) -> DataFrame:
        t = F.col("t")
        runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n))))
        return df.where(F.length(t) >= n).select("grp", "id", "t", F.explode(runs).alias("gram"))

    a, b = (d.select(F.col(group).alias("grp"), F.col(id_col).alias("id"), F.col(text).alias("t")).where(F.coalesce(F.trim("t"), F.lit("")) != "") for d in (left, right))

    def held(x: DataFrame, y: DataFrame, n: int, one: bool) -> DataFrame:
        """(grp, held, holder) of texts of x in texts of y; `one`: of the texts of exactly n characters alone."""
        have = grams(y, n).select("grp", "gram", F.col("id").alias("holder"), F.col("t").alias("whole"))
        frequency = have.groupBy("grp", "gram").agg(F.count(F.lit(1)).alias("f"))
        want = grams(x.where(F.length("t") == n) if one else x, n).join(frequency, ["grp", "gram"], "left")
        # a text with a pair of characters that no text of the group has is held by none
        rarest = want.groupBy("grp", "id", "t").agg(F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "gram")).alias("m")).where("m.f > 0")
        return rarest.select("grp", F.col("id").alias("held"), "t", F.col("m.gram").alias("gram")).join(have, ["grp", "gram"]).where(F.contains("whole", F.col("t"))).select("grp", "held", "holder")

    found = [held(x, y, n, n == 1).select("grp", F.col("held" if forward else "holder").alias("g"), F.col("holder" if forward else "held").alias("p")) for n in (1, 2) for x, y, forward in ((a, b, True), (b, a, False))]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).distinct()

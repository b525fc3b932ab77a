"""Precision, recall and F1 with exact, best-match and one-to-one matching."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.similarity import similar_pairs


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0.0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def prf(tp: Column, predicted: Column, gold: Column, places: int = 4) -> list[Column]:
    """precision, recall and f1."""
    p, r = ratio(tp, predicted), ratio(tp, gold)
    f = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return [F.round(p, places).alias("precision"), F.round(r, places).alias("recall"), F.round(f, places).alias("f1")]


def exact_f1(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """One row: exact F1 on distinct lower-case keys."""
    g, p = (d.select(*(F.lower(F.trim(F.coalesce(k, F.lit("")))).alias(k) for k in keys)).distinct() for d in (gold, predicted))
    counts = g.withColumn("side", F.lit(1)).unionByName(p.withColumn("side", F.lit(2))).groupBy(*keys).agg(F.sum("side").alias("side"))
    n = counts.agg(*(F.coalesce(F.sum(F.when(F.col("side").isin(*s), 1).otherwise(0)), F.lit(0)).alias(a) for a, s in (("tp", [3]), ("n_gold", [1, 3]), ("n_pred", [2, 3]))))
    return n.select("tp", "n_gold", "n_pred", *prf(F.col("tp"), F.col("n_pred"), F.col("n_gold")))


def best_match(gold: DataFrame, predicted: DataFrame, group: str, id_col: str, text: str, threshold: float) -> DataFrame:
    """(group, n_gold, n_matched): gold rows whose best prediction of the group reaches the threshold; many may share one."""
    hit = similar_pairs(gold, predicted, group, id_col, text, threshold).select(F.col("grp").alias(group), F.col("g").alias(id_col)).distinct().withColumn("hit", F.lit(1))
    return gold.join(hit, [group, id_col], "left").groupBy(group).agg(F.count(F.lit(1)).alias("n_gold"), F.count("hit").alias("n_matched"))


def greedy_pairs(pairs: DataFrame, group: str) -> DataFrame:
    """One-to-one matching: pairs (group, g, p, similarity) taken from the most similar down, each g and p once.

    Pairs never cross groups, so each group is matched by itself; ties go by g, then p. A group holds the pairs of one
    event, which the join on the event already bounds.
    """
    kind = {f.name: f.dataType.simpleString() for f in pairs.schema}

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["similarity", "g", "p"], ascending=[False, True, True])
        gs, ps, keep = set(), set(), []
        for g, p in zip(pdf["g"], pdf["p"]):
            ok = g not in gs and p not in ps
            keep.append(ok)
            if ok:
                gs.add(g)
                ps.add(p)
        return pdf[keep]

    return pairs.select(group, "g", "p", "similarity").groupBy(group).applyInPandas(match, f"{group} {kind[group]}, g {kind['g']}, p {kind['p']}, similarity double")


def sentiment_accuracy(matched: DataFrame, gold: DataFrame, predicted: DataFrame, id_col: str, label: str) -> DataFrame:
    """One row (n, n_right, sentiment_accuracy): matched (g, p) pairs whose labels agree; null labels agree with each other."""
    both = matched.join(gold.select(F.col(id_col).alias("g"), F.col(label).alias("x")), "g").join(predicted.select(F.col(id_col).alias("p"), F.col(label).alias("y")), "p")
    n = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").eqNullSafe(F.col("y"))).alias("n_right"))
    return n.select("n", "n_right", F.round(ratio(F.col("n_right"), F.col("n")), 4).alias("sentiment_accuracy"))


def support_rates(predicted: DataFrame, verified: Column, label: Column, by: str) -> DataFrame:
    """(by, n, supported_rate, unsupported_rate): shares that are verified, and that are unsupported or lack evidence."""
    n = predicted.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(verified, F.lit(False))).alias("v"), F.count_if(F.coalesce(label.isin("unsupported", "insufficient_evidence"), F.lit(False))).alias("u"))
    return n.select(by, "n", F.round(ratio(F.col("v"), F.col("n")), 4).alias("supported_rate"), F.round(ratio(F.col("u"), F.col("n")), 4).alias("unsupported_rate"))


def judged_f1(gold: DataFrame, predicted: DataFrame, group: str, judged: DataFrame) -> DataFrame:
    """One row: precision, recall and F1 where a judge has said which rows match, over groups that have both sides.

    judged: (g, p) of matching ids, each once at most on either side. Groups without gold or predictions don't count.
    """
    both = gold.select(group).distinct().join(predicted.select(group).distinct(), group)
    n_gold, n_pred = (d.join(both, group, "left_semi").agg(F.count(F.lit(1)).alias(a)) for d, a in ((gold, "n_gold"), (predicted, "n_pred")))
    n = judged.agg(F.count(F.lit(1)).alias("tp")).join(n_gold).join(n_pred)  # three single rows
    return n.select("tp", "n_gold", "n_pred", *prf(F.col("tp"), F.col("n_pred"), F.col("n_gold")))


def soft_f1(gold: DataFrame, predicted: DataFrame, group: str, id_col: str, text: str, threshold: float = 0.5) -> DataFrame:
    """One row: one-to-one soft precision, recall and F1."""
    tp = greedy_pairs(similar_pairs(gold, predicted, group, id_col, text, threshold), "grp").agg(F.count(F.lit(1)).alias("tp"))
    n = gold.agg(F.count(F.lit(1)).alias("n_gold")).join(predicted.agg(F.count(F.lit(1)).alias("n_pred"))).join(tp)  # three single rows
    return n.select("tp", "n_gold", "n_pred", *prf(F.col("tp"), F.col("n_pred"), F.col("n_gold")))


def sensitivity(gold: DataFrame, predicted: DataFrame, group: str, id_col: str, text: str, thresholds: list[float]) -> DataFrame:
    """(threshold, tp): one-to-one matches at each threshold, from one similarity join."""
    pairs = similar_pairs(gold, predicted, group, id_col, text, min(thresholds))
    grid = pairs.select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).where(F.col("similarity") >= F.col("threshold"))
    keyed = grid.withColumn("cell", F.concat_ws("|", F.col("threshold").cast("string"), F.col("grp").cast("string")))
    return greedy_pairs(keyed.select("cell", "g", "p", "similarity"), "cell").groupBy(F.substring_index("cell", "|", 1).cast("double").alias("threshold")).agg(F.count(F.lit(1)).alias("tp"))


def confusion(df: DataFrame, gold: str, predicted: str, labels: list[str]) -> DataFrame:
    """(gold, predicted, n) for every pair of labels, zeros included."""
    grid = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("gold")).select("gold", F.explode(F.array(*map(F.lit, labels))).alias("predicted"))
    n = df.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["gold", "predicted"], "left").select("gold", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def class_scores(matrix: DataFrame) -> DataFrame:
    """(label, tp, precision, recall, f1) of a confusion table."""
    g = matrix.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("n_gold"), F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    p = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("n_pred"))
    return g.join(p, "label").select("label", "tp", *prf(F.col("tp"), F.col("n_pred"), F.col("n_gold")))


def set_overlap(gold: DataFrame, predicted: DataFrame, group: str, items: str) -> DataFrame:
    """One row: micro precision, recall and F1 of item sets by group."""
    g, p = (d.select(group, F.explode(items).alias("item")).distinct() for d in (gold, predicted))
    tp = g.join(p, [group, "item"]).agg(F.count(F.lit(1)).alias("tp"))
    n = g.agg(F.count(F.lit(1)).alias("n_gold")).join(p.agg(F.count(F.lit(1)).alias("n_pred"))).join(tp)  # three single rows
    return n.select("tp", "n_gold", "n_pred", *prf(F.col("tp"), F.col("n_pred"), F.col("n_gold")))

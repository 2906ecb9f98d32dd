"""Metrics of predictions on positive-unlabeled labels: one aggregate over y_pu, pred and score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parhelion.functions.scalar import safe_ratio

INF = float("inf")


def _counts(df: DataFrame) -> DataFrame:
    p, u, hit = F.col("y_pu") == 1, F.col("y_pu") == 0, F.col("pred") == 1
    count = lambda c: F.count_if(c)
    return df.agg(
        F.count("*").alias("n"), count(p).alias("p"), count(u).alias("u"),
        count(p & hit).alias("p_hit"), count(u & hit).alias("u_hit"), count(hit).alias("hit"),
        count(p & (F.col("score") <= 0)).alias("p_low"), count(u & (F.col("score") > 0)).alias("u_high"),
    )


def _metric(name: str, prior: float):
    c = F.col
    recall = safe_ratio(c("p_hit"), c("p"), 0)
    return {
        "pu_zero_one_risk": F.when((c("p") == 0) | (c("u") == 0), F.lit(INF)).otherwise(2 * prior * safe_ratio(c("p_low"), c("p"), 0) + safe_ratio(c("u_high"), c("u"), 0) - prior),
        "pu_recall": recall,
        "pu_estimated_precision": F.when(c("hit") == 0, 0.0).otherwise(F.least(F.lit(1.0), prior * recall * c("n") / F.nullif(c("hit"), F.lit(0)))),
        "pu_negative_rate": safe_ratio(c("u") - c("u_hit"), c("u"), 0),
        "pu_accuracy": safe_ratio(c("p_hit") + c("u") - c("u_hit"), c("n")),
        "pu_f1": safe_ratio(2 * c("p_hit"), c("hit") + c("p"), 0),
    }[name]


NAMES = ["pu_zero_one_risk", "pu_recall", "pu_estimated_precision", "pu_negative_rate", "pu_accuracy", "pu_f1"]


def scalar_metric(df: DataFrame, name: str, prior: float) -> DataFrame:
    """One row, one column named after the metric; empty groups as each metric defines."""
    return _counts(df).select(F.round(_metric(name, prior), 9).alias(name))


def _running(by: DataFrame, sums: list[str], descending: bool = False, parts: int = 32) -> DataFrame:
    """by (one row per s) with ``<name>_before``, the sum of each column over the rows before it in the order of s.

    Approximate quantiles cut s into at most ``parts`` ranges; each range is summed in
    its own tasks and one total per range is added, so no task holds all of s.  The
    cuts decide where rows go, never a result.  Null comes first and NaN last.
    """
    cuts = by.agg(F.percentile_approx("s", [i / parts for i in range(1, parts)], 1000)).first()[0] or []
    cuts = sorted({float(c) for c in cuts if c == c})
    part = F.lit(0)
    for c in cuts:
        part = part + F.coalesce((F.col("s") >= c).cast("int"), F.lit(0))
    order = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    rows = by.withColumn("_part", part)
    inside = Window.partitionBy("_part").orderBy(order("s")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy(order("_part")).rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy("_part").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    whole = whole.select("_part", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums])
    rows = rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_in") for c in sums])
    joined = rows.join(F.broadcast(whole), "_part")
    return joined.select(*by.columns, *[(F.col(f"{c}_in") + F.col(f"_{c}")).alias(f"{c}_before") for c in sums])


def auc(df: DataFrame, label: str = "y_pu", score: str = "score") -> DataFrame:
    """Mann-Whitney AUC with mid-ranks, from one group per distinct score.

    One class only gives null.
    """
    by = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("u"))
    won = _running(by, ["u"]).withColumn("won", F.col("p") * (F.col("u_before") + F.col("u") / 2))
    return won.agg(F.round(F.try_divide(F.sum("won"), F.sum("p").cast("double") * F.sum("u")), 9).alias("pu_auc_roc"))


def panel(df: DataFrame, prior: float) -> DataFrame:
    """metric, value of every scalar metric."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.round(_metric(n, prior), 9).alias("value")) for n in NAMES])
    rows = _counts(df).select(F.inline(pairs))
    return rows.unionByName(auc(df).select(F.lit("pu_auc_roc").alias("metric"), F.col("pu_auc_roc").alias("value")))


def average_precision(df: DataFrame, label: str = "y_true", score: str = "score") -> DataFrame:
    by = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count("*").alias("n"))
    run = _running(by, ["p", "n"], descending=True).select("p", (F.col("p_before") + F.col("p")).alias("tp"), (F.col("n_before") + F.col("n")).alias("seen"))
    return run.agg(F.round(F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("seen")), F.sum("p")), 9).alias("average_precision"))


def brier(df: DataFrame, probability: str = "probability", label: str = "y_true") -> DataFrame:
    return df.agg(F.round(F.avg(F.pow(F.col(probability) - F.col(label), 2)), 9).alias("brier"))

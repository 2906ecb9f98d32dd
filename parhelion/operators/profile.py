"""Summaries and rule-based issues of positive-unlabeled data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parhelion.functions.scalar import canonical_label, safe_ratio


def normalize_labels(df: DataFrame, label: str = "y") -> DataFrame:
    return df.withColumn("y_pu", canonical_label(F.col(label)))


def label_audit(df: DataFrame, label: str) -> DataFrame:
    """value, n, valid of every label value."""
    return df.groupBy(F.col(label).alias("value")).agg(F.count("*").alias("n")).withColumn("valid", F.coalesce(F.col("value").isin(-1, 0, 1), F.lit(False)))


def pu_summary(df: DataFrame, label: str = "y_pu") -> DataFrame:
    y = F.col(label)
    p, u = F.count_if(y == 1), F.count_if(y == 0)
    return df.agg(F.count("*").alias("n_samples"), p.alias("n_positives"), u.alias("n_unlabeled"), F.round(F.coalesce(safe_ratio(u, p), F.lit(float("inf"))), 9).alias("pu_ratio"), F.round(safe_ratio(p, F.count("*")), 9).alias("positive_fraction"))


def pnu_summary(df: DataFrame, label: str = "y_pnu") -> DataFrame:
    y = F.col(label)
    p, n, u = F.count_if(y == 1), F.count_if(y == -1), F.count_if(y == 0)
    ratio = lambda a, b: F.round(F.coalesce(safe_ratio(a, b), F.lit(float("inf"))), 9)
    return df.agg(F.count("*").alias("n_samples"), p.alias("n_positives"), n.alias("n_negatives"), u.alias("n_unlabeled"), ratio(u, p).alias("pu_ratio"), ratio(u, n).alias("nu_ratio"), ratio(p, n).alias("pn_ratio"))


def feature_statistics(df: DataFrame, features: list[str], low: float = 1e-12) -> DataFrame:
    """feature, missing, infinite, constant, low_variance, stddev (population): one pass, one row a feature."""
    stats = []
    for f in features:
        x = F.col(f).cast("double")
        missing = x.isNull() | F.isnan(x)
        good = F.when(~missing & (F.abs(x) < float("inf")), x)
        stats.append(F.struct(F.lit(f).alias("feature"), F.count_if(missing).alias("missing"), F.count_if(F.abs(x) == float("inf")).alias("infinite"), (F.min(good) == F.max(good)).alias("constant"), F.var_pop(good).alias("variance")))
    rows = df.agg(F.array(*stats).alias("s")).select(F.inline("s"))
    # findings of single features ask for finite values in all of them
    finite = rows.agg((F.sum("missing") + F.sum("infinite") == 0).alias("_finite"))  # one row
    rows = rows.crossJoin(F.broadcast(finite)).withColumn("constant", F.col("constant") & F.col("_finite"))
    return rows.select("feature", "missing", "infinite", "constant", (F.col("_finite") & ~F.col("constant") & (F.col("variance") <= low)).alias("low_variance"), F.round(F.sqrt("variance"), 6).alias("stddev"))


def profile_issues(df: DataFrame, label: str = "y_pu", least: int = 30, most_ratio: float = 100.0) -> DataFrame:
    """code, severity of the label rules that the data break."""
    s = pu_summary(df, label)
    rule = lambda code, severity, when: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    p, u = F.col("n_positives"), F.col("n_unlabeled")
    rules = F.array(rule("no_labeled_positives", "error", p == 0), rule("few_labeled_positives", "warning", (p > 0) & (p < least)), rule("no_unlabeled_samples", "error", u == 0), rule("extreme_pu_imbalance", "warning", (p > 0) & (u > 0) & (u > most_ratio * p)))
    return s.select(F.inline(F.array_compact(rules)))


def prediction_statistics(df: DataFrame) -> DataFrame:
    s = F.col("score").cast("double")
    good = F.when(~F.isnan(s) & (F.abs(s) < float("inf")), s)
    return df.agg(F.count("*").alias("n"), F.count_if(F.col("pred") == 1).alias("n_positive"), F.round(safe_ratio(F.count_if(F.col("pred") == 1), F.count("*")), 9).alias("positive_fraction"), F.count(good).alias("n_finite"), F.min(good).alias("min_score"), F.percentile(good, 0.5).alias("median_score"), F.max(good).alias("max_score"))

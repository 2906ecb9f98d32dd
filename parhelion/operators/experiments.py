"""Summaries and integrity checks of experiment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trial_summary(trials: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, mean, std (sample; 0 for one trial), n; missing values are left out."""
    rows = trials.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    rows = rows.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return rows.groupBy(*keys, "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("std"), F.count("*").alias("n"))


def duplicate_keys(trials: DataFrame, keys: list[str]) -> DataFrame:
    return trials.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def gram(df: DataFrame, vector: str, dims: list[int]) -> DataFrame:
    """i, j, value of the centroid covariance: sum(x_i x_j) / n^2 - sum(x_i) sum(x_j) / n^2."""
    x = lambda i: F.col(vector)[i].cast("double")
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), ((F.sum(x(i) * x(j)) - F.sum(x(i)) * F.sum(x(j))) / F.pow(F.count("*"), F.lit(2))).alias("v")) for i in dims for j in dims]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c")).select("i", "j", F.round("v", 6).alias("value"))

"""Intervals, paired comparisons and audits of experiment tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's steps."""
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    out = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + k * d) or tiny)
            c = (1 + k / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def t_tail(t: float, df: int) -> float:
    """P(|T| > t) for Student's t with df degrees of freedom."""
    a, b, x = df / 2, 0.5, df / (df + t * t)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_quantile(confidence: float, df: int) -> float:
    """The t with P(|T| <= t) = confidence, by bisection of ``t_tail``."""
    low, high = 0.0, 1.0
    while t_tail(high, df) > 1 - confidence:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_tail(mid, df) > 1 - confidence else (low, mid)
    return (low + high) / 2


def t_intervals(trials: DataFrame, keys: list[str], value: str, confidence: float = 0.95) -> DataFrame:
    """keys, n, mean, std (sample), half_width, low, high; one trial has no interval (nulls).

    The quantile depends on n alone, so one literal is made for each n that occurs; a
    deviation of zero gives an interval of no width.
    """
    s = trials.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    sizes = [r.n for r in s.select("n").distinct().collect()]
    t = F.lit(None).cast("double")
    for n in sizes:
        if n > 1:
            t = F.when(F.col("n") == n, F.lit(t_quantile(confidence, n - 1))).otherwise(t)
    half = t * F.col("std") / F.sqrt("n")
    return s.select(*keys, "n", F.round("mean", 6).alias("mean"), F.round(F.coalesce("std", F.lit(0.0)), 6).alias("std"), F.round(half, 5).alias("half_width"), F.round(F.col("mean") - half, 5).alias("low"), F.round(F.col("mean") + half, 5).alias("high"))


def paired_summary(trials: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, n, mean and std of a - b, win_rate (share of trials with a < b)."""
    d = trials.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_d", F.col(a) - F.col(b))
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg("_d"), 6).alias("mean_difference"), F.round(F.coalesce(F.stddev_samp("_d"), F.lit(0.0)), 6).alias("std_difference"), F.round(F.avg((F.col("_d") < 0).cast("double")), 9).alias("win_rate"))


def fold_summary(folds: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, mean, std (population; null below two computed folds)."""
    known = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    return folds.groupBy(*keys).agg(F.count(known).alias("n"), F.round(F.avg(known), 6).alias("mean"), F.round(F.when(F.count(known) >= 2, F.stddev_pop(known)), 6).alias("std"))


def key_audit(planned: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """keys, finding: missing (planned, absent), unexpected, or duplicated (with its count n)."""
    p, a = planned.select(*keys).distinct().withColumn("_p", F.lit(1)), actual.groupBy(*keys).agg(F.count("*").alias("n"))
    both = p.join(a, keys, "full")
    finding = F.when(F.col("n").isNull(), "missing").when(F.col("_p").isNull(), "unexpected").when(F.col("n") > 1, "duplicated")
    return both.select(*keys, finding.alias("finding"), F.coalesce("n", F.lit(0)).cast("long").alias("n")).filter("finding is not null")


def strict_audit(trials: DataFrame, keys: list[str], metrics: list[str], cell: list[str], repetitions: int) -> DataFrame:
    """rule, violations: duplicate keys, metrics that are null or not finite, cells without the number of repetitions."""
    duplicated = trials.groupBy(*keys).count().filter("count > 1").agg(F.count("*").alias("violations")).select(F.lit("duplicate_keys").alias("rule"), "violations")
    bad = F.lit(False)
    for m in metrics:
        x = F.col(m).cast("double")
        bad = bad | x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))
    finite = trials.agg(F.count_if(bad).alias("violations")).select(F.lit("non_finite_metrics").alias("rule"), "violations")
    cells = trials.groupBy(*cell).count().filter(F.col("count") != repetitions).agg(F.count("*").alias("violations")).select(F.lit("repetitions").alias("rule"), "violations")
    return duplicated.union(finite).union(cells)


def sampling_plan(spark, unlabeled: list[int], priors: list[float], repetitions: int, positives: int, negatives: int, labeled: int, seed: int = 0) -> DataFrame:
    """One row for each size, prior and repetition: its seed, the rows that it asks of both classes, whether the pools hold them."""
    rows = [(u, float(p), r, seed + i) for i, (u, p, r) in enumerate((u, p, r) for u in unlabeled for p in priors for r in range(repetitions))]
    plan = spark.createDataFrame(rows, "n_unlabeled int, prior double, repetition int, seed int")
    need = F.bround(F.col("n_unlabeled") * F.col("prior"), 0).cast("int")
    plan = plan.withColumns({"need_positive": need + labeled, "need_negative": F.col("n_unlabeled") - need})
    reason = F.when(F.col("need_positive") > positives, "positives").when(F.col("need_negative") > negatives, "negatives").otherwise("")
    return plan.withColumn("reason", reason).withColumn("feasible", F.col("reason") == "")


def sampling_audit(plan: DataFrame) -> DataFrame:
    """For each size and prior: repetitions that are feasible, and the reasons against the others."""
    return plan.groupBy("n_unlabeled", "prior").agg(F.count("*").alias("n"), F.count_if("feasible").alias("n_feasible"), F.array_join(F.array_sort(F.collect_set(F.nullif("reason", F.lit("")))), ",").alias("reasons"))


def ranks(df: DataFrame, column: str) -> DataFrame:
    """column and its average rank (from 1), one row a value, with no task that sees all values.

    The values are cut into ranges; rows before a range come from the ranges' totals.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    ranged = counts.repartitionByRange(parts, column).withColumn("_part", F.spark_partition_id())
    totals = ranged.groupBy("_part").agg(F.sum("_n").alias("_rows"))
    before = totals.select("_part", F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("_own", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(before), "_part")
    return out.select(column, (F.col("_before") + F.col("_own") + (F.col("_n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """The correlation of the average ranks of a and b over rows with both."""
    known = df.select(a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ra, rb = ranks(known, a).withColumnRenamed("rank", "_ra"), ranks(known, b).withColumnRenamed("rank", "_rb")
    return known.groupBy(a, b).agg(F.count("*").alias("_n")).join(ra, a).join(rb, b).agg(_weighted_correlation("_ra", "_rb", "_n").alias("spearman"))


def _weighted_correlation(x: str, y: str, n: str):
    total = F.sum(n)
    mx, my = F.sum(F.col(x) * F.col(n)) / total, F.sum(F.col(y) * F.col(n)) / total
    xy, xx, yy = F.sum(F.col(x) * F.col(y) * F.col(n)) / total, F.sum(F.col(x) * F.col(x) * F.col(n)) / total, F.sum(F.col(y) * F.col(y) * F.col(n)) / total
    return F.round((xy - mx * my) / F.sqrt((xx - mx * mx) * (yy - my * my)), 6)

"""Source-to-target shift: domain classifier, rules, resampled intervals, decisions."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parhelion.operators.priors import standardized


def with_domain(source: DataFrame, target: DataFrame) -> DataFrame:
    """The rows of both with domain 0 and 1."""
    return source.withColumn("domain", F.lit(0)).unionByName(target.withColumn("domain", F.lit(1)))


def domain_scores(both: DataFrame, features: list[str], id_col: str, folds: int = 5) -> DataFrame:
    """both with ``p``: the chance of the target domain by a logistic fit on the other folds (dealt by md5 of the id)."""
    rows = standardized(both, features).withColumn("_fold", F.conv(F.substring(F.md5(F.concat_ws(":", "domain", id_col)), 1, 7), 16, 10).cast("long") % folds)
    rows = rows.withColumn("_x", array_to_vector(F.array(*[F.col(f).cast("double") for f in features])))
    out = None
    for k in range(folds):
        fit = LogisticRegression(featuresCol="_x", probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred", labelCol="domain", maxIter=100, regParam=0.0).fit(rows.filter(F.col("_fold") != k))
        part = fit.transform(rows.filter(F.col("_fold") == k)).withColumn("p", vector_to_array("_prob")[1]).drop("_x", "_fold", "_raw", "_prob", "_pred")
        out = part if out is None else out.union(part)
    return out


def separability(auc):
    """Column: the AUC of domains whichever side is called positive."""
    return F.greatest(auc, 1 - auc)


def severity(auc):
    """Column: high from 0.75 on, moderate from 0.6 on, else low."""
    return F.when(auc >= 0.75, "high").when(auc >= 0.6, "moderate").otherwise("low")


def density_weights(source: DataFrame, p: str, n_source: int, n_target: int, alpha: float = 0.1, clip: float = 1e-6) -> DataFrame:
    """source with raw (relative density ratio r / (alpha r + 1 - alpha), r = p / (1 - p) * n_source / n_target), weight (of mean 1), clipped."""
    q = F.least(F.greatest(F.col(p), F.lit(clip)), F.lit(1 - clip))
    r = q / (1 - q) * (n_source / n_target)
    raw = source.withColumns({"raw": r / (alpha * r + (1 - alpha)), "clipped": (F.col(p) < clip) | (F.col(p) > 1 - clip)})
    mean = raw.agg(F.avg("raw").alias("_mean"))  # one row
    return raw.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("raw") / F.col("_mean")).drop("_mean")


def weight_summary(weighted: DataFrame, alpha: float = 0.1) -> DataFrame:
    """One row: effective_fraction, clip_fraction, boundary_fraction (raw at 0.99 / alpha or more), raw_mean."""
    w, raw = F.col("weight"), F.col("raw")
    return weighted.agg(
        F.round(F.sum(w) * F.sum(w) / F.sum(w * w) / F.count("*"), 6).alias("effective_fraction"),
        F.round(F.avg(F.col("clipped").cast("double")), 9).alias("clip_fraction"),
        F.round(F.avg((raw >= 0.99 / alpha).cast("double")), 9).alias("boundary_fraction"),
        F.round(F.avg(raw), 6).alias("raw_mean"),
    )


def shift_issues(summary: DataFrame, least_effective: float = 0.5, most_boundary: float = 0.05, least_mass: float = 0.1) -> DataFrame:
    """code, level of every rule that a summary row breaks.

    summary: severity, effective_fraction, boundary_fraction, raw_mean, source_rate,
    target_rate (null without labels of the target).
    """
    gap = F.abs(F.col("target_rate") - F.col("source_rate")) >= 0.1
    rules = [
        ("domain_shift_high", "warning", F.col("severity") == "high"),
        ("domain_shift_moderate", "info", F.col("severity") == "moderate"),
        ("low_effective_sample_size", "warning", F.col("effective_fraction") < least_effective),
        ("relative_weight_boundary", "warning", F.col("boundary_fraction") > most_boundary),
        ("low_source_target_overlap", "warning", F.col("raw_mean") < least_mass),
        ("target_pu_missing", "info", F.col("target_rate").isNull()),
        ("observed_label_rate_shift", "warning", gap),
    ]
    found = F.array(*[F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(c).alias("code"), F.lit(v).alias("level"))) for c, v, on in rules])
    return summary.select(F.inline(F.array_compact(found)))


def ready(target_rate, effective, boundary, mass):
    """Column: whether weights may be used: labels of the target, enough effective rows, few at the boundary, enough mass."""
    return target_rate.isNotNull() & (effective >= 0.5) & (boundary <= 0.05) & (mass >= 0.1)


def alerts(windows: DataFrame, order: str, auc_jump: float = 0.1, rate_jump: float = 0.05) -> DataFrame:
    """windows with auc_change and label_rate_change against the window before, codes and level.

    windows: order, domain_auc, severity, adaptation_ready, label_rate; one row a window.
    """
    w = Window.orderBy(order)  # one row a window
    t = windows.withColumns({"auc_change": F.round(F.col("domain_auc") - F.lag("domain_auc").over(w), 9), "label_rate_change": F.round(F.col("label_rate") - F.lag("label_rate").over(w), 9)})
    codes = [
        F.when(F.col("severity") == "high", "high_domain_shift"),
        F.when(~F.col("adaptation_ready"), "adaptation_not_ready"),
        F.when(F.abs("auc_change") >= auc_jump, "domain_auc_jump"),
        F.when(F.abs("label_rate_change") >= rate_jump, "label_rate_jump"),
    ]
    critical = (F.col("severity") == "high") | ~F.col("adaptation_ready")
    out = t.withColumn("codes", F.concat_ws(",", *codes))
    return out.withColumn("level", F.when(critical, "critical").when(F.col("codes") != "", "warning").when(F.col("severity") == "moderate", "info").otherwise("none"))


def bootstrap_rates(df: DataFrame, domain: str, y: str, replicates: int = 50, buckets: int = 64) -> DataFrame:
    """replicate, domain, rate: label rates of resampled rows.

    Rows are dealt into buckets by md5 of their id and each replicate draws as many buckets
    with replacement: one pass over the table gives the buckets' counts, and replicates
    are made of those.  df has an id column ``row_id``.
    """
    bucket = F.conv(F.substring(F.md5(F.col("row_id").cast("string")), 1, 7), 16, 10).cast("long") % buckets
    counts = df.groupBy(domain, bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(y).alias("p"))
    draws = df.sparkSession.range(replicates * buckets).select((F.col("id") / buckets).cast("int").alias("replicate"), (F.conv(F.substring(F.md5(F.concat(F.lit("draw:"), F.col("id").cast("string"))), 1, 7), 16, 10).cast("long") % buckets).alias("bucket"))
    return draws.join(F.broadcast(counts), "bucket").groupBy("replicate", domain).agg((F.sum("p") / F.sum("n")).alias("rate"))


def percentile_interval(values: DataFrame, keys: list[str], column: str, confidence: float = 0.95) -> DataFrame:
    """keys, n, estimate (mean), low, high (linear percentiles) of a bounded number of replicates."""
    a = (1 - confidence) / 2
    return values.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(column), 6).alias("estimate"), F.round(F.expr(f"percentile({column}, {a!r}D)"), 6).alias("low"), F.round(F.expr(f"percentile({column}, {1 - a!r}D)"), 6).alias("high"))


def compare_metrics(baseline: DataFrame, weighted: DataFrame) -> DataFrame:
    """metric, baseline, weighted, improvement (risk counts down, all others up) of two tables (metric, value)."""
    both = baseline.withColumnRenamed("value", "baseline").join(weighted.withColumnRenamed("value", "weighted"), "metric", "left")
    sign = F.when(F.col("metric").contains("risk"), -1).otherwise(1)
    return both.select("metric", "baseline", "weighted", F.round((F.col("weighted") - F.col("baseline")) * sign, 9).alias("improvement"))


def recommendation(target_labels: bool, is_ready: bool, improvement: float | None, margin: float = 0.0) -> str:
    """What a comparison of baseline and weighted training advises."""
    if not target_labels:
        return "collect_target_data"
    if not is_ready:
        return "audit_only"
    return "reweight_recommended" if improvement is not None and improvement > margin else "no_clear_benefit"

"""Source and target comparison, prior sensitivity, windows, and review queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parhelion.functions.scalar import relative_weight, safe_ratio, sigmoid

EPS = 8 * 2.220446049250313e-16


def sensitivity_points(df: DataFrame, priors: list[float]) -> DataFrame:
    """prior, propensity, consistent, precision, risk: one aggregate, then the grid of constants."""
    p, u, hit = F.col("y_pu") == 1, F.col("y_pu") == 0, F.col("pred") == 1
    one = df.agg(F.count("*").alias("n"), F.count_if(p).alias("p"), F.count_if(u).alias("u"), F.count_if(hit).alias("hit"), F.count_if(p & hit).alias("p_hit"), F.count_if(u & hit).alias("u_hit"))
    grid = one.withColumn("prior", F.explode(F.array(*[F.lit(float(x)) for x in priors])))
    recall = safe_ratio(F.col("p_hit"), F.col("p"), 0)
    propensity = safe_ratio(F.col("p"), F.col("n")) / F.col("prior")
    precision = F.when(F.col("hit") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("prior") * recall * F.col("n") / F.nullif(F.col("hit"), F.lit(0))))
    risk = 2 * F.col("prior") * (1 - recall) + safe_ratio(F.col("u_hit"), F.col("u"), 0) - F.col("prior")
    return grid.select("prior", F.round(propensity, 9).alias("propensity"), (propensity <= 1 + EPS).alias("consistent"), F.round(precision, 9).alias("precision"), F.round(risk, 9).alias("risk"))


def sensitivity_ranges(points: DataFrame) -> DataFrame:
    """metric, low, high, span, n over the consistent points."""
    rows = points.filter("consistent").select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("precision", "risk")])))
    return rows.groupBy("metric").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.max("value") - F.min("value"), 9).alias("span"), F.count("value").alias("n"))


def domain_assumptions(df: DataFrame, priors: dict[str, float], tolerance: float = 0.05) -> DataFrame:
    """Rates, propensities and their change from source to target, and what they say."""
    rate = lambda d: safe_ratio(F.count_if((F.col("domain") == d) & (F.col("y_pu") == 1)), F.count_if(F.col("domain") == d))
    r = df.agg(rate("source").alias("rs"), rate("target").alias("rt"))
    cs, ct = F.col("rs") / priors["source"], F.col("rt") / priors["target"]
    moved, mechanism = F.lit(abs(priors["target"] - priors["source"]) >= tolerance), F.abs(ct - cs) >= tolerance
    possible = (cs <= 1) & (ct <= 1)
    says = F.when(~F.coalesce(possible, F.lit(False)), "inconclusive").when(moved & mechanism, "both_shift").when(moved, "class_prior_shift").when(mechanism, "labeling_mechanism_shift").otherwise("stable")
    return r.select(F.round("rs", 9).alias("source_rate"), F.round("rt", 9).alias("target_rate"), F.round(cs, 9).alias("source_propensity"), F.round(ct, 9).alias("target_propensity"), F.round(ct - cs, 9).alias("propensity_change"), says.alias("conclusion"))


def domain_sensitivity_grid(df: DataFrame, priors: dict[str, float], radius: float = 0.05) -> DataFrame:
    """Propensities of both domains at each prior, a radius below it and a radius above it: nine rows.

    One aggregate of the rows; the grid is a literal.  A domain without rows gives null propensities.
    """
    around = {d: [min(max(p + step, 1e-6), 1 - 1e-6) for step in (-radius, 0.0, radius)] for d, p in priors.items()}
    rate = lambda d: safe_ratio(F.count_if((F.col("domain") == d) & (F.col("y_pu") == 1)), F.count_if(F.col("domain") == d))
    points = F.array(*[F.struct(F.lit(s).alias("source_prior"), F.lit(t).alias("target_prior")) for s in around["source"] for t in around["target"]])
    grid = df.agg(rate("source").alias("rs"), rate("target").alias("rt")).select("rs", "rt", F.inline(points))
    cs, ct = F.col("rs") / F.col("source_prior"), F.col("rt") / F.col("target_prior")
    return grid.select(F.round("source_prior", 9).alias("source_prior"), F.round("target_prior", 9).alias("target_prior"), F.round(cs, 9).alias("source_propensity"), F.round(ct, 9).alias("target_propensity"), F.round(ct - cs, 9).alias("propensity_change"))


def importance_weights(df: DataFrame, probability: str = "probability", alpha: float = 0.1, clip: float = 1e-6) -> DataFrame:
    """id and weight of the source rows: the bounded relative ratio, mean one."""
    p = F.least(F.greatest(F.col(probability), F.lit(clip)), F.lit(1 - clip))
    raw = df.withColumn("raw", relative_weight(p / (1 - p), alpha))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).withColumn("weight", F.col("raw") / F.col("mean")).drop("mean")


def weight_statistics(w: DataFrame) -> DataFrame:
    q = F.percentile("weight", F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    s = w.agg(F.min("weight").alias("a"), q.alias("q"), F.max("weight").alias("z"), F.avg("weight").alias("m"), (F.pow(F.sum("weight"), 2) / F.sum(F.pow("weight", F.lit(2)))).alias("ess"), F.count("*").alias("n"))
    names = ["p05", "p25", "median", "p75", "p95"]
    return s.select(F.round("a", 6).alias("min_weight"), *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(names)], F.round("z", 6).alias("max_weight"), F.round("m", 6).alias("mean_weight"), F.round("ess", 4).alias("ess"), F.round(F.col("ess") / F.col("n"), 6).alias("ess_fraction"))


def calibrate_prior(df: DataFrame, prior: float, probability: str = "probability", rounds: int = 8, ways: int = 32) -> DataFrame:
    """df with the probabilities' logits shifted (by -30 to 30 at most) so that their mean is ``prior``.

    Each round is one aggregate that tries ``ways`` shifts and narrows the range to
    1 / (ways + 1), in place of one pass for each halving.  Null probabilities stay
    null and count in no mean; no rows give no rows.
    """
    p = F.least(F.greatest(F.col(probability), F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = F.when(F.col(probability).isNotNull(), F.ln(p / (1 - p)))
    low, high = -30.0, 30.0
    for _ in range(rounds):
        tried = [low + (high - low) * k / (ways + 1) for k in range(1, ways + 1)]
        means = df.agg(*[F.avg(sigmoid(logit + x)) for x in tried]).first()
        below = sum(m is not None and m < prior for m in means)
        edges = [low, *tried, high]
        low, high = edges[below], edges[below + 1]
    return df.withColumn(probability, F.when(F.col(probability).isNotNull(), sigmoid(logit + (low + high) / 2)))


def monitor_windows(df: DataFrame, jump: float = 0.05) -> DataFrame:
    """window_id, n, label_rate, label_rate_change (to the window before), level, in order of window_id."""
    by = df.groupBy("window_id").agg(F.count("*").alias("n"), F.avg(F.col("y_pu").cast("double")).alias("rate"))
    change = F.col("rate") - F.lag("rate").over(Window.orderBy("window_id"))
    return by.select("window_id", "n", F.round("rate", 9).alias("label_rate"), F.round(change, 9).alias("label_rate_change"), F.when(F.abs(change) >= jump, "warning").otherwise("none").alias("level"))


def review_queue(df: DataFrame, budget: int, id_col: str) -> DataFrame:
    """rank, id, uncertainty of the unlabeled rows that the model knows least about: a top-n."""
    queue = df.filter("y_pu = 0").select(id_col, (1 - 2 * F.abs(F.col("probability") - 0.5)).alias("uncertainty"))
    top = queue.orderBy(F.desc("uncertainty"), id_col).limit(budget)
    return top.select(F.row_number().over(Window.orderBy(F.desc("uncertainty"), id_col)).cast("int").alias("rank"), id_col, F.round("uncertainty", 9).alias("uncertainty"))


def selective_summary(df: DataFrame, least: float = 0.5) -> DataFrame:
    sure = 2 * F.abs(F.col("probability") - 0.5) >= least
    right = (F.col("probability") >= 0.5).cast("int") == F.col("y_true")
    return df.agg(F.count("*").alias("n"), F.count_if(sure).alias("n_kept"), F.round(safe_ratio(F.count_if(sure), F.count("*")), 9).alias("coverage"), F.round(safe_ratio(F.count_if(sure & right), F.count_if(sure)), 9).alias("selective_accuracy"))


def trusted_set(df: DataFrame, target: int, id_col: str) -> DataFrame:
    """id, side: the target // 2 lowest and highest probabilities, two top-n reads."""
    half = target // 2
    low = df.orderBy("probability", id_col).limit(half).select(id_col, F.lit("negative").alias("side"))
    return low.union(df.orderBy(F.desc("probability"), F.desc(id_col)).limit(half).select(id_col, F.lit("positive").alias("side")))

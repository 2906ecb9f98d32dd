"""Class priors from positive and unlabeled rows.

Kernels are taken against a bounded number of centres or rows (parameters), so the
work over the table is one pass of aggregates, or a sample of proven size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, features: list[str], n: int, order: str) -> np.ndarray:
    """The features of the n rows with the smallest ``order``, as a matrix (n is a bound of the caller)."""
    rows = df.orderBy(order).limit(n).select(*[F.col(f).cast("double").alias(f) for f in features]).collect()
    return np.array([tuple(r) for r in rows], float).reshape(len(rows), len(features))


def squared_distance(features: list[str], point):
    """Column: squared distance of the features to a point of numbers."""
    out = F.lit(0.0)
    for f, x in zip(features, point):
        d = F.col(f).cast("double") - F.lit(float(x))
        out = out + d * d
    return out


def rbf_means(df: DataFrame, features: list[str], centers: np.ndarray, sigma: float, by: str) -> DataFrame:
    """by, center (its number), mean of exp(-d^2 / (2 sigma^2)) over the rows: one pass, partly aggregated."""
    cells = [F.avg(F.exp(-squared_distance(features, c) / (2 * sigma * sigma))).alias(f"c{i}") for i, c in enumerate(centers)]
    wide = df.groupBy(by).agg(*cells)
    return wide.select(by, F.posexplode(F.array(*[f"c{i}" for i in range(len(centers))])).alias("center", "mean"))


def median_distance(points: np.ndarray) -> float:
    """Median distance of the pairs of at most 1,000 rows; 1 if there is none above zero."""
    d = np.sqrt(np.maximum(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1), 0))[np.triu_indices(len(points), 1)]
    return float(np.median(d)) if len(d) and np.median(d) > 0 else 1.0


def standardized(df: DataFrame, features: list[str]) -> DataFrame:
    """df with the features less their mean over their population deviation (1 if that is nearly zero)."""
    stats = df.agg(*[F.struct(F.avg(f).alias("m"), F.stddev_pop(f).alias("s")).alias(f) for f in features]).first()
    out = {}
    for f in features:
        m, s = stats[f].m or 0.0, stats[f].s or 0.0
        out[f] = (F.col(f).cast("double") - m) / (s if s > 1e-12 else 1.0)
    return df.withColumns(out)


def penalized_objective(means: DataFrame, y: str, thetas: list[float], ridge: float = 0.01) -> DataFrame:
    """theta, objective: sum of max(b, 0) b / ridge - theta + 1 with b = theta * mean_P - mean_U of each centre."""
    p = means.filter(F.col(y) == 1).select("center", F.col("mean").alias("p"))
    u = means.filter(F.col(y) == 0).select("center", F.col("mean").alias("u"))
    grid = p.join(u, "center").select("p", "u", F.explode(F.array(*[F.lit(float(t)) for t in thetas])).alias("theta"))
    b = F.col("theta") * F.col("p") - F.col("u")
    return grid.groupBy("theta").agg((F.sum(F.greatest(b, F.lit(0.0)) * b) / ridge - F.first("theta") + 1).alias("objective"))


def pen_l1(df: DataFrame, y: str, features: list[str], order: str, n_centers: int = 200, ridge: float = 0.01, sigma: float | None = None, thetas: list[float] | None = None, standardize: bool = True) -> float:
    """The prior that minimises the penalised L1 distance over a grid (the smaller one at ties)."""
    rows = standardized(df, features) if standardize else df
    sample = first_rows(rows, features, 1000, order)
    width = sigma or 0.6 * median_distance(sample)
    means = rbf_means(rows, features, sample[:n_centers], width, y)
    grid = thetas or [i / 100 for i in range(1, 100)]
    best = penalized_objective(means, y, grid, ridge).agg(F.min(F.struct("objective", "theta")).alias("x")).first().x
    if best is None:
        raise ValueError("there must be labeled and unlabeled rows")
    return float(best.theta)


def simplex_distance(gram: np.ndarray, target: np.ndarray, own: float, steps: int = 2000, gap: float = 1e-9) -> tuple[float, np.ndarray]:
    """Squared RKHS distance of a point to the convex hull of points with a Gram matrix, by conditional gradients.

    target: inner products of the point with the points; own: with itself.
    """
    w = np.full(len(gram), 1 / len(gram))
    for _ in range(steps):
        slope = gram @ w - target
        i = int(slope.argmin())
        toward = -w
        toward[i] += 1
        if -(slope @ toward) < gap:
            break
        curve = toward @ gram @ toward
        w = w + min(1.0, -(slope @ toward) / max(curve, 1e-300)) * toward
    return float(max(w @ gram @ w - 2 * w @ target + own, 0.0)), w


def kernel_mean(df: DataFrame, y: str, features: list[str], order: str, sample: int = 300, threshold: float = 0.1, gradient: bool = True) -> float:
    """Prior by kernel mean embedding: the largest mixture of positives that leaves a distribution.

    For lambda from 1 to 8 the point lambda * mean_U + (1 - lambda) * mean_P is held
    against the hull of the sample; bisection finds where its distance (or, with gradient,
    the growth of that) passes the threshold, and the prior is (lambda - 1) / lambda of the
    rest.  ``sample`` rows of each label at most are used.
    """
    p, u = (first_rows(df.filter(F.col(y) == v), features, sample, order) for v in (1, 0))
    if not len(p) or not len(u):
        raise ValueError("there must be labeled and unlabeled rows")
    x = np.vstack([u, p])
    x = (x - x.mean(0)) / np.where(x.std(0) > 1e-12, x.std(0), 1)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    k = np.exp(-d / (2 * median_distance(x) ** 2))
    mu, mp = np.r_[np.full(len(u), 1 / len(u)), np.zeros(len(p))], np.r_[np.zeros(len(u)), np.full(len(p), 1 / len(p))]

    def distance(lam: float) -> float:
        point = lam * mu + (1 - lam) * mp
        return float(np.sqrt(simplex_distance(k, k @ point, float(point @ k @ point))[0]))

    step = 0.05
    test = (lambda lam: (distance(lam + step) - distance(lam)) / step) if gradient else distance
    limit = threshold * float(np.sqrt((mu - mp) @ k @ (mu - mp))) if gradient else threshold
    low, high = 1.0, 8.0
    for _ in range(20):
        mid = (low + high) / 2
        low, high = (low, mid) if test(mid) > limit else (mid, high)
    return (low - 1) / low


def row_ranks(df: DataFrame, columns: list[str], descending: bool = True) -> DataFrame:
    """columns and rank (from 1) of the rows in order of the columns, which must tell rows apart.

    Rows are dealt into ranges; the ranges' totals, a bounded table, give the rows before each.
    """
    way = F.desc if descending else F.asc
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select(*columns).repartitionByRange(parts, *[way(c) for c in columns]).withColumn("_part", F.spark_partition_id())
    totals = ranged.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = totals.select("_part", F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*[way(c) for c in columns]))
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_part").select(*columns, (F.col("_before") + F.col("_own")).alias("rank"))


def regrouped(df: DataFrame, y: str, score: str, id_col: str, fraction: float = 0.1, out: str = "y_regrouped") -> DataFrame:
    """df with the ceil(fraction * n_U) unlabeled rows of the largest score (ties: the larger id) moved to the positives."""
    unlabeled = df.filter(F.col(y) == 0)
    take = unlabeled.agg(F.ceil(F.count("*") * F.lit(fraction)).alias("_take"))  # one row
    top = row_ranks(unlabeled, [score, id_col]).crossJoin(F.broadcast(take)).filter("rank <= _take").select(id_col, F.lit(1).alias("_top"))
    return df.join(top, id_col, "left").withColumn(out, F.when((F.col(y) == 1) | (F.col("_top") == 1), 1).otherwise(0)).drop("_top")


def prior_quantile_predict(df: DataFrame, score: str, prior: float, out: str = "prediction") -> DataFrame:
    """df with 1 where the score is above the threshold: the score with floor(n (1 - prior)) scores before it in ascending order."""
    counts = df.filter(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("_n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = counts.repartitionByRange(parts, score).withColumn("_part", F.spark_partition_id())
    totals = ranged.groupBy("_part").agg(F.sum("_n").alias("_rows"))
    span = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_part", F.coalesce(F.sum("_rows").over(span), F.lit(0)).alias("_before"), F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    upto = F.sum("_n").over(Window.partitionBy("_part").orderBy(score).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = ranged.withColumn("_upto", upto).join(F.broadcast(before), "_part")
    place = F.least(F.floor(F.col("_all") * (1 - prior) + 1e-9), F.col("_all") - 1)
    threshold = seen.filter(F.col("_before") + F.col("_upto") > place).agg(F.min(score).alias("_threshold"))  # one row
    return df.crossJoin(F.broadcast(threshold)).withColumn(out, (F.col(score) > F.col("_threshold")).cast("int")).drop("_threshold")


def prior_from_positive_fraction(labeled: int, n: int, flipped: float) -> float:
    """The prior for which a share ``flipped`` of the positives is unlabeled: labeled / (n (1 - flipped))."""
    if n < 1 or not 0 <= flipped < 1:
        raise ValueError("n must be positive and the flipped share in [0, 1)")
    prior = labeled / (n * (1 - flipped))
    if not 0 < prior <= 1:
        raise ValueError("the flipped share contradicts the number of labeled rows")
    return prior


def centroid_denominator(prior: float, flipped: float, least: float = 1e-8) -> float:
    """1 - 2 prior flipped, if it isn't too near zero."""
    d = 1 - 2 * prior * flipped
    if abs(d) < least:
        raise ValueError("2 * prior * flipped is too near one")
    return d

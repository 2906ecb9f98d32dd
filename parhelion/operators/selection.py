"""Label mechanisms that depend on features, and generated tables.

The chance of a draw comes from an md5 of seed and id, so any engine draws the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The names of the mechanisms.
MECHANISMS = {"scar": "scar", "constant": "scar", "linear": "linear", "sar_linear": "linear", "nonlinear": "nonlinear", "sar_nonlinear": "nonlinear"}


def mechanism_name(name: str) -> str:
    """The mechanism, in any case and with - or blanks for _."""
    key = name.strip().lower().replace("-", "_").replace(" ", "_")
    if key not in MECHANISMS:
        raise ValueError(f"unknown mechanism {name!r}, known are {sorted(set(MECHANISMS.values()))}")
    return MECHANISMS[key]


def uniform(id_col: str, seed: int):
    """Column: a number in [0, 1) from the first 32 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col))), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def projection(df: DataFrame, y: str, features: list[str], weights: list[float] | None = None, out: str = "projection") -> DataFrame:
    """df with the weighted sum of the features, each standardized by the positives (population), the weights of length 1, centred on the positives."""
    w = weights or [1.0] * len(features)
    size = sum(x * x for x in w) ** 0.5
    if len(w) != len(features) or size == 0:
        raise ValueError("there must be a weight for each feature, not all zero")
    pos = df.filter(F.col(y) == 1).agg(*[F.struct(F.avg(f).alias("m"), F.stddev_pop(f).alias("s")).alias(f) for f in features]).first()
    total = F.lit(0.0)
    for f, x in zip(features, w):
        m, s = pos[f].m or 0.0, pos[f].s or 0.0
        total = total + (F.col(f).cast("double") - m) / (s if s > 1e-12 else 1.0) * (x / size)
    return df.withColumn(out, total)


def calibrated_intercept(values: DataFrame, column: str, target: float, low: float = -80.0, high: float = 80.0) -> float:
    """The b for which the mean of sigmoid(column + b) is target, 32 trial values a pass over the table."""
    if not 0 < target < 1:
        raise ValueError("target must be between 0 and 1")
    while high - low > 1e-12 * max(1.0, abs(low)):
        grid = [low + (high - low) * i / 33 for i in range(1, 33)]
        means = values.agg(*[F.avg(1 / (1 + F.exp(-(F.col(column) + b)))).alias(f"m{i}") for i, b in enumerate(grid)]).first()
        if means[0] is None:
            raise ValueError("there are no positives")
        under = [b for b, m in zip(grid, means) if m < target]
        over = [b for b, m in zip(grid, means) if m >= target]
        new = (max(under, default=low), min(over, default=high))
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def sar_propensity(df: DataFrame, y: str, features: list[str], mechanism: str = "linear", label_frequency: float = 0.3, strength: float = 1.0, weights: list[float] | None = None, out: str = "propensity") -> DataFrame:
    """df with the chance that a row is labeled: 0 for negatives, of mean label_frequency over the positives."""
    kind = mechanism_name(mechanism)
    if not 0 < label_frequency <= 1:
        raise ValueError("label_frequency must be in (0, 1]")
    positive = F.col(y) == 1
    if label_frequency == 1 or kind == "scar" or strength == 0:
        return df.withColumn(out, F.when(positive, F.lit(float(label_frequency))).otherwise(0.0))
    z = projection(df, y, features, weights, "_z")
    if kind == "nonlinear":
        square = z.filter(positive).agg(F.avg(F.col("_z") * F.col("_z"))).first()[0] or 0.0
        z = z.withColumn("_z", F.col("_z") + 0.5 * (F.col("_z") * F.col("_z") - square))
    z = z.withColumn("_z", strength * F.col("_z"))
    b = calibrated_intercept(z.filter(positive), "_z", label_frequency)
    return z.withColumn(out, F.when(positive, 1 / (1 + F.exp(-(F.col("_z") + b)))).otherwise(0.0)).drop("_z")


def bernoulli_labels(df: DataFrame, propensity: str, id_col: str, seed: int = 0, ensure: bool = True, out: str = "y_pu") -> DataFrame:
    """df with label 1 where the row's uniform number is below its propensity.

    With ``ensure`` and no such row, the row of the largest propensity (the smallest id
    of those) is labeled, if that is above 0.
    """
    hit = uniform(id_col, seed) < F.col(propensity)
    drawn = df.withColumn(out, hit.cast("int"))
    if not ensure or not drawn.filter(F.col(out) == 1).isEmpty():
        return drawn
    best = df.filter(F.col(propensity) > 0).agg(F.min(F.struct((-F.col(propensity)).alias("p"), F.col(id_col).alias("i"))).alias("x")).first().x
    return drawn if best is None else drawn.withColumn(out, (F.col(id_col) == F.lit(best.i)).cast("int"))


def gaussian_pu(spark: SparkSession, n_positive: int, n_unlabeled: int, n_features: int = 2, separation: float = 2.0, seed: int = 0) -> DataFrame:
    """id, x0.., y_true, y_pu: labeled positives around +separation / 2 and unlabeled negatives around -separation / 2."""
    rows = spark.range(n_positive + n_unlabeled).withColumn("y_true", (F.col("id") < n_positive).cast("int"))
    side = F.when(F.col("y_true") == 1, separation / 2).otherwise(-separation / 2)
    return rows.select("id", *[(F.randn(seed * 1000 + i) + side).alias(f"x{i}") for i in range(n_features)], "y_true", F.col("y_true").alias("y_pu"))


def scar_table(spark: SparkSession, n: int, label_frequency: float, n_features: int = 2, separation: float = 2.0, seed: int = 0) -> DataFrame:
    """n positives and n negatives; of the positives a fixed number, in order of md5, is labeled."""
    from parhelion.operators.sampling import scar_labels

    rows = gaussian_pu(spark, n, n, n_features, separation, seed).drop("y_pu")
    return rows.join(scar_labels(rows, label_frequency, "id", seed=seed), "id")


def sar_table(spark: SparkSession, n: int, label_frequency: float, mechanism: str = "linear", strength: float = 1.0, n_features: int = 2, separation: float = 2.0, seed: int = 0) -> DataFrame:
    """n positives and n negatives, labeled by ``sar_propensity`` and ``bernoulli_labels``."""
    rows = gaussian_pu(spark, n, n, n_features, separation, seed).drop("y_pu")
    return bernoulli_labels(sar_propensity(rows, "y_true", [f"x{i}" for i in range(n_features)], mechanism, label_frequency, strength), "propensity", "id", seed)

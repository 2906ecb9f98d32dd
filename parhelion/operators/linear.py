"""Linear learners from aggregates: the table is read in passes, the driver holds d x d numbers.

Every learner has fit(df) and then transform(df), which adds ``score`` and ``prediction``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parhelion.operators.priors import standardized


def moments(df: DataFrame, y: str, features: list[str]) -> dict:
    """For each label: (mean of x x', mean of x, count), x with a last component 1; one pass."""
    x = [F.col(f).cast("double") for f in features] + [F.lit(1.0)]
    d = len(x)
    cells = [F.avg(x[i] * x[j]).alias(f"m{i}_{j}") for i in range(d) for j in range(i, d)]
    out = {}
    for row in df.groupBy(y).agg(F.count("*").alias("n"), *cells).collect():
        second = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                second[i, j] = second[j, i] = row[f"m{i}_{j}"]
        out[row[y]] = (second, second[-1].copy(), row.n)
    return out


def linear_score(features: list[str], weights):
    out = F.lit(float(weights[-1]))
    for f, w in zip(features, weights):
        out = out + F.col(f).cast("double") * float(w)
    return out


@dataclass
class Linear:
    """score = w . x + b; prediction 1 at a score of ``threshold`` or more."""

    features: list[str]
    threshold: float = 0.0
    weights: np.ndarray | None = field(default=None, repr=False)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.weights is None:
            raise RuntimeError("fit comes first")
        return df.withColumn("score", linear_score(self.features, self.weights)).withColumn("prediction", (F.col("score") >= self.threshold).cast("int"))


@dataclass
class PNU(Linear):
    """Squared loss on positives, negatives and unlabeled rows, closed form; eta in [-1, 1] mixes PN with PU (above 0) or NU (below)."""

    class_prior: float = 0.5
    eta: float = 0.0
    ridge: float = 1e-3

    def fit(self, df: DataFrame, y: str = "y_pnu") -> "PNU":
        m = moments(df, y, self.features)
        if not {1, -1, 0} <= set(m):
            raise ValueError("positives, negatives and unlabeled rows must occur")
        (hp, p, _), (hn, n, _), (hu, u, _) = m[1], m[-1], m[0]
        pi, g = self.class_prior, abs(self.eta)
        p, n = pi * p, (1 - pi) * n
        h = (1 - g) * (pi * hp + (1 - pi) * hn) + g * hu
        target = (1 - g) * (p - n) + g * (2 * p - u if self.eta >= 0 else u - 2 * n)
        penalty = self.ridge * np.eye(len(target))
        penalty[-1, -1] = 0.0
        self.weights = np.linalg.solve(h + penalty, target)
        return self


@dataclass
class NonNegativePU(Linear):
    """Non-negative risk with the sigmoid loss by full-batch Adam: each step is one aggregate over the table.

    When the negative part falls below -beta, the step climbs it (times gamma) instead.
    """

    class_prior: float = 0.5
    beta: float = 0.0
    gamma: float = 1.0
    steps: int = 30
    rate: float = 0.1

    def fit(self, df: DataFrame, y: str = "y_pu") -> "NonNegativePU":
        rows = df.select(y, *[F.col(f).cast("double").alias(f) for f in self.features])
        d = len(self.features) + 1
        w, m, v = np.zeros(d), np.zeros(d), np.zeros(d)
        for t in range(1, self.steps + 1):
            s = 1 / (1 + F.exp(-linear_score(self.features, w)))
            slope = [F.avg(s * (1 - s) * x) for x in [*[F.col(f) for f in self.features], F.lit(1.0)]]
            got = {r[y]: r for r in rows.groupBy(y).agg(F.avg(s).alias("s"), F.array(*slope).alias("g")).collect()}
            if not {0, 1} <= set(got):
                raise ValueError("labeled and unlabeled rows must occur")
            gp, gu = np.array(got[1].g), np.array(got[0].g)
            negative = got[0].s - self.class_prior * got[1].s
            g = -self.gamma * (gu - self.class_prior * gp) if negative < -self.beta else gu - 2 * self.class_prior * gp
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weights = w
        return self


@dataclass
class LogisticUPU(Linear):
    """Unbiased risk with the logistic loss and a ridge, by Newton steps of one aggregate each."""

    class_prior: float = 0.5
    ridge: float = 1e-3
    steps: int = 20

    def fit(self, df: DataFrame, y: str = "y_pu") -> "LogisticUPU":
        rows = df.select(y, *[F.col(f).cast("double").alias(f) for f in self.features])
        x = [*[F.col(f) for f in self.features], F.lit(1.0)]
        d = len(x)
        p = np.array(rows.filter(F.col(y) == 1).agg(F.array(*[F.avg(c) for c in x])).first()[0], float)
        unlabeled = rows.filter(F.col(y) == 0)
        w = np.zeros(d)
        for _ in range(self.steps):
            s = 1 / (1 + F.exp(-linear_score(self.features, w)))
            row = unlabeled.agg(F.array(*[F.avg(s * c) for c in x]).alias("g"), F.array(*[F.avg(s * (1 - s) * x[i] * x[j]) for i in range(d) for j in range(d)]).alias("h")).first()
            g = np.array(row.g) - self.class_prior * p + self.ridge * w
            h = np.array(row.h).reshape(d, d) + self.ridge * np.eye(d)
            step = np.linalg.solve(h, g)
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
        self.weights = w
        return self


#: Names of the fit's own columns, so that none of the table's is met.
_OWN = {"featuresCol": "_x", "probabilityCol": "_prob", "rawPredictionCol": "_raw", "predictionCol": "_pred"}


def _scored(model, rows: DataFrame, out: str) -> DataFrame:
    """rows (with _x) and the chance of label 1 in the column out, without the fit's own columns."""
    return model.transform(rows).withColumn(out, vector_to_array("_prob")[1]).drop("_x", "_raw", "_prob", "_pred")


def _vector(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumn("_x", array_to_vector(F.array(*[F.col(f).cast("double") for f in features])))


@dataclass
class BiasedPU:
    """Logistic fit of labeled against unlabeled rows on standardized features, with a threshold of its own."""

    features: list[str]
    threshold: float = 0.5
    c: float = 1.0
    weight: str | None = None  # a column of row weights
    model: object = field(default=None, repr=False)
    scale: dict = field(default_factory=dict, repr=False)

    def fit(self, df: DataFrame, y: str = "y_pu") -> "BiasedPU":
        row = df.agg(F.count("*").alias("n"), *[F.struct(F.avg(f).alias("m"), F.stddev_pop(f).alias("s")).alias(f"s_{i}") for i, f in enumerate(self.features)]).first()
        self.scale = {f: (row[f"s_{i}"].m, row[f"s_{i}"].s if row[f"s_{i}"].s > 1e-12 else 1.0) for i, f in enumerate(self.features)}
        weighted = {"weightCol": self.weight} if self.weight else {}
        self.model = LogisticRegression(**_OWN, **weighted, labelCol=y, maxIter=200, tol=1e-9, regParam=1 / (self.c * row.n), standardization=False).fit(self._rows(df))
        return self

    def _rows(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_x", array_to_vector(F.array(*[(F.col(f).cast("double") - m) / s for f, (m, s) in self.scale.items()])))

    def transform(self, df: DataFrame) -> DataFrame:
        out = _scored(self.model, self._rows(df), "score")
        return out.withColumn("prediction", (F.col("score") >= self.threshold).cast("int"))


def posterior_given_unlabeled(p, c):
    """Column: the chance that an unlabeled row is positive, p its chance and c that of being labeled if so."""
    return p * (1 - c) / F.greatest(1 - p * c, F.lit(1e-12))


@dataclass
class LabelingBias:
    """Expectation-maximisation of a classifier and a labeling propensity, both logistic.

    Unlabeled rows start with the class prior (or twice the labeled share, within 0.05 and
    0.95).  The classifier is fit on every row twice, weighted by the chances of both classes;
    the propensity on all rows weighted by the chance of being positive.
    """

    features: list[str]
    rounds: int = 20
    threshold: float = 0.5
    class_prior: float | None = None
    model: object = field(default=None, repr=False)
    propensity: object = field(default=None, repr=False)

    def fit(self, df: DataFrame, y: str = "y_pu") -> "LabelingBias":
        rows = _vector(df, self.features).select("_x", F.col(y).cast("double").alias("_y"))
        fit = lambda data, label: LogisticRegression(**_OWN, labelCol=label, weightCol="_w", maxIter=100, regParam=1e-4).fit(data)
        labeled = rows.agg(F.avg("_y")).first()[0] or 0.0
        start = self.class_prior or min(0.95, max(0.05, 2 * labeled))
        q = F.when(F.col("_y") == 1, 1.0).otherwise(float(start))
        known = rows.withColumn("_q", q)
        for _ in range(self.rounds):
            both = known.select("_x", F.lit(1.0).alias("_t"), F.col("_q").alias("_w")).union(known.select("_x", F.lit(0.0), 1 - F.col("_q"))).filter("_w > 0")
            self.model = fit(both, "_t")
            self.propensity = fit(known.withColumn("_w", F.greatest("_q", F.lit(1e-9))), "_y")
            p = _scored(self.model, rows.withColumn("_v", F.col("_x")), "_p").withColumnRenamed("_v", "_x")
            c = _scored(self.propensity, p.withColumn("_v", F.col("_x")), "_c").withColumnRenamed("_v", "_x")
            # the models are numbers, so the plan of a round starts from the table again
            known = c.select("_x", "_y", F.when(F.col("_y") == 1, 1.0).otherwise(posterior_given_unlabeled(F.col("_p"), F.col("_c"))).alias("_q"))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = _scored(self.model, _vector(df, self.features), "score")
        return out.withColumn("prediction", (F.col("score") >= self.threshold).cast("int"))


def cross_validated(df: DataFrame, fold: str, folds: int, make, measure) -> DataFrame:
    """fold, metric, value: make() is fit on the other folds, and measure(scored) gives (metric, value) rows of each."""
    out = None
    for k in range(folds):
        scored = make().fit(df.filter(F.col(fold) != k)).transform(df.filter(F.col(fold) == k))
        part = measure(scored).select(F.lit(k).alias("fold"), "metric", "value")
        out = part if out is None else out.union(part)
    return out


__all__ = ["BiasedPU", "LabelingBias", "Linear", "LogisticUPU", "NonNegativePU", "PNU", "cross_validated", "linear_score", "moments", "posterior_given_unlabeled", "standardized"]

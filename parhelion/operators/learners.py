"""Learners with fit and transform, on pyspark.ml and closed forms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class ElkanNotoModel:
    """probability = P(labeled | x) / c, with c the mean of P(labeled | x) over held-out positives."""

    model: object
    c: float

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df.withColumn("_v", array_to_vector(F.col("features").cast("array<double>"))))
        p = vector_to_array("_p")[1] / self.c
        return out.withColumn("probability", p).withColumn("prediction", (p >= 0.5).cast("int")).drop("_v", "_r", "_p", "_y")


@dataclass
class ElkanNoto:
    """Logistic regression of the label, divided by the labeling propensity."""

    id_col: str
    hold_out: float = 0.2
    reg: float = 1e-3
    seed: int = 0

    def fit(self, df: DataFrame) -> ElkanNotoModel:
        from parhelion.operators.sampling import shuffle_split

        split = shuffle_split(df, 1, self.hold_out, self.id_col, seed=self.seed).select(self.id_col, "is_test")
        rows = df.join(split, self.id_col).withColumn("_v", array_to_vector(F.col("features").cast("array<double>")))
        lr = LogisticRegression(featuresCol="_v", labelCol="y_pu", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y", regParam=self.reg)
        model = lr.fit(rows.filter("is_test = 0"))
        c = model.transform(rows.filter("is_test = 1 and y_pu = 1")).agg(F.avg(vector_to_array("_p")[1])).first()[0]
        if not c:
            raise ValueError("no labeled positive was held out")
        return ElkanNotoModel(model, float(c))


def upu_squared(df: DataFrame, prior: float, x1: str, x2: str, reg: float = 0.01) -> DataFrame:
    """w1, w2 minimising the unbiased squared risk of w.x plus reg |w|^2 / 2: a 2 x 2 solve in one aggregate."""
    u = lambda e: F.avg(F.when(F.col("y_pu") == 0, e))
    p = lambda e: F.avg(F.when(F.col("y_pu") == 1, e))
    a, b = F.col(x1), F.col(x2)
    m = df.agg((u(a * a) / 2 + reg).alias("m11"), (u(a * b) / 2).alias("m12"), (u(b * b) / 2 + reg).alias("m22"), (prior * p(a) - u(a) / 2).alias("r1"), (prior * p(b) - u(b) / 2).alias("r2"))
    det = F.col("m11") * F.col("m22") - F.col("m12") * F.col("m12")
    return m.select(F.round(F.try_divide(F.col("m22") * F.col("r1") - F.col("m12") * F.col("r2"), det), 6).alias("w1"), F.round(F.try_divide(F.col("m11") * F.col("r2") - F.col("m12") * F.col("r1"), det), 6).alias("w2"))

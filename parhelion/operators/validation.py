"""Checks of labels, features and weights, each one aggregate over the table.

``*_report`` functions give one row of counts and findings; ``require_*`` functions
raise ValueError for what a report finds wrong and return the table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unlabeled (or all) rows for each labeled one above which a report warns.
IMBALANCE = 1000.0
PU_SETS = ((0, 1), (-1, 1))


def _found(y: str, values) -> list:
    return [F.coalesce(F.bool_or(F.col(y) == v), F.lit(False)).alias(f"has_{i}") for i, v in enumerate(values)]


def label_sets(df: DataFrame, y: str, allowed=PU_SETS) -> DataFrame:
    """One row: n, n_null, n_strange (in no set), and fits: whether one allowed set holds all labels."""
    every = sorted({v for s in allowed for v in s})
    inside = [F.coalesce(F.bool_and(F.coalesce(F.col(y).isin(*s), F.lit(False))), F.lit(True)) for s in allowed]
    fits = inside[0]
    for one in inside[1:]:
        fits = fits | one
    strange = F.count_if(F.col(y).isNotNull() & ~F.col(y).isin(*every))
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(y).isNull()).alias("n_null"), strange.alias("n_strange"), fits.alias("fits"))


def require_labels(df: DataFrame, y: str, allowed=PU_SETS, require_all: bool = False) -> DataFrame:
    """df, if one allowed set holds all labels and, with require_all, all of that set occur."""
    every = sorted({v for s in allowed for v in s})
    row = df.agg(F.count("*").alias("n"), F.count_if(F.col(y).isNull() | ~F.col(y).isin(*every)).alias("bad"), *_found(y, every)).first()
    seen = {v for i, v in enumerate(every) if row[f"has_{i}"]}
    fits = [s for s in allowed if seen <= set(s)]
    if not row.n or row.bad or not fits:
        raise ValueError(f"labels {y} must be of one of {[tuple(s) for s in allowed]}")
    if require_all and not any(seen == set(s) for s in fits):
        raise ValueError(f"labels {y} must hold every value of one of {[tuple(s) for s in allowed]}")
    return df


def normalize_pu(df: DataFrame, y: str, out: str = "y_pu") -> DataFrame:
    """The labels of {0, 1} or {-1, 1} as 1 and 0; other sets, and a mix of both, raise."""
    return require_labels(df, y).withColumn(out, (F.col(y) == 1).cast("int"))


def normalize_pnu(df: DataFrame, y: str, out: str = "y_pnu") -> DataFrame:
    """The labels 1, -1 and 0 as int; all three must occur."""
    return require_labels(df, y, ((-1, 0, 1),), require_all=True).withColumn(out, F.col(y).cast("int"))


def _ratio(a, b):
    return F.when(b == 0, F.lit(math.inf)).otherwise(a / b)


def _bad_features(features: list[str]) -> list:
    """Counts of missing and of infinite numbers over the feature columns (numbers or arrays of them)."""
    missing, infinite = F.lit(0).cast("long"), F.lit(0).cast("long")
    for f in features:
        x = F.col(f).cast("double")
        missing = missing + F.count_if(x.isNull() | F.isnan(x))
        infinite = infinite + F.count_if(F.abs(x) == F.lit(math.inf))
    return [missing.alias("n_missing"), infinite.alias("n_infinite")]


def pu_report(df: DataFrame, y: str, features: list[str], least: int = 2) -> DataFrame:
    """One row: counts, ratio, and the first finding that makes the table unusable ('' if none); warning is large_imbalance or ''."""
    c = df.agg(F.count("*").alias("n"), F.count_if(F.col(y) == 1).alias("n_positive"), F.count_if(F.col(y) == 0).alias("n_unlabeled"), *_bad_features(features))
    ratio = _ratio(F.col("n_unlabeled"), F.col("n_positive"))
    error = F.when(F.col("n") == 0, "empty").when(F.col("n_positive") + F.col("n_unlabeled") < F.col("n"), "invalid_labels").when(F.col("n_missing") + F.col("n_infinite") > 0, "non_finite_features").when(F.col("n_positive") < least, "too_few_positives").otherwise("")
    return c.select("*", F.round(ratio, 9).alias("ratio"), error.alias("error"), F.when(ratio > IMBALANCE, "large_imbalance").otherwise("").alias("warning"))


def pnu_report(df: DataFrame, y: str, features: list[str]) -> DataFrame:
    """As ``pu_report`` for labels 1, -1 and 0; every group must have a row."""
    groups = [F.count_if(F.col(y) == v).alias(n) for v, n in ((1, "n_positive"), (-1, "n_negative"), (0, "n_unlabeled"))]
    c = df.agg(F.count("*").alias("n"), *groups, *_bad_features(features))
    ratio = _ratio(F.col("n_unlabeled"), F.least("n_positive", "n_negative"))
    known = F.col("n_positive") + F.col("n_negative") + F.col("n_unlabeled")
    error = F.when(F.col("n") == 0, "empty").when(known < F.col("n"), "invalid_labels").when(F.col("n_missing") + F.col("n_infinite") > 0, "non_finite_features").when(F.least("n_positive", "n_negative", "n_unlabeled") == 0, "missing_group").otherwise("")
    return c.select("*", F.round(ratio, 9).alias("ratio"), error.alias("error"), F.when(ratio > IMBALANCE, "large_imbalance").otherwise("").alias("warning"))


def require_valid(report: DataFrame) -> dict:
    """The report's row, if it has no error."""
    row = report.first().asDict()
    if row["error"]:
        raise ValueError(f"invalid table: {row['error']}")
    return row


def true_label_report(df: DataFrame, y_true: str, y_pu: str | None = None) -> DataFrame:
    """One row: n, n_invalid (true labels other than 0 and 1), n_contradicting (labeled positive, truly not)."""
    t = F.col(y_true)
    against = F.count_if((F.col(y_pu) == 1) & ~F.coalesce(t == 1, F.lit(False))) if y_pu else F.lit(0).cast("long")
    return df.agg(F.count("*").alias("n"), F.count_if(t.isNull() | ~t.isin(0, 1)).alias("n_invalid"), against.alias("n_contradicting"))


def require_true_labels(df: DataFrame, y_true: str, y_pu: str | None = None) -> DataFrame:
    row = true_label_report(df, y_true, y_pu).first()
    if not row.n or row.n_invalid:
        raise ValueError("true labels must be 0 or 1")
    if row.n_contradicting:
        raise ValueError("a labeled positive must be a true positive")
    return df


def weight_report(df: DataFrame, weight: str) -> DataFrame:
    """One row: n, n_invalid (null, not finite or negative), min, max, mean, ess; usable: valid and not all 0."""
    w = F.col(weight).cast("double")
    bad = w.isNull() | F.isnan(w) | (F.abs(w) == F.lit(math.inf)) | (w < 0)
    good = F.when(~bad, w)
    total = F.sum(good)
    usable = (F.count_if(bad) == 0) & (F.coalesce(total, F.lit(0.0)) > 0)
    return df.agg(F.count("*").alias("n"), F.count_if(bad).alias("n_invalid"), F.round(F.min(good), 9).alias("min_weight"), F.round(F.max(good), 9).alias("max_weight"), F.round(F.avg(good), 9).alias("mean_weight"), F.round(total * total / F.nullif(F.sum(good * good), F.lit(0.0)), 6).alias("ess"), usable.alias("usable"))


def require_weights(df: DataFrame, weight: str) -> DataFrame:
    if not weight_report(df, weight).first().usable:
        raise ValueError("weights must be finite, not negative and not all zero")
    return df


def check_range(name: str, value: float, low: float, high: float, inclusive: bool = True) -> float:
    """value, if it is a number between low and high."""
    inside = low <= value <= high if inclusive else low < value < high
    if isinstance(value, bool) or not inside:
        marks = "[]" if inclusive else "()"
        raise ValueError(f"{name} must be in {marks[0]}{low}, {high}{marks[1]}, got {value!r}")
    return value

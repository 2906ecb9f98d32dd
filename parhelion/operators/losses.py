"""Risk functionals as one aggregate over labels and scores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parhelion.functions.scalar import sigmoid, softplus


def _mean(value, label: str, of: int):
    return F.avg(F.when(F.col(label) == of, value))


def upu_risk(df: DataFrame, prior: float, kind: str = "logistic", label: str = "y_pu", score: str = "g") -> DataFrame:
    g = F.col(score)
    unlabeled = softplus(g) if kind == "logistic" else F.pow(g + 1, 2) / 4
    return df.agg(F.round(-prior * _mean(g, label, 1) + _mean(unlabeled, label, 0), 6).alias("risk"))


def nnpu_risk(df: DataFrame, prior: float, label: str = "y_pu", score: str = "g") -> DataFrame:
    """positive_risk, negative_part, upu, nnpu with the sigmoid loss."""
    g = F.col(score)
    parts = df.agg(_mean(sigmoid(-g), label, 1).alias("a"), _mean(sigmoid(g), label, 1).alias("b"), _mean(sigmoid(g), label, 0).alias("c"))
    r = F.col("c") - prior * F.col("b")
    return parts.select(F.round("a", 6).alias("positive_risk"), F.round(r, 6).alias("negative_part"), F.round(prior * F.col("a") + r, 6).alias("upu"), F.round(prior * F.col("a") + F.greatest(F.lit(0.0), r), 6).alias("nnpu"))


def pnu_risks(df: DataFrame, prior: float, eta: float, label: str = "y_pnu", score: str = "g") -> DataFrame:
    """pn, pu, nu and their mix: eta >= 0 mixes in the unlabeled with positives, else with negatives."""
    g = F.col(score)
    m = df.agg(_mean(g, label, 1).alias("p"), _mean(g, label, -1).alias("n"), _mean(g, label, 0).alias("u"))
    pn = -prior * F.col("p") + (1 - prior) * F.col("n")
    pu = -prior * F.col("p") + F.col("u")
    nu = (1 - prior) * F.col("n") - F.col("u")
    mix = (1 - abs(eta)) * pn + abs(eta) * (pu if eta >= 0 else nu)
    return m.select(F.round(pn, 6).alias("pn"), F.round(pu, 6).alias("pu"), F.round(nu, 6).alias("nu"), F.round(mix, 6).alias("mix"))


def llsvm_parts(df: DataFrame, alpha: float = 1.0, beta: float = 1.0, label: str = "y_pu", score: str = "g") -> DataFrame:
    s = F.col(score)
    hinge = F.when(F.col(label) == 1, F.pow(F.greatest(1 - s, F.lit(0.0)), 2))
    hat = F.when(F.col(label) == 0, F.exp(-5 * s * s))
    return df.agg(F.round(alpha * F.sum(hinge), 4).alias("hinge"), F.round(beta * F.sum(hat), 4).alias("hat"))


def smi_objective(df: DataFrame, label: str = "y_pu", score: str = "g") -> DataFrame:
    r = F.col(score)
    return df.agg(F.round(_mean(r * r, label, 0) / 2 - _mean(r, label, 1), 6).alias("pu_smi"))


def risk_components(df: DataFrame, prior: float, label: str = "y_pnu", score: str = "g") -> DataFrame:
    """component, value: the PN, PU and NU parts of the linear PNU risk; null where a needed class is absent."""
    m = pnu_risks(df, prior, 0.0, label, score)
    return m.unpivot([], ["pn", "pu", "nu"], "component", "value")


def label_calibration(df: DataFrame, prior: float, gamma: float = 10.0, squash: float = 10.0, label: str = "y_pu", score: str = "g") -> DataFrame:
    """Squared excess of squashed unlabeled scores over 2 * prior - 1; zero without unlabeled rows."""
    over = F.greatest(squash / math.pi * F.atan(F.col(score)) - (2 * prior - 1), F.lit(0.0))
    return df.agg(F.round(F.coalesce(gamma * _mean(over * over, label, 0), F.lit(0.0)), 6).alias("calibration"))

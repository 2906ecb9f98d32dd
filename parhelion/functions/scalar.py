"""Scalar expressions shared by the operators; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(z: Column) -> Column:
    """1 / (1 + e^-z) without overflow; null of null."""
    return F.when(z.isNotNull(), 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0)))))


def softplus(z: Column) -> Column:
    """ln(1 + e^z) without overflow."""
    return F.greatest(z, F.lit(0.0)) + F.ln(1 + F.exp(-F.abs(z)))


def canonical_label(y: Column) -> Column:
    """-1 and 0 are unlabeled (0), 1 is a labeled positive; other values give null."""
    return F.when(y == 1, 1).when(y.isin(-1, 0), 0).cast("int")


def order_key(seed: int, row: Column) -> Column:
    """A reproducible random order that any engine with md5 can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), row.cast("string")).cast("binary"))


def relative_weight(ratio: Column, alpha: float) -> Column:
    return ratio / (alpha * ratio + (1 - alpha))


def safe_ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if empty is None else F.coalesce(out, F.lit(float(empty)))

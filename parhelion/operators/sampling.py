"""Label mechanisms, folds and samples in md5 order: the same rows in any engine.

Quotas are taken by rank within a stratum.  The first three digits of the md5 deal a
stratum into 4,096 ordered parts; a row's rank is its place in the part plus the rows of
the parts before, so no task holds a stratum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parhelion.functions.scalar import order_key


def _ranked(df: DataFrame, id_col: str, strata: list[str], key) -> DataFrame:
    """df with _r (rank from 1 in its stratum) and _n (rows of the stratum); the counts of the parts are a bounded broadcast."""
    rows = df.withColumn("_key", key).withColumn("_part", F.substring("_key", 1, 3))
    own, whole = Window.partitionBy(*strata).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*strata)
    counts = rows.groupBy(*strata, "_part").agg(F.count("*").alias("_c"))
    counts = counts.select(*strata, "_part", F.coalesce(F.sum("_c").over(own), F.lit(0)).alias("_before"), F.sum("_c").over(whole).alias("_n"))
    place = F.row_number().over(Window.partitionBy(*strata, "_part").orderBy("_key", id_col))
    return rows.withColumn("_own", place).join(F.broadcast(counts), [*strata, "_part"]).withColumn("_r", F.col("_before") + F.col("_own")).drop("_key", "_part", "_before", "_own")


def require_quota(df: DataFrame, label: str, value: int, n: int) -> None:
    """Raise if fewer than n rows have the label value."""
    have = df.filter(F.col(label) == value).count()
    if have < n:
        raise ValueError(f"{n} rows with {label} = {value} are asked for, there are {have}")


def scar_labels(df: DataFrame, c: float, id_col: str, label: str = "y_true", seed: int = 0) -> DataFrame:
    """id, y_pu: max(1, round(c * positives)) of the positives are labeled, half to even."""
    take = F.least(F.greatest(F.lit(1), F.bround(F.col("_n") * c, 0)), F.col("_n"))
    return _ranked(df, id_col, [label], order_key(seed, F.col(id_col))).select(id_col, F.when((F.col(label) == 1) & (F.col("_r") <= take), 1).otherwise(0).alias("y_pu"))


def case_control_labels(df: DataFrame, n: int, id_col: str, label: str = "y_true", seed: int = 0) -> DataFrame:
    require_quota(df, label, 1, n)
    return _ranked(df, id_col, [label], order_key(seed, F.col(id_col))).select(id_col, F.when((F.col(label) == 1) & (F.col("_r") <= n), 1).otherwise(0).alias("y_pu"))


def pnu_labels(df: DataFrame, n_negatives: int, id_col: str, label: str = "y_true", seed: int = 0) -> DataFrame:
    require_quota(df, label, 0, n_negatives)
    return _ranked(df, id_col, [label], order_key(seed, F.col(id_col))).select(id_col, F.when(F.col(label) == 1, 1).when(F.col("_r") <= n_negatives, -1).otherwise(0).alias("y_pnu"))


def kfold(df: DataFrame, k: int, id_col: str, label: str = "y_pu", seed: int = 0) -> DataFrame:
    """id, fold (0 to k - 1), stratified by label."""
    if k < 2:
        raise ValueError("k must be 2 at least")
    require_quota(df, label, 1, k)
    return _ranked(df, id_col, [label], order_key(seed, F.col(id_col))).select(id_col, ((F.col("_r") - 1) % k).cast("int").alias("fold"))


def shuffle_split(df: DataFrame, n_splits: int, test_size: float, id_col: str, label: str = "y_pu", seed: int = 0) -> DataFrame:
    """split, id, is_test; at least one labeled positive is in each test part."""
    rows = df.select(id_col, label, F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("split"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("split").cast("string"), F.lit(":"), F.col(id_col).cast("string")).cast("binary"))
    rows = _ranked(rows, id_col, ["split", label], key)
    quota = F.bround(F.col("_n") * test_size, 0)
    quota = F.when(F.col(label) == 1, F.greatest(F.lit(1), quota)).otherwise(quota)
    return rows.select("split", id_col, (F.col("_r") <= quota).cast("int").alias("is_test"))


def first_by_order(df: DataFrame, n: int, id_col: str, seed: int = 0) -> DataFrame:
    """n rows without replacement: a top-n by md5, no full sort."""
    return df.orderBy(order_key(seed, F.col(id_col)), id_col).limit(n).select(id_col)

"""Readers of feature tables, labels, weights and profiles; every check is one aggregate over the file."""

from __future__ import annotations

import io
import math
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _number(text) -> bool:
    try:
        float(text)
    except (TypeError, ValueError):
        return False
    return True


def numbered(df: DataFrame) -> DataFrame:
    """df, read from files and not yet shuffled, with ``row_id``: the place of the row in its files, from 0.

    Rows are counted inside each block of a file, so a task sees one block at most; the
    totals of the blocks before, one row a block, are added.
    """
    block = ["_path", "_block"]
    rows = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    totals = rows.groupBy(*block).agg(F.count("*").alias("_n"))
    before = totals.select(*block, F.coalesce(F.sum("_n").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*block).orderBy("_at")) - 1
    return rows.withColumn("_in", inside).join(before, block).select(*df.columns, (F.col("_before") + F.col("_in")).cast("long").alias("row_id"))


def read_table(spark: SparkSession, path: str, what: str = "data") -> DataFrame:
    """A CSV file with a header, or a Parquet table, with row_id.

    A CSV file whose first row holds numbers only is refused: it would lose a row to the header.
    """
    if path.rstrip("/").endswith(".parquet"):
        return numbered(spark.read.parquet(path))
    first = spark.read.csv(path).limit(1).collect()
    if not first:
        raise ValueError(f"{what}: {path} is empty")
    if all(_number(v) for v in first[0]):
        raise ValueError(f"{what}: {path} has no header; its first row is numeric")
    return numbered(spark.read.csv(path, header=True))


def require_finite(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    """df, or ValueError if one of the columns holds a null, NaN or an infinity."""
    bad = F.lit(False)
    for c in columns:
        x = F.col(f"`{c}`")
        bad = bad | x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)
    n = df.agg(F.count_if(bad)).first()[0]
    if n:
        raise ValueError(f"{what}: {n} rows hold values that are missing, no numbers or not finite")
    return df


def load_features(spark: SparkSession, path: str, what: str = "data") -> DataFrame:
    """row_id and the features as finite doubles; images of a .npy file (see ``load_images``) as one array."""
    if path.endswith(".npy"):
        return load_images(spark, path)
    raw = read_table(spark, path, what)
    names = [c for c in raw.columns if c != "row_id"]
    return require_finite(raw.select("row_id", *[F.col(f"`{c}`").try_cast("double").alias(c) for c in names]), names, what)


def load_images(spark: SparkSession, path: str) -> DataFrame:
    """row_id, shape and features (array of floats) of the images in a .npy file of four dimensions."""

    def unpack(batches):
        import numpy as np
        import pandas as pd

        for files in batches:
            for content in files["content"]:
                images = np.load(io.BytesIO(content), allow_pickle=False)
                if not isinstance(images, np.ndarray) or images.ndim != 4:
                    raise ValueError("images must be one array of four dimensions")
                for at in range(0, len(images), 256):
                    part = images[at : at + 256].astype(np.float32)
                    if not np.isfinite(part).all():
                        raise ValueError("images hold values that are not finite")
                    yield pd.DataFrame({"row_id": range(at, at + len(part)), "shape": [list(images.shape[1:])] * len(part), "features": list(part.reshape(len(part), -1))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "row_id long, shape array<long>, features array<float>")


def load_column(spark: SparkSession, path: str, what: str) -> DataFrame:
    """row_id and value of a table with a single column."""
    raw = read_table(spark, path, what)
    names = [c for c in raw.columns if c != "row_id"]
    if len(names) != 1:
        raise ValueError(f"{what}: {path} must have one column and has {len(names)}")
    return require_finite(raw.select("row_id", F.col(f"`{names[0]}`").try_cast("double").alias("value")), ["value"], what)


def load_binary_labels(spark: SparkSession, path: str, what: str = "labels") -> DataFrame:
    """row_id and value (0 or 1)."""
    out = load_column(spark, path, what)
    if strange := out.agg(F.count_if(~F.col("value").isin(0.0, 1.0))).first()[0]:
        raise ValueError(f"{what}: {strange} labels are neither 0 nor 1")
    return out.withColumn("value", F.col("value").cast("int"))


def load_weights(spark: SparkSession, path: str) -> DataFrame:
    """row_id and value of importance weights: none negative, not all zero."""
    out = load_column(spark, path, "weights")
    low, high = out.agg(F.min("value"), F.max("value")).first()
    if low is None or low < 0 or high <= 0:
        raise ValueError("weights must not be negative and not all zero")
    return out


def zipped(features: DataFrame, **columns: DataFrame) -> DataFrame:
    """features with a column of each given (row_id, value) table, joined by place; all must have as many rows."""
    n = features.count()
    out = features
    for name, other in columns.items():
        if (m := other.count()) != n:
            raise ValueError(f"{name} has {m} rows and the features have {n}")
        out = out.join(other.select("row_id", F.col("value").alias(name)), "row_id")
    return out


def load_profile(spark: SparkSession, path: str) -> dict:
    """A profile from its JSON document."""
    row = spark.read.json(path, multiLine=True).first()
    if row is None or "n_samples" not in row.asDict():
        raise ValueError(f"{path} is no profile")
    return row.asDict(recursive=True)


def load_libsvm(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """label and features (vector) of a libsvm file, whose bytes must have the given hash."""
    if sha256 is not None:
        found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
        if found != sha256.lower():
            raise ValueError(f"{PurePosixPath(path).name} has the hash {found}")
    return spark.read.format("libsvm").load(path)


def max_scaled(df: DataFrame, features: list[str]) -> DataFrame:
    """df with every feature divided by its largest value; a largest value of zero leaves it."""
    top = df.agg(*[F.max(f).alias(f"_{f}") for f in features])  # one row
    scaled = {f: F.col(f) / F.when(F.col(f"_{f}") == 0, 1.0).otherwise(F.col(f"_{f}")) for f in features}
    return df.crossJoin(F.broadcast(top)).withColumns(scaled).drop(*[f"_{f}" for f in features])


def positive_class(dataset: str, label):
    """Column: 1 for the positive class of a data set's own labels (mushrooms: 2; usps: odd; others: 1)."""
    if dataset == "mushrooms":
        return (label == 2).cast("int")
    return (label % 2 == 1).cast("int") if dataset == "usps" else (label == 1).cast("int")


def require_counts(df: DataFrame, label: str, rows: int, positives: int) -> DataFrame:
    """df, or ValueError if it has not so many rows and positives."""
    found = df.agg(F.count("*"), F.count_if(F.col(label) == 1)).first()
    if tuple(found) != (rows, positives):
        raise ValueError(f"expected {rows} rows with {positives} positives, found {found[0]} with {found[1]}")
    return df


def term_weights(train: DataFrame, test: DataFrame, id_col: str, text: str, max_features: int = 2000) -> DataFrame:
    """id, term, weight: term counts times smoothed inverse document frequencies of train, each row of length 1.

    The terms are the ``max_features`` most frequent words of two or more letters or digits in
    train, ties by name; this list is the broadcast side, its size being the parameter.
    """
    words = lambda d: d.select(id_col, F.explode(F.expr(rf"regexp_extract_all(lower(`{text}`), '([\\p{{L}}\\p{{N}}_]{{2,}})', 1)")).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))
    n = train.count()
    seen = words(train).groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    kept = seen.orderBy(F.desc("total"), "term").limit(max_features).select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = words(test).join(F.broadcast(kept), "term").withColumn("w", F.col("tf") * F.col("idf"))
    length = raw.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_length"))
    return raw.join(length, id_col).select(id_col, "term", (F.col("w") / F.col("_length")).alias("weight"))

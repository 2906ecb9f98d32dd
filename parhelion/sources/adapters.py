"""The driver's tables in the roles that the operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parhelion.functions.scalar import order_key, sigmoid
from parhelion.session import table


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Line items: truth is a return, half of the returns are labeled, the score is the quantity."""
    t = table(spark, d, "lineitem")
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    true = F.col("l_returnflag") == "R"
    return t.select(true.cast("int").alias("y_true"), (true & (F.substring(order_key(7, key), 1, 1) < "8")).cast("int").alias("y_pu"), (F.col("l_quantity") - 25).alias("score"), (F.col("l_quantity") > 25).cast("int").alias("pred"), ((F.col("l_quantity") - 25) / 10).alias("g"), sigmoid((F.col("l_quantity") - 25) / 10).alias("probability"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings: labels below 3 are positive."""
    t = table(spark, d, "embeddings")
    true = F.col("label") < 3
    x = F.col("embedding")
    return t.select("vec_id", F.col("embedding").alias("features"), true.cast("int").alias("y_true"), (true & (F.substring(order_key(7, F.col("vec_id")), 1, 1) < "8")).cast("int").alias("y_pu"), sigmoid(x[0].cast("double") * 4).alias("probability"))


def text_labels(spark: SparkSession, d: str) -> DataFrame:
    """Documents: toxic ones are positive, those of quality 1 negative, those without a label unlabeled."""
    docs, labels = table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels")
    y = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, -1).otherwise(0)
    return docs.join(labels, "doc_id", "left").select("doc_id", F.coalesce(y, F.lit(0)).alias("y_pnu"), (F.ln(F.col("n_chars") + 1.0) - 7).alias("g"))


def domains(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders")
    return t.select(F.when(F.col("o_orderdate") < "1998-01-01", "source").otherwise("target").alias("domain"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y_pu"))


def windows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("window_id"), (F.col("event_type") == "purchase").cast("int").alias("y_pu"), F.col("ts").cast("timestamp").alias("ts"))


def trials(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("method"), F.col("p_size").alias("seed"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))

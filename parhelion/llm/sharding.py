"""Sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parhelion.llm.shared import Scratch, number_rows

_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # fixed values of the 64-bit finaliser


def _scramble(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64((key * 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
        return x ^ (x >> np.uint64(31))


def permute(numbers: np.ndarray, n: int, seed: int = 0, rounds: int = 6) -> np.ndarray:
    """Map each of 0..n-1 to a distinct one of 0..n-1.

    A Feistel network on pairs (left < a, right < b) with a * b >= n, a and b close to
    the square root of n; outputs of n or more are fed in again (cycle walking) until
    they fall below n, which ends because the network is a bijection.
    """
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))
    left_size, right_size = np.uint64(a), np.uint64(b)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] // right_size, out[todo] % right_size
        for r in range(rounds):
            if r % 2:
                right = (right + _scramble(left, seed * 64 + r) % right_size) % right_size
            else:
                left = (left + _scramble(right, seed * 64 + r) % left_size) % left_size
        out[todo] = left * right_size + right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def place(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of one global row number, without touching any data."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, size, text_crc32, row, shard, slot for every row.

    Rows are numbered in the order of doc_id (nulls first), size and crc; the number
    is permuted to p; shard = p mod shards and slot = p div shards, so shard sizes
    differ by one row at most and slots have no gaps.  A null text has size 1 and crc
    0; repeated rows get places of their own; an empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    numbered = number_rows(narrow, ["doc_id", "size", "text_crc32"], scratch)
    n = scratch.save(numbered)
    total = n.count()

    @F.pandas_udf("long")
    def permuted(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), total, seed))

    return n.withColumn("_p", permuted("row")).select("doc_id", "size", "text_crc32", "row", (F.col("_p") % shards).cast("int").alias("shard"), F.expr(f"_p div {shards}").alias("slot"))

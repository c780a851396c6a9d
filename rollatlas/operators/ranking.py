"""First, last and top-k rows per key.

Each is a ``row_number() <= k`` filter: Spark then keeps at most k rows per key
in every input task before the shuffle, so a key holding a large share of the
rows costs no more network than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "_rank_in_key"


def top_k(df: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(_RANK, F.row_number().over(window))
    return ranked.filter(F.col(_RANK) <= k).drop(_RANK)


def first_rows(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """First ``n`` rows in the given order, for inspection."""
    return df.orderBy(*order).limit(n)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    return top_k(df, keys, order, 1)


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return top_k(df, keys, [F.col(c).desc() for c in order], 1)

"""Array columns to rows.

A plain explode makes the optimizer add a filter on the array's size in front of
it, which evaluates a costly array expression twice more. The outer form does not;
its extra null row for an empty array is dropped afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_costly(df: DataFrame, keep: list[Column | str], array: Column | str, name: str) -> DataFrame:
    """One row per element; elements must not be null."""
    rows = df.select(*keep, F.explode_outer(array).alias(name))
    return rows.filter(F.col(name).isNotNull())


def posexplode_costly(
    df: DataFrame, keep: list[Column | str], array: Column | str, pos: str, name: str
) -> DataFrame:
    """One row per element with its position; elements must not be null."""
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, name))
    return rows.filter(F.col(name).isNotNull())

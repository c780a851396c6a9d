"""Name an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once.

    Column expressions are trees: using a value n times repeats its whole tree n
    times, and within lambdas nothing removes the copies.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))

"""Number reading and exact sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollatlas.functions.text import BLANK_CLASS, col

_NUMBER = rf"^{BLANK_CLASS}*([+-]?(?:Infinity|[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?))"

# Degrees are summed as whole 1e-7 degrees, so an average does not depend on the
# order in which partial sums arrive from the tasks.
SCALE = 10_000_000


def parse_float(text: Column | str) -> Column:
    """Leading number of a text, trailing text ignored; null when there is none."""
    return F.regexp_extract(col(text).cast("string"), _NUMBER, 1).try_cast("double")


def fixed_point(value: Column | str) -> Column:
    return F.round(col(value) * SCALE).cast("bigint")


def avg_of_sums(whole: Column, count: Column) -> Column:
    """Average of degrees from their sum in whole 1e-7 degrees and their number."""
    return whole.cast("double") / count / F.lit(float(SCALE))

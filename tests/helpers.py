"""Small fixtures in the shape of the clean and raw tables."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollatlas.schema import DISTRICT_COLUMNS, GAZETTEER_SCHEMA, RAW_COLUMNS, SCHOOL_COLUMNS


def evaluate(spark: SparkSession, rows: list[tuple], schema: str, **columns) -> list:
    """Evaluate columns over rows, in row order."""
    ddl = "i int, " + schema
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ddl)
    out = df.select("i", *[c.alias(n) for n, c in columns.items()]).orderBy("i").collect()
    if len(columns) == 1:
        return [r[1] for r in out]
    return [tuple(r)[1:] for r in out]


def _frame(spark, records: list[dict], columns: list[str], blank, extra: str = "") -> DataFrame:
    fields = ["ord bigint", *[f"{c} string" for c in columns]]
    extras = [e.strip().split(" ") for e in extra.split(",") if e.strip()]
    fields += [f"{n} {t}" for n, t in extras]
    rows = [
        (r.get("ord", i), *[r.get(c, blank) for c in columns], *[r.get(n) for n, _ in extras])
        for i, r in enumerate(records)
    ]
    return spark.createDataFrame(rows, ", ".join(fields))


def raw_records(spark, records: list[dict]) -> DataFrame:
    return _frame(spark, records, RAW_COLUMNS, "")


def district_table(spark, records: list[dict]) -> DataFrame:
    return _frame(spark, records, [*DISTRICT_COLUMNS, "slug"], "", "lat double, lon double")


def school_table(spark, records: list[dict]) -> DataFrame:
    return _frame(spark, records, [*SCHOOL_COLUMNS, "district_cds"], "", "lat double, lon double")


def gazetteer_table(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, GAZETTEER_SCHEMA)


def candidate(query, rank, lat="36.1", lon="-119.2", shown="", name="", kind="", sort=""):
    return (query, rank, lat, lon, shown, name, kind, sort)


def plan_of(df: DataFrame) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


__all__ = ["F", "candidate", "district_table", "evaluate", "gazetteer_table", "plan_of", "raw_records", "school_table"]

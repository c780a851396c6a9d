"""Directory export (CSV) to raw records.

Every record carries ``ord``, its place in the source: (file, block, row). It is
set once, straight from the scan, and costs neither a pass over the data nor a
shuffle. Row numbers grow within a block, blocks within a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollatlas.schema import RAW_COLUMNS, RAW_SCHEMA

PREAMBLE_LINES = 4

_OPTIONS = {
    "header": "false",
    "ignoreLeadingWhiteSpace": "true",
    "ignoreTrailingWhiteSpace": "true",
    "escape": '"',
}


_NOT_VALUES = ", \t\n\v\f\r"
# An empty quoted field. Without a repeated group, for which the regex engine would recurse.
_EMPTY_QUOTED = r"(^|,)\s*\"\s*\"\s*(?=,|$)"


def no_values(line: Column | str) -> Column:
    """Whether a line holds nothing but empty fields.

    Checked on the text: a filter on the parsed fields would be moved in front of the parser and
    run it once per field.
    """
    line = F.col(line) if isinstance(line, str) else line
    # Most records begin with a value; only others are looked at whole.
    begins = ~F.substring(F.ltrim(line), 1, 1).isin("", '"', *_NOT_VALUES)
    empty = F.translate(F.regexp_replace(line, _EMPTY_QUOTED, "$1"), _NOT_VALUES, "") == ""
    return F.when(begins, False).otherwise(empty)


def source_position() -> Column:
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """lines(ord, line) of text files, blank lines included. Splittable."""
    return spark.read.text(path).select(source_position().alias("ord"), F.col("value").alias("line"))


def row_in_file(file: Column | str, block: Column | str) -> Column:
    """Number of a row in its file, from 0, for rows of a scan; exact in a file's first block.

    A task reads its files one after the other and rows stay in order, so rows are counted where
    they are read. Only two whole numbers of each row go to Python, the row itself does not. Told
    to vary, so that it runs before any filter on it and only once.
    """

    @F.arrow_udf("long")
    def count(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last, seen = None, 0
        for files, blocks in batches:
            key = np.stack([files.to_numpy(zero_copy_only=False), blocks.to_numpy(zero_copy_only=False)])
            if not key.shape[1]:
                yield pa.array([], pa.int64())
                continue
            new = np.ones(key.shape[1], bool)
            new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
            new[0] = last is None or (key[:, 0] != last).any()
            at = np.arange(len(new))
            start = np.maximum.accumulate(np.where(new, at, -1))
            yield pa.array(np.where(start >= 0, at - start, at + seen))
            seen = len(new) - int(start[-1]) if start[-1] >= 0 else seen + len(new)
            last = key[:, -1]

    return count.asNondeterministic()(F.xxhash64(file), block)


def skip_preamble(lines: DataFrame, count: int = PREAMBLE_LINES) -> DataFrame:
    """Drop the first ``count`` rows of every file of a scan with ``ord``.

    One scan and no shuffle, however many files: the first rows are known where they are read.
    ``lines`` must come straight from the scan. A preamble that does not end in the first block
    of a file is longer than this can see, so blocks must hold it.
    """
    at = F.col("ord")
    numbered = lines.withColumn("_number", row_in_file(at["file"], at["block"]))
    return numbered.filter((at["block"] > 0) | (F.col("_number") >= count)).drop("_number")


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines(ord, line) to raw records; blank lines and blank records go.

    Fields are trimmed, the inside of quotes is not.
    A line with too few or too many fields stops the job. Empty fields are empty
    text, not null (the sentinel is for fields that are not there at all).
    """
    filled = lines.filter(~no_values("line"))
    fields = ", ".join(f"{c} string" for c in RAW_COLUMNS)
    record = F.from_csv("line", fields, {**_OPTIONS, "mode": "FAILFAST"})
    parsed = filled.select("ord", record.alias("_record"))
    fields = [F.coalesce(F.col("_record")[c], F.lit("")).alias(c) for c in RAW_COLUMNS]
    return parsed.select("ord", *fields)


def read_directory(
    spark: SparkSession, path: str | list[str], preamble: int = PREAMBLE_LINES
) -> DataFrame:
    """Raw records of one or more directory exports, one record per line."""
    lines = read_lines(spark, path)
    return parse_lines(skip_preamble(lines, preamble) if preamble else lines)


def read_directory_multiline(
    spark: SparkSession, path: str | list[str], preamble: int = PREAMBLE_LINES
) -> DataFrame:
    """As ``read_directory`` for exports with line breaks inside quoted fields.

    Such a file cannot be split; prefer many files. The preamble is counted in
    non-blank records here.
    """
    reader = spark.read.schema(RAW_SCHEMA).options(**_OPTIONS, multiLine="true", mode="FAILFAST")
    fields = [F.coalesce(c, F.lit("")).alias(c) for c in RAW_COLUMNS]
    rows = reader.csv(path).select(source_position().alias("ord"), *fields)
    kept = skip_preamble(rows, preamble) if preamble else rows
    return kept.filter(F.concat_ws("", *RAW_COLUMNS) != "")

"""Run a query and its reference SQL and compare types and values."""

from __future__ import annotations

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def kind(t: pa.DataType) -> str:
    if pa.types.is_integer(t):
        return f"int{t.bit_width}"
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "text"
    return str(t)


def rows(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    out = list(zip(*[table.column(n).to_pylist() for n in names])) if names else []
    return sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


def differences(got: pa.Table, want: pa.Table) -> list[str]:
    found = []
    types_got = {n: kind(got.schema.field(n).type) for n in got.column_names}
    types_want = {n: kind(want.schema.field(n).type) for n in want.column_names}
    if types_got != types_want:
        found.append(f"types {sorted(set(types_got.items()) ^ set(types_want.items()))}")
    if got.num_rows != want.num_rows:
        found.append(f"rows {got.num_rows} != {want.num_rows}")
    if set(types_got) == set(types_want):
        bad = [(a, b) for a, b in zip(rows(got), rows(want)) if a != b]
        if bad:
            found.append(f"{len(bad)} rows differ, first {bad[0]}")
    return found

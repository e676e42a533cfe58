"""Run a registered query and its SQL statement side by side."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, float) and math.isnan(value):
        return (1, "")
    return (2, repr(value))


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(row[i] for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: [_key(v) for v in r])


def differences(spark_df, con, sql) -> list[str]:
    cur = con.execute(sql)
    expected_names, expected = rows_by_name([d[0] for d in cur.description], cur.fetchall())
    names, got = rows_by_name(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if names != expected_names:
        return [f"columns {names} != {expected_names}"]
    if len(got) != len(expected):
        return [f"{len(got)} rows != {len(expected)}"]
    out = []
    for g, e in zip(got, expected):
        for name, a, b in zip(names, g, e):
            if type(a) is not type(b) or a != b:
                out.append(f"{name}: {a!r} != {b!r} in {dict(zip(names, g))}"[:400])
                if len(out) >= 3:
                    return out
    return out

"""Run a query and its SQL twin and compare them as bags of rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if hasattr(value, "__float__") and not isinstance(value, (str, int)):
        value = float(value)
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def compare(spark_frame, con, text: str) -> str | None:
    """None when equal, else what differs."""
    names, got = _bag(spark_frame.columns, [tuple(r) for r in spark_frame.collect()])
    result = con.execute(text)
    wanted_names, wanted = _bag([d[0] for d in result.description], result.fetchall())
    if names != wanted_names:
        return f"columns {names} != {wanted_names}"
    if len(got) != len(wanted):
        return f"rows {len(got)} != {len(wanted)}"
    for a, b in zip(got, wanted):
        if a != b:
            return f"row {str(a)[:300]} != {str(b)[:300]}"
    return None

"""Compare a query's rows with those of its SQL on the same tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return db


def _plain(value):
    if isinstance(value, float):
        return float(f"{value:.10g}") if math.isfinite(value) else str(value)
    return value


def differences(spark_df, db, sql: str) -> list[str]:
    names = sorted(spark_df.columns)
    result = db.execute(sql)
    sql_names = [c[0] for c in result.description]
    if sorted(sql_names) != names:
        return [f"columns {names} against {sorted(sql_names)}"]
    places = [sql_names.index(n) for n in names]
    expected_rows = result.fetchall()
    expected = Counter(tuple(_plain(r[i]) for i in places) for r in expected_rows)
    got = Counter(tuple(_plain(v) for v in r) for r in spark_df.select(*names).collect())
    problems = []
    if sum(got.values()) != sum(expected.values()):
        problems.append(f"{sum(got.values())} rows against {sum(expected.values())}")
    extra, missing = got - expected, expected - got
    if extra or missing:
        problems.append(f"extra {list(extra.items())[:3]} missing {list(missing.items())[:3]}")
    kinds = {tuple(type(v).__name__ for v in r) for r in list(got)[:200]}
    sql_kinds = {tuple(type(v).__name__ for v in r) for r in list(expected)[:200]}
    if not kinds & sql_kinds and got:
        problems.append(f"types {list(kinds)[:2]} against {list(sql_kinds)[:2]}")
    return problems

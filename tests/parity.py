"""Comparing a query's rows with those of its SQL: columns by name, rows in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(folder: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        at = Path(folder, f"{t}.parquet")
        if at.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}{'/*' if at.is_dir() else ''}')")
    return con.execute(sql).df()


def plain(value: object) -> object:
    if value is None or isinstance(value, float) and math.isnan(value) or value is pd.NA or value is pd.NaT:
        return None
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (float, np.floating)):
        return round(float(value), 5) + 0.0
    if isinstance(value, (int, np.integer)):
        return int(value)
    return str(value)


def rows(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in frame[names].itertuples(index=False)), key=repr)


def differences(ours: pd.DataFrame, theirs: pd.DataFrame) -> list[str]:
    if sorted(ours.columns) != sorted(theirs.columns):
        return [f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"]
    a, b = rows(ours), rows(theirs)
    out = [] if len(a) == len(b) else [f"{len(a)} and {len(b)} rows"]
    bad = [f"{x} and {y}" for x, y in zip(a, b, strict=False) if x != y and not _near(x, y)]
    return out + bad[:3]


def _near(x: tuple, y: tuple) -> bool:
    return all(p == q or isinstance(p, (int, float)) and isinstance(q, (int, float)) and abs(p - q) <= 2e-5 * max(1, abs(p)) for p, q in zip(x, y, strict=True))

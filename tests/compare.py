"""Compare a catalog query with its check statement."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normalise(frame: pd.DataFrame) -> list[tuple]:
    """Rows as sortable tuples, columns in name order, NULLs alike."""
    columns = sorted(frame.columns)
    rows = []
    for row in frame[columns].astype(object).itertuples(index=False, name=None):
        values = []
        for v in row:
            if pd.isna(v):
                values.append("")
            elif isinstance(v, bool):
                values.append(str(v))
            elif isinstance(v, (int, float)):
                values.append(repr(round(float(v), 6) + 0.0))
            else:
                values.append(str(v))
        rows.append(tuple(values))
    return sorted(rows)


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} vs {sorted(theirs.columns)}"
    kinds = {c: (ours[c].dtype.kind, theirs[c].dtype.kind) for c in ours.columns}
    a, b = normalise(ours), normalise(theirs)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[:2]} ({kinds})"
    return None

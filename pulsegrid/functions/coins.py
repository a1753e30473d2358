"""Random choices that a row's key makes, the same in every run, file layout and engine."""

from __future__ import annotations


def coin(seed: int | str, *key: str) -> str:
    """SQL for a number in [0, 1) from the key columns and a seed; a NULL is a key value like any other."""
    parts = ", ".join(f"coalesce(CAST({k} AS STRING), '-')" for k in key)
    return f"conv(substr(md5(concat_ws(':', {parts}, '{seed}')), 1, 13), 16, 10) / 4503599627370496D"

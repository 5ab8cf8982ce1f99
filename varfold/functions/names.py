"""Names of columns: those that a transformation needs, and some for columns that come and go within it."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused_prefix(*frames: DataFrame) -> str:
    """A prefix with which no column of the frames begins."""
    prefix = "__"
    while any(c.startswith(prefix) for f in frames for c in f.columns):
        prefix += "_"
    return prefix


def require(df: DataFrame, columns: tuple[str, ...], what: str) -> None:
    """Raise early where ``df`` lacks columns that a step before it would have made."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} needs the columns {', '.join(missing)}")

"""Helper columns that cannot clash with a table's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name like ``name`` that none of the tables has; Spark's names differ by more than case."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

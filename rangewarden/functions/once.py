"""Columns that a plan evaluates once a row, however many others refer to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """The columns to keep, and new ones whose expressions are evaluated once.

    Catalyst copies an expression to wherever its column is used, and pushes filters through projections; a
    generator of one row is what it leaves in place. It stays within whole-stage code generation.
    """
    return df.select(*[F.col(c) for c in keep], F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))

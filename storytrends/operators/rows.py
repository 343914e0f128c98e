"""Costly values as rows or columns that the optimizer does not compute twice.

A filter on a computed column is pushed below it with a second copy of its
expression, and an inner explode adds a filter of its own on its input. Neither
passes an outer explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def array_rows(df: DataFrame, keep: str, array: Column, name: str) -> DataFrame:
    """``keep, name``: one row per element of ``array``; there are no null elements."""
    rows = df.select(keep, F.explode_outer(array).alias(name))
    return rows.filter(F.col(name).isNotNull())


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as a column that later filters can use as it is."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def row_keyed(df: DataFrame, id: str, *columns: str) -> DataFrame:
    """``_key`` and ``columns``: the id with a number of its own for each row.

    Steps that group exploded rows again use it, so that rows of one id stay apart.
    """
    key = F.struct(F.col(id).alias("id"), F.monotonically_increasing_id().alias("row"))
    return df.select(key.alias("_key"), *columns)

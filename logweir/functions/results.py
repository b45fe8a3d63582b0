"""Results of row-wise work: a value column beside an error column, of which one is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_ok(error: Column) -> Column:
    return error.isNull()


def unwrap(value: Column, error: Column) -> Column:
    """The value; a row with an error fails the query with it."""
    return F.when(error.isNull(), value).otherwise(F.raise_error(error))


def unwrap_or(value: Column, error: Column, other: Column) -> Column:
    """The value, or another one where there is an error."""
    return F.when(error.isNull(), value).otherwise(other)


def mapped(value: Column, error: Column, change) -> Column:
    """``change`` of the value; null where there is an error, which stays as it is."""
    return F.when(error.isNull(), change(value))


def split(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows without and with an error."""
    return rows.where(F.col(error).isNull()).drop(error), rows.where(F.col(error).isNotNull())

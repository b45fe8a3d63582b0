"""Typing of JSON values: int64, float64, string or bool, and the lattice that widens them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The four column types by their number in an archive's column definition.
TYPE_NAMES = ["int64", "float64", "string", "bool"]
# Spark's type of each column type.
SPARK_TYPES = {"int64": "bigint", "float64": "double", "string": "string", "bool": "boolean"}


def type_name(number: Column) -> Column:
    """Name of a column type given as 0 to 3; null for any other number."""
    return F.get(F.array(*[F.lit(t) for t in TYPE_NAMES]), F.when(number >= 0, number))


def json_type(value: Column) -> Column:
    """Type of a VARIANT value; null for JSON null. Objects and arrays are kept as their JSON text.

    A whole number beyond int64 is a float64, as is any number written with a point or exponent.
    """
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "BIGINT", "int64")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "float64")
        .when(kind == "BOOLEAN", "bool")
        .when(kind != "VOID", "string")
    )


def widened(kinds: Column) -> Column:
    """Least type that holds all of an array of distinct type names; null for none."""
    return (
        F.when(F.size(kinds) == 0, F.lit(None))
        .when(F.size(kinds) == 1, F.get(kinds, F.lit(0)))
        .when(F.forall(kinds, lambda k: k.isin("int64", "float64")), "float64")
        .otherwise("string")
    )


def text_type(text: Column) -> Column:
    """Type of what a text spells: int64, float64, bool or string; null for a null text."""
    plain = F.trim(text)
    return (
        F.when(text.isNull(), F.lit(None))
        .when(plain.rlike(r"^[+-]?\d{1,19}\z") & plain.try_cast("bigint").isNotNull(), "int64")
        .when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), "float64")
        .when(F.lower(plain).isin("true", "false"), "bool")
        .otherwise("string")
    )


def exploded(df: DataFrame, document: str, keep: list[str]) -> DataFrame:
    """One row per field of each JSON object: the kept columns, ``col_key`` and VARIANT ``value``.

    Text that is no JSON, or JSON that is no object, has no field.
    """
    read = df.select(*keep, F.try_parse_json(document).alias("_v"))
    return df.sparkSession.sql(
        f"SELECT {''.join(f'`{c}`, ' for c in keep)}e.key AS col_key, e.value AS value FROM {{t}}, LATERAL variant_explode(_v) AS e WHERE e.key IS NOT NULL", t=read
    )


def text_of(value: Column) -> Column:
    """A VARIANT value as text; objects and arrays as JSON, JSON null as null."""
    return F.when(~F.is_variant_null(value), F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value)))

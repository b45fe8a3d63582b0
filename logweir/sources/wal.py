"""Write-ahead log: JSON lines of {"l": labels, "d": document}, written and scanned in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_ERROR = "line is no record"


def record_line(labels: Column, document: Column) -> Column:
    """A record as one line; ``document`` is a VARIANT, a struct or a map."""
    return F.to_json(F.struct(labels.alias("l"), document.alias("d")))


def append(records: DataFrame, path: str) -> None:
    """Appends records (l, d) as new files. What a reader sees is what was committed whole."""
    records.select(record_line(F.col("l"), F.col("d")).alias("value")).write.mode("append").text(path)


def decode(lines: DataFrame, line: str = "value") -> DataFrame:
    """Adds l, d (VARIANT) and ``error`` to lines; a bad line is an error row, not a failure.

    Lines may have any length. An empty line is an error; what follows the record is not read.
    """
    v = F.try_parse_json(line)
    labels = F.try_variant_get("_v", "$.l", "map<string,string>")
    document = F.try_variant_get("_v", "$.d", "variant")
    good = labels.isNotNull() & document.isNotNull()
    return (
        lines.withColumn("_v", v)
        .withColumns({"l": labels, "d": document})
        .withColumn("error", F.when(~good, F.lit(RECORD_ERROR)))
        .drop("_v")
    )


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Every line of every object below ``path``: value, l, d, error and the object's name."""
    return decode(spark.read.text(path, recursiveFileLookup=True).withColumn("object", F.col("_metadata.file_name")))

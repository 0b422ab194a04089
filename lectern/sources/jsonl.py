"""JSON lines: blank and malformed lines, and those that aren't objects, are passed over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parsed(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """The objects of a column of lines by `schema`; absent fields are null."""
    rows = lines.where(F.regexp_like(F.trim(column), F.lit("^\\{")))
    found = rows.select(F.from_json(column, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return found.where("r._bad IS NULL").select("r.*").drop("_bad")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return parsed(spark.read.text(path), schema)


def append(df: DataFrame, path: str) -> None:
    """One object a line, added to what is there."""
    df.write.mode("append").json(path)

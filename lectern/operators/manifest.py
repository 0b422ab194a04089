"""The manifest of a book's chapters: hashes, and whether an earlier one still holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reusable(chapters: DataFrame, manifest: DataFrame, book: str, position: str, name: str, text: str) -> DataFrame:
    """`text_sha256` of each chapter, and whether the manifest has it at its place with this name and hash.

    Places that only the manifest has are not rows; a null text has a null hash and is never reusable.
    """
    old = manifest.select(book, position, F.col(name).alias("_name"), F.col("text_sha256").alias("_hash"))
    now = chapters.withColumn("text_sha256", F.sha2(F.col(text), 256)).join(old, [book, position], "left")
    return now.withColumn("reusable", F.coalesce((F.col("_name") == F.col(name)) & (F.col("_hash") == F.col("text_sha256")), F.lit(False))).drop("_name", "_hash")

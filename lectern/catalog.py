"""All queries of the core operators by name, with their SQL, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import segment, speech, text
from lectern.queries import ORACLES, QUERIES  # noqa: F401
from lectern.session import spread, table


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents from raw text to spoken chunks: cleaned, cut, weighted with pauses, verbalized, and cut again where they grew."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", text.cleaned(F.col("text")).alias("text"))
    return segment.respoken(segment.chunks(docs, "text", 400).withColumn("spoken", speech.spoken(F.col("chunk"))), "spoken", 400)

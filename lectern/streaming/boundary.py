"""The boundary log as a stream: the same choice of events, with running counts and deltas by type."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.latency import finite
from lectern.session import shared_path


def events(stream: DataFrame) -> DataFrame:
    """Running counts and mean deltas of gapless events by type."""
    rows = stream.select("event_type", F.when(F.col("event_type").isin("click", "view"), F.lit("gapless")).otherwise("auto").alias("trigger"), finite(F.expr("value * 12 - 900")).alias("delta_ms"))
    return rows.where("trigger = 'gapless' AND delta_ms BETWEEN -5000 AND 5000").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("delta_ms"), 6).alias("mean_delta_ms"))


def drained(spark: SparkSession, folder: str) -> DataFrame:
    """The result of streaming a folder's whole `events` table once; state and result are in the shared folder."""
    out = shared_path(spark, "boundary")
    source = spark.readStream.schema(spark.read.parquet(f"{folder}/events.parquet").schema).parquet(f"{folder}/event[s].parquet")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/result")

    query = events(source).writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/result")

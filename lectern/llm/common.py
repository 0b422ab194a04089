"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows in one Arrow batch: with very long texts, Spark's default of 10,000 would not fit a worker.
BATCH_ROWS = 1000
#: Characters of text that are handled at once inside a batch.
SLICE_CHARS = 2_000_000


def small_batches(df: DataFrame) -> DataFrame:
    """`df`; from here on its session hands at most BATCH_ROWS rows at once to Python."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df


def doc_texts(docs: DataFrame, *more: Column | str) -> DataFrame:
    """doc_id and text (null: empty) alone, and `more`: other columns never reach Python."""
    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more))


def split_remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE_CHARS bytes of `column`, a row at least."""
    lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + (n or 0) > SLICE_CHARS:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def rows_of(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    import pyarrow.compute  # noqa: F401  (pa.compute)

    for batch in batches:
        yield from slices(batch, column)

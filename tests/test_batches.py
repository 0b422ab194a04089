"""Text goes to Python in batches that don't grow with the table."""

import pytest

from lectern.queries import QUERIES


@pytest.mark.parametrize("name", ["v_verbalized_documents", "c6_c7_w1_chunks", "c3_sentences"])
def test_small_batches(spark, sf, name):
    names = [f"spark.sql.execution.arrow.{n}" for n in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], 10_000)
        spark.conf.unset(names[1])
        QUERIES[name](spark, sf)
        assert int(spark.conf.get(names[0])) <= 1000 and int(spark.conf.get(names[1])) <= 4 << 20
    finally:
        for n, value in zip(names, before):
            spark.conf.set(n, value)

"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Texts with one fingerprint are one class from the start, so only distinct fingerprints are compared, and
a group of copies of any size costs one row. Every distinct fingerprint emits itself and all variants at
one differing bit, half the radius of two. Fingerprints at two bits or fewer share a variant, and a
variant has at most 65 distinct fingerprints around it, so no key of the join can be hot. A pair meets at
several variants; it counts at one of them alone, which is the deduplication, and is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import doc_texts, rows_of
from lectern.llm.components import components
from lectern.llm.kernels import Words, majority_bits, text_bytes, xxh64
from lectern.plans.skew import salted_lookup
from lectern.session import discard, written

SEED = 42


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, fp, the 64-bit fingerprint as a signed long, and `more`, of every whole text.

    A-Z are lower-cased; features are the 3-word shingles, repeats included. A text of one or two words
    has itself as the only shingle; one without words, or null, has fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            words = Words(*text_bytes(batch.column("text")))
            at, size, many = words.shingles(3)
            bits = majority_bits(xxh64(words.buffer, at, size, SEED), many)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits.view(np.int64)), *(batch.column(c) for c in names)], names=["doc_id", "fp", *names])

    rows = doc_texts(docs, *more)
    names = rows.columns[2:]
    return rows.mapInArrow(run, "doc_id long, fp long" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:]))


def links(classes: DataFrame) -> DataFrame:
    """Pairs (x, y), x < y, of the distinct `fp` that differ in one or two bits."""
    ball = classes.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), b -> fp ^ shiftleft(1L, b)))")).alias("variant"))
    left, right = ball.select(F.col("fp").alias("x"), "variant"), ball.select(F.col("fp").alias("y"), "variant")
    differ = F.col("x").bitwiseXOR(F.col("y"))
    low = differ.bitwiseAND(F.bitwise_not(differ) + F.lit(1))  # the lowest differing bit
    met_at = F.when(F.bit_count(differ) == 1, F.col("x")).otherwise(F.col("x").bitwiseXOR(low))
    # a table that is small before it is exploded must not be taken for a small side of the join
    return left.join(right.hint("merge"), "variant").where((F.col("x") < F.col("y")) & (F.bit_count(differ) <= 2) & (F.col("variant") == met_at)).select("x", "y")


def clusters(prints: DataFrame) -> DataFrame:
    """(fp, n, rep, n_near, root) for every distinct fingerprint of `prints` (doc_id, fp): its rows, its smallest
    doc_id, how many other rows are at two bits or fewer, and the smallest fingerprint that links lead to."""
    classes = written(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep")), "classes")
    pairs = written(links(classes), "links")
    sized = classes.select("fp", "n")
    beside = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    near = beside.join(sized, beside.y == sized.fp).groupBy("x").agg(F.sum("n").alias("others"))
    roots = components(pairs)
    nodes = classes.join(near, classes.fp == near.x, "left").join(roots, classes.fp == roots.node, "left")
    nodes = written(nodes.select("fp", "n", "rep", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"), F.coalesce("root", "fp").alias("root")), "nodes")
    discard(classes, pairs)
    return nodes


def with_least(nodes: DataFrame, value: str, name: str) -> DataFrame:
    """`nodes` with the least `value` of their component; a component of very many fingerprints is spread over tasks."""
    least = nodes.groupBy("root").agg(F.min(value).alias(name), F.count("*").alias("_size"))
    least = written(least, "components")
    return salted_lookup(nodes, least, "root", "_size", max(1, nodes.count()), F.col("fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, fingerprint (16 hex digits), n_near, component_id.

    n_near counts the other rows at two bits or fewer, component_id is the smallest doc_id that links
    lead to. Rows with a repeated or null doc_id count each for themselves; a component without any
    doc_id has a null component_id. An empty table gives no rows. Other columns are ignored.
    """
    prints = written(fingerprints(docs), "fingerprints")
    nodes = with_least(clusters(prints), "rep", "component_id").select("fp", "n", "n_near", "component_id")
    found = salted_lookup(prints, nodes, "fp", "n", max(1, prints.count()), F.col("doc_id"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "n_near", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each component, all columns kept: of the smallest doc_id that isn't null, of the
    least digest of text among rows with that doc_id, and any one of rows that are equal in both.

    It goes by rows: a doc_id that comes with other texts has a row in the component of each, and none is lost.
    Components without any doc_id keep one row too. Null texts count as empty. Rows are known by
    their id and a 128-bit digest of their text. An empty table gives no rows.
    """
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("none")), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    keys = written(fingerprints(docs, key.alias("_key")), "fingerprints")
    nodes = clusters(keys)
    # the least row of each fingerprint, then of each component
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("_key").alias("key"))
    firsts = keys.groupBy("fp").agg(F.min(order).alias("first"))
    kept = nodes.select("fp", "root").join(firsts, "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = written(kept.select(F.col("first.key").alias("_key")), "kept")
    discard(keys, nodes)
    # equal rows collapse in their own tasks before the shuffle, and the join takes over its partitioning; the kept
    # keys grow with the input, so they are never broadcast by force
    return docs.withColumn("_key", key).dropDuplicates(["_key"]).join(kept.hint("merge"), "_key", "left_semi").select(docs.columns)

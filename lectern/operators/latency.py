"""The playback boundary log: checking its events, choosing the sound ones, and what to recommend from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import written

QUANTILES = (0.10, 0.25, 0.50, 0.75, 0.90)


def finite(x: Column) -> Column:
    """The value as a double, null unless it is a finite number."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def optional_ms(x: Column, most: float = 5000.0) -> Column:
    """A time in ms within 0 and `most`, three decimals; else null."""
    d = finite(x)
    return F.when(d.between(0, most), F.round(d, 3))


def checked(events: DataFrame, order: str = "event_id", most: int = 500) -> DataFrame:
    """The sound ones of the first `most` events: indexes of 0 and more, deltas within 5 s; other fields are mended.

    Speeds are held within 0.25 and 4, pads and remaining times at 0 at least; numbers have three decimals.
    `most` is the log's batch limit, not a limit on data.
    """
    delta = finite(F.col("delta_ms"))
    whole = {c: F.col(c).try_cast("bigint") for c in ("from_index", "to_index")}
    rate = F.coalesce(F.nullif(finite(F.col("playback_rate")), F.lit(0.0)), F.lit(1.0))
    first = events.orderBy(order).limit(most)
    sound = first.where((whole["from_index"] >= 0) & (whole["to_index"] >= 0) & delta.between(-5000, 5000))
    return sound.withColumns({
        **whole, "delta_ms": F.round(delta, 3), "playback_rate": F.round(F.least(F.greatest(rate, F.lit(0.25)), F.lit(4.0)), 3),
        "pad_ms": F.greatest(F.coalesce(F.col("pad_ms").try_cast("bigint"), F.lit(0)), F.lit(0)), "output_latency_ms": optional_ms(F.col("output_latency_ms")),
        "trigger": F.coalesce(F.nullif(F.col("trigger"), F.lit("")), F.lit("auto")), "preloaded": F.coalesce("preloaded", F.lit(False)),
    })


def gapless(events: DataFrame) -> DataFrame:
    """Events that measure a gapless change: preloaded, at about normal speed, with a believable delta."""
    return events.where((F.col("trigger") == "gapless") & F.col("preloaded") & F.col("playback_rate").between(0.95, 1.05) & finite(F.col("delta_ms")).between(-5000, 5000))


#: Ranges of values that a group's order statistics are first looked for in.
BINS = 4096


def stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, min, max, mean and quantiles (the value at place floor((n-1)*q), no interpolation), three decimals.

    Quantiles are exact order statistics without sorting a group in one task: counts of BINS equal ranges tell the range
    that a place lies in, and only the distinct values of that range, with their counts, are put in order. Nulls of
    `value` are left out; a null in `by` is a group.
    """
    from pyspark.sql import Window

    rows = df.where(F.col(value).isNotNull()).select(F.struct(*by).alias("_g"), F.col(value).alias("_v"))
    whole = rows.groupBy("_g").agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.avg("_v").alias("_mean"))
    whole = written(whole, "stats")
    bin_ = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS)).otherwise(0)
    values = written(rows.join(whole, "_g").withColumn("_bin", bin_).groupBy("_g", "_bin", "_v").agg(F.count("*").alias("_c")), "values")
    before = lambda *keys: F.sum("_c").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1])) - F.col("_c")
    bins = values.groupBy("_g", "_bin").agg(F.sum("_c").alias("_c")).withColumn("_before", before("_g", "_bin"))
    places = whole.select("_g", F.posexplode(F.array(*(F.floor((F.col("n") - 1) * q) for q in QUANTILES))).alias("_q", "_k"))
    inside = (F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_c"))
    wanted = places.join(bins, "_g").where(inside).select("_g", "_bin", "_q", (F.col("_k") - F.col("_before")).alias("_k"))
    ranked = values.join(wanted.select("_g", "_bin").distinct(), ["_g", "_bin"], "left_semi").withColumn("_before", before("_g", "_bin", "_v"))
    found = ranked.join(wanted, ["_g", "_bin"]).where(inside).groupBy("_g").agg(*(F.max(F.when(F.col("_q") == i, F.col("_v"))).alias(f"_q{i}") for i in range(len(QUANTILES))))
    # a quantile of 0 gives way to the least value, or from the upper quarter on to the greatest
    edge = lambda q: F.col("_lo") if q <= 0.5 else F.col("_hi")
    quantiles = [F.round(F.coalesce(F.nullif(F.col(f"_q{i}"), F.lit(0.0)), edge(q)), 3).alias(f"p{round(q * 100)}") for i, q in enumerate(QUANTILES)]
    return whole.join(found, "_g").select(*(F.col(f"_g.{c}").alias(c) for c in by), "n", F.round("_lo", 3).alias("min"), *quantiles, F.round("_hi", 3).alias("max"), F.round("_mean", 3).alias("mean"))


def report(events: DataFrame, by: list[str], min_samples: int = 200, min_coverage: float = 0.8) -> DataFrame:
    """A row a group of gapless events: counts, the coverage of latencies, the pads, and the pad change to recommend.

    That is the median of delta plus latency, to a whole number (half to even), if there are `min_samples` events and
    `min_coverage` of them have a latency.
    """
    latency = optional_ms(F.col("output_latency_ms"))
    rows = gapless(events).withColumn("corrected", F.when(latency.isNotNull(), finite(F.col("delta_ms")) + finite(F.col("output_latency_ms"))))
    total = rows.groupBy(*by).agg(F.count("*").alias("samples"), F.count("corrected").alias("with_latency"), F.array_sort(F.collect_set(F.col("pad_ms").try_cast("bigint"))).alias("pads"))
    middle = stats(rows, by, "corrected").select(*by, "p50")
    share = F.col("with_latency") / F.col("samples")
    enough = (F.col("samples") >= min_samples) & (share >= min_coverage)
    return total.join(middle, by, "left").select(*by, "samples", "with_latency", F.round(share, 4).alias("coverage"), "pads", F.when(enough, F.bround("p50", 0).cast("long")).alias("pad_change_ms"))

"""Which ranges of a key hold a number: merged ranges in bins, found by an equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a bin's number within the next larger one, and the sizes of bins (numbers of up to 32 bits).
BITS, LEVELS = 8, 4
#: The largest command, for complements.
LARGEST = 0xFFFF


def merged(ranges: DataFrame, *key: str) -> DataFrame:
    """(key..., lo, hi) without overlaps: ranges that overlap or touch become one, empty ones go."""
    order = Window.partitionBy(*key).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = ranges.where("lo <= hi").withColumn("_new", F.coalesce(F.col("lo") > reach + 1, F.lit(True)).cast("int"))
    islands = fresh.withColumn("_island", F.sum("_new").over(order))
    return islands.groupBy(*key, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def complement(ranges: DataFrame, *key: str, largest: int = LARGEST) -> DataFrame:
    """(key..., lo, hi) of the numbers from 0 to ``largest`` that the merged ranges of a key leave out."""
    order = Window.partitionBy(*key).orderBy("lo")
    held = merged(ranges, *key)
    before = held.select(*key, (F.coalesce(F.lag("hi").over(order), F.lit(-1)) + 1).alias("lo"), (F.col("lo") - 1).alias("hi"))
    after = held.groupBy(*key).agg((F.max("hi") + 1).alias("lo")).withColumn("hi", F.lit(largest).cast("bigint"))
    return before.unionByName(after).where("lo <= hi")


def binned(ranges: DataFrame) -> DataFrame:
    """Adds level and bin, a row for each bin of the smallest size of which a range needs at most 257."""
    span = F.col("hi") - F.col("lo")
    level = F.coalesce(*[F.when(span < F.lit(1 << BITS * (k + 2)), F.lit(k)) for k in range(LEVELS - 1)], F.lit(LEVELS - 1))
    size = F.coalesce(*[F.when(F.col("level") == k, F.lit(1 << BITS * (k + 1)).cast("bigint")) for k in range(LEVELS)])
    return ranges.withColumn("level", level).withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))))


def held(numbers: DataFrame, ranges: DataFrame, *key: str) -> DataFrame:
    """The rows of numbers (key..., n, ...) that a range (key..., lo, hi) of their key holds, each once."""
    index = binned(merged(ranges.select(*key, "lo", "hi"), *key))
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("n") / (1 << BITS * (k + 1))).alias("bin")) for k in range(LEVELS)])).alias("_at")
    asked = numbers.select("*", levels).select(*numbers.columns, F.col("_at.level").alias("level"), F.col("_at.bin").alias("bin"))
    met = asked.join(index, [*key, "level", "bin"])
    return met.where((F.col("lo") <= F.col("n")) & (F.col("n") <= F.col("hi"))).select(*numbers.columns)

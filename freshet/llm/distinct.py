"""Distinct counts of very large identifier sets: multiresolution bitmaps.

An identifier is hashed once. The number of trailing ones of a part of the hash puts it into a level: level i gets a share of 2^-(i+1)
of the hash space, the last level what is left. Another part sets one of `bits` positions of the level's small bitmap. Bitmaps
merge by OR, so partial results of tasks, days or exporters can be combined in any way and repeated identifiers change nothing.

For an estimate the levels that are too full are skipped; those from `base` on hold a share of 2^-base of the identifiers, each is
read by linear counting (bits * ln(bits / zeros)), and the sum is scaled by 2^base. The relative error doesn't depend on how many
there are: the sampling by levels contributes sqrt((1 - 2^-base) / n_base) and the collisions in the bitmaps
sqrt(sum of bits * (e^r - r - 1)) / n_base for fill r.

The bitmaps are ordinary rows (group, level, word of 64 bits) and their maintenance is bit_or in a hash aggregate, combined map-side:
levels * bits / 64 rows per group and task at most, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, LEVELS, FULL = 4096, 26, 0.75
Z = 5.0  # standard errors that a stated bound allows for


def slot(value: Column, bits: int = BITS, levels: int = LEVELS) -> tuple[Column, Column, Column]:
    """(level, word, mask) of a value."""
    h = F.xxhash64(value)
    high = F.shiftrightunsigned(h, 64 - levels + 1)
    trailing_ones = F.bit_count(high.bitwiseXOR(high + 1)) - 1
    level = F.least(trailing_ones, F.lit(levels - 1))
    place = F.pmod(h, F.lit(bits))
    return level.cast("byte"), F.shiftright(place, 6).cast("short"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))


def build(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Partial results: keys..., field, level, word, mask, n_rows. n_rows adds up to the number of rows of a group. NULL values
    are rows but no identifier: they are in the row whose level is NULL. NULL keys are a group. An empty table gives no bitmaps."""
    k = [F.col(f"`{x}`").alias(x) for x in keys]
    entries = []
    for f in fields:
        level, word, mask = slot(F.col(f"`{f}`"))
        there = F.col(f"`{f}`").isNotNull()
        entries.append(F.struct(F.lit(f).alias("field"), F.when(there, level).alias("level"), F.when(there, word).alias("word"), F.when(there, mask).alias("mask")))
    rows = df.select(*k, F.explode(F.array(*entries)).alias("x")).select(*keys, "x.*")
    return rows.groupBy(*keys, "field", "level", "word").agg(F.bit_or("mask").alias("mask"), F.count(F.lit(1)).alias("n_rows"))


def merge(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """Bitmaps of the groups of fewer keys: OR, and the sum of rows."""
    return bitmaps.groupBy(*keys, "field", "level", "word").agg(F.bit_or("mask").alias("mask"), F.sum("n_rows").alias("n_rows"))


def estimate(bitmaps: DataFrame, keys: list[str], bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """keys..., field, n_rows, n_distinct (DOUBLE), rel_error (one standard error), base. A group without identifiers has 0 of them."""
    per = bitmaps.groupBy(*keys, "field", "level").agg(F.sum(F.bit_count("mask")).alias("set"), F.sum("n_rows").alias("n_rows"))
    # at most `levels` entries per group
    g = per.groupBy(*keys, "field").agg(
        F.sum("n_rows").alias("n_rows"),
        F.collect_list(F.when(F.col("level").isNotNull(), F.struct(F.col("level").cast("int").alias("level"), F.col("set").cast("double").alias("set")))).alias("f"),
        F.coalesce(F.max(F.when((F.col("set") > FULL * bits) & (F.col("level") < levels - 1), F.col("level"))) + 1, F.lit(0)).cast("int").alias("base"),
    )
    used = F.filter("f", lambda x: x.level >= F.col("base"))
    linear = lambda x: -F.lit(float(bits)) * F.log1p(-F.least(x["set"], F.lit(bits - 1.0)) / bits)
    noise = lambda r: bits * (F.exp(r) - r - 1)
    n = F.aggregate(used, F.lit(0.0), lambda a, x: a + linear(x))
    v = F.aggregate(used, F.lit(0.0), lambda a, x: a + noise(linear(x) / bits))
    share = F.pow(F.lit(2.0), -F.col("base"))
    return (
        g.withColumn("_n", n).withColumn("_v", v)
        .select(
            *keys, "field", "n_rows", (F.col("_n") / share).alias("n_distinct"),
            F.when(F.col("_n") > 0, F.sqrt((1 - share) / F.col("_n") + F.col("_v") / (F.col("_n") * F.col("_n")))).otherwise(F.lit(0.0)).alias("rel_error"),
            "base",
        )
    )


def bounded(estimates: DataFrame) -> DataFrame:
    """Adds lower and upper: Z standard errors and one collision either way; never more than the rows."""
    e = F.col("n_distinct")
    margin = F.lit(Z) * F.col("rel_error") * e + F.lit(1.0)
    return estimates.withColumn("lower", F.greatest(e - margin, F.lit(0.0))).withColumn("upper", F.least(e + margin, F.col("n_rows").cast("double")))

"""Per-key results where a few keys hold most of the rows: two-stage salted aggregation.

1. All rows are counted per hash bucket of the key (a few thousand buckets, combined map-side, so next to nothing is shuffled).
   A bucket with at least the share `hot_share` of the rows is hot: at most 1/hot_share buckets can be, which bounds what is
   broadcast, and every key with that share lies in one.
2. Rows of hot buckets get a random salt; partial results are made per (key, salt) and then merged per key.

A hot key's rows are thus spread over `salts` groups for any aggregate, also for those that don't combine map-side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.util import c


@dataclass(frozen=True)
class Partial:
    """An aggregate in two stages: `first` over rows, `merge` over the column of partial results."""

    name: str
    first: Column
    merge: str = "sum"  # sum, min, max, bit_or

    def merged(self) -> Column:
        return getattr(F, self.merge)(c(self.name)).alias(self.name)


def count_rows(name: str = "n_rows") -> Partial:
    return Partial(name, F.count(F.lit(1)))


def hot_buckets(df: DataFrame, keys: list[str], buckets: int, hot_share: float, per: list[str] | None = None) -> DataFrame:
    """(per..., _bucket) with at least `hot_share` of the rows of its `per` group: at most 1/hot_share rows for each group."""
    per = per or []
    counts = df.groupBy(*[c(p) for p in per], F.pmod(F.xxhash64(*[c(k) for k in keys]), F.lit(buckets)).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window

    total = F.sum("_n").over(Window.partitionBy(*[c(p) for p in per]) if per else Window.partitionBy(F.lit(0)))
    return counts.withColumn("_all", total).where(F.col("_n") >= F.lit(hot_share) * F.col("_all")).select(*[c(p) for p in per], "_bucket")


def salted_aggregate(df: DataFrame, keys: list[str], aggs: list[Partial], salts: int = 32, hot_share: float = 0.01, buckets: int = 4096, per: list[str] | None = None, seed: int = 17) -> DataFrame:
    """One row per key with the merged aggregates. `per` (a subset of `keys` with few values) separates independent key spaces:
    shares are taken within each.

    A NULL key is a key like any other. Repeated rows count again. An empty input gives an empty result. Columns besides the keys
    and those used by `aggs` may have any name but `_bucket`, `_hot` and `_salt`.
    """
    per = per or []
    hot = hot_buckets(df, keys, buckets, hot_share, per).withColumn("_hot", F.lit(True))
    on = [*per, "_bucket"]
    flagged = df.withColumn("_bucket", F.pmod(F.xxhash64(*[c(k) for k in keys]), F.lit(buckets)))
    # at most 1/hot_share rows per `per` group: small by construction
    flagged = flagged.join(F.broadcast(hot), on, "left")
    salted = flagged.withColumn("_salt", F.when(F.col("_hot"), F.floor(F.rand(seed) * salts).cast("int")).otherwise(F.lit(0)))
    partial = salted.groupBy(*[c(k) for k in keys], F.col("_salt")).agg(*[a.first.alias(a.name) for a in aggs])
    return partial.groupBy(*[c(k) for k in keys]).agg(*[a.merged() for a in aggs])

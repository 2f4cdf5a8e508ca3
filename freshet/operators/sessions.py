"""Sessions by inactivity gaps: a sweep over +1/-1 deltas.

A key's activity is the set of intervals [start, end + gap]; a session is a connected part of their union. Each interval adds one
at its start and takes one away at end + gap; where the running sum falls to zero a session closes.

Scale: all intervals of a key whose starts fall into the same slot of one gap's length belong to one session (their starts are less
than a gap apart), so they are replaced by their envelope in a hash aggregate with map-side combine *before* anything is sorted. A
key that holds a third of all rows then has at most (time span / gap) rows; the sweep window never sees more than that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.util import c


def sessionize(df: DataFrame, key: str, start: str, end: str, gap: int, sums: dict[str, str] | None = None) -> DataFrame:
    """One row per session: `key`, session_no, session_start, session_end, duration, n_events and a sum for each entry of `sums`
    (output name -> input column).

    * An event belongs to the running session unless it starts more than `gap` after the latest end so far.
    * Bounds in the wrong order are swapped. Events whose key or either bound is NULL are left out. Repeated events count again.
    * NULL counters count as 0 in `sums`. An empty input gives an empty result. Other columns of the input are not looked at,
      whatever their names.
    """
    if gap < 1:
        raise ValueError("gap must be at least 1")
    sums = sums or {}
    ev = df.select(
        c(key).alias("_k"), F.least(c(start), c(end)).cast("long").alias("_s"), F.greatest(c(start), c(end)).cast("long").alias("_e"),
        *[F.coalesce(c(x).cast("long"), F.lit(0).cast("long")).alias(f"_v{i}") for i, x in enumerate(sums.values())],
        c(start).alias("_s0"), c(end).alias("_e0"),
    ).where("_k is not null and _s0 is not null and _e0 is not null")
    vals = [f"_v{i}" for i in range(len(sums))]
    slots = ev.groupBy("_k", F.floor(F.col("_s") / F.lit(gap)).alias("_slot")).agg(
        F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(v) for v in vals]
    )
    zero = F.lit(0).cast("long")
    opens = F.struct(F.col("_s").alias("t"), F.lit(1).alias("d"), F.col("_n").alias("n"), *[F.col(v).alias(v) for v in vals])
    closes = F.struct((F.col("_e") + F.lit(gap)).alias("t"), F.lit(-1).alias("d"), zero.alias("n"), *[zero.alias(v) for v in vals])
    deltas = slots.select("_k", F.explode(F.array(opens, closes)).alias("x")).select("_k", "x.*")
    sweep = Window.partitionBy("_k").orderBy(F.col("t"), F.col("d").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        deltas.withColumn("_run", F.sum("d").over(sweep))
        .withColumn("_no", F.sum(F.when((F.col("d") == 1) & (F.col("_run") == 1), 1).otherwise(0)).over(sweep))
        .groupBy("_k", "_no")
        .agg(
            F.min("t").alias("session_start"), (F.max("t") - F.lit(gap)).alias("session_end"), F.sum("n").alias("n_events"),
            *[F.sum(v).alias(v) for v in vals],
        )
        .select(
            F.col("_k").alias(key), F.col("_no").alias("session_no"), "session_start", "session_end",
            (F.col("session_end") - F.col("session_start")).alias("duration"), "n_events",
            *[F.col(v).alias(out) for v, out in zip(vals, sums)],
        )
    )

"""Event-time periods that are corrected by late records, with low watermarks per source.

An arrival of a source is also a punctuation: once something of it has arrived after time t, nothing of it is still to come that arrived
up to t, and its low watermark is t. For a period with end E (exclusive)

* E + `on_time` is the bound up to which (inclusive) records make up the first result,
* E + `cutoff` is the bound up to which (inclusive) late records correct it,
* a source releases the period when its low watermark reaches E + `cutoff`; one from which nothing has come for `idle_timeout` no longer
  holds it,
* the period closes when every source has released it. What arrives after that is diverted; so are the records of a source that has
  passed its own bound while others still hold the period open. Diverted records are counted apart and never change the result.

Scale: bounds lie on a grid of time (the ends of periods, and those + `on_time`), so all records of a source and period that arrive in one
cell of the grid meet the same watermark. They are combined map-side into that cell; watermarks and closings are worked out from the
cells, whose number follows time and sources, not records. A source that holds a third of all records has as many cells as a quiet one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.util import c

IDLE_MS = 1_800_000


def period_start(event: Column, length: int) -> Column:
    return (event - F.pmod(event, F.lit(length))).cast("long")


def whole_div(x: Column, by: int) -> Column:
    """Rounded down, in whole numbers."""
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))


def low_watermark(arrival: Column, length: int, on_time: int, cutoff: int) -> Column:
    """The last bound of any period that a source has passed by an arrival: the largest point of the grid before it."""
    last = arrival - 1
    within = F.pmod(last, F.lit(length))
    offsets = sorted({on_time % length, cutoff % length})
    at = F.lit(offsets[-1] - length)
    for o in offsets:
        at = F.when(within >= o, F.lit(o)).otherwise(at)
    return (last - within + at).cast("long")


def _cells(df: DataFrame, source: str, event: str, arrival: str, length: int, on_time: int, cutoff: int, sums: dict[str, str]) -> DataFrame:
    """_src, _p (period), _wm (the source's low watermark when the records come), _slot (of the grid of period ends), _n, _min and _max
    (arrivals), _v0 ... (sums)."""
    if cutoff % length:
        raise ValueError("cutoff must be a multiple of length")
    zero = F.lit(0).cast("long")
    x = df.select(c(source).alias("_src"), c(event).cast("long").alias("_ev"), c(arrival).cast("long").alias("_ar"), *[F.coalesce(c(v).cast("long"), zero).alias(f"_v{i}") for i, v in enumerate(sums.values())])
    x = x.where("_src is not null and _ev is not null and _ar is not null")
    x = x.withColumns({"_p": period_start(F.col("_ev"), length), "_wm": low_watermark(F.col("_ar"), length, on_time, cutoff), "_slot": whole_div(F.col("_ar"), length)})
    keys = ["_p", "_wm", "_slot"]
    values = {"_n": F.count(F.lit(1)), "_min": F.min("_ar"), "_max": F.max("_ar")} | {f"_v{i}": F.sum(f"_v{i}") for i in range(len(sums))}
    cells = x.where("_p is not null and _slot is not null").groupBy("_src", *keys).agg(*[v.alias(n) for n, v in values.items()])
    # True of every row and cell; all columns are asked for, so that all uses of the cells have one plan and they are made once.
    return cells.where(" and ".join(["_n > 0", *(f"{n} is not null" for n in list(values)[1:])]))


def _closings(cells: DataFrame, length: int, cutoff: int, idle_timeout: int) -> DataFrame:
    """_p, close_at, n_sources of each period that has a record."""
    slots = cells.groupBy("_src", "_slot").agg(F.min("_min").alias("_min"), F.max("_max").alias("_max"))
    w = Window.partitionBy("_src").orderBy("_slot")
    nxt = slots.select("_slot", "_max", F.lead("_slot").over(w).alias("_next"), F.lead("_min").over(w).alias("_next_min"))
    # Bounds between two slots of a source that it holds open: those before its idle timeout ends. At most idle_timeout / length + 1.
    first, idle = F.col("_slot") + 1, whole_div(F.col("_max") + idle_timeout - 1, length)
    held = nxt.withColumn("_to", F.least(F.coalesce(F.col("_next"), idle), idle)).where(F.col("_to") >= first)
    held = held.select("_max", "_next_min", F.explode(F.sequence(first, F.col("_to"))).alias("_b"))
    release = F.least(F.coalesce(F.col("_next_min"), F.lit(2**62)), F.col("_max") + idle_timeout)
    bound = F.col("_b") * length
    held = held.groupBy((bound - cutoff - length).alias("_p")).agg(F.max(F.greatest(bound, release)).alias("_close"))
    # one number per source: in which slot it was first heard of
    heard = cells.groupBy("_src").agg(F.min("_slot").alias("_s")).agg(F.sort_array(F.collect_list("_s"))).scalar()
    seen = cells.select("_p").distinct().join(held, "_p", "left")
    end = F.col("_p") + length + cutoff
    n = F.size(F.filter("_heard", lambda s: s * length < end)).cast("long")
    return seen.withColumn("_heard", heard).select("_p", F.coalesce("_close", end).alias("close_at"), n.alias("n_sources"))


def closures(df: DataFrame, source: str, event: str, arrival: str, length: int, cutoff: int, idle_timeout: int = IDLE_MS) -> DataFrame:
    """One row per period that has a record: period_start, close_at and n_sources. A period closes at the latest of its sources'
    releases; a source releases the bound B = period end + cutoff with its first arrival at or after B or, if it is idle by then, at
    B or when its idle timeout ends, whichever is later. Sources that haven't been heard of before B don't hold it; n_sources counts
    the others.

    `cutoff` must be a multiple of `length`, so that the bounds of all periods lie on one grid. Other rules as in period_results().
    """
    return _closings(_cells(df, source, event, arrival, length, 0, cutoff, {}), length, cutoff, idle_timeout).withColumnRenamed("_p", "period_start")


def period_results(df: DataFrame, source: str, event: str, arrival: str, length: int, on_time: int, cutoff: int, sums: dict[str, str] | None = None, idle_timeout: int = IDLE_MS) -> DataFrame:
    """One row per source and period: `source`, period_start, n_first and n_final (records in the first and in the corrected result),
    n_late, n_dropped, for each entry of `sums` (name -> column) name_first, name_final and name_dropped, closed_at: the first
    arrival of the source beyond the period's cut-off that brought a record of this period, NULL if none did; and close_at: when every
    source had released the period, by the rules of closures().

    Records whose source, event time or arrival time is NULL are left out; NULL counters count as 0; repeated records count again.
    An empty input gives an empty result. Other columns of the input are not looked at. `cutoff` must be a multiple of `length`.
    """
    sums = sums or {}
    cells = _cells(df, source, event, arrival, length, on_time, cutoff, sums)
    x = cells.join(_closings(cells, length, cutoff, idle_timeout).select("_p", "close_at"), "_p")
    end = F.col("_p") + length
    # closed by all sources, or passed by its own: a period is never closed before its cut-off
    dropped = (F.col("_min") > F.col("close_at")) | (F.col("_wm") >= end + cutoff)
    first = ~dropped & (F.col("_wm") < end + on_time)
    x = x.withColumn("_dropped", dropped).withColumn("_first", first)
    dropped, first, zero = F.col("_dropped"), F.col("_first"), F.lit(0).cast("long")
    total = lambda when, v: F.sum(F.when(when, F.col(v)).otherwise(zero))
    aggs = [total(first, "_n").alias("n_first"), total(~dropped, "_n").alias("n_final"), total(~dropped & ~first, "_n").alias("n_late"), total(dropped, "_n").alias("n_dropped")]
    for i, name in enumerate(sums):
        aggs += [total(first, f"_v{i}").alias(f"{name}_first"), total(~dropped, f"_v{i}").alias(f"{name}_final"), total(dropped, f"_v{i}").alias(f"{name}_dropped")]
    out = x.groupBy("_src", "_p").agg(*aggs, F.min(F.when(dropped, F.col("_min"))).alias("closed_at"), F.max("close_at").alias("close_at"))
    return out.withColumnsRenamed({"_src": source, "_p": "period_start"})


def verdicts(results: DataFrame, source: str) -> DataFrame:
    """From period_results(): a row `corrected` for each source and period with a late record, a row `dropped` for each with a record
    that was diverted."""
    kinds = F.array_compact(F.array(F.when(F.col("n_late") > 0, F.lit("corrected")), F.when(F.col("n_dropped") > 0, F.lit("dropped"))))
    return results.select(c(source), "period_start", F.explode(kinds).alias("verdict"))

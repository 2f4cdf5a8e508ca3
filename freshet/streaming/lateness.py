"""Streaming form of the late-event operator: periods per source, corrected by late records and closed by low watermarks.

State is kept per (source, period): sums only, so a hot period costs no more than a quiet one. Each batch's records are combined per
(source, period, class) in the tasks that read them, before anything is shuffled or reaches the state. A period's result is emitted when it
is first published and again with each correction; records beyond the cut-off are counted in `n_dropped` and change nothing, whether the
period's state is still there or not.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from freshet.operators.lateness import low_watermark, period_start, whole_div

OUT = "source long, period_start long, revision int, n_final long, packets long, bytes long, n_late long, n_dropped long"
STATE = "revision int, n_final long, packets long, bytes long, n_late long, n_dropped long"


def corrected_periods(stream: DataFrame, source: str, event: str, arrival: str, length: int, on_time: int, cutoff: int, packets: str = "in_packets", size: str = "in_bytes", delay: str = "1 hour") -> DataFrame:
    """A row for each change of a period: revision 1 is its first result, later ones are corrections.

    Records whose source, event or arrival time is NULL are left out. State is dropped once the watermark of arrivals is past the
    cut-off by `delay`. What comes for a period after that gives a row with n_dropped only, the records diverted since the row before;
    its other counts are NULL and it has no revision. Spark leaves out records that arrive more than `delay` behind the newest arrival.
    """
    zero = F.lit(0).cast("long")
    x = stream.select(F.col(source).cast("long").alias("source"), F.col(event).cast("long").alias("ev"), F.col(arrival).cast("long").alias("ar"), F.coalesce(F.col(packets), zero).alias("p"), F.coalesce(F.col(size), zero).alias("b"))
    x = x.where("source is not null and ev is not null and ar is not null").withColumn("period", period_start(F.col("ev"), length))
    end, passed = F.col("period") + length, low_watermark(F.col("ar"), length, on_time, cutoff)
    x = x.withColumn("c", F.when(passed >= end + cutoff, 2).when(passed >= end + on_time, 1).otherwise(0)).withColumn("ts", F.timestamp_millis("ar"))

    def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.groupby(["source", "period", "c"]).agg(n=("p", "size"), p=("p", "sum"), b=("b", "sum"), ts=("ts", "max")).reset_index()

    few = x.mapInPandas(combine, "source long, period long, c int, n long, p long, b long, ts timestamp").withWatermark("ts", delay)
    names = [c.split()[0] for c in OUT.split(", ")]

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ends = int(key[1]) + length + cutoff
        got = pd.concat(list(frames))
        kept = got[got["c"] < 2]
        late, dropped = int(got.loc[got["c"] == 1, "n"].sum()), int(got.loc[got["c"] == 2, "n"].sum())
        if not state.exists and state.getCurrentWatermarkMs() > ends:  # the period's result is out and forgotten, or it never had one
            yield pd.DataFrame([(*key, None, None, None, None, None, dropped + int(kept["n"].sum()))], columns=names).astype(object)
            return
        before = state.get if state.exists else (0, 0, 0, 0, 0, 0)
        now = (before[0] + 1, before[1] + int(kept["n"].sum()), before[2] + int(kept["p"].sum()), before[3] + int(kept["b"].sum()), before[4] + late, before[5] + dropped)
        state.update(now)
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*key, *now)], columns=names)

    return few.groupBy("source", "period").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def closed_periods(stream: DataFrame, source: str, event: str, arrival: str, length: int, cutoff: int, idle_timeout: int, delay: str = "1 hour") -> DataFrame:
    """A row for each period once all sources have released it: period_start, close_at, n_sources, by the rules of lateness.closures().

    A period is emitted when the watermark of arrivals, `delay` behind the newest, has passed its closing, so arrivals that are out of
    order by less don't change it. One whose first record comes when the watermark is past its cut-off gets no row: all its records are
    diverted. Only the first and last arrival of each source and slot reach the state; it is kept in one place.
    """
    if cutoff % length:
        raise ValueError("cutoff must be a multiple of length")
    x = stream.select(F.col(source).cast("long").alias("source"), F.col(event).cast("long").alias("ev"), F.col(arrival).cast("long").alias("ar"))
    x = x.where("source is not null and ev is not null and ar is not null").withColumn("ts", F.timestamp_millis("ar"))
    x = x.select("source", period_start(F.col("ev"), length).alias("period"), whole_div(F.col("ar"), length).alias("slot"), "ar", "ts")

    def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                g = f.groupby(["source", "slot", "period"]).agg(first=("ar", "min"), last=("ar", "max"), ts=("ts", "max")).reset_index()
                yield g.assign(one=0)[["one", "source", "slot", "period", "first", "last", "ts"]]

    few = x.mapInPandas(combine, "one int, source long, slot long, period long, first long, last long, ts timestamp").withWatermark("ts", delay)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        slots, waiting = pickle.loads(state.get[0]) if state.exists else ({}, set())
        now = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for f in frames:
                for s, slot, period, first, last in f[["source", "slot", "period", "first", "last"]].itertuples(index=False):
                    a, z = slots.setdefault(s, {}).get(slot, (first, last))
                    slots[s][slot] = (min(a, first), max(z, last))
                    if period + length + cutoff >= now:
                        waiting.add(period)
        out = []
        for p in sorted(waiting):
            bound = p + length + cutoff
            if bound >= now:
                break
            releases = []
            for of in slots.values():
                before = max((z for k, (_, z) in of.items() if k < bound // length), default=None)
                if before is not None:
                    after = min((a for k, (a, _) in of.items() if k >= bound // length), default=2**62)
                    releases.append(min(after, max(bound, before + idle_timeout)))
            close = max(releases, default=bound)
            if close < now:
                out.append((p, close, len(releases)))
        waiting -= {p for p, *_ in out}
        least = min([now, *(p + length + cutoff for p in waiting)]) // length
        for of in slots.values():  # of what lies before the bounds that are still to come the last slot is enough
            old = sorted(k for k in of if k < least)
            for k in old[:-1]:
                del of[k]
        state.update((pickle.dumps((slots, waiting)),))
        if waiting:
            state.setTimeoutTimestamp(now + 1)
        if out:
            yield pd.DataFrame(out, columns=["period_start", "close_at", "n_sources"])

    return few.groupBy("one").applyInPandasWithState(update, "period_start long, close_at long, n_sources long", "known binary", "append", GroupStateTimeout.EventTimeTimeout)

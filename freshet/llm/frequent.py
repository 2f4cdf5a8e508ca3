"""Most frequent items in bounded memory: lossy counting with mergeable summaries and guaranteed count intervals.

Within a task rows are taken in buckets of ceil(1/eps). An entry holds the weight counted since it was entered and `delta`, the most
that can have been missed before. At a bucket's end entries are pruned whose count + delta is at most eps times the task's weight so
far; whatever a task has dropped of an item is thus at most that bound, `missed`. Counting rows, weight means rows; for sums (bytes,
octets) it means the sum.

Task summaries merge by adding: count is the sum of the counts; an item may have lost its delta where a task reports it and the
task's `missed` where it doesn't. So lower = sum(count) and upper = lower + sum over all tasks of missed
- sum over reporting tasks of (missed - delta). That is a plain sum per item, combined map-side; the total lies within eps * total
weight of the truth. A summary has at most (1/eps) * log(eps * n) entries, however many distinct items there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUMMARY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("item", T.LongType()), *(T.StructField(x, T.LongType()) for x in ("count", "slack", "missed", "total"))])


class LossyCounter:
    """Summary of one stream of (items, weights)."""

    def __init__(self, eps: float) -> None:
        self.eps, self.total, self.missed = eps, 0, 0
        self.item, self.count, self.delta = (np.empty(0, np.int64) for _ in range(3))

    def bucket(self, items: np.ndarray, weights: np.ndarray | None) -> None:
        new, place = np.unique(items, return_inverse=True)
        got = np.bincount(place, minlength=len(new)) if weights is None else _sums(place, weights, len(new))
        at = np.searchsorted(self.item, new)
        known = np.zeros(len(new), bool)
        inside = at < len(self.item)
        known[inside] = self.item[at[inside]] == new[inside]
        self.count[at[known]] += got[known]
        fresh = ~known
        if fresh.any():
            item = np.concatenate([self.item, new[fresh]])
            order = np.argsort(item, kind="stable")
            self.count = np.concatenate([self.count, got[fresh]])[order]
            # what was seen of it before can have been no more than what was pruned at the last bucket's end
            self.delta = np.concatenate([self.delta, np.full(int(fresh.sum()), self.missed, np.int64)])[order]
            self.item = item[order]

    def prune(self) -> None:
        bound = int(self.eps * self.total)
        gone = self.count + self.delta <= bound
        if gone.any():
            self.missed = max(self.missed, int((self.count + self.delta)[gone].max()))
            keep = ~gone
            self.item, self.count, self.delta = self.item[keep], self.count[keep], self.delta[keep]


def _sums(place: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, place, weights)
    return out


def summarize(df: DataFrame, kinds: dict[str, tuple[str, str | None]], eps: float) -> DataFrame:
    """One pass for several columns: kinds maps a name to (item column, weight column or None for rows). Gives rows
    (kind, item, count, slack = missed - delta, missed, total); one row per kind and task has item NULL and carries missed and total.

    Rows with a NULL item belong to the total but to no item; NULL or negative weights count as 0.
    """
    cols = list(dict.fromkeys(x for pair in kinds.values() for x in pair if x))
    data = df.select(*[F.col(f"`{x}`").cast("long").alias(x) for x in cols])
    width = int(np.ceil(1 / eps))
    target = pa.schema([(f.name, pa.string() if f.name == "kind" else pa.int64()) for f in SUMMARY])

    def column(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
        x = b.column(name)
        return x.fill_null(0).to_numpy(zero_copy_only=False), ~x.is_null().to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = {k: LossyCounter(eps) for k in kinds}
        filled = 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                x = b.slice(at, min(width - filled, b.num_rows - at))
                at += x.num_rows
                filled += x.num_rows
                for k, (item, weight) in kinds.items():
                    items, there = column(x, item)
                    w = None
                    if weight:
                        w = np.maximum(column(x, weight)[0], 0)
                    have[k].total += x.num_rows if w is None else int(w.sum())
                    have[k].bucket(items[there], None if w is None else w[there])
                if filled == width:
                    filled = 0
                    for h in have.values():
                        h.prune()
        for k, h in have.items():
            h.prune()
            n = len(h.item)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * (n + 1)), pa.array([None, *h.item.tolist()], pa.int64()), pa.array([0, *h.count.tolist()]), pa.array([0, *(h.missed - h.delta).tolist()]), pa.array([h.missed] + [0] * n), pa.array([h.total] + [0] * n)],
                schema=target,
            )

    return data.mapInArrow(run, SUMMARY)


def merge(summaries: DataFrame) -> DataFrame:
    """Adds summaries (of tasks, days, tables): same columns again, one row per item and one with item NULL for each kind; and `head`, true
    for the latter. A task has dropped all it may by its own bound before, so what is shuffled are its (1/eps) * log(eps * n) entries."""
    return summaries.groupBy("kind", "item").agg(*[F.sum(x).alias(x) for x in ("count", "slack", "missed", "total")], F.bool_or(F.col("item").isNull()).alias("head"))


def intervals(merged: DataFrame, share: float, eps: float) -> DataFrame:
    """kind, item, lower, upper, total of every item that may have at least `share` of its kind's total; share must exceed eps.

    Each such item has a lower count of at least (share - eps) * total, so there are at most 1/(share - eps) of them per kind.
    Ties at the threshold are all kept. Where the total is 0 no item is reported.
    """
    if share <= eps:
        raise ValueError("share must exceed eps")
    # Sums of what is never negative. Said here, and `head` asked instead of the key, so that both uses below have one plan and the
    # summaries are made once.
    merged = merged.where("count >= 0 and slack >= 0 and missed >= 0 and total >= 0")
    totals = merged.where("head").select("kind", F.col("missed").alias("all_missed"), F.col("total").alias("all_total"))
    # one row per kind
    x = merged.where("not head").join(F.broadcast(totals), "kind")
    # never NULL here; said so that no test for it goes down into one of the two uses
    x = x.select("kind", F.coalesce("item", F.lit(0)).alias("item"), F.col("count").alias("lower"), (F.col("count") + F.col("all_missed") - F.col("slack")).alias("upper"), F.col("all_total").alias("total"))
    return x.where((F.col("total") > 0) & (F.col("upper") >= F.lit(share) * F.col("total")))


def verified(df: DataFrame, kinds: dict[str, tuple[str, str | None]], candidates: DataFrame) -> DataFrame:
    """candidates (at most 1/(share - eps) rows per kind) with their exact counts over all rows: kind, item, total, exact."""
    pairs = [F.struct(F.lit(k).alias("kind"), F.col(f"`{i}`").cast("long").alias("item"), (F.greatest(F.col(f"`{w}`").cast("long"), F.lit(0)) if w else F.lit(1).cast("long")).alias("w")) for k, (i, w) in kinds.items()]
    rows = df.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")
    # bounded by intervals(): some hundred rows
    return rows.join(F.broadcast(candidates.select("kind", "item", "total")), ["kind", "item"]).groupBy("kind", "item", "total").agg(F.coalesce(F.sum("w"), F.lit(0).cast("long")).alias("exact"))

"""Percentiles per group with bounded rank error: mergeable rank-interval summaries.

A summary of n values is a sorted list of tuples (value, rmin, rmax): the value stands in the sorted column at a position from rmin to
rmax. The first and last tuple are the minimum and the maximum, so for any rank r there are tuples around it, and
`rmax(next) - rmin(this)` is the uncertainty between two neighbours.

* build: a sorted run has exact ranks; tuples are left out as long as the uncertainty between neighbours stays within 2*eps*n.
* merge: ranks of the parts add up (an element's position is its own plus the positions of its neighbours in the other parts); the
  uncertainty of the result is at most the sum of the parts' uncertainties, so the relative error doesn't grow by merging.
* compress: after each merge tuples are dropped again within the error permitted at that level of the hierarchy. Levels get growing
  shares of eps, hence the error of any summary is at most eps*n, and the error it really has is carried in its tuples.
* hierarchy: whoever merges a group holds fewer than FAN_IN summaries of each level; FAN_IN of one level become one of the next.
  Memory for a group is bounded however many tasks report it.

Everything is deterministic. Summaries of days, partitions or exporters are ordinary rows and can be stored and merged later.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUFFER_ROWS = 500_000
FAN_IN = 64


def compress(v: np.ndarray, rmin: np.ndarray, rmax: np.ndarray, allowed: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keeps the first and last tuple and as few between as leave no two neighbours further apart than `allowed` ranks, except where
    they were before."""
    if len(v) <= 2:
        return v, rmin, rmax
    keep, i, n = [0], 0, len(v)
    while i < n - 1:
        j = int(np.searchsorted(rmax, rmin[i] + allowed, "right")) - 1
        i = min(max(j, i + 1), n - 1)
        keep.append(i)
    k = np.array(keep)
    return v[k], rmin[k], rmax[k]


def of_sorted(values: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(values)
    step = max(1, int(2 * eps * n))
    k = np.arange(0, n, step)
    if k[-1] != n - 1:
        k = np.append(k, n - 1)
    return values[k], k + 1, k + 1


def merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """parts: (values, rmin, rmax, n). All at once: in the common order each tuple adds its own rank step to everything after it."""
    if len(parts) == 1:
        return parts[0]
    v = np.concatenate([p[0] for p in parts])
    part = np.concatenate([np.full(len(p[0]), i) for i, p in enumerate(parts)])
    # lower ranks: what each part is known to have at or below, once its tuple is passed
    low = np.concatenate([np.diff(p[1], prepend=0) for p in parts])
    # upper ranks: before a part's first tuple nothing of it need lie below; after its last one all n do
    high = np.concatenate([np.diff(np.append(p[2] - 1, p[3])) for p in parts])
    start = sum(int(p[2][0]) - 1 for p in parts)
    order = np.lexsort((np.concatenate([np.arange(len(p[0])) for p in parts]), part, v))
    low, high = low[order], high[order]
    return v[order], np.cumsum(low), start + np.cumsum(high) - high + 1, sum(p[3] for p in parts)


def bounds(v: np.ndarray, rmin: np.ndarray, rmax: np.ndarray, rank: int) -> tuple[int, int, int, int]:
    """(lower, upper, estimate, error): the value of that rank lies within lower..upper; the estimate's rank is off by error at most."""
    lo = max(int(np.searchsorted(rmax, rank, "right")) - 1, 0)
    hi = min(int(np.searchsorted(rmin, rank, "left")), len(v) - 1)
    near = np.arange(lo, hi + 1)
    off = np.maximum(np.abs(rank - rmin[near]), np.abs(rmax[near] - rank))
    best = int(near[int(np.argmin(off))])
    return int(v[lo]), int(v[hi]), int(v[best]), int(off.min())


def eps_of_level(eps: float, level: int) -> float:
    """Share of the error that summaries of a level may have: half at the leaves, ever nearer to all of it above."""
    return eps * (1 - 0.5 ** (level + 1))


class Hierarchy:
    """Summaries of one group, merged FAN_IN at a time."""

    def __init__(self, eps: float) -> None:
        self.eps, self.levels = eps, []

    def add(self, part: tuple[np.ndarray, np.ndarray, np.ndarray, int], level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(part)
        if len(self.levels[level]) == FAN_IN:
            v, lo, hi, n = merge(self.levels[level])
            self.levels[level] = []
            self.add((*compress(v, lo, hi, 2 * eps_of_level(self.eps, level + 1) * n), n), level + 1)

    def whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        v, lo, hi, n = merge([p for x in self.levels for p in x])
        return (*compress(v, lo, hi, 2 * self.eps * n), n)


def _summaries(keys: list[str], eps: float):
    """mapInArrow: rows (keys..., value) to tuples (keys..., part, n, i, v, rmin, rmax)."""

    def flush(held: list[pa.RecordBatch]) -> dict:
        df = pa.Table.from_batches(held).to_pandas()
        df = df.sort_values([*keys, "value"], kind="stable")
        out = {}
        for k, g in df.groupby(keys, sort=False, dropna=False)["value"]:
            out[k] = (*of_sorted(g.to_numpy(np.int64), eps / 2), len(g))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, rows, have = [], 0, {}

        def absorb() -> None:
            for k, s in flush(held).items():
                if k in have:
                    v, lo, hi, n = merge([have[k], s])
                    # within one task: runs are exact to eps/2 of their own length, what is dropped here adds as much again at most
                    s = (*compress(v, lo, hi, eps * n), n) if len(v) > 8 / eps else (v, lo, hi, n)
                have[k] = s
            held.clear()

        for x in batches:
            held.append(x)
            rows += x.num_rows
            if rows >= BUFFER_ROWS:
                absorb()
                rows = 0
        if rows:
            absorb()
        yield from _packed(have, keys, part)

    return run


def _packed(have: dict, keys: list[str], part: int) -> Iterator[dict]:
    for k, (v, lo, hi, n) in have.items():
        kv = k if isinstance(k, tuple) else (k,)
        # a group key of NULL arrives as NaN and makes its column one of floats
        d = {name: [None if x is None or x is pd.NA or x != x else int(x) if isinstance(x, float) and x.is_integer() else x] for name, x in zip(keys, kv)}
        yield d | {"part": [part], "n": [n], "v": [v.tolist()], "rmin": [lo.tolist()], "rmax": [hi.tolist()]}


SUMMARY_FIELDS = [T.StructField("n", T.LongType()), *(T.StructField(x, T.ArrayType(T.LongType())) for x in ("v", "rmin", "rmax"))]


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def summarize(df: DataFrame, keys: list[str], value: str, eps: float) -> DataFrame:
    """Level 0: one summary per group and task: keys..., part, n, v, rmin, rmax. NULL values are left out, NULL keys are a group."""
    x = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{value}`").cast("long").alias("value")).where("value is not null")
    schema = T.StructType([*[f for f in x.schema if f.name != "value"], T.StructField("part", T.LongType()), *SUMMARY_FIELDS])
    target = _arrow(schema)
    inner = _summaries(keys, eps)

    def run(batches):
        for d in inner(batches):
            yield pa.RecordBatch.from_pydict(d, schema=target)

    return x.mapInArrow(run, schema)


def merge_summaries(s: DataFrame, keys: list[str], eps: float) -> DataFrame:
    """One merged summary per group of `keys` (any subset of the columns), compressed to eps. Groups come sorted and are merged as they
    pass, so no task holds a group's summaries all at once."""
    schema = T.StructType([*[s.schema[k] for k in keys], *SUMMARY_FIELDS])
    target = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tree = None, Hierarchy(eps)
        rows: dict[str, list] = {f.name: [] for f in target}

        def close() -> None:
            if current is not None:
                v, lo, hi, n = tree.whole()
                for name, x in zip(rows, (*(None if k is _NAN else k for k in current), n, v, lo, hi)):
                    rows[name].append(x)

        for b in batches:
            key = list(zip(*[[_NAN if x != x else x for x in b.column(k).to_pylist()] for k in keys]))
            lists = [b.column(x) for x in ("v", "rmin", "rmax")]
            ends = [x.offsets.to_numpy() for x in lists]
            flat = [x.values.to_numpy() for x in lists]
            for i, n in enumerate(b.column("n").to_pylist()):
                if key[i] != current:
                    close()
                    current, tree = key[i], Hierarchy(eps)
                tree.add((*(f[e[i] : e[i + 1]] for f, e in zip(flat, ends)), n))
            if len(rows["n"]) >= 1000:
                yield pa.RecordBatch.from_pydict(rows, schema=target)
                rows = {f.name: [] for f in target}
        close()
        if rows["n"]:
            yield pa.RecordBatch.from_pydict(rows, schema=target)

    by = [F.col(f"`{k}`") for k in keys]
    return s.select(*by, "n", "v", "rmin", "rmax").repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


_NAN = "not a number"  # equal to itself, as a key must be


def group_summaries(df: DataFrame, keys: list[str], value: str, eps: float = 0.005) -> DataFrame:
    """One summary per group: keys..., n, v, rmin, rmax, with a rank error of at most eps*n.

    NULL values are left out; a group without values has no summary; an empty table gives none. Ties and repeated rows count each.
    Columns other than those named are not looked at.
    """
    x = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{value}`"))
    return merge_summaries(summarize(x, keys, value, eps / 2), keys, eps)


def percentiles(s: DataFrame, keys: list[str], pcts: list[int]) -> DataFrame:
    """keys..., n, pct, estimate, lower, upper, rank_error for each summary and percentile (the value number ceil(pct*n/100))."""
    out = T.StructType([*[s.schema[k] for k in keys], T.StructField("n", T.LongType()), T.StructField("pct", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in ("estimate", "lower", "upper", "rank_error"))])
    target = _arrow(out)

    def run(batches):
        for b in batches:
            rows = {f.name: [] for f in target}
            for r in b.to_pylist():
                v, lo, hi = (np.asarray(r[x], np.int64) for x in ("v", "rmin", "rmax"))
                for p in pcts:
                    low, up, est, err = bounds(v, lo, hi, max(1, -(-p * r["n"] // 100)))
                    for k, x in zip(rows, (*[r[k] for k in keys], r["n"], p, est, low, up, err)):
                        rows[k].append(x)
            yield pa.RecordBatch.from_pydict(rows, schema=target)

    return s.select(*[F.col(f"`{k}`") for k in keys], "n", "v", "rmin", "rmax").mapInArrow(run, out)

"""Sessions, intervals, late events and skew against brute force, with awkward inputs."""

import random

import pytest
from pyspark.sql import functions as F

from freshet.operators import intervals, lateness, sessions, skew

EVENTS = "k long, s long, e long, v long, session_start string, `_k` string, `a.b` int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], EVENTS)


def random_rows(seed, n=400, keys=(1, 1, 1, 2, 3, None), span=5000, longest=60):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        s = r.randrange(span)
        e = s + r.choice([0, 0, r.randrange(longest)])
        out.append((r.choice(keys), *((s, e) if r.random() < 0.9 else (e, s)), r.choice([None, 1, 5])))
    return out + [(2, None, 5, 1), (2, 7, None, 1), out[0], out[0]]


def sessions_by_hand(rows, gap):
    out = []
    for k in {r[0] for r in rows} - {None}:
        ev = sorted((min(s, e), max(s, e), v or 0) for kk, s, e, v in rows if kk == k and s is not None and e is not None)
        cur = None
        for s, e, v in ev:
            if cur is None or s > cur[1] + gap:
                cur = [s, e, 0, 0]
                out.append((k, cur))
            cur[1], cur[2], cur[3] = max(cur[1], e), cur[2] + 1, cur[3] + v
    return sorted((k, *c) for k, c in out)


@pytest.mark.parametrize("gap", [1, 10, 100, 10_000])
def test_sessions(spark, gap):
    rows = random_rows(gap)
    got = sessions.sessionize(frame(spark, rows), "k", "s", "e", gap, {"total": "v"}).collect()
    assert sorted((r.k, r.session_start, r.session_end, r.n_events, r.total) for r in got) == sessions_by_hand(rows, gap)
    assert all(r.duration == r.session_end - r.session_start for r in got)


def test_sessions_edge_of_gap_and_names(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 20, 20), ("a", 31, 31)], "`a.b` string, s long, e long")
    got = sorted((r["session_start"], r["session_end"]) for r in sessions.sessionize(df, "a.b", "s", "e", 10).collect())
    assert got == [(0, 20), (31, 31)]
    assert sessions.sessionize(df.limit(0), "a.b", "s", "e", 10).count() == 0
    with pytest.raises(ValueError):
        sessions.sessionize(df, "a.b", "s", "e", 0)


def periods_by_hand(rows):
    out = {}
    for k in {r[0] for r in rows} - {None}:
        cur = []
        for s, e in sorted((min(s, e), max(s, e)) for kk, s, e, _ in rows if kk == k and s is not None and e is not None):
            if cur and s <= cur[-1][1]:
                cur[-1][1] = max(cur[-1][1], e)
            else:
                cur.append([s, e])
        out[k] = cur
    return out


@pytest.mark.parametrize(("seed", "span", "longest", "bits"), [(1, 5000, 60, 23), (2, 800, 30, 4), (3, 10**13, 10**7, 23), (4, 300, 3, 2), (5, 200_000, 300, 4), (6, 90_000, 150, 2)])
def test_periods_and_gaps(spark, monkeypatch, seed, span, longest, bits):
    monkeypatch.setattr(intervals, "TILE_BITS", bits)
    rows = random_rows(seed, 600, span=span, longest=longest)
    by = periods_by_hand(rows)
    df = frame(spark, rows)
    if bits != 23:  # the tile's size is a default of the worker functions
        monkeypatch.setattr(intervals.canonical_runs, "__defaults__", (bits,))
    got = sorted((r.k, r.period_start, r.period_end) for r in intervals.periods(df, "k", "s", "e").collect())
    assert got == sorted((k, *p) for k, ps in by.items() for p in ps)
    got = sorted((r.k, r.gap_start, r.gap_end) for r in intervals.gaps(df, "k", "s", "e").collect())
    assert got == sorted((k, p[1], q[0]) for k, ps in by.items() for p, q in zip(ps, ps[1:]))


@pytest.mark.parametrize("seed", range(4))
def test_blocks_above_tiles(spark, monkeypatch, seed):
    """Long intervals over short ones: what lies in tiles that a larger block covers is gone, before and after zero."""
    monkeypatch.setattr(intervals, "TILE_BITS", 3)
    monkeypatch.setattr(intervals.canonical_runs, "__defaults__", (3,))
    r = random.Random(seed)
    rows = [(r.choice("ab"), (s := r.randrange(-3000, 6000)), s + r.choice([0, 0, 1, 2, r.randrange(700)]), None) for _ in range(150)]
    by = periods_by_hand(rows)
    df = spark.createDataFrame([x[:3] for x in rows], "k string, s long, e long").repartition(3)
    assert sorted(map(tuple, intervals.periods(df, "k", "s", "e").collect())) == sorted((k, *p) for k, ps in by.items() for p in ps)
    assert sorted(map(tuple, intervals.gaps(df, "k", "s", "e").collect())) == sorted((k, p[1], q[0]) for k, ps in by.items() for p, q in zip(ps, ps[1:]))


def test_an_interval_of_fifty_years_is_few_rows(spark):
    df = spark.createDataFrame([("x", 1, 1_710_000_000_000), ("y", 10**17, 10**17 + 5), ("z", 2**61, 2**61 + 1)], "k string, s long, e long")
    assert intervals._tile_runs(df, "k", "s", "e").where("k = 'x'").count() < 200
    assert sorted(map(tuple, intervals.periods(df, "k", "s", "e").collect())) == [("x", 1, 1_710_000_000_000), ("y", 10**17, 10**17 + 5)]


def test_touching_intervals(spark):
    df = spark.createDataFrame([("x", 1, 5), ("x", 5, 9), ("x", 10, 10), ("y", 3, 3)], "k string, s long, e long")
    assert sorted(map(tuple, intervals.periods(df, "k", "s", "e").collect())) == [("x", 1, 9), ("x", 10, 10), ("y", 3, 3)]
    assert list(map(tuple, intervals.gaps(df, "k", "s", "e").collect())) == [("x", 9, 10)]
    assert intervals.periods(df.limit(0), "k", "s", "e").count() == 0
    assert intervals.gaps(df.limit(0), "k", "s", "e").count() == 0


def test_dyadic_blocks_are_canonical():
    import numpy as np

    r = random.Random(5)
    for _ in range(50):
        a = r.randrange(60)
        b = r.randrange(a + 1, 65)
        levels = intervals.dyadic_blocks(np.zeros(1, np.int64), np.array([a]), np.array([b]), 6)
        cells = sorted(c for lv, xs in enumerate(levels) for x in xs for c in range(x << lv, (x + 1) << lv))
        assert cells == list(range(a, b))
        merged = intervals.merged_upward(intervals.without_covered(levels), 6)
        for lv, xs in enumerate(merged[:-1]):
            assert not any(x % 2 == 0 and x + 1 in set(xs.tolist()) for x in xs.tolist())


LATE = dict(length=100, on_time=10, cutoff=200)


def test_late_events(spark):
    rows = [(1, 5, 50, 1), (1, 99, 110, 1), (1, 99, 111, 1), (1, 0, 300, 1), (1, 0, 301, 4), (1, 100, 100, 1), (2, 50, 5, None), (None, 1, 1, 1), (1, None, 1, 1), (1, 1, None, 1)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "src int, ev long, ar long, v long, period_start string")
    res = lateness.period_results(df, "src", "ev", "ar", **LATE, sums={"v": "v"})
    got = {(r.src, r.period_start): r for r in res.collect()}
    r = got[1, 0]
    assert (r.n_first, r.n_final, r.n_late, r.n_dropped, r.v_first, r.v_final, r.v_dropped, r.closed_at) == (2, 4, 2, 1, 2, 4, 4, 301)
    assert (got[2, 0].n_first, got[2, 0].v_first) == (1, 0)
    assert len(got) == 3
    assert sorted(map(tuple, lateness.verdicts(res, "src").collect())) == [(1, 0, "corrected"), (1, 0, "dropped")]
    assert lateness.period_results(df.limit(0), "src", "ev", "ar", **LATE).count() == 0


def closures_by_hand(rows, length, cutoff, idle):
    out = {}
    for p in {ev - ev % length for _, ev, _ in rows}:
        bound, ends, n = p + length + cutoff, [], 0
        for s in {r[0] for r in rows}:
            before = [a for k, _, a in rows if k == s and a < bound]
            after = [a for k, _, a in rows if k == s and a >= bound]
            if before:
                n += 1
                ends.append(min([max(bound, max(before) + idle), *([min(after)] if after else [])]))
        out[p] = (max(ends) if ends else bound, n)
    return out


def test_closures(spark):
    r = random.Random(2)
    rows = [(r.randrange(4), ev := r.randrange(3000), ev + r.randrange(600)) for _ in range(200)]
    df = spark.createDataFrame(rows, "src int, ev long, ar long")
    got = {x.period_start: (x.close_at, x.n_sources) for x in lateness.closures(df, "src", "ev", "ar", 100, 200, 150).collect()}
    assert got == closures_by_hand(rows, 100, 200, 150)
    with pytest.raises(ValueError):
        lateness.closures(df, "src", "ev", "ar", 100, 150, 1)


def test_salted_aggregate(spark):
    r = random.Random(3)
    rows = [(r.choice([7, 7, 7, 7, None, r.randrange(1000)]), r.randrange(10)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k int, v int")
    aggs = [skew.count_rows(), skew.Partial("s", F.sum("v")), skew.Partial("m", F.max("v"), "max"), skew.Partial("lo", F.min("v"), "min")]
    got = {x.k: (x.n_rows, x.s, x.m, x.lo) for x in skew.salted_aggregate(df, ["k"], aggs, salts=8).collect()}
    want = {}
    for k, v in rows:
        n, s, m, lo = want.get(k, (0, 0, -1, 99))
        want[k] = (n + 1, s + v, max(m, v), min(lo, v))
    assert got == want
    assert skew.salted_aggregate(df.limit(0), ["k"], aggs).count() == 0
    assert skew.hot_buckets(df, ["k"], 64, 0.3).count() == 1


def test_salted_aggregate_per_space(spark):
    df = spark.createDataFrame([("a", 1)] * 50 + [("b", i) for i in range(50)], "f string, k long")
    got = {(x.f, x.k): x.n_rows for x in skew.salted_aggregate(df, ["f", "k"], [skew.count_rows()], per=["f"]).collect()}
    assert got == {("a", 1): 50, **{("b", i): 1 for i in range(50)}}

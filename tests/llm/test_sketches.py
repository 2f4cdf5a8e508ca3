"""Percentiles, frequent items and distinct counts against exact results, with awkward inputs."""

import math
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("freshet.llm")
from freshet.llm import distinct, frequent, quantiles  # noqa: E402


def true_bounds_hold(values, v, lo, hi):
    """Every tuple's value stands somewhere between its ranks."""
    s = np.sort(values)
    first, last = np.searchsorted(s, v, "left") + 1, np.searchsorted(s, v, "right")
    assert (lo <= last).all() and (hi >= first).all() and (lo <= hi).all()


@pytest.mark.parametrize("kind", ["spread", "ties", "equal", "sorted"])
def test_merge_and_compress_keep_bounds(kind):
    r = np.random.default_rng(1)
    parts, everything = [], []
    for i in range(30):
        n = int(r.integers(1, 900))
        x = {"spread": r.integers(0, 10**9, n), "ties": r.integers(0, 5, n), "equal": np.full(n, 7), "sorted": np.arange(n) + 1000 * i}[kind]
        everything.append(x)
        parts.append((*quantiles.of_sorted(np.sort(x), 0.01), n))
    every = np.concatenate(everything)
    v, lo, hi, n = quantiles.merge(parts)
    assert n == len(every) and v[0] == every.min() and v[-1] == every.max()
    true_bounds_hold(every, v, lo, hi)
    v, lo, hi = quantiles.compress(v, lo, hi, 2 * 0.02 * n)
    true_bounds_hold(every, v, lo, hi)
    assert (lo[1:] - 0 >= 1).all() and (hi[1:] - lo[:-1] <= 2 * 0.02 * n + 1).all()
    s = np.sort(every)
    for p in (1, 10, 50, 90, 99, 100):
        rank = max(1, math.ceil(p * n / 100))
        low, up, est, err = quantiles.bounds(v, lo, hi, rank)
        assert low <= s[rank - 1] <= up and err <= 2 * 0.02 * n + 1


def test_group_summaries(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, r.randrange(1000), r.randrange(10**12)]), "x") for _ in range(4000)] + [("c", 5, "x"), ("d", None, "x")]
    df = spark.createDataFrame(rows, "g string, value long, n string").repartition(7)
    s = quantiles.group_summaries(df, ["g"], "value", 0.01)
    got = {(x.g, x.pct): x for x in quantiles.percentiles(s, ["g"], [50, 99]).collect()}
    for g in ("a", "b", None, "c"):
        vals = sorted(v for k, v, _ in rows if k == g and v is not None)
        for p in (50, 99):
            x = got[g, p]
            assert x.n == len(vals) and x.lower <= vals[math.ceil(p * len(vals) / 100) - 1] <= x.upper and x.rank_error <= 0.01 * len(vals) + 1
    assert not any(k[0] == "d" for k in got)
    assert quantiles.group_summaries(df.limit(0), ["g"], "value").count() == 0


def test_hierarchy_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FAN_IN", 3)
    df = spark.range(20_000).selectExpr("cast(id % 2 as int) as k", "id * 37 % 20000 as value").repartition(20)
    s = quantiles.group_summaries(df, ["k"], "value", 0.01)
    for x in quantiles.percentiles(s, ["k"], [50]).collect():
        true = 10_000 if x.k else 9_998
        assert x.n == 10_000 and abs(x.estimate - true) <= 0.01 * 20_000 + 2 and x.lower <= x.upper


def test_summaries_of_days_merge(spark):
    df = spark.range(3000).selectExpr("id % 3 as day", "id as value")
    s = quantiles.group_summaries(df, ["day"], "value", 0.01)
    one = quantiles.percentiles(quantiles.merge_summaries(s.selectExpr("0 as whole", "n", "v", "rmin", "rmax"), ["whole"], 0.01), ["whole"], [50]).first()
    assert one.n == 3000 and one.lower <= 1499 <= one.upper


def test_lossy_counter_bounds():
    r = np.random.default_rng(2)
    eps = 0.01
    items = np.concatenate([np.full(900, 1), np.full(300, 2), r.integers(10, 10**6, 8800)])
    r.shuffle(items)
    c = frequent.LossyCounter(eps)
    for i in range(0, len(items), 100):
        part = items[i : i + 100]
        c.total += len(part)
        c.bucket(part, None)
        c.prune()
    true = Counter(items.tolist())
    have = dict(zip(c.item.tolist(), zip(c.count.tolist(), c.delta.tolist())))
    assert {1, 2} <= set(have) and len(have) < 1 / eps * math.log(eps * len(items)) * 2
    assert c.missed <= eps * len(items)
    for k, n in true.items():
        lo, d = have.get(k, (0, c.missed))
        assert lo <= n <= lo + d


@pytest.mark.parametrize("parts", [1, 5])
def test_frequent_items(spark, parts):
    r = random.Random(6)
    rows = [(r.choice([1, 1, 2, 3, None, r.randrange(10**6)]), r.choice([None, -5, 0, 10, 1000]), "x") for _ in range(6000)]
    df = spark.createDataFrame(rows, "src long, w long, kind string").repartition(parts)
    kinds = {"rows": ("src", None), "weight": ("src", "w")}
    got = frequent.intervals(frequent.merge(frequent.summarize(df, kinds, 0.002)), 0.05, 0.002)
    exact = {(x.kind, x.item): x for x in frequent.verified(df, kinds, got).collect()}
    rowsn, weight = Counter(k for k, _, _ in rows if k is not None), Counter()
    for k, w, _ in rows:
        if k is not None:
            weight[k] += max(w or 0, 0)
    allw = sum(max(w or 0, 0) for _, w, _ in rows)
    for x in got.collect():
        true = (rowsn if x.kind == "rows" else weight)[x.item]
        assert x.lower <= true <= x.upper and exact[x.kind, x.item].exact == true and x.total == (6000 if x.kind == "rows" else allw)
    for k, n in rowsn.items():
        assert (("rows", k) in exact) >= (n >= 300)
    for k, n in weight.items():
        assert (("weight", k) in exact) >= (n >= 0.05 * allw)


def test_frequent_items_of_nothing(spark):
    df = spark.createDataFrame([(None, None)], "src long, w long")
    kinds = {"rows": ("src", None), "weight": ("src", "w")}
    for x in (df, df.limit(0)):
        assert frequent.intervals(frequent.merge(frequent.summarize(x, kinds, 0.01)), 0.1, 0.01).count() == 0
    with pytest.raises(ValueError):
        frequent.intervals(df, 0.01, 0.01)


def test_distinct_counts(spark):
    sizes = {"none": 0, "one": 1, "some": 900, "many": 60_000}
    df = spark.range(70_000).selectExpr("explode(array('none', 'one', 'some', 'many')) as g", "id").selectExpr("g", "case g when 'none' then null when 'one' then 5 when 'some' then id % 900 else id % 60000 end as v", "'x' as field", "1 as n_rows")
    parts = distinct.build(df.repartition(5), ["g"], ["v"])
    got = {x.g: x for x in distinct.bounded(distinct.estimate(parts, ["g"])).collect()}
    for g, n in sizes.items():
        assert got[g].n_rows == 70_000 and got[g].lower <= n <= got[g].upper
        assert abs(got[g].n_distinct - n) <= 0.05 * n + 1
    assert got["many"].base > 0 and got["some"].base == 0
    every = distinct.estimate(distinct.merge(parts, []), []).first()
    assert abs(every.n_distinct - 60_000) < 3000 and every.n_rows == 280_000
    assert distinct.estimate(distinct.build(df.limit(0), ["g"], ["v"]), ["g"]).count() == 0


def test_bitmaps_of_parts_are_bitmaps_of_the_whole(spark):
    df = spark.range(5000).selectExpr("id % 7 as k", "id % 1234 as v")
    whole = distinct.merge(distinct.build(df, [], ["v"]), [])
    parts = distinct.merge(distinct.build(df, ["k"], ["v"]), [])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))

"""The queries of the llm folder against their SQL, or against brute force where SQL can't say it."""

import math
from collections import Counter

import pytest

pytest.importorskip("freshet.llm")
from freshet.llm import leaks, queries  # noqa: E402
from tests.oracle import database, same  # noqa: E402

Q, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    same(spark, database(sf), Q[name], SQL[name], sf)


def test_percentiles_hold(spark, sf):
    db = database(sf)
    values = {}
    for e, day, b, p in db.execute("select exporter_id, strftime(make_timestamp(first_ms * 1000), '%Y-%m-%d'), in_bytes, in_packets from flows where first_ms <> 0 and last_ms <> 0").fetchall():
        for key in ((e, day), (e, None), (None, day), (None, None)):
            values.setdefault((*key, "in_bytes"), []).append(b)
            values.setdefault((*key, "in_packets"), []).append(p)
    values = {k: sorted(x for x in v if x is not None) for k, v in values.items()}
    got = Q["p1_percentiles"](spark, sf).collect()
    assert {(r.exporter_id, r.flow_day, r.metric) for r in got} == {k for k, v in values.items() if v}
    for r in got:
        v = values[r.exporter_id, r.flow_day, r.metric]
        assert r.n == len(v) and r.lower <= v[math.ceil(r.pct * len(v) / 100) - 1] <= r.upper and r.rank_error <= queries.PCT_EPS * r.n + 1


def test_intervals_hold(spark, sf):
    db = database(sf)
    rows = db.execute("select srcaddr, dstaddr, doctets from v1_records").fetchall()
    true = {"srcaddr": Counter(r[0] for r in rows), "dstaddr": Counter(r[1] for r in rows), "dstaddr_octets": Counter()}
    for _, d, o in rows:
        true["dstaddr_octets"][d] += o or 0
    for r in Q["p2_intervals"](spark, sf).collect():
        assert r.lower <= true[r.kind][r.item] <= r.upper


def test_distinct_bounds_hold(spark, sf):
    db = database(sf)
    want = {}
    for f in ("srcaddr", "dstaddr"):
        for e, day, n in db.execute(f"select exporter_id, strftime(make_timestamp(received_ms * 1000), '%Y-%m-%d') d, count(distinct {f}) from v1_records where received_ms is not null group by grouping sets ((exporter_id, d), (exporter_id), (d), ())").fetchall():
            want[e, day, f] = n
    got = {(r.exporter_id, r.rec_day, r.field): r for r in Q["p6_counts"](spark, sf).collect()}
    assert set(got) == set(want) and all(got[k].lower <= n <= got[k].upper for k, n in want.items())


def test_leaks_by_hand(spark, sf):
    db = database(sf)
    grams: dict[tuple, set] = {}
    for i, p in db.execute("select item_id, passage from eval_items").fetchall():
        w = leaks.words(p)
        for k in range(len(w) - leaks.N + 1):
            grams.setdefault(tuple(w[k : k + leaks.N]), set()).add(i)
    want = set()
    for d, t in db.execute("select doc_id, text from documents where text is not null").fetchall():
        w = leaks.words(t)
        for k in range(len(w) - leaks.N + 1):
            want |= {(d, i) for i in grams.get(tuple(w[k : k + leaks.N]), ())}
    assert {tuple(r) for r in Q["p9_found"](spark, sf).collect()} == want
    assert {(r.doc_id, r.item_id) for r in Q["p9_spans"](spark, sf).collect()} == want


def test_packing_holds_all_texts(spark, sf):
    db = database(sf)
    size = dict(db.execute("select doc_id, strlen(text) + 1 from documents where text is not null").fetchall())
    caps = dict(db.execute("select container_class, capacity_tokens from containers").fetchall())
    full, seen = Counter(), Counter()
    for r in Q["p8_assign"](spark, sf).collect():
        full[r.container_class, r.container_id] += r.size
        seen[r.container_class, r.doc_id] += r.size
    assert seen == Counter({(c, d): n for c in caps for d, n in size.items()})
    assert all(n <= caps[c] for (c, _), n in full.items())
    for r in Q["p8_fill"](spark, sf).collect():
        assert r.n_containers <= math.ceil(r.tokens / caps[r.container_class]) * 1.2 + 2


def test_segments_are_whole(spark, sf):
    db = database(sf)
    long_ = {d: sum(len(x) for x in t.split("\n") if len(x) >= 60) for d, t in db.execute("select doc_id, text from documents where text is not null").fetchall()}
    got = Counter()
    rows = Q["p10_segments"](spark, sf).collect()
    for r in rows:
        got[r.doc_id] += r.n_chars
    assert got == Counter({d: n for d, n in long_.items() if n})
    named = [r for r in rows if r.named and r.n_langs == 1]
    assert sum(r.named == r.lang for r in named) > 0.85 * len(named)


@pytest.mark.parametrize("name", ["p9_cleaned", "p10_documents", "p10_found"])
def test_runs(spark, sf, name):
    assert Q[name](spark, sf).count() > 0

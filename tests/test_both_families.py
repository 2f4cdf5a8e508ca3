"""Queries over flows of both families whose addresses SQL can't print: against ipaddress and sums in Python."""

import ipaddress
from collections import defaultdict

import pytest

from freshet.plans import flows


@pytest.fixture(scope="module")
def rows(spark, sf):
    return spark.read.parquet(f"{sf}/flows.parquet").collect()


def text(r, side):
    v4, v6 = r[f"{side}4"], r[f"{side}6"]
    return str(ipaddress.IPv4Address(v4)) if v4 is not None else str(ipaddress.IPv6Address(bytes(v6))) if v6 is not None else None


def top(rows, sides, by, n):
    """Values of the first n; sources at the end may tie, so their names are compared above the last value only."""
    t = defaultdict(int)
    for r in rows:
        for s in sides:
            if (k := text(r, s)) is not None:
                t[k] += (r.in_bytes or 0) if by == "bytes" else (r.cnt_flows or 1)
    best = sorted(t.items(), key=lambda x: -x[1])[:n]
    return [v for _, v in best], {(k, v) for k, v in best if v > best[-1][1]}


def test_statistics(spark, sf, rows):
    for name, some, sides, by, n in (("stat_srcip_https", [r for r in rows if r.proto == 6 and r.dst_port == 443], ["src"], "bytes", 10), ("stat_ip_flows", rows, ["src", "dst"], "flows", 20)):
        got = flows.queries()[name](spark, sf).orderBy("rank").collect()
        values, names = top(some, sides, by, n)
        assert [r[by] for r in got] == values
        assert names <= {(r.key, r[by]) for r in got}


def test_an_ipv6_source_can_lead(spark, sf, tmp_path):
    """The largest IPv6 flow over HTTPS is made the largest of all."""
    f = spark.read.parquet(f"{sf}/flows.parquet")
    one = f.where("src6 is not null and proto = 6 and dst_port = 443").orderBy("rec_no").limit(1).selectExpr("* except (in_bytes)", "cast(1e12 as bigint) in_bytes")
    f.unionByName(one).write.parquet(str(tmp_path / "flows.parquet"))
    first = flows.stat_srcip_https(spark, str(tmp_path)).where("rank = 1").first()
    assert ipaddress.ip_address(first.key).version == 6 and first.bytes >= 10**12


def test_csv_has_every_flow(spark, sf, rows):
    got = flows.out_csv_fast(spark, sf).collect()
    assert len(got) == len(rows) and sum(r.af == 6 for r in got) == sum(r.src6 is not None for r in rows) > 0
    want = sorted((r.rec_no or 0, text(r, "src") or "0.0.0.0", text(r, "dst") or "0.0.0.0") for r in rows)
    assert sorted((r.cnt, r.srcAddr, r.dstAddr) for r in got) == want

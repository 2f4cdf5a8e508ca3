"""Aggregation, statistics, totals, lookups and output on small hand-made tables."""

import json

import pytest
from pyspark.sql import functions as F

from freshet.api import Flows
from freshet.operators import aggregate as agg
from freshet.operators import enrich, stat, summary
from freshet.output import json as json_out
from freshet.output import tokens
from freshet.schema import SCHEMA, conform, normalise

A, B = 0x0A000001, 0x0A000002


def flows(spark, rows):
    return spark.createDataFrame([tuple(({"rec_no": i} | r).get(f.name) for f in SCHEMA) for i, r in enumerate(rows, 1)], SCHEMA)


def base(**k):
    return dict(first_ms=1000, last_ms=3000, received_ms=4000, in_packets=10, in_bytes=1000, src_port=1000, dst_port=80, proto=6, tcp_flags=2, src4=A, dst4=B) | k


def test_bidirectional_merges_pairs(spark):
    rows = [base(), base(src4=B, dst4=A, src_port=80, dst_port=1000, in_packets=5, in_bytes=50, tcp_flags=16, last_ms=9000), base(proto=1), base(src4=B, dst4=A, proto=1, src_port=80, dst_port=1000), base(src4=B, dst4=A, src_port=53, dst_port=7, proto=17, rec_no=1), base(src_port=7, dst_port=53, proto=17, rec_no=2)]
    got = {(r.src4, r.src_port, r.proto): r for r in agg.bidirectional(flows(spark, rows)).collect()}
    t = got[A, 1000, 6]
    assert (t.in_packets, t.out_packets, t.in_bytes, t.out_bytes, t.tcp_flags, t.last_ms, t.cnt_flows) == (10, 5, 1000, 50, 18, 9000, 2)
    assert len(got) == 4 and (B, 53, 17) in got  # ICMP stays apart; the first record says which way is forward
    assert agg.bidirectional(flows(spark, []).limit(0)).count() == 0


def test_guess_direction(spark):
    rows = [base(src_port=80, dst_port=50000, in_packets=3, in_bytes=30), base(src_port=50000, dst_port=80), base(src_port=80, dst_port=50000, proto=1)]
    got = agg.guess_direction(agg.aggregate(flows(spark, rows))).collect()
    assert sorted((r.proto, r.src_port, r.in_packets, r.out_packets) for r in got) == [(1, 80, 10, 0), (6, 50000, 0, 3), (6, 50000, 10, 0)]


def test_aggregation_keys(spark):
    f = flows(spark, [base(src4=0x0A0101FF), base(src4=0x0A010101, cnt_flows=5), base(src4=None), base(mpls=[16 * 7, 1])])
    got = {(r.src4, r.mpls1): r.cnt_flows for r in agg.aggregate(f, "srcip4/24,mpls1").collect()}
    assert got == {(0x0A010100, None): 6, (None, None): 1, (0x0A000000, 7): 1}
    first = agg.aggregate(f, "proto", first=["src4", "dst_port"]).first()
    assert (first.src4, first.dst_port) == (0x0A0101FF, 80)
    for bad in ("nothing", "proto,proto", "proto/8", "srcip4/40", "srcip/24", ","):
        with pytest.raises(ValueError):
            agg.aggregate(f, bad)
    net = agg.aggregate(flows(spark, [base(src_mask=8), base(src4=0x0A020202, src_mask=8), base(src_mask=0), base(src4=None, src6=bytes.fromhex("20010db8ffff") + bytes(10), src_mask=36)]), "srcnet").collect()
    assert sorted((r.src4 if r.src4 is not None else -1, r.src6.hex() if r.src6 else "") for r in net) == [(-1, "20010db8f" + "0" * 23), (0, ""), (0x0A000000, "")]


def test_every_order(spark):
    g = agg.aggregate(flows(spark, [base(), base(src4=B, in_packets=0, in_bytes=0, last_ms=1000), base(src4=5, out_packets=7, out_bytes=70)]))
    for o in agg.ORDERS:
        assert agg.ordered(g, o, ["src4"]).count() == 3
    assert [r.src4 for r in agg.ordered(g, "bytes", ["src4"]).collect()] == [5, A, B] and [r.src4 for r in agg.ordered(g, "bytes:a", ["src4"]).collect()] == [B, A, 5]
    with pytest.raises(ValueError):
        agg.ordered(g, "colour")


def test_every_statistic(spark):
    f = flows(spark, [base(), base(src4=None, dst4=None, src6=bytes(15) + b"\1", dst6=bytes(15) + b"\2"), base(nbar_id=b"\1\2\3\4", in_src_mac=5, ingress_acl=[1, 2, 3], fw_event=2)])
    names = [n for n in stat.ELEMENTS if n not in ("srcgeo", "dstgeo", "geo", "ja3", "ja4", "ja4s")]
    for i in range(0, len(names), 8):
        got = {r.stat for r in stat.statistics(f, names[i : i + 8]).collect()}
        for n in names[i : i + 8]:
            assert (n in got) or stat.ELEMENTS[n][0] in ("ip", "mac", "hex", "list")
    top = stat.top_n(f, ["ip/flows", "srcip:p/bytes"], 10).collect()
    ips = {r.key: r.flows for r in top if r.stat == "ip"}
    assert ips == {"10.0.0.1": 2, "10.0.0.2": 2, "::1": 1, "::2": 1}
    assert {r.proto for r in top if r.stat == "srcip:p"} == {6}
    for o in stat.ORDERS:
        assert stat.top_n(f, [f"proto/{o}"], 1).count() == 1
    assert stat.top_n(f.limit(0), ["proto"], 5).count() == 0
    for bad in ("nothing", "srcip/colour", "srcip:x"):
        with pytest.raises(ValueError):
            stat.parse_request(bad)
    with pytest.raises(ValueError):
        stat.statistics(f, ["proto"] * 9)


def test_totals(spark):
    f = flows(spark, [base(), base(proto=17, in_packets=None), base(proto=58), base(proto=47, first_ms=0, last_ms=0), base(proto=None, received_ms=None)])
    s = summary.summary(f).first()
    assert (s.flows, s.flows_tcp, s.flows_udp, s.flows_icmp, s.flows_other, s.packets, s.packets_udp, s.first_ms) == (5, 1, 1, 1, 2, 40, 0, 1000)
    assert summary.summary(f.limit(0)).first().flows == 0
    assert [r.slot_ms for r in summary.per_slot(f).collect()] == [0]
    ch = {r.channel: r.flows for r in summary.profile(f, {"tcp": "proto tcp", "all": "any", "none": "port 1"}).collect()}
    assert ch == {"tcp": 1, "all": 4}
    line = summary.line_protocol(summary.profile(f, {"a b": "any"}).select("channel", "slot_ms", "flows"), "flow", ["channel"]).first()[0]
    assert line == "flow,channel=a\\ b flows=4i 0"


def test_rolling_day(spark):
    s = spark.createDataFrame([(t * 300_000, 6, 80, 1, 2, 3) for t in (0, 1, 287, 288, 600)], "slot_ms long, proto int, dst_port int, flows long, packets long, bytes long")
    assert [r.flows_day for r in summary.rolling_ports(s).orderBy("slot_ms").collect()] == [1, 2, 3, 3, 1]


def test_sequence_gaps(spark):
    p = spark.createDataFrame([(1, 0, 10, 1), (1, 10, 5, 2), (1, 18, 5, 3), (1, 20, 5, 4), (2, 2**32 - 3, 5, 1), (2, 2, 1, 2)], "e int, s long, n long, t long")
    for slot in (1, 2, 300_000):
        assert sorted(map(tuple, summary.sequence_gaps(p, "e", "s", "n", "t", slot=slot).collect())) == [(1, 4, 2, 3), (2, 2, 0, 0)]


def test_lookups(spark):
    f = spark.createDataFrame([(0x0A010101, 1), (0x0A020202, 0), (0x0B000000, None), (None, 9)], "src4 long, src_as long")
    b = enrich.with_prefixes4(spark.createDataFrame([(0x0A000000, 0x0AFFFFFF, 1), (0x0A010000, 0x0A01FFFF, 2)], "net_start long, net_end long, location_id long"))
    places = spark.createDataFrame([(1, "AA"), (2, "BB")], "location_id long, country string")
    assert [r.src_geo for r in enrich.geo(f, "src4", b, places, "src_geo").orderBy(F.col("src4").asc_nulls_last()).collect()] == ["BB", "AA", "..", None]
    assert sorted(r.src_as for r in enrich.as_number(f, "src4", b.withColumnRenamed("location_id", "asn"), "src_as").collect()) == [0, 1, 1, 9]
    six = enrich.with_prefixes6(spark.createDataFrame([(bytes.fromhex("20010db8") + bytes(12), bytes.fromhex("20010db8") + b"\xff" * 12, 5), (bytes.fromhex("20010db880") + bytes(11), bytes.fromhex("20010db8ff") + b"\xff" * 11, 6)], "net_start binary, net_end binary, location_id long"))
    assert sorted(r.prefix_len for r in six.collect()) == [32, 33]
    g = spark.createDataFrame([(bytes.fromhex("20010db8") + bytes(12),), (bytes.fromhex("20010db890") + bytes(11),), (bytes(16),), (None,)], "src6 binary")
    assert sorted((x.loc or 0) for x in enrich.longest_prefix(g, "src6", six, {"location_id": "loc"}, family=6).collect()) == [0, 0, 5, 6]
    assert enrich.longest_prefix(f, "src4", b.limit(0), {"location_id": "loc"}).where("loc is not null").count() == 0
    w = enrich.whois(spark, ["10.1.0.9", "11.0.0.1"], b, places, b.select("net_start", "prefix_len", F.col("location_id").alias("asn"), F.lit("Org").alias("org")), spark.createDataFrame([(0x0A010009, [])], "ip long, intervals array<struct<first: long, last: long>>"))
    assert sorted((r.ip, r.country, r.asn, r.exit_intervals is not None) for r in w.collect()) == [("10.1.0.9", "BB", 2, True), ("11.0.0.1", "..", None, False)]
    orgs = spark.createDataFrame([(1, "One"), (1, "Uno")], "asn long, org string")
    assert sorted(r.o for r in enrich.as_organisation(f, "src_as", orgs, "o").collect()) == ["One", "not found", "not found", "not found"]


@pytest.mark.parametrize("family", [4, 6])
def test_prefixes_by_search_and_by_join(spark, monkeypatch, family):
    """Nested and repeated prefixes of any length, both ways, against a walk over all of them."""
    import ipaddress
    import random

    r = random.Random(family)
    width, low = (32, 0x0A000000) if family == 4 else (128, 0x20010DB8 << 96)
    own = lambda n: n if family == 4 else n.to_bytes(16, "big")
    address = lambda: low + (r.randrange(1 << 10) << (width - 18))
    nets = [(a >> (width - n) << (width - n), n, r.randrange(5)) for a, n in ((address(), r.choice([0, 7, 9, 12, 14, 16, 18])) for _ in range(60))] + [((1 << width) - 4 >> 2 << 2, width - 2, 9)]
    nets += [(a, n, v + 1) for a, n, v in nets[:5]]
    prefixes = spark.createDataFrame([(own(a), n, v) for a, n, v in nets], f"net_start {'long' if family == 4 else 'binary'}, prefix_len int, v int")
    asked = [address() + r.randrange(100) for _ in range(200)] + [0, (1 << width) - 1, low - 1]
    flows = spark.createDataFrame([(i, own(a)) for i, a in enumerate(asked)] + [(9999, None)], f"i int, `a.b` {'long' if family == 4 else 'binary'}").withColumnRenamed("a.b", "a")
    want = {9999: None}
    for i, a in enumerate(asked):
        held = [(n, v) for net, n, v in nets if a >> (width - n) == net >> (width - n)]
        want[i] = max(held)[1] if held else None
    find = lambda: {x.i: x.found for x in enrich.longest_prefix(flows, "a", prefixes, {"v": "found"}, family).collect()}
    assert find() == want and ipaddress
    monkeypatch.setattr(enrich, "MAX_PREFIXES", 0)
    assert find() == want


def test_lookups_on_demand(spark):
    b = enrich.with_prefixes4(spark.createDataFrame([(0x0A000000, 0x0AFFFFFF, 1), (0x0A010000, 0x0A01FFFF, 2)], "net_start long, net_end long, location_id long"))
    places = spark.createDataFrame([(1, "AA", "Aton"), (2, "BB", "Bton")], "location_id long, country string, city string")
    numbers = b.select("net_start", "prefix_len", F.lit(64999).alias("asn"), F.lit("Net").alias("org"))
    exits = spark.createDataFrame([(0x0A010101, [(0, 10)])], "ip long, intervals array<struct<first: long, last: long>>")
    f = spark.createDataFrame([(1, 0x0A010101, 0x0A020202, 5, 0, 1000, 2000), (2, 0x0B000000, 0x0A010101, None, 7, 1000, 2000)], "rec_no long, src4 long, dst4 long, src_as long, dst_as long, first_ms long, last_ms long")
    know = Flows(f, lookups=enrich.Lookups(places, b, None, numbers, None, exits))
    seen = lambda text: sorted(r.rec_no for r in know.filter(text).df.collect())
    assert (seen("src geo BB"), seen("geo BB"), seen("not geo AA"), seen("ip tor"), seen("src ip tor"), seen("as 64999"), seen("src as 0")) == ([1], [1, 2], [2], [1, 2], [1], [1], [2])
    assert {(r.key, r.flows) for r in know.stat("srcgeo/flows").collect()} == {("BB", 1), ("..", 1)}
    assert sorted(r.src_geo for r in know.aggregate("srcgeo").df.collect()) == ["..", "BB"]
    assert sorted(r.line for r in know.fmt("fmt:%sc %dasn %stor %sloc".removeprefix("fmt:")).collect())[1].split() == ["BB", "Net", "EX", "BB/Bton"]
    bare = Flows(f)
    for ask in (lambda: bare.filter("geo BB"), lambda: bare.filter("not ip tor"), lambda: bare.stat("geo/bytes"), lambda: bare.aggregate("dstgeo")):
        with pytest.raises(ValueError):
            ask()
    assert bare.filter("src as 5").df.count() == 1 and bare.fmt("%sc").first().line.strip() == ".."


def test_tor_and_sampling(spark):
    day = 86_400
    seen = spark.createDataFrame([(7, t) for t in (0, day, 5 * day)] + [(8, 100)], "ip long, seen long")
    ex = enrich.tor_intervals(seen)
    assert {r.ip: [(v["first"], v["last"]) for v in r.intervals] for r in ex.collect()} == {7: [(0, day), (5 * day, 5 * day)], 8: [(100, 100)]}
    f = spark.createDataFrame([(7, day * 1000, day * 1000), (7, 4 * day * 1000, 4 * day * 1000), (9, 0, 0), (None, 0, 0)], "src4 long, first_ms long, last_ms long")
    assert [r.t for r in enrich.tor(f, "src4", ex, "t").orderBy(F.col("src4").asc_nulls_last(), "first_ms").collect()] == ["EX", "ex", "..", None]
    s = spark.createDataFrame([(1, -2, 1, 9), (1, -1, 1, 1), (2, 5, 10, 90), (2, -3, 1, 0), (3, 4, 1, 3)], "sysid int, id long, packet_interval long, space_interval long")
    g = spark.createDataFrame([(1, None, 10), (2, 5, 10), (3, 4, 10), (3, 6, 10), (4, None, None)], "exporter_id int, selector_id long, in_packets long")
    assert sorted((r.exporter_id, r.in_packets or -1) for r in enrich.sampling(g, s).collect()) == [(1, 20), (2, 10), (3, 10), (3, 40), (4, -1)]


def test_uptime_wraps(spark):
    df = spark.createDataFrame([(1000, 10**12, 400), (100, 10**12, 2**32 - 100), (100, 10**12, 200)], "s long, u long, t long")
    assert [r[0] for r in df.select(enrich.uptime_to_ms(df.s, df.u, df.t)).collect()] == [10**12 - 600, 10**12 - 200, 10**12 + 100]


def test_every_token(spark):
    f = flows(spark, [base(), dict(), base(proto=1, dst_port=0x0301, src6=bytes(16), mpls=[17] * 10, min_ttl=3, username="u", in_payload=b"x", nbar_id=b"\1\0\0\5")])
    every = " ".join(f"%{t}" for t in [*tokens.TOKENS, *tokens.ALIASES])
    lines = tokens.fmt(f, every).collect()
    assert len(lines) == 3 and all(r.line is not None for r in lines)
    named = ",".join(f"%{t}" for t, (_, h, _) in tokens.TOKENS.items() if h != "-")
    got = tokens.csv(f, named)
    assert got.count() == 3 and len(set(got.columns)) == len(got.columns)
    for name in ("biline", "nsel", "nat", "glong"):
        assert tokens.fmt(f, name).first().line
    with pytest.raises(ValueError):
        tokens.fmt(f, "%nonsense")
    with pytest.raises(ValueError):
        tokens.csv(f, "%sap")
    assert len(tokens.TOKENS) + len(tokens.ALIASES) >= 140


def test_line_format(spark):
    f = flows(spark, [base(first_ms=1720689310010, last_ms=1720689312010)])
    line = tokens.fmt(f, "%ts|%td|%pr|%sap|%dap|%flg|%pkt|%byt|%bps|%pps|%bpp|%fl").first().line.split("|")
    assert [x.strip() for x in line] == ["2024-07-11 09:15:10.010", "00:00:02.000", "TCP", "10.0.0.1:1000", "10.0.0.2:80", "......S.", "10", "1000", "4000", "5", "100", "1"]
    assert tokens.fmt(f, "mine", user={"mine": "<%line>"}).first().line.startswith("<2024")
    assert len(tokens.header("line")) == len(tokens.fmt(f, "line").first().line)
    big = flows(spark, [base(in_bytes=1_500_000, in_packets=2_300_000_000)])
    assert tokens.fmt(big, "%byt/%pkt", plain=False).first().line.replace(" ", "") == "1.5M/2.3G"


def test_json(spark):
    f = flows(spark, [base(src_mask=8, flags=2), base(proto=1, dst_port=0x0301, src4=None, dst4=None, src6=bytes(15) + b"\1", dst6=bytes(16))])
    a, b = (json.loads(r.value) for r in json_out.ndjson(f).collect())
    assert (a["src4_addr"], a["src_net"], a["tcp_flags"], a["src_port"], a["sampled"], a["first"]) == ("10.0.0.1", "10.0.0.0/8", "......S.", 1000, 1, "1970-01-01T00:00:01.000")
    assert (b["icmp_type"], b["icmp_code"], b["src6_addr"]) == (3, 1, "::1") and "src4_addr" not in b and "src_port" not in b and "mpls_1" not in a


def test_schema_rules(spark):
    f = flows(spark, [dict(first_ms=0, last_ms=0, nsel_event_ms=77), base(src6=bytes(16), dst6=bytes(16), ip_version=6), base(src6=bytes(16), dst6=bytes(16)), base(src4=0, dst4=0, src6=b"\1" * 16, dst6=bytes(16))])
    r = normalise(f).orderBy("rec_no").collect()
    assert (r[0].first_ms, r[0].last_ms) == (77, 77) and r[1].src4 is None and r[1].src6 is not None and r[2].src6 is None and r[2].src4 == A and r[3].src4 is None
    assert conform(f.select("src4", "rec_no").withColumn("other", F.lit(1))).schema.names == SCHEMA.names


def test_fluent(spark):
    f = Flows(flows(spark, [base(), base(src4=B, in_bytes=5), base(proto=17)]))
    assert f.filter("proto tcp").aggregate("srcip4").top(1, "bytes").df.first().src4 == A
    assert f.aggregate("srcip4/24,dstport").fmt().count() == 1 and "10.0.0.0" in f.aggregate("srcip4/24,dstport").fmt().first().line
    assert f.stat("proto/flows").count() == 2 and f.summary().first().flows == 3 and f.first(2).df.count() == 2 and f.bidirectional().guess_direction().df.count() == 3
    assert f.csv().count() == 3 and f.ndjson().count() == 3 and f.window(0, 5000).df.count() == 3 and f.order("tstart").df.count() == 3

"""The filter language: a table of filters over single records, logic, and texts that are no filters."""

import pytest
from pyspark.sql import functions as F

from freshet.filterlang.compiler import apply_filter, compile_filter, needs
from freshet.filterlang.parser import And, FilterError, Not, Or, parse, tokenize
from freshet.schema import SCHEMA

V6 = bytes.fromhex("20010db8000700000000000000000042")
# One TCP flow of 8 s from 198.51.100.20:50123 to 203.0.113.80:8443 on 2024-03-05, with a value in every extension.
RECORD = dict(
    rec_no=1, ident="lab-east", exporter_id=61, engine_type=2, engine_id=9,
    first_ms=1709640000250, last_ms=1709640008250, in_packets=64, in_bytes=4800, src_port=50123, dst_port=8443, proto=6, tcp_flags=0x19, fwd_status=0x42, src_tos=72,
    src4=0xC6336414, dst4=0xCB007150, input_if=31, output_if=32, src_mask=26, dst_mask=27, dir=0, dst_tos=96,
    cnt_flows=3, out_packets=40, out_bytes=90_000, src_vlan=310, dst_vlan=320, src_as=64501, dst_as=64502,
    mpls=[700 << 4 | 4, 800 << 4 | 10, 900 << 4 | 1] + [0] * 7,
    in_src_mac=0x020000000A01, out_dst_mac=0x020000000A02, in_dst_mac=0x020000000A03, out_src_mac=0x020000000A04, next_as=64503, prev_as=64504,
    client_us=150, server_us=2500, app_us=40_000, fw_event=2, fw_xevent=1001, username="amelie", x_src4=0xC0000263, x_src_port=40001, x_dst_port=40002,
    ingress_acl=[5, 6, 7], egress_acl=[15, 16, 17], nat_event=5, pb_start=50_000, pb_end=50_999, pb_step=1, pb_size=1000,
    in_payload=b"PUT /reports/7 HTTP/1.0\r\n", tun_src4=0xC0000201, tun_proto=47, obs_domain_id=0x1F, ingress_vrf=12, egress_vrf=13,
    pf_action=0, pf_reason=0, pf_rule=8, pf_dir=0, pf_ifname="em3", ether_type=0x86DD, min_ttl=57, max_ttl=61, router4=0xC00002FE, next4=0xC0000202, bgp_next6=V6,
)
MATCH = [
    # everything, header
    "any", "not not any", "ipv4", "not ipv6", "count 1", "ident lab-east", "engine-type 2", "engine id 9", "exporter id 61", "exporter sysid < 62",
    # protocol, ports, flags, types of service
    "proto tcp", "proto TCP", "proto 6", "src port 50123", "dst port 8443", "port 8443", "port > 50000", "port in [22 8443]", "src port in [50122, 50123]",
    "flags F", "flags PA", "flags =FPA", "not flags S", "flags 25", "flags > 24", "flags < 26", "tos 72", "src tos >= 72", "dst tos 96", "fwdstat 66",
    # counters and rates
    "packets 64", "packets > 0x3f", "packets < 1k", "in bytes 4800", "out packets 40", "out bytes < 1m", "out bytes 90k", "flows 3", "duration 8000", "duration <= 8000", "pps 8", "bps 4800", "bpp 75",
    # addresses and prefixes
    "src ip 198.51.100.20", "ip 203.0.113.80", "host 203.0.113.80", "dst ip in [192.0.2.7 203.0.113.0/24]", "ip in [192.0.2.7, 198.51.100.20]", "src net 198.51.100.16/28", "net 203.0.113.64 255.255.255.192", "net 192.0.2.1/0",
    "src tun ip 192.0.2.1", "router ip 192.0.2.254", "exporter ip 192.0.2.254", "next ip 192.0.2.2", "bgp next ip 2001:db8:7::42", "bgp next ip in [2001:db8::/32]",
    # interfaces, networks, systems
    "in if 31", "out if 32", "if 32", "src vlan 310", "vlan 320", "as 64501", "src as 64501", "dst as > 64501", "as in [7 64502]", "next as 64503", "prev as 64504", "src mask 26", "mask 27", "flowdir 0", "flowdir ingress", "ethertype 0x86dd",
    "mpls label0 700", "mpls label1 > 799", "mpls any 900", "mpls eos 900", "mpls exp1 5",
    "in src mac 02:00:00:00:0a:01", "src mac 02:00:00:00:0a:04", "out mac 02:00:00:00:0a:02", "mac 02:00:00:00:0a:03", "observation domain id 0x1f", "ingress vrf 12", "vrf 13", "tun proto 47", "tun proto gre",
    # latencies, firewall and address translation
    "client latency 150", "server latency > 2k", "app latency 40000", "asa event 2", "asa xevent 1001", "asa user amelie", "src nat ip 192.0.2.99", "nat ip 192.0.2.99", "nat net 192.0.2.0/24", "src nat port 40001", "nat port in [40002]",
    "ingress acl 6", "egress acl > 16", "nat event 5", "nat pblock start 50000", "nat pblock size 1000", "src port in nat pblock", "not dst port in nat pblock", "pf action pass", "pf rule 8", "pf dir in", "pf interface em3",
    # payload, time to live
    "payload content 'PUT /rep'", "payload regex '(PUT|POST)'", "payload regex 'put' i", 'payload regex "HT{2}P/[01][.][0-9]"', "min ttl 57", "max ttl > 60", "ttl < 58", "not ttl equal",
    # times
    "first seen 2024-03-05T12:00:00.250", "first seen > 2024-03-05T12:00:00.249", "last seen < 2024-03-06", "first seen > 2024", "first seen > 2024/03/05.11:59:59",
    # logic
    "src port 50123 and dst port 8443", "src port 9 or dst port 8443", "not (src port 9 or dst port 10)", "! src port 9 and ! dst port 10", "src port 9 and src port 10 or dst port 8443", "proto tcp # and proto udp",
]
MISMATCH = [
    "not any", "ipv6", "ident lab-west", "count > 1", "engine-type 3", "exporter id 62", "proto udp", "src port 8443", "port in [9 10]", "flags S", "flags =F", "flags U", "packets 63", "bytes > 1m", "duration > 8000", "pps > 8",
    "src ip 192.0.2.7", "src ip 2001:db8:7::42", "net 10.0.0.0/8", "dst ip in [192.0.2.7]", "as 7", "vlan 330", "mask 28", "flowdir egress", "mpls label2 800", "mpls exp1 > 5", "out mac 02:00:00:00:0a:01", "client latency < 150", "asa event create",
    "nat event add", "dst port in nat pblock", "payload content POST", "payload regex put", "tun proto 4", "pf action block", "min ttl < 57", "ttl equal", "icmp type 8", "icmp-code 0", "first seen > 2024-03-05T12:00:00.250", "last seen > 2025",
    "geo SE", "ip tor", "src port 9 or dst port 10", "not src port 50123 and dst port 8443", "payload ssl defined", "payload dns defined", "payload ja3 defined",
]
NO_FILTER = [
    "proto nosuch", "src", "port", "port 65536", "port 8443 and", "(port 8443", "port 8443)", "proto 256", "flags Z", "flags 256", "mpls label 1", "mpls label10 1", "src ip 192.0.2.256", "net 192.0.2.0/33", "ip in []", "flowdir 2",
    "asa event maybe", "nat event maybe", "pf action jump", "first seen > tomorrow", "bytes many", "mac 2:0:0", "port 8443 dst", "src duration 8", "exporter name 61", "$%&",
]


@pytest.fixture(scope="module")
def record(spark):
    return spark.createDataFrame([tuple(RECORD.get(f.name) for f in SCHEMA)], SCHEMA)


@pytest.fixture(scope="module")
def blank(spark):
    return spark.createDataFrame([tuple(1 if f.name == "rec_no" else None for f in SCHEMA)], SCHEMA)


def test_truth_table(record):
    got = record.select(*[compile_filter(f, record).alias(str(i)) for i, f in enumerate(MATCH + MISMATCH)]).first()
    assert [f for i, f in enumerate(MATCH) if got[i] is not True] == []
    assert [f for i, f in enumerate(MISMATCH) if got[len(MATCH) + i] is not False] == []


def test_missing_extensions_are_false_and_their_negation_true(blank):
    names = [f for f in MATCH + MISMATCH if not any(w in f for w in ("any", "not", "!", "as", "count", " or ", "ident"))]
    got = blank.select(*[compile_filter(f, blank).alias(str(i)) for i, f in enumerate(names)]).first()
    assert [f for i, f in enumerate(names) if got[i]] == []
    got = blank.select(*[compile_filter(f"not ({f.split('#')[0]})", blank).alias(str(i)) for i, f in enumerate(names)]).first()
    assert [f for i, f in enumerate(names) if not got[i]] == []
    assert blank.where(compile_filter("as 0 and src as < 100 and not dst as 5", blank)).count() == 1
    assert blank.where(compile_filter("ident none", blank)).count() == 1


def test_table_without_the_column(spark):
    df = spark.range(3).select(F.col("id").alias("rec_no"))
    assert apply_filter(df, "not vlan 5").count() == 3
    assert apply_filter(df, "vlan 5 or port 80").count() == 0
    assert apply_filter(df, "").count() == 3


@pytest.mark.parametrize("text", NO_FILTER)
def test_no_filter(record, text):
    with pytest.raises(FilterError):
        compile_filter(text, record)


def test_precedence():
    t = parse("port 1 or port 2 and not port 3")
    assert isinstance(t, Or) and isinstance(t.right, And) and isinstance(t.right.right, Not)


def test_numbers_strings_and_includes(tmp_path):
    assert [x.number() for x in tokenize("12 0x10 3k 4M 5g 6t")] == [12, 16, 3000, 4_000_000, 5 * 10**9, 6 * 10**12]
    (tmp_path / "inner").write_text("port 53 # name service")
    (tmp_path / "loop").write_text("@include loop")
    assert parse("proto udp and @include inner", tmp_path) == parse("proto udp and port 53")
    with pytest.raises(FilterError):
        parse("@include loop", tmp_path)


def test_needs():
    assert needs(parse("src geo CH or ip tor")) == {"geo", "tor"}
    assert needs(parse("port 80")) == set()


def test_counts_add_up(spark, sf):
    df = spark.read.parquet(f"{sf}/flows.parquet")
    n = df.count()
    for f in ("proto tcp", "src as 0", "bytes > 10k and not port 443", "src net 10.0.0.0/8 or ipv6"):
        assert apply_filter(df, f).count() + apply_filter(df, f"not ({f})").count() == n


def test_prefixes_reach_the_scan(spark, sf):
    df = apply_filter(spark.read.parquet(f"{sf}/flows.parquet"), "proto tcp and dst port 443")
    plan = df.select("rec_no")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "proto" in plan.split("PushedFilters")[1]

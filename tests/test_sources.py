"""Binary inputs: exporter packets, captures, flow files, and what is written for replay."""

import gzip
import struct

import pytest

from freshet.sources import files, flowfile, netflow, pcap, sflow

FLOW = dict(src4=0x0A000001, dst4=0xAC100002, next4=0x0A0000FE, input_if=3, output_if=4, in_packets=7, in_bytes=900, src_port=1234, dst_port=443, proto=6, tcp_flags=27, src_tos=8, src_as=100, dst_as=200, src_mask=24, dst_mask=16, first_ms=1_700_000_000_000, last_ms=1_700_000_005_000)


def v1_packet(uptime=10_000, first=4_000, last=9_000):
    head = struct.pack(">HHIII", 1, 1, uptime, 1_700_000_000, 500_000_000)
    return head + struct.pack(">IIIHHIIIIHHHBBB7s", 1, 2, 3, 4, 5, 6, 700, first, last, 80, 443, 0, 6, 0, 16, bytes(7))


def test_v1_and_wrapped_uptime():
    (r,) = netflow.decode_fixed(v1_packet(), 5, 9)
    assert (r["src4"], r["in_bytes"], r["first_ms"], r["last_ms"], r["exporter_id"]) == (1, 700, 1_699_999_994_500, 1_699_999_999_500, 9)
    (r,) = netflow.decode_fixed(v1_packet(uptime=1_000, first=2**32 - 1_000, last=500))
    assert (r["first_ms"], r["last_ms"]) == (1_699_999_998_500, 1_700_000_000_000)


def test_v5_round_trip_and_short_packets():
    p = netflow.encode_v5([FLOW, FLOW])
    got = netflow.decode_fixed(p)
    assert len(got) == 2 and all(got[0][k] == v for k, v in FLOW.items())
    assert len(netflow.decode_fixed(p[:-1])) == 1
    assert netflow.decode_fixed(b"") == [] and netflow.decode_fixed(b"\x00\x05" + bytes(10)) == []
    sampled = bytearray(p)
    sampled[22:24] = struct.pack(">H", 0x4000 | 100)
    assert netflow.decode_fixed(bytes(sampled))[0]["in_packets"] == 700


def test_v9_needs_its_template():
    d = netflow.TemplateDecoder()
    whole, bare = netflow.encode_v9([FLOW], domain=5), netflow.encode_v9([FLOW], domain=5, with_template=False)
    assert d.packet(bare) == []
    (r,) = d.packet(whole)
    want = {k: v for k, v in FLOW.items()}
    assert all(r[k] == v for k, v in want.items()) and r["obs_domain_id"] == 5
    assert len(d.packet(bare)) == 1
    assert d.packet(whole[:30]) == [] and d.packet(b"\x00\x09") == []


def ipfix(sets, domain=1):
    body = b"".join(struct.pack(">HH", k, 4 + len(b)) + b for k, b in sets)
    return struct.pack(">HHIII", 10, 16 + len(body), 1_700_000_000, 0, domain) + body


def test_ipfix_variable_length_reverse_sampling_and_withdrawal():
    fields = [(8, 4, 0), (12, 4, 0), (4, 1, 0), (7, 2, 0), (11, 2, 0), (1, 8, 0), (2, 8, 0), (1, 8, 29305), (152, 8, 0), (153, 8, 0), (371, 0xFFFF, 0), (9999, 3, 0)]
    t = struct.pack(">HH", 300, len(fields)) + b"".join(struct.pack(">HHI", e | 0x8000, n, pen) if pen else struct.pack(">HH", e, n) for e, n, pen in fields)
    rec = lambda name: struct.pack(">IIBHHQQQQQ", 1, 2, 17, 53, 5353, 100, 1, 200, 1000, 2000) + name + b"xyz"
    d = netflow.TemplateDecoder()
    got = d.packet(ipfix([(2, t), (300, rec(b"\x03joe") + rec(b"\xff\x00\x04anna"))]))
    assert [(r["username"], r["in_bytes"], r["out_bytes"], r["first_ms"], r["last_ms"]) for r in got] == [("joe", 100, 200, 1000, 2000), ("anna", 100, 200, 1000, 2000)]
    options = struct.pack(">HHH", 301, 3, 1) + struct.pack(">HHHHHH", 302, 4, 305, 4, 306, 4)
    d.packet(ipfix([(3, options), (301, struct.pack(">III", 0, 1, 9))]))
    d.samplers[-1] = d.samplers.pop(0)
    assert d.packet(ipfix([(300, rec(b"\x00"))]))[0]["in_bytes"] == 1000
    assert d.packet(ipfix([(2, struct.pack(">HH", 300, 0)), (300, rec(b"\x00"))])) == []


def test_ipfix_nested_lists():
    inner = struct.pack(">HH", 400, 2) + struct.pack(">HHHH", 8, 4, 12, 4)
    outer = struct.pack(">HH", 401, 2) + struct.pack(">HHHH", 4, 1, 293, 0xFFFF)
    part = struct.pack(">HH", 400, 4 + 16) + struct.pack(">IIII", 1, 2, 3, 4)
    body = b"\x03" + part
    got = netflow.TemplateDecoder().packet(ipfix([(2, inner + outer), (401, b"\x06" + bytes([len(body)]) + body)]))
    assert [(r.get("proto"), r.get("src4")) for r in got] == [(6, None), (None, 1), (None, 3)]


def test_packets_of_all_versions(spark):
    rows = [(1, 10, v1_packet()), (1, 20, netflow.encode_v5([FLOW])), (2, 5, netflow.encode_v9([FLOW], with_template=False)), (2, 30, netflow.encode_v9([FLOW])), (2, 40, netflow.encode_v9([FLOW], with_template=False)), (3, 1, b"junk"), (3, 1, b""), (3, 1, None)]
    got = netflow.decode_packets(spark.createDataFrame(rows, netflow.PACKET)).select("exporter_id", "nf_version", "received_ms").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 10), (1, 5, 20), (2, 9, 30), (2, 9, 40)]


def test_templates_reach_later_chunks(spark):
    far = 10 * netflow.CHUNK_MS
    whole, bare = netflow.encode_v9([FLOW]), netflow.encode_v9([FLOW], with_template=False)
    rows = [(2, 5, bare), (2, 30, whole), (2, far, bare), (2, 2 * far, bare), (2, 2 * far + 1, whole), (2, 3 * far, bare), (4, far, bare)]
    got = netflow.decode_packets(spark.createDataFrame(rows, netflow.PACKET)).select("exporter_id", "received_ms", "in_bytes").collect()
    assert sorted(map(tuple, got)) == [(2, t, 900) for t in (30, far, 2 * far, 2 * far + 1, 3 * far)]


def ether(ip, vlan=None):
    return bytes(range(12)) + (struct.pack(">HH", 0x8100, vlan) if vlan else b"") + struct.pack(">H", 0x0800 if ip[0] >> 4 == 4 else 0x86DD) + ip


def ip4(payload, proto, src=0x0A000001, dst=0x0A000002, frag=0, ident=1, ttl=64):
    return struct.pack(">BBHHHBBHII", 0x45, 0, 20 + len(payload), ident, frag, ttl, proto, 0, src, dst) + payload


def tcp(sp, dp, flags, data=b""):
    return struct.pack(">HHIIBBHHH", sp, dp, 0, 0, 0x50, flags, 0, 0, 0) + data


def udp(sp, dp, data=b""):
    return struct.pack(">HHHH", sp, dp, 8 + len(data), 0) + data


def capture(packets, order="<", nano=False):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for us, b in packets:
        out += struct.pack(order + "IIII", us // 10**6, us % 10**6 * (1000 if nano else 1), len(b), len(b)) + b
    return out


def test_decode_headers():
    r = pcap.decode(7, 1, ether(ip4(tcp(1, 2, 2, b"hi"), 6), vlan=9))
    assert (r["src4"], r["dst_port"], r["tcp_flags"], r["vlan"], r["payload"], r["bytes"], r["ttl"]) == (0x0A000001, 2, 2, 9, b"hi", 42, 64)
    r = pcap.decode(7, 1, ether(ip4(ip4(udp(5, 6), 17, src=1, dst=2), 4)))
    assert (r["tun_src4"], r["tun_proto"], r["src4"], r["src_port"], r["proto"]) == (0x0A000001, 4, 1, 5, 17)
    r = pcap.decode(7, 1, ether(ip4(b"\x08\x01" + bytes(6), 1)))
    assert (r["proto"], r["dst_port"]) == (1, 0x0801)
    v6 = struct.pack(">IHBB", 6 << 28, 16, 44, 3) + bytes(15) + b"\1" + bytes(15) + b"\2" + struct.pack(">BBHI", 17, 0, 0, 5) + udp(53, 54)
    r = pcap.decode(7, 1, ether(v6))
    assert (r["proto"], r["src_port"], r["dst6"][-1], r["ttl"]) == (17, 53, 2, 3)
    assert pcap.decode(7, 1, b"short") is None and pcap.decode(7, 1, bytes(12) + b"\x08\x06" + bytes(40)) is None


@pytest.mark.parametrize(("order", "nano"), [("<", False), (">", False), ("<", True)])
def test_read_capture(order, nano):
    data = capture([(1_500_000, b"a"), (2_000_001, b"bc")], order, nano)
    assert [(t, b) for t, _, b, _ in pcap.read_capture(data)] == [(1_500_000, b"a"), (2_000_001, b"bc")]
    assert len(list(pcap.read_capture(gzip.compress(data)))) == 2
    assert len(list(pcap.read_capture(data[:-1]))) == 1
    with pytest.raises(ValueError):
        list(pcap.read_capture(b"no capture at all, none"))


def test_captures_to_flows(spark, tmp_path):
    a, b = 0x0A000001, 0x0A000002
    sec = 10**6
    fwd = lambda t, f, d=b"": (t, ether(ip4(tcp(1000, 80, f, d), 6, a, b)))
    rev = lambda t, f, d=b"": (t, ether(ip4(tcp(80, 1000, f, d), 6, b, a, ttl=50)))
    packets = [
        fwd(sec, 2), rev(sec + 300, 18), fwd(sec + 500, 16), rev(sec + 900, 16, b"answer"), fwd(sec + 2000, 17), rev(sec + 2500, 17),
        (5 * sec, ether(ip4(udp(9, 10), 17))), (6 * sec, ether(ip4(udp(9, 10), 17))), (70 * sec, ether(ip4(udp(9, 10), 17))),
        (5 * sec, ether(ip4(udp(4000, 53), 17))), (5 * sec + 1, ether(ip4(udp(4000, 53), 17))), (6 * sec, ether(ip4(b"\x08\x00" + bytes(6), 1))),
    ]
    (tmp_path / "x.pcap").write_bytes(capture(sorted(packets)))
    (tmp_path / "bad.pcap").write_bytes(b"nothing")
    p = pcap.packets(spark, str(tmp_path))
    assert p.count() == len(packets)
    got = pcap.flows(p).collect()
    t = {r.src4: r for r in got if r.proto == 6}
    assert (t[a].in_packets, t[a].tcp_flags, t[b].in_packets, t[b].in_payload) == (3, 19, 3, b"answer")
    assert (t[a].server_us, t[a].client_us, t[a].app_us) == (300, 200, 400) and t[b].min_ttl == 50
    assert sorted(r.in_packets for r in got if r.src_port == 9) == [1, 2]
    assert sum(r.dst_port == 53 for r in got) == 2 and sum(r.proto == 1 for r in got) == 1


def test_active_timeout_and_empty(spark):
    rows = [dict(ts_us=t * 10**6, src4=1, dst4=2, src_port=5, dst_port=6, proto=17, bytes=10) for t in range(0, 700, 30)]
    p = spark.createDataFrame([tuple(r.get(f.name) for f in pcap.PACKETS) for r in rows], pcap.PACKETS)
    got = sorted(pcap.flows(p).collect(), key=lambda r: r.first_ms)
    assert [(r.first_ms // 1000, r.last_ms // 1000) for r in got] == [(0, 300), (330, 630), (660, 690)]
    assert sum(r.in_bytes for r in got) == 10 * len(rows)
    assert pcap.flows(p.limit(0)).count() == 0


def test_datagrams_are_put_together(spark, tmp_path):
    text = bytes(range(65, 91)) * 4
    datagram = udp(1111, 2222, text)
    cut = lambda a, z, more, ident=5: ether(ip4(datagram[a:z], 17, frag=(0x2000 if more else 0) | a // 8, ident=ident))
    packets = [(1_000_000, cut(0, 48, True)), (1_000_100, cut(80, len(datagram), False)), (1_000_200, cut(48, 80, True)), (2_000_000, cut(0, 48, True, 6)), (3_000_000, ether(ip4(datagram, 17, ident=9)))]
    packets += [(4_000_000, cut(0, 48, True)), (4_000_001, cut(48, len(datagram), False)), (50_000_000, cut(0, 48, True, 8)), (70_000_000, cut(48, len(datagram), False, 8))]
    (tmp_path / "a.pcap").write_bytes(capture(packets))
    (tmp_path / "b.pcap").write_bytes(b"no capture at all, whatever its name says")
    got = sorted((r.ts_us, r.frag_offset, r.more_frags, bytes(r.payload)) for r in pcap.reassembled(pcap.packets(spark, str(tmp_path)).repartition(3)).collect())
    whole = (0, False, text)
    assert got == [(1_000_000, *whole), (2_000_000, 0, True, text[:40]), (3_000_000, *whole), (4_000_000, *whole), (50_000_000, 0, True, text[:40]), (70_000_000, 48, False, datagram[48:])]
    assert [(r.path.rsplit("/", 1)[1], r.packets) for r in pcap.unreadable(spark, str(tmp_path)).collect()] == [("b.pcap", 0)]


def test_fragments_and_repeats(spark):
    mk = lambda **k: tuple(({"src4": 1, "dst4": 2, "proto": 17, "frag_id": 7, "src_port": 0, "dst_port": 0, "more_frags": False, "frag_offset": 0} | k).get(f.name) for f in pcap.PACKETS)
    rows = [mk(ts_us=9_999_999, src_port=11, dst_port=22, more_frags=True), mk(ts_us=10_000_001, frag_offset=1480), mk(ts_us=1, frag_id=8, frag_offset=8)]
    p = spark.createDataFrame(rows, pcap.PACKETS)
    assert sorted((r.ts_us, r.src_port, r.dst_port) for r in pcap.with_fragment_ports(p).collect()) == [(1, 0, 0), (9_999_999, 11, 22), (10_000_001, 11, 22)]
    twice = spark.createDataFrame([mk(ts_us=1), mk(ts_us=500), mk(ts_us=5000)], pcap.PACKETS)
    assert sorted(r.ts_us for r in pcap.without_repeats(twice).collect()) == [1, 5000]


def test_sflow(spark):
    frame = ether(ip4(tcp(1000, 443, 2), 6), vlan=7)
    raw = struct.pack(">IIII", 1, 1500, 4, len(frame)) + frame + bytes(-len(frame) % 4)
    switch = struct.pack(">IIII", 7, 0, 8, 0)
    sample = struct.pack(">IIIIIIII", 1, 3, 400, 0, 0, 5, 6, 2) + struct.pack(">II", 1, len(raw)) + raw + struct.pack(">II", 1001, len(switch)) + switch
    d = struct.pack(">IIIIIII", 5, 1, 0x7F000001, 0, 1, 1, 2) + struct.pack(">II", 2, 4) + bytes(4) + struct.pack(">II", 1, len(sample)) + sample
    (r,) = sflow.datagram(d, 99, 3)
    assert (r["in_packets"], r["in_bytes"], r["dst_port"], r["src_vlan"], r["dst_vlan"], r["input_if"], r["router4"]) == (400, 600_000, 443, 7, 8, 5, 0x7F000001)
    assert sflow.datagram(d[:60]) == [] and sflow.datagram(b"") == []
    assert sflow.decode_datagrams(spark.createDataFrame([(3, 99, d), (3, 99, b"x"), (3, 1, None)], netflow.PACKET)).count() == 1


WIDE = FLOW | dict(src4=None, dst4=None, src6=bytes(15) + b"\1", dst6=bytes(15) + b"\2", exporter_id=3, nf_version=10, mpls=list(range(10)), username="joe", in_payload=b"abc\0d", label="tag", flow_id=2**64 - 1, pf_rule=5, pf_ifname="em0", client_us=9, ingress_acl=[1, 2, 3], vxlan=5, ether_type=2048)


@pytest.mark.parametrize("packing", [flowfile.NONE, flowfile.BZ2, flowfile.ZSTD])
def test_flow_files(spark, tmp_path, packing):
    flowfile.write_file(str(tmp_path / "a"), [FLOW, WIDE] * 3, "gw-1", packing, per_block=2)
    spark.dataSource.register(flowfile.FlowFileSource)
    df = spark.read.format("flowfile").load(str(tmp_path))
    got = sorted(df.collect(), key=lambda r: r.rec_no)
    assert len(got) == 6 and {r.ident for r in got} == {"gw-1"}
    assert all(got[0][k] == v for k, v in FLOW.items())
    assert (got[1].src6, got[1].mpls, got[1].username, got[1].in_payload, int(got[1].flow_id), got[1].pf_ifname, got[1].src4) == (WIDE["src6"], WIDE["mpls"], "joe", b"abc\0d", 2**64 - 1, "em0", None)
    assert flowfile.verify(str(tmp_path / "a")) == {"blocks": 3, "corrupt_blocks": 0, "records": 6}
    flowfile.repack(str(tmp_path / "a"), str(tmp_path / "b"), flowfile.ZSTD, "other")
    assert {r["ident"] for r in flowfile.read_file(str(tmp_path / "b"))} == {"other"}


def test_corrupt_flow_file(tmp_path):
    flowfile.write_file(str(tmp_path / "a"), [FLOW] * 4, "x", flowfile.BZ2, per_block=2)
    b = bytearray((tmp_path / "a").read_bytes())
    b[60] ^= 0xFF
    (tmp_path / "a").write_bytes(bytes(b))
    assert len(list(flowfile.read_file(str(tmp_path / "a")))) == 2
    (tmp_path / "c").write_bytes(b"nothing")
    with pytest.raises(flowfile.Corrupt):
        list(flowfile.read_file(str(tmp_path / "c")))


def test_block_decompressors():
    # literals "abcd", then eight bytes copied from four back, then a last literal
    assert flowfile._lz4(bytes([0x44]) + b"abcd" + b"\x04\x00" + bytes([0x10]) + b"z", 100) == b"abcdabcdabcdz"
    # first byte 17 + 4 literals; a match of 8 bytes from 4 back (t = 0xE0 | (3 << 2), h = 0); the end mark
    assert flowfile._lzo(bytes([21]) + b"abcd" + bytes([0xEC, 0x00]) + b"\x11\x00\x00", 100) == b"abcdabcdabcd"
    with pytest.raises((flowfile.Corrupt, IndexError)):
        flowfile._lz4(b"\x04\xff\xff", 100)


def test_parquet_tree(spark, sf, tmp_path):
    f = spark.read.parquet(f"{sf}/flows.parquet").where("received_ms < 1709254000000")
    path = str(tmp_path / "tree")
    files.write(f, path)
    n = f.count()
    assert files.read(spark, path).count() == n
    slots = sorted(str(r[0]) for r in files.read(spark, path).select("slot").distinct().collect())
    some = files.read(spark, path, slots=f"{slots[1]}:{slots[3]}")
    assert sorted(str(r[0]) for r in some.select("slot").distinct().collect()) == slots[1:4]
    one = files.read(spark, path, sources=["core-*"])
    assert 0 < one.count() < n and all(r[0].startswith("core-") for r in one.select("source").distinct().collect())
    assert files.read_many(spark, [path, path]).count() == 2 * n


def test_retention_and_idents(spark):
    s = spark.createDataFrame([("a", t, 10) for t in range(10)] + [("b", 5, 1)], "source string, slot_ms long, bytes long")
    assert sorted((r.source, r.slot_ms) for r in files.expired(s, 10, max_age_ms=7).collect()) == [("a", 0), ("a", 1), ("a", 2)]
    assert sorted(r.slot_ms for r in files.expired(s, 10, max_bytes=50).collect()) == [0, 1, 2, 3, 4, 5]
    f = spark.createDataFrame([(0x0A010203,), (0x0A020304,), (0x01020304,)], "router4 long")
    assert [r.ident for r in files.ident_of(f, "router4", {"10.0.0.0/8": "ten", "10.1.0.0/16": "ten-one"}).collect()] == ["ten-one", "ten", "1-2-3-4"]


def test_geo_and_exit_lists(spark, tmp_path):
    (tmp_path / "b.csv").write_text("network,geoname_id,registered_country_geoname_id,latitude,longitude,accuracy_radius\n10.1.0.0/16,5,,1.5,2.5,10\n")
    r = files.read_geo_csv(spark, str(tmp_path / "b.csv"), "blocks4").first()
    assert (r.net_start, r.net_end, r.prefix_len, r.location_id) == (0x0A010000, 0x0A01FFFF, 16, 5)
    (tmp_path / "b6.csv").write_text("network,autonomous_system_number,autonomous_system_organization\n2001:db8::/32,7,Seven\n")
    r = files.read_geo_csv(spark, str(tmp_path / "b6.csv"), "as6").first()
    assert (bytes(r.net_start)[:4].hex(), r.prefix_len, r.asn, r.org) == ("20010db8", 32, 7, "Seven")
    (tmp_path / "tor").write_text("ExitNode X\nPublished 2024-01-01 00:00:00\nExitAddress 10.0.0.1 2024-01-02 03:04:05\n")
    assert list(map(tuple, files.read_tor(spark, str(tmp_path / "tor")).collect())) == [(0x0A000001, 1704164645)]
    (tmp_path / "c.toml").write_text('[dump]\nworkers = 4\n[fmt]\nmine = "%ts %line"\n')
    assert files.load_config(str(tmp_path / "c.toml"))["fmt"]["mine"] == "%ts %line"


@pytest.mark.parametrize("layout", range(9))
def test_layouts(spark, sf, tmp_path, layout):
    """Every layout of folders against strftime; slots are found in all of them."""
    from datetime import datetime, timezone

    f = spark.read.parquet(f"{sf}/flows.parquet").where("received_ms % 40 = 0 and ident = 'core-a'").limit(20)
    rows = f.select("received_ms", "last_ms").collect()
    files.write(f, str(tmp_path / "t"), layout=layout)
    want = set()
    for r in rows:
        ms = (r.received_ms or r.last_ms or 0) // 1000
        parts = ["", "%Y/%m/%d", "%Y/%m/%d/%H", "%Y/%W/%u", "%Y/%W/%u/%H", "%Y/%j", "%Y/%j/%H", "%F", "%F/%H"][layout]
        want.add(datetime.fromtimestamp(ms, timezone.utc).strftime(parts) if parts else "")
    folders = {p.parent.parent.relative_to(tmp_path / "t" / "source=core-a") for p in (tmp_path / "t").rglob("*.parquet")}
    assert {"/".join(x.partition("=")[2] for x in p.parts) for p in folders} == want
    back = files.read(spark, str(tmp_path / "t"), slots="202403010000:")
    assert back.count() == sum((r.received_ms or r.last_ms or 0) >= 1709251200000 for r in rows)


def test_packets_are_sent_on(tmp_path):
    import socket
    import time

    from freshet.sources import udp as collector

    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as sink, socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as out:
        sink.bind(("127.0.0.1", 0))
        sink.settimeout(5)
        with collector.Collector(str(tmp_path), "127.0.0.1", 0, every_s=0.2, repeat_to=[("127.0.0.1", sink.getsockname()[1])]) as c:
            out.sendto(b"flow", ("127.0.0.1", c.port))
            assert sink.recv(100) == b"flow"
            time.sleep(0.5)
    assert list(tmp_path.glob("*.parquet"))

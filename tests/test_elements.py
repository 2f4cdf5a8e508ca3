"""Elements of NetFlow 9 and IPFIX beyond the common ones: firewalls, latencies, other forms of ports, times and counters, enterprises."""

import struct

from freshet.sources import netflow
from tests.test_sources import ipfix

SECS = 1_700_000_000


def v9(fields):
    """What one record of (element, value) gives."""
    t = struct.pack(">HH", 256, len(fields)) + b"".join(struct.pack(">HH", e, len(v)) for e, v in fields)
    data = b"".join(v for _, v in fields)
    sets = struct.pack(">HH", 0, 4 + len(t)) + t + struct.pack(">HH", 256, 4 + len(data)) + data
    (r,) = netflow.TemplateDecoder().packet(struct.pack(">HHIIII", 9, 2, 60_000, SECS, 0, 0) + sets)
    return r


def v10(fields):
    t = struct.pack(">HH", 256, len(fields)) + b"".join(struct.pack(">HHI", e | 0x8000, len(v), pen) if pen else struct.pack(">HH", e, len(v)) for e, v, pen in fields)
    (r,) = netflow.TemplateDecoder().packet(ipfix([(2, t), (256, b"".join(v for _, v, _ in fields))]))
    return r


def n(v, size=4):
    return v.to_bytes(size, "big")


def test_firewall_and_latency():
    acl = struct.pack(">III", 7, 8, 9)
    r = v9([(231, n(100)), (232, n(200)), (298, n(3)), (299, n(4)), (148, n(55)), (40005, n(2, 1)), (33002, n(1001, 2)), (33000, acl), (33001, acl), (40000, b"joe" + bytes(17)), (40001, n(1)), (40002, n(2)), (40003, n(11, 2)), (40004, n(22, 2)), (323, n(5, 8))])
    want = dict(in_bytes=100, out_bytes=200, in_packets=3, out_packets=4, conn_id=55, fw_event=2, fw_xevent=1001, ingress_acl=[7, 8, 9], egress_acl=[7, 8, 9], username="joe", x_src4=1, x_dst4=2, x_src_port=11, x_dst_port=22, nsel_event_ms=5)
    assert {k: r.get(k) for k in want} == want and "flow_id" not in r
    r = v9([(57554, n(1)), (57555, n(5)), (57556, n(0)), (57557, n(6)), (57559, n(7)), (57558, n(2))])
    assert (r["client_us"], r["server_us"], r["app_us"]) == (1_000_005, 6, 2_000_007)
    batch = netflow.rows_to_batch([v9([(33000, acl), (57555, n(5))])])
    assert batch.column("ingress_acl").to_pylist() == [[7, 8, 9]] and batch.column("client_us").to_pylist() == [5]


def test_ports_counters_and_layer2():
    r = v10([(180, n(1, 2), 0), (183, n(2, 2), 0), (171, n(10, 8), 0), (172, n(3, 8), 0), (60, n(4, 1), 0), (192, n(64, 1), 0), (252, n(5), 0), (253, n(6), 0), (278, n(2), 0), (312, n(99, 2), 0), (408, n(1, 2), 0)])
    want = dict(src_port=1, dst_port=2, out_bytes=10, out_packets=3, ip_version=4, min_ttl=64, l2_ingress=5, l2_egress=6, cnt_flows=2, frame_size=99, link_type=1)
    assert {k: r.get(k) for k in want} == want
    r = v10([(182, n(3, 2), 0), (181, n(4, 2), 0)])
    assert (r["src_port"], r["dst_port"]) == (3, 4)


def test_times():
    ntp = lambda ms: n(((ms // 1000 + 2_208_988_800) << 32) + (ms % 1000) * 2**32 // 1000 + 1, 8)
    r = v10([(156, ntp(SECS * 1000 + 250), 0), (157, ntp(SECS * 1000 + 750), 0)])
    assert (r["first_ms"], r["last_ms"]) == (SECS * 1000 + 250, SECS * 1000 + 750)
    r = v10([(158, n(3_000_000), 0), (159, n(1_000_000), 0)])
    assert (r["first_ms"], r["last_ms"]) == (SECS * 1000 - 3000, SECS * 1000 - 1000)
    r = v10([(161, n(500), 0), (152, n(1000, 8), 0)])
    assert (r["first_ms"], r["last_ms"]) == (1000, 1500)


def test_enterprises():
    r = v10([(18, b"in!", 6871), (16402, b"out", 6871), (91, n(7, 2), 637), (92, n(8, 2), 637), (93, b"sub\0", 637), (12236, n(1), 9), (12237, n(2), 9), (12241, n(443, 2), 9), (8337, n(10), 9), (8338, n(20), 9), (77, n(1), 4242)])
    want = dict(in_payload=b"in!", out_payload=b"out", in_service_id=7, out_service_id=8, nat_string="sub", src4=1, dst4=2, dst_port=443, in_bytes=10, out_bytes=20)
    assert {k: r.get(k) for k in want} == want

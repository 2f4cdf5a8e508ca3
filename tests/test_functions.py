"""Scalar functions: addresses, times, names, payloads, anonymisation."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from freshet.functions import cryptopan, enums, ip, payload, time
from freshet.functions.rates import div, weight


def test_addresses():
    assert ip.parse("10.1") == (4, 0x0A010000) and ip.parse("::1") == (6, bytes(15) + b"\1")
    assert ip.prefix_range("10.1.2.3", 8) == (4, 0x0A000000, 0x0AFFFFFF)
    assert ip.prefix_range("2001:db8::", 33)[2][:5].hex() == "20010db87f"
    assert ip.mask_bits("255.255.240.0") == 20 and ip.mac_number("0a:0:0:0:0:1") == 0x0A0000000001
    for bad in ("10", "1.2.3.256", "a.b", "10.0.0.0.1"):
        with pytest.raises(ValueError):
            ip.parse(bad)
    with pytest.raises(ValueError):
        ip.mask_bits("255.0.255.0")


def test_address_columns(spark):
    b = bytes.fromhex("20010db8ffffffff00000000000000ff")
    df = spark.createDataFrame([(0x0A0102FF, b, 20), (None, None, None), (0xFFFFFFFF, bytes(16), 0)], "a long, b binary, n int")
    r = df.select(
        ip.text4(df.a), ip.text6(df.b), ip.text6_long(df.b), ip.masked4(df.a, 24), ip.masked4(df.a, F.coalesce(df.n, F.lit(0))), F.hex(ip.masked6(df.b, 33)), F.hex(ip.masked6(df.b, 128)), F.hex(ip.masked6(df.b, 0)), ip.number4(ip.text4(df.a)), ip.mac_text(df.a)
    ).collect()
    assert tuple(r[0]) == ("10.1.2.255", "2001:db8:ffff:ffff::ff", "2001:0db8:ffff:ffff:0000:0000:0000:00ff", 0x0A010200, 0x0A010000 & 0xFFFFF000, "20010DB8" + "80" + "0" * 22, b.hex().upper(), "0" * 32, 0x0A0102FF, "00:00:0a:01:02:ff")
    assert r[1][0] is None and r[1][1] is None and r[1][5] is None and r[2][4] == 0


def test_ipv6_text(spark):
    import ipaddress
    import random

    r = random.Random(4)
    every = [bytes(16), b"\xff" * 16, bytes(10) + b"\xff\xff\1\2\3\4", bytes(15) + b"\1", b"\1" + bytes(15)] + [bytes(r.choice([0, 0, 0, 0, r.randrange(256)]) for _ in range(16)) for _ in range(300)]
    every += [b"".join(r.choice([b"\0\0", b"\0\0", b"\x12\x34"]) for _ in range(8)) for _ in range(200)]
    df = spark.createDataFrame([(b,) for b in every], "b binary")
    assert [x[0] for x in df.select(ip.text6(df.b)).collect()] == [str(ipaddress.IPv6Address(b)) for b in every]


def test_times(spark):
    assert time.parse_ms("2024-07-11T09:15:10.010") == 1720689310010 and time.parse_ms("2024/07/11.09:15") == 1720689300000 and time.parse_ms("2024") == 1704067200000
    assert time.parse_ms("2024-07-11T09:15:10", "Europe/Zurich") == 1720682110000 and time.parse_ms("2024-07-11T09:15:10Z", "Europe/Zurich") == 1720689310000
    assert time.parse_window("2024/07/11.09:00-2024/07/11.10:00") == (1720688400000, 1720692000000) and time.parse_window("2024-07-11/2024-07-12") == (1720656000000, 1720742400000)
    with pytest.raises(ValueError):
        time.parse_ms("tomorrow")
    df = spark.createDataFrame([(0, 61_001), (1720689310010, 90_061_500), (None, 0)], "t long, d long")
    r = df.select(time.iso(df.t), time.duration_text(df.d)).collect()
    assert [tuple(x) for x in r] == [("0000-00-00 00:00:00.000", "    00:01:01.001"), ("2024-07-11 09:15:10.010", " 1d 01:01:01.500"), ("0000-00-00 00:00:00.000", "    00:00:00.000")]


def test_names(spark):
    assert enums.protocol_number("tcp") == 6 and enums.protocol_number("UDP") == 17 and enums.protocol_number("gre") == 47 and enums.protocol_number("nonsense") is None and len(enums.PROTOCOLS) == 138
    assert enums.fw_event_number("Denied") == 3 and enums.fw_xevent_number("egress") == 1002 and enums.nat_event_number("threshld") == 18 and enums.pf_reason_number("no-route") == 16 and enums.forwarding_number("dhw") == 31
    df = spark.createDataFrame([(6, 18), (200, 255), (None, None)], "p int, f int")
    assert [tuple(r) for r in df.select(enums.protocol_name(df.p), enums.flags_text(df.f)).collect()] == [("TCP", "...A..S."), ("200", "CEUAPRSF"), (None, None)]


def test_division_and_weight(spark):
    df = spark.createDataFrame([(7, 2), (7, 0), (7, None), (None, 3)], "a long, b long")
    assert [r[0] for r in df.select(div(df.a, df.b)).collect()] == [3, 0, 0, None]
    assert [r[0] for r in df.select(weight(df.b)).collect()] == [2, 1, 1, 3]


def hello(kind=1, ciphers=(0x1301, 0x0A0A, 0x1302), sni=b"example.org", alpn=b"h2", versions=(0x0A0A, 0x0304, 0x0303)):
    x = lambda t, b: struct.pack(">HH", t, len(b)) + b
    if kind == 1:
        name = b"\0" + struct.pack(">H", len(sni)) + sni
        ext = x(0, struct.pack(">H", len(name)) + name) + x(0x1A1A, b"") + x(10, struct.pack(">HHH", 4, 29, 23)) + x(11, b"\1\0") + x(13, struct.pack(">HHH", 4, 0x0403, 0x0804)) + x(16, struct.pack(">HB", len(alpn) + 1, len(alpn)) + alpn)
        ext += x(43, bytes([2 * len(versions)]) + b"".join(struct.pack(">H", v) for v in versions))
        body = struct.pack(">H", 0x0303) + bytes(32) + b"\0" + struct.pack(">H", 2 * len(ciphers)) + b"".join(struct.pack(">H", c) for c in ciphers) + b"\1\0"
    else:
        ext = x(43, struct.pack(">H", 0x0304)) + x(51, bytes(4))
        body = struct.pack(">H", 0x0303) + bytes(32) + b"\0" + struct.pack(">H", ciphers[0]) + b"\0"
    body += struct.pack(">H", len(ext)) + ext
    msg = bytes([kind]) + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack(">H", len(msg)) + msg


def test_tls_fingerprints():
    c = payload.parse_tls(hello())
    assert (c["kind"], c["version"], c["sni"]) == ("client", 0x0304, "example.org")
    assert c["ja3"] == hashlib.md5(b"771,4865-4866,0-10-11-13-16-43,29-23,0").hexdigest()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()[:12]
    assert c["ja4"] == f"t13d0206h2_{sha('1301,1302')}_{sha('000a,000b,000d,002b_0403,0804')}"
    s = payload.parse_tls(hello(2))
    assert s["ja4s"] == f"t130200_1301_{sha('002b,0033')}" and s["ja3"] == hashlib.md5(b"771,4865,43-51").hexdigest() and s["ja4"] is None
    assert payload.parse_tls(None) is None and payload.parse_tls(b"") is None and payload.parse_tls(hello()[:60]) is None and payload.parse_tls(b"\x17" + hello()[1:]) is None


def dns_message():
    q = b"\3www\7example\3org\0" + struct.pack(">HH", 1, 1)
    rr = lambda kind, data: b"\xc0\x0c" + struct.pack(">HHIH", kind, 1, 60, len(data)) + data
    return struct.pack(">6H", 1, 0x8180, 1, 2, 0, 1) + q + rr(1, bytes([192, 0, 2, 7])) + rr(5, b"\xc0\x10") + rr(28, bytes(15) + b"\1")


def test_dns():
    m = dns_message()
    assert payload.parse_dns(m, False) == {"names": ["www.example.org"], "addresses": ["192.0.2.7", "::1"]}
    assert payload.parse_dns(b"\0\0" + m, True) == payload.parse_dns(m, False)
    loop = struct.pack(">6H", 1, 0, 1, 0, 0, 0) + b"\xc0\x0c"
    assert payload.parse_dns(m[:-3], False) is None and payload.parse_dns(None, False) is None and payload.parse_dns(loop, False) is None and payload.parse_dns(b"x", False) is None


def test_payload_filters(spark):
    from freshet.filterlang.compiler import apply_filter

    rows = [(1, 6, 1000, 443, hello(), hello(2)), (2, 17, 1000, 53, dns_message(), None), (3, 6, 1, 2, b"GET / HTTP/1.1\r\n\0x", None), (4, 6, 1, 2, None, None)]
    df = spark.createDataFrame(rows, "rec_no long, proto short, src_port int, dst_port int, in_payload binary, out_payload binary")
    ids = lambda f: [r.rec_no for r in apply_filter(df, f).select("rec_no").orderBy("rec_no").collect()]
    assert ids("payload tls defined") == [1] and ids("payload ssl version 1.3") == [1] and ids("payload tls version 1.2") == [] and ids("payload tls sni example") == [1] and ids("payload ja3 defined") == [1] and ids("payload ja4s defined") == [1]
    assert ids(f"payload ja3 {payload.parse_tls(hello())['ja3']}") == [1] and ids("payload dns defined") == [2] and ids("payload dns name example") == [2] and ids("payload dns address 192.0.2") == [2] and ids("payload dns name nowhere") == []
    assert ids("payload content 'HTTP'") == [3] and ids("payload regex '^get' i") == [3] and ids("not payload tls defined and proto tcp") == [3, 4]


def test_aes_and_prefix_preservation(spark):
    key = bytes(range(16))
    import numpy as np

    block = np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), np.uint8)[None]
    assert cryptopan.encrypt(block, cryptopan.expand_key(key)).tobytes().hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    # the sample key and addresses published with the scheme
    k = "0x" + bytes([21, 34, 23, 141, 51, 164, 207, 128, 19, 10, 91, 22, 73, 144, 125, 16, 216, 152, 143, 131, 121, 121, 101, 39, 98, 87, 76, 45, 42, 132, 34, 2]).hex()
    a = cryptopan.Anonymizer(k)
    num = lambda s: ip.parse(s)[1]
    assert a.v4([num("128.11.68.132"), num("129.118.74.4"), num("130.132.252.244")]) == [num("135.242.180.132"), num("134.136.186.123"), num("133.68.164.234")]
    rng = np.random.default_rng(1)
    xs = rng.integers(0, 2**32, 60).tolist()
    ys = a.v4(xs)
    same = lambda p, q: 32 - (p ^ q).bit_length()
    assert all(same(p, q) == same(s, t) for p, s in zip(xs, ys) for q, t in zip(xs, ys))
    v6 = [bytes(range(16)), bytes(range(15)) + b"\xff"]
    w6 = a.v6(v6)
    assert w6[0][:14] == w6[1][:14] and w6[0] != w6[1] and w6[0] != v6[0]
    df = spark.createDataFrame([(xs[0], None, v6[0], 5), (None, None, None, None)], "src4 long, dst4 long, src6 binary, src_as long")
    r = cryptopan.anonymize(df, k).collect()
    assert (r[0].src4, bytes(r[0].src6), r[0].src_as) == (ys[0], w6[0], 0) and tuple(r[1]) == (None,) * 4
    assert cryptopan.anonymize(df, k, "dst").first().src4 == xs[0]
    with pytest.raises(ValueError):
        cryptopan.parse_key("short")

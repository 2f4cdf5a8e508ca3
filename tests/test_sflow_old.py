"""sFlow versions 2 and 4: counter samples between flow samples, user and URL extensions, AS paths."""

import struct

import pytest

from freshet.sources import sflow
from tests.test_sources import ether, ip4, tcp

u = lambda *v: struct.pack(f">{len(v)}I", *v)
text = lambda b: u(len(b)) + b + bytes(-len(b) % 4)
FRAME = ether(ip4(tcp(1000, 443, 2), 6))


def flow(port, extensions=()):
    return u(1, 7, 1, 100, 0, 0, port, 6, 1, 1, 1500) + text(FRAME) + u(len(extensions)) + b"".join(extensions)


def counters(block, size):
    return u(2, 9, 1, 30, block) + bytes([255]) * size


def datagram(version, *samples):
    return u(version, 1, 0x7F000001, 5, 6, len(samples)) + b"".join(samples)


@pytest.mark.parametrize("version", [2, 4])
def test_counters_are_read_over(version):
    blocks = [(1, 88), (2, 140), (3, 160), (4, 88), (5, 168), (6, 88), (7, 28)]
    d = datagram(version, *[s for b, n in blocks for s in (counters(b, n), flow(b))])
    assert [(r["input_if"], r["in_bytes"], r["dst_port"]) for r in sflow.datagram(d)] == [(b, 150_000, 443) for b, _ in blocks]
    assert sflow.datagram(datagram(version, flow(1), counters(8, 4), flow(2)))[0]["input_if"] == 1


@pytest.mark.parametrize("version", [2, 4])
def test_user_and_url_and_path(version):
    user, url = u(4) + text(b"anna") + text(b"bo"), u(5, 1) + text(b"http://x/")
    path = u(3, 10, 20, 30) + (u(2, 40, 50) if version == 2 else u(1, 2, 2, 40, 50) + u(1, 60, 70))
    got = sflow.datagram(datagram(version, flow(1, [user, path, url]), flow(2)))
    assert [r["input_if"] for r in got] == [1, 2]
    assert (got[0]["src_as"], got[0]["prev_as"], got[0]["next_as"], got[0]["dst_as"]) == (20, 30, 40, 50)

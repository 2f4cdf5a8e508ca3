"""Templates and samplers of NetFlow 9 and IPFIX streams beyond one chunk."""

import struct

from freshet.sources import netflow, udp
from tests.test_sources import FLOW

CHUNK = netflow.CHUNK_MS


def sampler(interval, domain=0, secs=1_700_000_000, seq=0):
    """A version 9 packet with an options template and its record: one of `interval` packets, for the whole exporter."""
    t = struct.pack(">HHH", 300, 4, 4) + struct.pack(">HHHH", 1, 4, 34, 4)
    sets = struct.pack(">HH", 1, 4 + len(t)) + t + struct.pack(">HH", 300, 12) + struct.pack(">II", 0, interval)
    return struct.pack(">HHIIII", 9, 2, 0, secs, seq, domain) + sets


def decode(spark, rows):
    got = netflow.decode_packets(spark.createDataFrame(rows, netflow.PACKET)).select("exporter_id", "received_ms", "in_packets", "in_bytes").collect()
    return sorted(map(tuple, got), key=lambda r: (r[0] or 0, r[1] or 0))


def test_samplers_reach_later_chunks(spark):
    whole, bare = netflow.encode_v9([FLOW]), netflow.encode_v9([FLOW], with_template=False)
    rows = [(2, 5, whole), (2, 6, sampler(10)), (2, 7, bare), (2, 3 * CHUNK, bare), (2, 9 * CHUNK, sampler(100)), (2, 9 * CHUNK + 1, bare), (2, 20 * CHUNK, bare), (4, 20 * CHUNK, whole)]
    assert decode(spark, rows) == [(2, 5, 7, 900), (2, 7, 70, 9000), (2, 3 * CHUNK, 70, 9000), (2, 9 * CHUNK + 1, 700, 90000), (2, 20 * CHUNK, 700, 90000), (4, 20 * CHUNK, 7, 900)]


def test_unknown_exporter_and_time(spark):
    whole, bare = netflow.encode_v9([FLOW]), netflow.encode_v9([FLOW], with_template=False)
    assert decode(spark, [(None, 1, whole), (None, 9 * CHUNK, bare)]) == [(None, 1, 7, 900), (None, 9 * CHUNK, 7, 900)]
    # without an arrival time the header's time and sequence say the order
    at = lambda s, **k: netflow.encode_v9([FLOW], unix_ms=1_700_000_000_000 + s * 1000, sequence=s, **k)
    assert len(decode(spark, [(3, None, at(900, with_template=False)), (3, None, at(1)), (3, None, at(0, with_template=False))])) == 2


def test_later_definition_wins_over_an_older_set(spark):
    """A set that defined two templates is carried for one of them and doesn't bring back the other's old form."""
    two = b"".join(struct.pack(">HH", tid, 1) + struct.pack(">HH", 1, 4) for tid in (256, 257))
    new = struct.pack(">HH", 257, 1) + struct.pack(">HH", 2, 4)
    p = lambda kind, body: struct.pack(">HHIIII", 9, 1, 0, 1_700_000_000, 0, 0) + struct.pack(">HH", kind, 4 + len(body)) + body
    rows = [(1, 0, p(0, two)), (1, CHUNK, p(0, new)), (1, 3 * CHUNK, p(257, struct.pack(">I", 5))), (1, 3 * CHUNK + 1, p(256, struct.pack(">I", 6)))]
    assert decode(spark, rows) == [(1, 3 * CHUNK, 5, None), (1, 3 * CHUNK + 1, None, 6)]


def test_templates_reach_later_batches(spark, tmp_path):
    """Each packet is a batch of its own; the job is also stopped and started again."""
    whole, bare = netflow.encode_v9([FLOW]), netflow.encode_v9([FLOW], with_template=False)
    spool, got = str(tmp_path / "spool"), []

    def put(*rows):
        spark.createDataFrame([(e, "x", t, p) for e, t, p in rows], udp.SPOOL).coalesce(1).write.mode("append").parquet(spool)

    def drain():
        each = lambda df, batch: got.extend((batch, r.exporter_id, r.received_ms, r.in_bytes) for r in df.collect())
        udp.decoded(udp.stream(spark, spool, 1))(each, str(tmp_path / "c"), every=None).awaitTermination()

    put((2, 5, whole), (None, 5, whole))
    drain()
    put((2, 6, sampler(10)), (3, 6, bare))
    drain()
    put((2, 30 * CHUNK, bare), (None, 30 * CHUNK, bare), (3, 30 * CHUNK, bare))
    drain()
    # arrives later with an earlier time, and in a batch that tells of nothing
    put((2, 4, bare))
    drain()
    assert sorted(got, key=str) == sorted([(0, 2, 5, 900), (0, None, 5, 900), (2, 2, 30 * CHUNK, 9000), (2, None, 30 * CHUNK, 900), (3, 2, 4, 9000)], key=str)
    assert len(list((tmp_path / "c" / "templates").glob("batch=*"))) <= 3

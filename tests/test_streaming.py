"""Streams over folders of Parquet: rotation, metrics, profiles, late periods, packet assembly."""

import pytest

from freshet.schema import SCHEMA
from freshet.sources import pcap
from freshet.streaming import jobs, lateness, packetflows


@pytest.fixture
def stream(spark, sf):
    return spark.readStream.schema(spark.read.parquet(f"{sf}/flows.parquet").schema).option("pathGlobFilter", "flows.parquet").parquet(sf)


def drain(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_rotation_and_profiles(spark, sf, stream, tmp_path):
    n = spark.read.parquet(f"{sf}/flows.parquet").count()
    told = []
    few = stream.where("exporter_id = 11")
    jobs.rotate(few, str(tmp_path / "out"), str(tmp_path / "c1"), every=None, hook=told.append).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = spark.read.parquet(f"{sf}/flows.parquet").where("exporter_id = 11")
    assert got.count() == want.count() and {"source", "slot", "batch"} <= set(got.columns) and told[0]
    jobs.profiles(stream, {"web": "port 443", "all": "any"}, str(tmp_path / "p"), str(tmp_path / "c2"), every=None).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "p" / "channel=all")).count() == n
    totals = spark.read.parquet(str(tmp_path / "p" / "_totals"))
    assert totals.where("channel = 'all'").count() > 0


def test_metrics_and_ports(spark, sf, stream):
    m = drain(jobs.metrics(stream.where("exporter_id < 3")), "complete", "m")
    assert m.agg({"flows": "sum"}).first()[0] >= m.count() > 0 and {"slot_ms", "source", "exporter_id", "flows_tcp"} <= set(m.columns)
    p = drain(jobs.port_sums(stream, "1 hour", None), "complete", "p")
    assert p.agg({"records": "sum"}).first()[0] == spark.read.parquet(f"{sf}/flows.parquet").where("proto in (6, 17) and received_ms is not null").count()


def test_late_periods(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "src int, ev long, ar long, in_packets long, in_bytes long").coalesce(1)
    path = str(tmp_path / "in")
    rows((1, 50, 60, 1, 10), (1, 60, 200, 1, 10), (2, 10, None, 1, 1)).write.mode("append").parquet(path)
    rows((1, 70, 250, 2, 20), (1, 70, 100_000, 5, 50), (None, 1, 1, 1, 1)).write.mode("append").parquet(path)
    src = spark.readStream.schema(rows((1, 1, 1, 1, 1)).schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = drain(lateness.corrected_periods(src, "src", "ev", "ar", 100, 10, 200), "update", "late").orderBy("revision").collect()
    last = got[-1]
    assert (last.source, last.period_start, last.n_final, last.packets, last.bytes, last.n_late, last.n_dropped) == (1, 0, 3, 4, 40, 2, 1)
    assert [r.revision for r in got] == [1, 2]


def test_packet_assembly(spark, tmp_path):
    p = lambda t, **k: tuple(({"src4": 1, "dst4": 2, "src_port": 5, "dst_port": 6, "proto": 6, "bytes": 10, "tcp_flags": 16, "ts_us": t * 10**6} | k).get(f.name) for f in pcap.PACKETS)
    path = str(tmp_path / "in")
    write = lambda *x: spark.createDataFrame(x, pcap.PACKETS).coalesce(1).write.mode("append").parquet(path)
    write(p(1), p(2), p(3, src4=9))
    write(p(4, tcp_flags=17), p(5, src4=9))
    write(p(500, src4=7, tcp_flags=4))
    src = spark.readStream.schema(pcap.PACKETS).option("maxFilesPerTrigger", 1).parquet(path)
    got = drain(packetflows.assemble(src), "append", "flows").collect()
    assert {(r.src4, r.in_packets, r.first_ms, r.last_ms) for r in got} == {(1, 3, 1000, 4000), (7, 1, 500_000, 500_000), (9, 2, 3000, 5000)}


def test_schema_fits(stream):
    assert set(stream.columns) <= set(SCHEMA.names)

"""The command line, and the remaining carriers of flow records."""

import struct

import pytest

from freshet.cli import run
from freshet.sources import flowfile, netflow, pcap
from tests.test_sources import FLOW, capture, ether, ip4, ipfix, udp


@pytest.fixture(scope="module")
def tree(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("flows") / "t")
    spark.read.parquet(f"{sf}/flows.parquet").where("received_ms < 1709260000000").write.parquet(path)
    return path


@pytest.mark.parametrize(
    "args",
    [
        ["proto", "tcp"], ["-o", "extended", "-c", "5"], ["-o", "csv"], ["-o", "csv-fast", "-c", "3"], ["-o", "ndjson", "-c", "3"], ["-o", "raw", "-c", "2"], ["-o", "null"], ["-o", "fmt:%ts %sap", "-6", "-c", "3"], ["-I"], ["-g"], ["-s", "srcip/bytes", "-s", "port:p", "-n", "3", "proto udp"],
        ["-s", "record/bytes"], ["-A", "srcip4/24,dstport", "-O", "bytes", "-n", "5", "-P", "packets > 1"], ["-a", "-O", "tstart"], ["-b", "-O", "flows", "-n", "2"], ["-B"], ["-t", "2024/03/01.00:00-2024/03/02.00:00", "-c", "4"], ["-K", "abcdefghijklmnopqrstuvwxyz012345", "-c", "3"],
    ],
)
def test_command_line(spark, tree, capsys, args):
    run(spark, ["-r", tree, *args])
    out = capsys.readouterr().out
    assert out.strip() or args == ["-o", "null"]


def test_write_and_flow_files(spark, tree, tmp_path, capsys):
    run(spark, ["-r", tree, "-w", str(tmp_path / "w"), "proto", "udp"])
    n = spark.read.parquet(str(tmp_path / "w")).count()
    assert n == spark.read.parquet(tree).where("proto = 17").count()
    spark.dataSource.register(flowfile.FlowFileSource)
    from freshet.schema import conform

    conform(spark.read.parquet(tree)).repartition(2).write.format("flowfile").option("ident", "gw").mode("append").save(str(tmp_path / "ff"))
    back = spark.read.format("flowfile").load(str(tmp_path / "ff"))
    assert back.count() == spark.read.parquet(tree).count() and back.select("ident").distinct().first()[0] == "gw"
    sums = "sum(in_bytes)", "sum(src4)", "min(first_ms)"
    assert back.selectExpr(*sums).first()[0] == spark.read.parquet(tree).selectExpr(*sums).first()[0]
    run(spark, ["-r", str(tmp_path / "ff"), "--flowfile", "-s", "proto"])
    assert "proto" in capsys.readouterr().out


def test_native_packets(spark):
    p = netflow.encode_raw([FLOW, FLOW])
    assert [r["in_bytes"] for r in netflow.decode_raw(p)] == [900, 900] and netflow.decode_raw(p[:-1]) and netflow.decode_raw(b"x") == []
    assert netflow.decode_raw_packets(spark.createDataFrame([(1, 5, p), (1, 6, None), (1, 7, b"junk" * 9)], netflow.PACKET)).count() == 2


def test_packets_in_captures_and_files(spark, tmp_path):
    export = netflow.encode_v5([FLOW])
    (tmp_path / "x.pcap").write_bytes(capture([(5_000_000, ether(ip4(udp(1, 9995, export), 17))), (6_000_000, ether(ip4(udp(1, 53, b"no"), 17)))]))
    got = netflow.decode_packets(netflow.captured_packets(pcap.packets(spark, str(tmp_path)), 9995)).collect()
    assert [(r.exporter_id, r.received_ms, r.in_bytes) for r in got] == [(0x0A000001, 5000, 900)]
    t = struct.pack(">HH", 300, 2) + struct.pack(">HHHH", 8, 4, 1, 4)
    (tmp_path / "ipfix").mkdir()
    (tmp_path / "ipfix" / "a").write_bytes(ipfix([(2, t), (300, struct.pack(">II", 1, 10))]) + ipfix([(300, struct.pack(">II", 2, 20))]))
    assert sorted(r.in_bytes for r in netflow.read_ipfix_files(spark, str(tmp_path / "ipfix")).collect()) == [10, 20]


def test_names_and_sequences(spark):
    options = struct.pack(">HHH", 301, 2, 1) + struct.pack(">HHHH", 10, 4, 82, 0xFFFF)
    p = ipfix([(3, options), (301, struct.pack(">I", 7) + b"\x04eth0")])
    got = netflow.decode_names(spark.createDataFrame([(1, 5, p), (1, 6, p)], netflow.PACKET)).collect()
    assert list(map(tuple, got)) == [(1, "interface", "7", "eth0")]
    from freshet.operators.summary import sequence_gaps

    rows = [(1, t, netflow.encode_v5([FLOW], s)) for t, s in ((1, 0), (2, 1), (3, 5))]
    s = netflow.packet_sequences(spark.createDataFrame(rows, netflow.PACKET))
    assert list(map(tuple, sequence_gaps(s, "exporter_id", "sequence", "n_flows", "received_ms").collect())) == [(1, 3, 1, 3)]


def test_replay(spark):
    import socket

    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        s.settimeout(10)
        netflow.replay(spark.createDataFrame([tuple(FLOW.values())] * 3, list(FLOW)).coalesce(1), "127.0.0.1", s.getsockname()[1], 9)
        assert len(netflow.TemplateDecoder().packet(s.recv(65535))) == 3
        netflow.replay(spark.createDataFrame([tuple(FLOW.values())], list(FLOW)).coalesce(1), "127.0.0.1", s.getsockname()[1], 250, speed=100.0)
        assert len(netflow.decode_raw(s.recv(65535))) == 1


def test_collector(spark, tmp_path):
    import socket
    import time

    from freshet.sources import udp as collector

    with collector.Collector(str(tmp_path / "spool"), "127.0.0.1", 0, {"127.0.0.0/8": 7}, every_s=0.5) as c, socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for p in (netflow.encode_v5([FLOW]), netflow.encode_v9([FLOW]), netflow.encode_raw([FLOW]), b"noise"):
            s.sendto(p, ("127.0.0.1", c.port))
        time.sleep(1.0)
    got = []
    start = collector.decoded(collector.stream(spark, str(tmp_path / "spool")))
    start(lambda df, batch: got.extend(df.select("exporter_id", "nf_version", "in_bytes").collect()), str(tmp_path / "cp"), None).awaitTermination()
    assert sorted((r.nf_version, r.in_bytes) for r in got) == [(0, 900), (5, 900), (9, 900)]
    with collector.Collector(str(tmp_path / "other"), "127.0.0.1", 0, unknown=None, every_s=0.2) as c, socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.sendto(b"x", ("127.0.0.1", c.port))
        time.sleep(0.5)
    assert not list((tmp_path / "other").iterdir())


def test_more_options(spark, tree, tmp_path, capsys):
    said = lambda *args: (run(spark, list(args)), capsys.readouterr().out)[1]
    (tmp_path / "f").write_text("proto tcp or proto udp # both")
    (tmp_path / "c.toml").write_text("[fmt]\nmine = '%sa %pkt'\n")
    assert said("-Z", "proto tcp").strip() == "OK" and "port" in said("-X", "port 80")
    with pytest.raises(ValueError):
        run(spark, ["-Z", "no filter"])
    n = spark.read.parquet(tree).where("proto in (6, 17)").count()
    weight = spark.read.parquet(tree).where("proto in (6, 17)").selectExpr("sum(coalesce(nullif(cnt_flows, 0), 1))").first()[0]
    out = said("-r", tree, "-f", str(tmp_path / "f"), "-o", "line").strip().splitlines()
    assert len(out) == n + 2 and f"total flows: {weight}," in out[-1]
    assert len(said("-r", tree, "-q", "-o", "mine", "-C", str(tmp_path / "c.toml"), "-c", "3").strip().splitlines()) == 3
    import json

    assert len(json.loads(said("-r", tree, "-o", "json", "-c", "3"))) == 3
    assert said("-r", tree, "-s", "record/bytes/packets", "-n", "2").count("Top 2 flows") == 2
    assert len(said("-r", tree, "-E").strip().splitlines()) == spark.read.parquet(tree).select("exporter_id").distinct().count()
    assert f"generic,{spark.read.parquet(tree).where('in_packets is not null or first_ms is not null or proto is not null').count()}" in said("-r", tree, "-x")
    first = [x.split()[1] for x in said("-r", tree, "-m", "-q", "first seen > 2024").strip().splitlines()]
    assert first == sorted(first)
    run(spark, ["-r", tree, "-w", str(tmp_path / "ff"), "-z", "bz2", "proto udp"])
    one = str(next(p for p in (tmp_path / "ff").iterdir() if p.name.startswith("part-")))
    assert "corrupt_blocks: 0" in said("-r", one, "-v")
    run(spark, ["-r", one, "-i", "other", "-J", "zstd", "-w", str(tmp_path / "again")])
    assert flowfile.load(spark, str(tmp_path / "again")).select("ident").distinct().first()[0] == "other"
    assert flowfile.load(spark, str(tmp_path / "ff")).count() == spark.read.parquet(tree).where("proto = 17").count()
    with pytest.raises(ValueError):
        run(spark, ["-r", tree, "geo SE"])


def test_commands(spark, tree, tmp_path, capsys):
    from freshet import tools
    from freshet.sources import files, udp as collector

    call = lambda *args: (tools.run(spark, [str(x) for x in args]), capsys.readouterr().out)[1]
    (tmp_path / "caps").mkdir()
    (tmp_path / "caps" / "a.pcap").write_bytes(capture([(5_000_000 + 500_000 * i, ether(ip4(udp(1000, 2000, b"x"), 17))) for i in range(3)]))
    call("capture", tmp_path / "caps", tmp_path / "made")
    assert [(r.in_packets, r.src_port, r.source) for r in spark.read.parquet(str(tmp_path / "made")).collect()] == [(3, 1000, "capture")]
    files.write(spark.read.parquet(tree), str(tmp_path / "t"))
    key = "abcdefghijklmnopqrstuvwxyz012345"
    call("anonymise", tmp_path / "t", tmp_path / "hidden", key)
    assert spark.read.parquet(str(tmp_path / "hidden")).count() == spark.read.parquet(tree).count()
    assert "80" in call("track", tmp_path / "t", "-n", "3") and "web" in call("profile", tmp_path / "t", "web=port 443", "all=any")
    old = call("expire", tmp_path / "t", "--max-age-hours", "1", "--now-ms", "1709258400000", "--remove").strip().splitlines()
    assert len(old) > 1 and call("expire", tmp_path / "t", "--max-age-hours", "1", "--now-ms", "1709258400000").strip().count("\n") == 0
    (tmp_path / "b.csv").write_text("network,geoname_id,registered_country_geoname_id,latitude,longitude,accuracy_radius\n10.0.0.0/8,7,7,1.5,2.5,10\n")
    (tmp_path / "l.csv").write_text("geoname_id,continent_code,country_iso_code,city_name\n7,EU,SE,Town\n")
    (tmp_path / "x.txt").write_text("ExitNode 00\nExitAddress 10.1.2.3 2024-03-01 00:00:00\n")
    call("import-geo", tmp_path / "b.csv", "blocks4", tmp_path / "geo"), call("import-geo", tmp_path / "l.csv", "locations", tmp_path / "geo"), call("import-exits", tmp_path / "x.txt", tmp_path / "exits")
    assert call("lookup", "10.1.2.3", "11.0.0.1", "-G", tmp_path / "geo", "-H", tmp_path / "exits").splitlines()[1].startswith("10.1.2.3,SE,")
    run(spark, ["-r", tree, "-G", str(tmp_path / "geo"), "-s", "srcgeo/bytes", "src geo SE"])
    assert ",SE," in capsys.readouterr().out
    import threading

    (tmp_path / "spool").mkdir()
    threading.Timer(12, lambda: call("replay", tree, "--port", "19997", "--filter", "proto tcp and ipv4")).start()
    call("collect", tmp_path / "spool", tmp_path / "got", tmp_path / "cp", "--port", "19997", "--host", "127.0.0.1", "--seconds", "30", "--every", "5 seconds")
    assert isinstance(collector.SPOOL.names, list) and spark.read.parquet(str(tmp_path / "got")).where("proto = 6").count() > 0

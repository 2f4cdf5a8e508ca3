"""Commands beside the query tool: `python -m freshet collect ...` and the like. Each is a thin shell around functions of the library."""

from __future__ import annotations

import argparse

COMMANDS = ("collect", "capture", "anonymise", "replay", "expire", "track", "profile", "lookup", "import-geo", "import-exits")


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="freshet")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str):
        return sub.add_parser(name, help=text).add_argument

    a = command("collect", "receive exporter packets over UDP and store the flows by source and slot")
    a("spool"), a("path"), a("checkpoint"), a("--port", type=int, default=9995), a("--host", default="0.0.0.0"), a("--sflow", action="store_true"), a("--seconds", type=float, help="stop after so long"), a("--every", default="5 minutes"), a("--repeat-to", nargs="*", default=[], metavar="HOST:PORT", help="send every packet on")
    a = command("capture", "make flows of capture files")
    a("captures"), a("path"), a("--active", type=int, default=300), a("--inactive", type=int, default=60), a("--ident", default="capture")
    a = command("anonymise", "anonymise the addresses of a tree of flows")
    a("source"), a("path"), a("key"), a("--side", choices=["src", "dst", "both"], default="both")
    a = command("replay", "send flows as exporter packets")
    a("source"), a("--host", default="127.0.0.1"), a("--port", type=int, default=9995), a("--version", type=int, choices=[5, 9, 250], default=9), a("--delay", type=float, default=0.0), a("--speed", type=float), a("--filter", default="")
    a = command("expire", "list the slots that are too old or too many, and remove them with --remove")
    a("path"), a("--max-age-hours", type=float), a("--max-bytes", type=int), a("--now-ms", type=int), a("--remove", action="store_true")
    a = command("track", "sums of ports per slot, with those of the last day; the largest with -n")
    a("source"), a("-n", type=int)
    a = command("profile", "totals of channels per slot: name=filter ...")
    a("source"), a("channels", nargs="+")
    a = command("lookup", "what the tables know of addresses")
    a("addresses", nargs="+"), a("-G", "--geo"), a("-H", "--exits")
    a = command("import-geo", "make tables of places and systems from CSV")
    a("csv"), a("kind", choices=["locations", "blocks4", "blocks6", "as4", "as6"]), a("path")
    a = command("import-exits", "make the table of exit nodes from lists of sightings")
    a("lists"), a("path")
    return p


def run(spark, argv: list[str]) -> None:
    o = arguments().parse_args(argv)
    globals()["_" + o.command.replace("-", "_")](spark, o)


def _flows(spark, path: str):
    from freshet.schema import normalise
    from freshet.sources import files

    return normalise(files.read(spark, path))


def _print(df) -> None:
    print(",".join(df.columns))
    for r in df.toLocalIterator():
        print(",".join("" if v is None else str(v) for v in r))


def _collect(spark, o) -> None:
    from freshet.sources import udp
    from freshet.streaming.jobs import store

    to = [(h, int(p)) for h, _, p in (x.rpartition(":") for x in o.repeat_to)]
    with udp.Collector(o.spool, o.host, o.port, repeat_to=to):
        query = udp.decoded(udp.stream(spark, o.spool), o.sflow)(lambda df, batch: store(df, o.path, batch), o.checkpoint, o.every)
        query.awaitTermination(o.seconds) if o.seconds else query.awaitTermination()
        query.stop()
    # what was spooled since the last batch
    udp.decoded(udp.stream(spark, o.spool), o.sflow)(lambda df, batch: store(df, o.path, batch), o.checkpoint, None).awaitTermination()


def _capture(spark, o) -> None:
    from pyspark.sql import functions as F

    from freshet.sources import files, pcap

    made = pcap.flows(pcap.reassembled(pcap.without_repeats(pcap.packets(spark, o.captures))), o.active, o.inactive)
    made = made.withColumns({"ident": F.lit(o.ident), "received_ms": F.col("last_ms"), "rec_no": F.monotonically_increasing_id()})
    files.write(made, o.path)
    for r in pcap.unreadable(spark, o.captures).toLocalIterator():
        print(f"{r.path}: {r.error}")


def _anonymise(spark, o) -> None:
    from freshet.functions.cryptopan import anonymize
    from freshet.sources import files

    files.write(anonymize(_flows(spark, o.source), o.key, o.side), o.path)


def _replay(spark, o) -> None:
    from freshet.filterlang.compiler import apply_filter
    from freshet.sources import netflow

    netflow.replay(apply_filter(_flows(spark, o.source), o.filter), o.host, o.port, o.version, delay_s=o.delay, speed=o.speed)


def _expire(spark, o) -> None:
    import time

    from freshet.sources import files

    slots = files.slot_sizes(spark, o.path)
    gone = files.expired(slots, o.now_ms or int(time.time() * 1000), None if o.max_age_hours is None else int(o.max_age_hours * 3_600_000), o.max_bytes).orderBy("source", "slot_ms")
    _print(gone.drop("folder"))
    if o.remove:
        files.remove(spark, [r.folder for r in gone.select("folder").collect()])  # a row per slot


def _track(spark, o) -> None:
    from freshet.operators import summary

    per = summary.ports(_flows(spark, o.source))
    _print(summary.top_ports(per, o.n) if o.n else summary.rolling_ports(per))


def _profile(spark, o) -> None:
    from freshet.operators import summary

    _print(summary.profile(_flows(spark, o.source), dict(x.split("=", 1) for x in o.channels)))


def _lookup(spark, o) -> None:
    from freshet.cli import lookups
    from freshet.operators import enrich

    t = lookups(spark, o.geo, o.exits)
    _print(enrich.whois(spark, o.addresses, t.blocks4, t.locations, t.as4, t.exits))


def _import_geo(spark, o) -> None:
    from freshet.sources import files

    files.read_geo_csv(spark, o.csv, o.kind).write.mode("overwrite").parquet(f"{o.path}/{o.kind}")


def _import_exits(spark, o) -> None:
    from freshet.operators import enrich
    from freshet.sources import files

    enrich.tor_intervals(files.read_tor(spark, o.lists)).write.mode("overwrite").parquet(o.path)

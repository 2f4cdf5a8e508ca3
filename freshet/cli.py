"""Command line: read flows, filter, aggregate or rank them, and print or write what is left."""

from __future__ import annotations

import argparse

from freshet.api import Flows
from freshet.functions.time import parse_window


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="freshet", description="Analyse network flow records.")
    a = p.add_argument
    a("filter", nargs="*", help="filter expression")
    a("-r", "--read", help="Parquet tree or file; with --flowfile, binary flow files")
    a("--flowfile", action="store_true", help="read binary flow files")
    a("-R", "--slots", help="first:last slot")
    a("-M", "--sources", help="idents, separated by colons; * and ? are wildcards")
    a("-t", "--time", help="time window from-to")
    a("-c", "--count", type=int, help="stop after so many records that pass")
    a("-a", "--aggregate", action="store_true", help="aggregate by the 5-tuple")
    a("-A", "--keys", help="aggregate by these keys")
    a("-b", "--bidirectional", action="store_true", help="merge both directions")
    a("-B", "--guess", action="store_true", help="merge both directions and guess which is which")
    a("-s", "--stat", action="append", default=[], help="statistic element[:p][/order...], or record[/order]")
    a("-n", "--top", type=int, help="number of rows (10 for statistics, else all; 0 for all)")
    a("-O", "--order", help="sort by this key")
    a("-P", "--post-filter", help="filter on aggregated rows")
    a("-o", "--output", default="line", help="format: line, long, extended, csv, csv-fast, json, ndjson, raw, null, fmt:..., csv:...")
    a("-6", "--long6", action="store_true", help="IPv6 addresses in full")
    a("-N", "--plain", action="store_true", help="numbers without units")
    a("-I", "--summary", action="store_true", help="totals only")
    a("-g", "--per-slot", action="store_true", help="totals per slot")
    a("-w", "--write", help="write the flows to this Parquet folder")
    a("-K", "--anonymize", help="anonymise addresses with this key")
    a("-f", "--filter-file", help="read the filter from this file")
    a("-m", "--merge", action="store_true", help="records in order of their first time")
    a("-q", "--quiet", action="store_true", help="no header and no totals")
    a("-Z", "--check", action="store_true", help="only say whether the filter is one")
    a("-X", "--tree", action="store_true", help="only print what the filter was understood as")
    a("-C", "--config", help="settings: user formats under [fmt] and [csv]")
    a("-G", "--geo", help="folder with the Parquet tables locations, blocks4, blocks6, as4, as6 (as far as there are)")
    a("-H", "--exits", help="Parquet table of exit nodes")
    a("-E", "--exporters", action="store_true", help="list the exporters and what came of each")
    a("-v", "--verify", action="store_true", help="check the blocks of a flow file")
    a("-x", "--extensions", action="store_true", help="how many records have each extension")
    a("-i", "--ident", help="write the flow file anew with this ident")
    a("-J", "--repack", choices=["none", "bz2", "zstd"], help="write the flow file anew with this packing")
    a("-z", "--packing", choices=["none", "bz2", "zstd"], help="with -w: write flow files, so packed")
    return p


def lookups(spark, geo: str | None, exits: str | None):
    from pathlib import Path

    from freshet.operators.enrich import Lookups

    have = {n: spark.read.parquet(f"{geo}/{n}") for n in ("locations", "blocks4", "blocks6", "as4", "as6") if geo and (Path(geo) / n).exists()}
    return Lookups(**have, exits=spark.read.parquet(exits) if exits else None)


def _totals(df) -> str:
    from freshet.operators.summary import summary

    t = summary(df).first().asDict()
    span = max((t["last_ms"] or 0) - (t["first_ms"] or 0), 0)
    rate = lambda x: x * 1000 // span if span else 0
    return f"Summary: total flows: {t['flows']}, total bytes: {t['bytes']}, total packets: {t['packets']}, avg bps: {rate(8 * t['bytes'])}, avg pps: {rate(t['packets'])}, avg bpp: {t['bytes'] // t['packets'] if t['packets'] else 0}"


def _show(df) -> None:
    for r in df.toLocalIterator():
        print(",".join("" if v is None else str(v) for v in r))


def run(spark, argv: list[str]) -> None:
    from freshet.filterlang.parser import parse
    from freshet.operators import aggregate as agg
    from freshet.operators import summary
    from freshet.output.raw import raw
    from freshet.output.tokens import auto_format, csv_fast, fmt, header
    from freshet.schema import normalise
    from freshet.sources import files, flowfile

    o = arguments().parse_args(argv)
    text = " ".join(o.filter)
    if o.filter_file:
        from pathlib import Path

        text = f"({Path(o.filter_file).read_text()}) and ({text})" if text else Path(o.filter_file).read_text()
    if o.check or o.tree:
        print(parse(text) if o.tree else "OK" if parse(text) else "")
        return
    if not o.read:
        raise SystemExit("-r is needed")
    if o.verify:
        for k, v in flowfile.verify(o.read).items():
            print(f"{k}: {v}")
        return
    if o.ident is not None or o.repack:
        packing = {"none": flowfile.NONE, "bz2": flowfile.BZ2, "zstd": flowfile.ZSTD, None: None}[o.repack]
        flowfile.repack(o.read, o.write or o.read, packing, o.ident)
        return
    user = files.load_config(o.config) if o.config else {}
    full = o.output.endswith("6") and o.output != "6" and ":" not in o.output
    o.output, o.long6 = o.output[:-1] if full else o.output, o.long6 or full
    if o.flowfile:
        spark.dataSource.register(flowfile.FlowFileSource)
        df = normalise(spark.read.format("flowfile").load(o.read))
    else:
        df = normalise(files.read(spark, o.read, slots=o.slots, sources=o.sources.split(":") if o.sources else None))
    df = Flows(df, lookups=lookups(spark, o.geo, o.exits)).filter(text).df
    if o.time:
        df = df.where(files.in_window(*parse_window(o.time)))
    f = Flows(df, lookups=lookups(spark, o.geo, o.exits))
    if o.exporters:
        _show(summary.exporters(f.df).orderBy("exporter_id"))
        return
    if o.extensions:
        _show(summary.extensions(f.df))
        return
    if o.count:
        f = f.first(o.count)
    if o.anonymize:
        f = f.anonymize(o.anonymize)
    if o.summary:
        for k, v in f.summary().first().asDict().items():
            print(f"{k}: {v}")
        return
    if o.per_slot:
        _show(summary.per_slot(f.df).orderBy("slot_ms").select("slot_ms", "flows", "packets", "bytes"))
        return
    elements = [s for s in o.stat if not s.startswith("record")]
    if elements:
        t = f.stat(*elements, n=10 if o.top is None else o.top).orderBy("stat", "ord", "rank")
        print(",".join(t.columns))
        _show(t)
        return
    record = next((s for s in o.stat if s.startswith("record")), None)
    grouped = o.aggregate or o.keys or o.bidirectional or o.guess or record
    if o.bidirectional or o.guess:
        f = f.bidirectional()
        f = f.guess_direction() if o.guess else f
    elif grouped:
        f = f.aggregate(o.keys)
    orders = record.split("/")[1:] if record else []
    order = o.order or (orders[0] if orders else "flows" if record else "tstart" if o.merge else None)
    n = o.top if o.top is not None else 10 if record else 0
    if len(orders) > 1 and not o.order:
        ties = [c for c in f.df.columns if f.df.schema[c].dataType.typeName() not in ("array", "binary")]
        several = agg.tops(f.df, orders, n, ties)
        for x in orders:  # one list after the other
            print(f"Top {n} flows ordered by {x}:")
            _show(fmt(several.where(several.ord == x).orderBy("rank"), auto_format(o.keys) if o.keys else "line", long6=o.long6, plain=o.plain))
        return
    if order:
        ties = [c for c in f.df.columns if f.df.schema[c].dataType.typeName() not in ("array", "binary")]
        f = Flows(agg.top(f.df, order, n, ties, o.post_filter if grouped else None), o.keys, lookups=f.lookups)
    elif o.post_filter and grouped:
        f = f.filter(o.post_filter)
    if o.write and o.packing:
        from freshet.schema import conform

        spark.dataSource.register(flowfile.FlowFileSource)
        conform(f.df).write.format("flowfile").option("packing", o.packing).mode("append").save(o.write)
        return
    if o.write:
        f.df.write.mode("overwrite").parquet(o.write)
        return
    out = f.df.limit(n) if n and not order else f.df
    kind, _, text = o.output.partition(":")
    if kind == "null":
        out.write.format("noop").mode("overwrite").save()
    elif kind == "csv-fast":
        _show(csv_fast(out))
    elif kind == "csv":
        t = f._new(out).csv(text or "csv", long6=o.long6, user=user.get("csv"))
        if not o.quiet:
            print(",".join(t.columns))
        _show(t)
    elif kind == "json":
        from freshet.output.json import pretty

        print("[")
        for i, r in enumerate(pretty(out).toLocalIterator()):
            print(("," if i else "") + r[0])
        print("]")
    elif kind == "ndjson":
        _show(Flows(out).ndjson())
    elif kind == "raw":
        _show(raw(out))
    else:
        what = text if kind == "fmt" else auto_format(o.keys) if o.keys and o.output == "line" else o.output
        formats = user.get("fmt")
        if not o.quiet:
            print(header(what, formats))
        _show(f._new(out).fmt(what, user=formats, long6=o.long6, plain=o.plain))
        if not o.quiet:
            print(_totals(out))


def main(argv: list[str] | None = None) -> None:
    import sys

    from freshet import tools
    from freshet.session import configured

    from pyspark.sql import SparkSession

    spark = configured(SparkSession.builder).appName("freshet").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    argv = sys.argv[1:] if argv is None else argv
    (tools.run if argv and argv[0] in tools.COMMANDS else run)(spark, argv)

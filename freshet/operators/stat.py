"""Statistics of flow elements: Top-N of any field by flows, packets, bytes or rates.

All statistics of a run share one scan: each record is exploded into (statistic, protocol, key) and one aggregation serves them all.
A record counts once for each source column of a statistic, also if both hold the same value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions import ip
from freshet.functions.rates import div, weight
from freshet.schema import COLUMNS, field

# name: kind and source columns. Numbers that are missing count under 0, other kinds are left out.
ELEMENTS = {
    "srcip": ("ip", ["src4", "src6"]), "dstip": ("ip", ["dst4", "dst6"]), "ip": ("ip", ["src4", "dst4", "src6", "dst6"]),
    "srcgeo": ("text", ["src_geo"]), "dstgeo": ("text", ["dst_geo"]), "geo": ("text", ["src_geo", "dst_geo"]),
    "nhip": ("ip", ["next4", "next6"]), "nhbip": ("ip", ["bgp_next4", "bgp_next6"]), "router": ("ip", ["router4", "router6"]),
    "srcport": ("number", ["src_port"]), "dstport": ("number", ["dst_port"]), "port": ("number", ["src_port", "dst_port"]), "proto": ("number", ["proto"]), "flags": ("number", ["tcp_flags"]),
    "srctos": ("number", ["src_tos"]), "dsttos": ("number", ["dst_tos"]), "tos": ("number", ["src_tos", "dst_tos"]), "dir": ("number", ["dir"]),
    "srcas": ("number", ["src_as"]), "srcasn": ("number", ["src_as"]), "dstas": ("number", ["dst_as"]), "dstasn": ("number", ["dst_as"]), "as": ("number", ["src_as", "dst_as"]), "asn": ("number", ["src_as", "dst_as"]),
    "prevas": ("number", ["prev_as"]), "nextas": ("number", ["next_as"]), "inif": ("number", ["input_if"]), "outif": ("number", ["output_if"]), "if": ("number", ["input_if", "output_if"]),
    "srcmask": ("number", ["src_mask"]), "dstmask": ("number", ["dst_mask"]), "mask": ("number", ["src_mask", "dst_mask"]), "tunproto": ("number", ["tun_proto"]),
    "srcvlan": ("number", ["src_vlan"]), "dstvlan": ("number", ["dst_vlan"]), "vlan": ("number", ["src_vlan", "dst_vlan"]),
    "insrcmac": ("mac", ["in_src_mac"]), "outdstmac": ("mac", ["out_dst_mac"]), "indstmac": ("mac", ["in_dst_mac"]), "outsrcmac": ("mac", ["out_src_mac"]), "ethertype": ("number", ["ether_type"]),
    "srcmac": ("mac", ["in_src_mac", "out_src_mac"]), "dstmac": ("mac", ["in_dst_mac", "out_dst_mac"]), "inmac": ("mac", ["in_src_mac", "in_dst_mac"]), "outmac": ("mac", ["out_dst_mac", "out_src_mac"]),
    "mac": ("mac", ["in_src_mac", "out_dst_mac", "in_dst_mac", "out_src_mac"]),
    "cl": ("number", ["client_us"]), "sl": ("number", ["server_us"]), "al": ("number", ["app_us"]), "nbar": ("hex", ["nbar_id"]),
    "ja3": ("text", ["ja3"]), "ja4": ("text", ["ja4"]), "ja4s": ("text", ["ja4s"]), "odid": ("number", ["obs_domain_id"]), "opid": ("number", ["obs_point_id"]),
    "event": ("number", ["fw_event"]), "xevent": ("number", ["fw_xevent"]), "nat": ("number", ["nat_event"]),
    "natsrcip": ("ip", ["x_src4", "x_src6"]), "natdstip": ("ip", ["x_dst4", "x_dst6"]), "natip": ("ip", ["x_src4", "x_src6", "x_dst4", "x_dst6"]),
    "natsrcport": ("number", ["x_src_port"]), "natdstport": ("number", ["x_dst_port"]), "natport": ("number", ["x_src_port", "x_dst_port"]),
    "iacl": ("list", ["ingress_acl"]), "eacl": ("list", ["egress_acl"]), "ivrf": ("number", ["ingress_vrf"]), "evrf": ("number", ["egress_vrf"]), "minttl": ("number", ["min_ttl"]), "maxttl": ("number", ["max_ttl"]),
}
ELEMENTS |= {f"mpls{i}": ("mpls", [str(i - 1)]) for i in range(1, 11)}
ORDERS = ["flows", "packets", "ipkg", "opkg", "bytes", "ibyte", "obyte", "pps", "ipps", "opps", "bps", "ibps", "obps", "bpp", "ibpp", "obpp"]
MAX_STATS = 8


@dataclass(frozen=True)
class Request:
    name: str
    by_proto: bool
    orders: tuple[tuple[str, bool], ...]  # (order, ascending)


def parse_request(text: str) -> Request:
    """`srcip:p/bytes/flows:a`: element, optional protocol split, and one or more orders (flows by default)."""
    head, *orders = text.lower().split("/")
    name, _, split = head.partition(":")
    if name not in ELEMENTS or split not in ("", "p"):
        raise ValueError(f"unknown statistic: {head}")
    out = []
    for o in orders or ["flows"]:
        n, _, way = o.partition(":")
        if n not in ORDERS or way not in ("", "a", "d"):
            raise ValueError(f"unknown order: {o}")
        out.append((n, way == "a"))
    return Request(name, split == "p", tuple(out))


def _sources(df: DataFrame, name: str) -> list[tuple[Column, Column]]:
    """Keys of a record, one (number, text) pair per source, both NULL where it has none. Numbers, IPv4 and MAC addresses stay numbers until
    they are aggregated; IPv6 addresses are hex until they are shown."""
    kind, names = ELEMENTS[name]
    no_number, no_text = F.lit(None).cast("long"), F.lit(None).cast("string")
    if kind == "mpls":
        return [(F.coalesce(F.shiftright(F.get(field(df, "mpls"), F.lit(int(names[0]))), 4), F.lit(0)).cast("long"), no_text)]
    if kind == "list":
        acl = field(df, names[0])
        return [(no_number, F.when(acl.isNotNull(), F.concat_ws(":", F.transform(acl, lambda x: F.format_string("0x%x", x)))))]
    out = []
    for n in names:
        c = field(df, n)
        if kind == "number":
            wide = COLUMNS[n].typeName() == "decimal"  # beyond 63 bits
            out.append((no_number, F.coalesce(c, F.lit(0)).cast("string")) if wide else (F.coalesce(c, F.lit(0)).cast("long"), no_text))
        elif kind == "ip" and n.endswith("6"):
            out.append((no_number, F.hex(c)))
        elif kind in ("ip", "mac"):
            out.append((c.cast("long"), no_text))
        else:
            out.append((no_number, F.hex(c) if kind == "hex" else c))
    return out


def _key_text(kinds: list[str]) -> Column:
    """Text of a key by the kind of its statistic (place in `kinds`)."""
    of = lambda kind: [i for i, k in enumerate(kinds) if k == kind]
    text = F.col("kl").cast("string")
    for kind, f in (("ip", ip.text4), ("mac", ip.mac_text)):
        if of(kind):
            text = F.when(F.col("sid").isin(*of(kind)), f(F.col("kl"))).otherwise(text)
    return F.coalesce(F.col("kt"), text)


def _measure(name: str) -> Column:
    p, q, b, d = (F.col(x) for x in ("in_packets", "out_packets", "in_bytes", "out_bytes"))
    dur = F.col("last_ms") - F.col("first_ms")
    pick = {"": (p + q, b + d), "i": (p, b), "o": (q, d)}
    side = name[0] if name[0] in "io" and name not in ("in", "out") else ""
    base = name[len(side) :]
    pk, by = pick[side]
    return {"flows": F.col("flows"), "packets": pk, "pkg": pk, "bytes": by, "byte": by, "pps": div(pk * 1000, dur), "bps": div(by * 8000, dur), "bpp": div(by, pk)}[base]


def statistics(df: DataFrame, requests: list[str]) -> DataFrame:
    """stat, proto (NULL unless split), key, first_ms, last_ms, flows, in/out packets and bytes: all values of all requested elements."""
    return _grouped(df, requests).drop("whole")


def _grouped(df: DataFrame, requests: list[str], with_total: bool = False) -> DataFrame:
    """statistics(); with_total, also a row for all records, whose stat is NULL and `whole` true."""
    reqs = [parse_request(r) for r in requests]
    if not 1 <= len(reqs) <= MAX_STATS:
        raise ValueError(f"between 1 and {MAX_STATS} statistics")
    wanted = list(dict.fromkeys((r.name, r.by_proto) for r in reqs))
    entry = lambda i, proto, n, t: F.struct(F.lit(i).alias("sid"), proto.alias("proto"), n.alias("kl"), t.alias("kt"))
    none = F.lit(None).cast("int")
    entries = [entry(-1, none, F.lit(0).cast("long"), F.lit(None).cast("string"))] if with_total else []
    for i, (name, split) in enumerate(wanted):
        entries += [entry(i, field(df, "proto").cast("int") if split else none, n, t) for n, t in _sources(df, name)]
    zero = F.lit(0).cast("long")
    counts = [F.coalesce(field(df, n), zero).alias(n) for n in ("in_packets", "in_bytes", "out_packets", "out_bytes")]
    x = df.select("first_ms", "last_ms", weight(field(df, "cnt_flows")).alias("flows"), *counts, F.explode(F.array(*entries)).alias("e"))
    g = x.select("e.*", "*").where("kl is not null or kt is not null").groupBy("sid", "proto", "kl", "kt")
    sums = ["flows", "in_packets", "in_bytes", "out_packets", "out_bytes"]
    g = g.agg(F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), *[F.sum(n).alias(n) for n in sums], F.bool_or(F.col("sid") < 0).alias("whole"))
    names = F.array(*[F.lit(name + (":p" if split else "")) for name, split in wanted])
    return g.select(F.get(names, F.col("sid")).alias("stat"), "proto", _key_text([ELEMENTS[name][0] for name, _ in wanted]).alias("key"), *[c for c in g.columns if c not in ("sid", "proto", "kl", "kt")])


def shown_key(df: DataFrame) -> DataFrame:
    """Turns hex IPv6 keys of address statistics into text."""
    hex6 = F.col("key").rlike("^[0-9A-F]{32}$") & F.col("stat").rlike("ip|router")
    return df.withColumn("key", F.when(hex6, ip.text6(F.unhex("key"))).otherwise(F.col("key")))


def top_n(df: DataFrame, requests: list[str], n: int = 10) -> DataFrame:
    """rank, stat, ord, proto, key, first_ms, last_ms, flows, packets, bytes, shares of the totals in hundredths of a percent, pps, bps, bpp.

    n = 0 keeps all. Ties are broken by key. An element that no record has gives no row; an empty table gives none at all.
    """
    # Sums are never NULL and no time lies before all others: true of every row. All columns are asked for, and `whole` instead of the key, so
    # that the totals and the values have one plan and the table is read once.
    values = _grouped(df, requests, with_total=True)
    values = values.where(" and ".join(f"coalesce({n}, 0L) > -9223372036854775808L" for n in ("first_ms", "last_ms", "flows", "in_packets", "in_bytes", "out_packets", "out_bytes")))
    total = values.where("whole").agg(F.max(F.struct(F.col("flows").alias("f"), (F.col("in_packets") + F.col("out_packets")).alias("p"), (F.col("in_bytes") + F.col("out_bytes")).alias("b")))).scalar()
    values = values.where("not whole")
    reqs = [parse_request(r) for r in requests]
    cases = []
    for r in reqs:
        stat = r.name + (":p" if r.by_proto else "")
        for o, up in r.orders:
            v = _measure(o)
            cases.append(F.when(F.col("stat") == stat, F.struct(F.lit(o).alias("ord"), (v if up else -v).alias("v"))))
    x = values.withColumn("c", F.explode(F.array_compact(F.array(*cases))))
    if len(cases) == 1 and n:
        # one list: the first n need no shuffle of all values
        x = x.orderBy("c.v", F.col("proto").asc_nulls_first(), "key").limit(n)
    w = Window.partitionBy("stat", "c.ord").orderBy(F.col("c.v"), F.col("proto").asc_nulls_first(), F.col("key"))
    x = x.withColumn("rank", F.row_number().over(w))
    if n:
        x = x.where(F.col("rank") <= n)
    x = x.withColumn("t", total)
    packets, bytes_ = F.col("in_packets") + F.col("out_packets"), F.col("in_bytes") + F.col("out_bytes")
    dur = F.col("last_ms") - F.col("first_ms")
    return shown_key(x).select(
        "rank", "stat", F.col("c.ord").alias("ord"), "proto", "key", "first_ms", "last_ms", "flows", packets.alias("packets"), bytes_.alias("bytes"),
        div(F.col("flows") * 10000, F.col("t.f")).alias("flows_share"), div(packets * 10000, F.col("t.p")).alias("packets_share"), div(bytes_ * 10000, F.col("t.b")).alias("bytes_share"),
        div(packets * 1000, dur).alias("pps"), div(bytes_ * 8000, dur).alias("bps"), div(bytes_, packets).alias("bpp"),
    )

"""Flow aggregation: by the 5-tuple, by any keys with prefix masks, and in both directions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions import ip
from freshet.functions.rates import div, weight
from freshet.schema import field

FIVE_TUPLE = ["src4", "dst4", "src6", "dst6", "src_port", "dst_port", "proto"]
# key name -> columns; those ending in 4 or 6 may have a mask
KEYS = {
    "proto": ["proto"], "srcport": ["src_port"], "dstport": ["dst_port"], "tos": ["src_tos"], "srctos": ["src_tos"], "flags": ["tcp_flags"],
    "srcip4": ["src4"], "dstip4": ["dst4"], "srcip6": ["src6"], "dstip6": ["dst6"], "srcip": ["src4", "src6"], "dstip": ["dst4", "dst6"],
    "srcnet": ["src4", "src6"], "dstnet": ["dst4", "dst6"], "xsrcip": ["x_src4", "x_src6"], "xdstip": ["x_dst4", "x_dst6"], "xsrcport": ["x_src_port"], "xdstport": ["x_dst_port"],
    "next": ["next4", "next6"], "bgpnext": ["bgp_next4", "bgp_next6"], "router": ["router4", "router6"], "insrcmac": ["in_src_mac"], "outdstmac": ["out_dst_mac"],
    "indstmac": ["in_dst_mac"], "outsrcmac": ["out_src_mac"], "srcas": ["src_as"], "dstas": ["dst_as"], "srcasn": ["src_as"], "dstasn": ["dst_as"], "nextas": ["next_as"], "prevas": ["prev_as"],
    "inif": ["input_if"], "outif": ["output_if"], "srcmask": ["src_mask"], "dstmask": ["dst_mask"], "dsttos": ["dst_tos"], "srcvlan": ["src_vlan"], "dstvlan": ["dst_vlan"],
    "odid": ["obs_domain_id"], "opid": ["obs_point_id"], "exp": ["exporter_id"], "srcgeo": ["src_geo"], "dstgeo": ["dst_geo"], "ethertype": ["ether_type"], "minttl": ["min_ttl"], "maxttl": ["max_ttl"],
}
KEYS |= {f"mpls{i}": [f"mpls{i}"] for i in range(1, 11)}
# Sort keys: name -> columns of totals, then rates over the duration.
ORDERS = ["flows", "packets", "ipackets", "opackets", "bytes", "ibytes", "obytes", "pps", "ipps", "opps", "bps", "ibps", "obps", "bpp", "ibpp", "obpp", "tstart", "tend", "duration"]
MAX_KEYS = 64


def key_columns(df: DataFrame, spec: str) -> dict[str, Column]:
    """`srcip4/24,dstport` to output column -> expression. Names may not repeat; only address keys that name a family take a mask."""
    out: dict[str, Column] = {}
    names = [x.strip() for x in spec.split(",") if x.strip()]
    if not names or len(names) > MAX_KEYS:
        raise ValueError(f"between 1 and {MAX_KEYS} keys")
    seen = set()
    for item in names:
        name, _, mask = item.lower().partition("/")
        if name not in KEYS:
            raise ValueError(f"unknown aggregation key: {name}")
        if name in seen:
            raise ValueError(f"aggregation key given twice: {name}")
        seen.add(name)
        if mask and not re.fullmatch(r"(src|dst)ip[46]", name):
            raise ValueError(f"{name} takes no mask")
        for c in KEYS[name]:
            out[c] = _key(df, name, c, int(mask) if mask else None)
    return out


def _key(df: DataFrame, name: str, column: str, mask: int | None) -> Column:
    if column.startswith("mpls"):
        return F.shiftright(F.get(field(df, "mpls"), F.lit(int(column[4:]) - 1)), 4)
    c = field(df, column)
    if mask is not None:
        if not 0 <= mask <= (32 if column.endswith("4") else 128):
            raise ValueError(f"prefix length out of range: {mask}")
        return ip.masked4(c, mask) if column.endswith("4") else ip.masked6(c, mask)
    if name in ("srcnet", "dstnet"):
        # by the record's own mask; without one nothing is known of the network
        bits = F.coalesce(field(df, name[:3] + "_mask"), F.lit(0))
        return ip.masked4(c, bits) if column.endswith("4") else _own_mask6(c, bits)
    return c


def _own_mask6(c: Column, bits: Column) -> Column:
    """By the nearest whole byte at or below the record's mask, then the bits of the next one."""
    whole = F.floor(F.least(bits.cast("int"), F.lit(128)) / 8).cast("int")
    rest = (F.least(bits.cast("int"), F.lit(128)) % 8).cast("int")
    byte = F.coalesce(F.conv(F.hex(F.substring(c, whole + 1, F.lit(1))), 16, 10).cast("int"), F.lit(0))
    keep = F.call_function("shiftleft", F.call_function("shiftright", byte, 8 - rest), 8 - rest)
    return F.when(c.isNotNull(), F.substring(F.concat(F.substring(c, F.lit(1), whole), F.unhex(F.lpad(F.hex(keep.cast("long")), 2, "0")), F.lit(bytes(16))), 1, 16))


def totals(df: DataFrame) -> list[Column]:
    """The fixed aggregates, in columns of the flow schema so that an aggregate is a flow table again."""
    return [
        F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"),
        F.coalesce(F.sum(field(df, "in_packets")), F.lit(0).cast("long")).alias("in_packets"), F.coalesce(F.sum(field(df, "in_bytes")), F.lit(0).cast("long")).alias("in_bytes"),
        F.coalesce(F.sum(field(df, "out_packets")), F.lit(0).cast("long")).alias("out_packets"), F.coalesce(F.sum(field(df, "out_bytes")), F.lit(0).cast("long")).alias("out_bytes"),
        F.sum(weight(field(df, "cnt_flows"))).alias("cnt_flows"), F.bit_or(F.coalesce(field(df, "tcp_flags"), F.lit(0)).cast("int")).alias("tcp_flags"),
    ]


def aggregate(df: DataFrame, keys: str | None = None, first: list[str] | None = None) -> DataFrame:
    """One row per key: the keys, first_ms, last_ms, in/out packets and bytes, cnt_flows, tcp_flags. Without `keys` by the 5-tuple.

    Columns in `first` are those of the group's first record (smallest rec_no). Missing keys are NULL and form a group of their own.
    """
    exprs = key_columns(df, keys) if keys else {c: field(df, c) for c in FIVE_TUPLE}
    made = totals(df)
    if "tcp_flags" in exprs:
        made = made[:-1]
    if first:
        # one by one: plain values fit a hash aggregate's buffer, a struct of them makes it a sort
        made += [F.min_by(field(df, c), F.col("rec_no")).alias(c) for c in first if c not in exprs]
    return df.groupBy(*[e.alias(n) for n, e in exprs.items()]).agg(*made)


_SIDES = [("src4", "dst4"), ("src6", "dst6"), ("src_port", "dst_port")]


def bidirectional(df: DataFrame) -> DataFrame:
    """5-tuple aggregation in which the reverse flow of TCP and UDP counts as the out side of the forward one.

    The first record of a pair (smallest rec_no) says which way is forward. Other protocols are aggregated as they are. A pair is
    grouped by its smaller and larger end, so there is no self join.
    """
    both = F.coalesce(field(df, "proto").isin(6, 17), F.lit(False))
    end = lambda side: F.struct(*[field(df, p[side]).alias(str(i)) for i, p in enumerate(_SIDES)])
    fwd = ~both | (end(0) <= end(1))
    x = df.select(
        "rec_no", "first_ms", "last_ms", field(df, "proto").alias("proto"), field(df, "tcp_flags").alias("tcp_flags"), weight(field(df, "cnt_flows")).alias("w"), fwd.alias("fwd"),
        F.when(fwd, end(0)).otherwise(end(1)).alias("a"), F.when(fwd, end(1)).otherwise(end(0)).alias("b"),
        *[F.coalesce(field(df, n), F.lit(0).cast("long")).alias(n) for n in ("in_packets", "in_bytes", "out_packets", "out_bytes")],
    )
    to = lambda way, same, other: F.sum(F.when(F.col("fwd") == way, F.col(same)).otherwise(F.col(other)))
    g = x.groupBy("a", "b", "proto").agg(
        F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.sum("w").alias("cnt_flows"), F.bit_or(F.coalesce("tcp_flags", F.lit(0)).cast("int")).alias("tcp_flags"),
        F.min_by("fwd", "rec_no").alias("f"),
        *[to(True, f"{s}_{n}", f"{o}_{n}").alias(f"{s}_{n}") for n in ("packets", "bytes") for s, o in (("in", "out"), ("out", "in"))],
    )
    f = F.col("f")
    pick = lambda x, y: F.when(f, x).otherwise(y)
    ends = [c for i, (s, d) in enumerate(_SIDES) for c in (pick(F.col(f"a.{i}"), F.col(f"b.{i}")).alias(s), pick(F.col(f"b.{i}"), F.col(f"a.{i}")).alias(d))]
    counts = [pick(F.col(f"{s}_{n}"), F.col(f"{o}_{n}")).alias(f"{s}_{n}") for n in ("packets", "bytes") for s, o in (("in", "out"), ("out", "in"))]
    return g.select(*ends, "proto", "first_ms", "last_ms", *counts, "cnt_flows", "tcp_flags")


_SWAPPED = [("src4", "dst4"), ("src6", "dst6"), ("src_port", "dst_port"), ("src_as", "dst_as"), ("input_if", "output_if"), ("src_mask", "dst_mask"), ("in_packets", "out_packets"), ("in_bytes", "out_bytes")]


def guess_direction(df: DataFrame) -> DataFrame:
    """Swaps both sides of TCP and UDP rows whose source port looks like the server's: sp < 1024 <= dp, and so at 32768 and 49152."""
    sp, dp = F.col("src_port"), F.col("dst_port")
    wrong = F.col("proto").isin(6, 17) & ((sp < 1024) & (dp >= 1024) | (sp < 32768) & (dp >= 32768) | (sp < 49152) & (dp >= 49152))
    wrong = F.coalesce(wrong, F.lit(False))
    out = {}
    for a, b in _SWAPPED:
        if a in df.columns and b in df.columns:
            out[a], out[b] = F.when(wrong, F.col(b)).otherwise(F.col(a)), F.when(wrong, F.col(a)).otherwise(F.col(b))
    return df.withColumns(out)


def order_value(df: DataFrame, key: str) -> Column:
    """What a sort key means for a row of an aggregate. Without prefix in and out are added."""
    zero = F.lit(0).cast("long")
    ip_, op, ib, ob = (F.coalesce(field(df, n), zero) for n in ("in_packets", "out_packets", "in_bytes", "out_bytes"))
    dur = field(df, "last_ms") - field(df, "first_ms")
    side = {"": (ip_ + op, ib + ob), "i": (ip_, ib), "o": (op, ob)}
    if key in ("flows", "tstart", "tend", "duration"):
        return {"flows": field(df, "cnt_flows"), "tstart": F.col("first_ms"), "tend": F.col("last_ms"), "duration": dur}[key]
    for s, (p, b) in side.items():
        named = {f"{s}packets": p, f"{s}bytes": b, f"{s}pps": div(p * 1000, dur), f"{s}bps": div(b * 8000, dur), f"{s}bpp": div(b, p)}
        if key in named:
            return named[key]
    raise ValueError(f"unknown order: {key}")


def ordered(df: DataFrame, order: str, ties: list[str] | None = None) -> DataFrame:
    """`bytes`, `tstart:d` ...: times ascend by default, everything else descends; ties by the given columns."""
    name, _, way = order.partition(":")
    v = order_value(df, name)
    up = way == "a" or (not way and name in ("tstart", "tend"))
    return df.orderBy(v.asc() if up else v.desc(), *[F.col(t).asc_nulls_first() for t in ties or []])


def tops(df: DataFrame, orders: list[str], n: int, ties: list[str] | None = None) -> DataFrame:
    """The first n rows by each of several orders, with `ord` and `rank`: one aggregate serves them all. Rows are ranked within each task
    before anything is shuffled, so a list costs n rows of each task."""
    from pyspark.sql import Window

    cases = []
    for o in orders:
        name, _, way = o.partition(":")
        v = order_value(df, name).cast("long")
        up = way == "a" or (not way and name in ("tstart", "tend"))
        cases.append(F.struct(F.lit(o).alias("ord"), (v if up else -v).alias("v")))
    x = df.withColumn("_o", F.explode(F.array(*cases)))
    w = Window.partitionBy("_o.ord").orderBy(F.col("_o.v"), *[F.col(t).asc_nulls_first() for t in ties or []])
    x = x.withColumn("rank", F.row_number().over(w)).withColumn("ord", F.col("_o.ord")).drop("_o")
    return x.where(F.col("rank") <= n) if n else x


def top(df: DataFrame, order: str, n: int, ties: list[str] | None = None, post_filter: str | None = None, filter_first: bool = False) -> DataFrame:
    """The first n rows by `order`. A post filter sees those n rows only, unless filter_first; n = 0 keeps all."""
    from freshet.filterlang.compiler import apply_filter

    if post_filter and filter_first:
        df = apply_filter(df, post_filter)
    df = ordered(df, order, ties)
    if n:
        df = df.limit(n)
    return apply_filter(df, post_filter) if post_filter and not filter_first else df

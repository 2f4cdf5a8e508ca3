"""Queries for filters, aggregation, statistics, totals, lookups and output, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.filterlang.compiler import apply_filter, compile_filter
from freshet.flowview import WIDE_SQL, flows, wide
from freshet.functions import enums
from freshet.operators import aggregate as agg
from freshet.operators import enrich, stat, summary
from freshet.output import json as json_out
from freshet.output import tokens
from freshet.util import table

Q: dict = {}
SQL: dict[str, str] = {}

WIDE = f"with w as ({WIDE_SQL}) "
N4 = "(({0}) // 16777216) || '.' || (({0}) // 65536 % 256) || '.' || (({0}) // 256 % 256) || '.' || (({0}) % 256)"


def text6_sql(h: str) -> str:
    """Condensed text of an IPv6 address given as 32 hex digits: the first of the longest runs of zero groups is ::."""
    groups = ", ".join(f"substr({h}, {1 + 4 * i}, 4)" for i in range(8))
    s = f"regexp_replace(lower(concat_ws(':', {groups})), '(^|:)0{{1,3}}', '\\1', 'g')"
    runs = [f"(^|:)0(:0){{{k - 1}}}(:|$)" for k in range(8, 1, -1)]
    mapped = "'::ffff:' || " + " || '.' || ".join(f"cast(('0x' || substr({h}, {25 + 2 * i}, 2))::int as varchar)" for i in range(4))
    return f"case when starts_with({h}, '00000000000000000000FFFF') then {mapped} " + " ".join(f"when regexp_matches({s}, '{r}') then regexp_replace({s}, '{r}', '::')" for r in runs) + f" else {s} end"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- filters: how many records each of many filters lets through, in one scan

# filter -> condition in SQL; NULL counts as false, its negation as true
FLOW_FILTERS = {
    "any": "true", "not any": "false", "ipv4": "src4 is not null", "ipv6": "src6 is not null", "count < 1000": "rec_no < 1000",
    "ident core-a": "coalesce(nullif(ident, ''), 'none') = 'core-a'", "ident none": "coalesce(nullif(ident, ''), 'none') = 'none'", "engine-type 2": "engine_type = 2", "engine id > 0": "engine_id > 0", "exporter id 3": "exporter_id = 3",
    "proto tcp": "proto = 6", "proto 17": "proto = 17", "not proto tcp": "not coalesce(proto = 6, false)", "src port 443": "src_port = 443", "dst port > 1024": "dst_port > 1024", "port 53": "src_port = 53 or dst_port = 53",
    "port in [53 80, 443]": "src_port in (53, 80, 443) or dst_port in (53, 80, 443)", "icmp-type 3": "proto in (1, 58) and dst_port // 256 = 3", "icmp code 1": "proto in (1, 58) and dst_port % 256 = 1",
    "flags S": "proto = 6 and tcp_flags & 2 = 2", "flags =SA": "proto = 6 and tcp_flags = 18", "not flags RF": "not coalesce(proto = 6 and tcp_flags & 5 = 5, false)", "flags > 20": "proto = 6 and tcp_flags > 20",
    "tos 184": "src_tos = 184", "fwdstat 64": "fwd_status = 64", "packets > 1k": "in_packets > 1000", "bytes >= 1m": "in_bytes >= 1000000", "flows > 1": "cnt_flows > 1", "duration >= 10000": "last_ms - first_ms >= 10000",
    "pps > 10": "in_packets is not null and case when coalesce(last_ms - first_ms, 0) = 0 then 0 else trunc(1000 * in_packets / (last_ms - first_ms)) end > 10",
    "bps > 1m": "in_bytes is not null and case when coalesce(last_ms - first_ms, 0) = 0 then 0 else trunc(8000 * in_bytes / (last_ms - first_ms)) end > 1000000",
    "bpp < 100": "in_bytes is not null and case when coalesce(in_packets, 0) = 0 then 0 else in_bytes // in_packets end < 100",
    "src ip 250.219.236.91": "src4 = 4208716891", "net 10.0.0.0/8": "src4 between 167772160 and 184549375 or dst4 between 167772160 and 184549375", "dst net 172.16.0.0 255.240.0.0": "dst4 between 2886729728 and 2887778303",
    "src ip in [10.0.0.0/8 172.16.0.0/12]": "src4 between 167772160 and 184549375 or src4 between 2886729728 and 2887778303", "src net 2001:db8::/32": "hex(src6) like '20010DB8%'",
    "as 0": "coalesce(src_as, 0) = 0 or coalesce(dst_as, 0) = 0", "src as < 64600": "coalesce(src_as, 0) < 64600", "src as in [64810 65470]": "coalesce(src_as, 0) in (64810, 65470)", "in if 13": "input_if = 13", "if 22": "input_if = 22 or output_if = 22",
    "src mask 16": "src_mask = 16", "first seen > 2024-03-02T12:00:00.500": "first_ms > 1709380800500", "last seen < 2024-03-02": "last_ms < 1709337600000",
    "src port > 1024 and not (dst port 80 or dst port 443) and proto udp": "src_port > 1024 and not coalesce(dst_port = 80 or dst_port = 443, false) and proto = 17", "vlan 5": "false", "not mpls any 33": "true",
}
WIDE_FILTERS = {
    "src vlan 3": "src_vlan = 3", "vlan 3": "src_vlan = 3 or dst_vlan = 3", "mpls label0 50": "mpls[1] // 16 = 50", "mpls label1 > 50": "mpls[2] // 16 > 50", "mpls any 7": "mpls[1] // 16 = 7 or mpls[2] // 16 = 7", "mpls eos 8": "mpls[2] // 16 = 8",
    "in src mac 00:00:00:00:03:e8": "in_src_mac = 1000", "mac 00:00:00:00:07:d1": "in_src_mac = 2001 or out_dst_mac = 2001", "src nat ip 10.0.0.5": "x_src4 = 167772165", "nat port 1100": "x_src_port = 1100", "nat net 10.0.0.0/28": "x_src4 between 167772160 and 167772175",
    "asa event denied": "fw_event = 3", "asa event > 3": "fw_event > 3", "client latency > 900": "client_us > 900", "server latency 23": "server_us = 23", "min ttl < 40": "min_ttl < 40", "ttl 64": "min_ttl = 64 or max_ttl = 64", "flowdir ingress": "dir = 0",
    "out packets > 50": "out_packets > 50", "out bytes < 10k": "out_bytes < 10000", "flows 2": "cnt_flows = 2", "prev as 0": "true",
}


def _filter_counts(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    names = list(filters)
    one = df.agg(*[F.count_if(compile_filter(f, df)).alias(str(i)) for i, f in enumerate(names)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.col(str(i)).alias("n")) for i, f in enumerate(names)])).alias("x")).select("x.*")


def _filter_sql(source: str, filters: dict[str, str], head: str = "") -> str:
    names = list(filters)
    one = ", ".join(f"count(*) filter (where coalesce({c}, false)) c{i}" for i, c in enumerate(filters.values()))
    return f"{head}{', ' if head else 'with '} one as (select {one} from {source}) " + " union all ".join("select '{}' as filter, c{} as n from one".format(f.replace("'", "''"), i) for i, f in enumerate(names))


@query(_filter_sql("flows", FLOW_FILTERS))
def filter_counts(spark: SparkSession, d: str) -> DataFrame:
    return _filter_counts(flows(spark, d), FLOW_FILTERS)


@query(_filter_sql("w", WIDE_FILTERS, f"with w as ({WIDE_SQL})"))
def filter_counts_wide(spark: SparkSession, d: str) -> DataFrame:
    return _filter_counts(wide(spark, d), WIDE_FILTERS)


@query("select rec_no, exporter_id, src4, dst4, src_port, dst_port, in_bytes from flows where proto = 6 and (dst_port = 443 or dst_port = 80) and in_bytes > 100000 and src4 between 167772160 and 184549375")
def filter_rows(spark: SparkSession, d: str) -> DataFrame:
    x = apply_filter(flows(spark, d), "proto tcp and dst port in [80 443] and bytes > 100k and src net 10.0.0.0/8")
    return x.select("rec_no", "exporter_id", "src4", "dst4", "src_port", "dst_port", "in_bytes")


@query("select rec_no, in_packets, in_bytes from flows where first_ms > 1709290800000 and last_ms < 1709294400000")
def filter_time_window(spark: SparkSession, d: str) -> DataFrame:
    from freshet.sources.files import in_window

    return flows(spark, d).where(in_window(1709290800000, 1709294400000)).select("rec_no", "in_packets", "in_bytes")


@query("select rec_no, in_bytes from flows where proto = 17 order by rec_no limit 500")
def filter_first_passing(spark: SparkSession, d: str) -> DataFrame:
    return apply_filter(flows(spark, d), "proto udp").orderBy("rec_no").limit(500).select("rec_no", "in_bytes")


# --- aggregation

_W = "case when coalesce(cnt_flows, 0) = 0 then 1 else cnt_flows end"
_TOT = f"min(first_ms) first_ms, max(last_ms) last_ms, cast(coalesce(sum(in_packets), 0) as bigint) in_packets, cast(coalesce(sum(in_bytes), 0) as bigint) in_bytes, cast({{op}} as bigint) out_packets, cast({{ob}} as bigint) out_bytes, cast(sum({_W}) as bigint) cnt_flows, bit_or(cast(coalesce(tcp_flags, 0) as integer)) tcp_flags"
TOT = _TOT.format(op="0", ob="0")
TOTW = _TOT.format(op="coalesce(sum(out_packets), 0)", ob="coalesce(sum(out_bytes), 0)")
T5 = "src4, dst4, src6, dst6, src_port, dst_port, proto"


@query(f"select {T5}, {TOT} from flows group by {T5}")
def agg_5tuple(spark: SparkSession, d: str) -> DataFrame:
    return agg.aggregate(flows(spark, d))


@query(f"select src4 // 256 * 256 src4, dst_port, {TOT} from flows group by 1, 2")
def agg_srcip4_24_dstport(spark: SparkSession, d: str) -> DataFrame:
    return agg.aggregate(flows(spark, d), "srcip4/24,dstport")


@query(f"select case when src6 is not null then unhex(substr(hex(src6), 1, 12) || repeat('0', 20)) end src6, proto, {TOT} from flows group by 1, 2")
def agg_srcip6_48(spark: SparkSession, d: str) -> DataFrame:
    return agg.aggregate(flows(spark, d), "srcip6/48,proto")


_BITS, _DIGITS = "coalesce(src_mask, 0)", "'0123456789ABCDEF'"
_NET4 = f"(src4 >> (32 - least({_BITS}, 32))) << (32 - least({_BITS}, 32))"
_NIBBLE = f"(strpos({_DIGITS}, substr(hex(src6), {_BITS} // 4 + 1, 1)) - 1)"
_NET6 = f"case when src6 is not null then unhex(substr(substr(hex(src6), 1, {_BITS} // 4) || substr({_DIGITS}, (({_NIBBLE} >> (4 - {_BITS} % 4)) << (4 - {_BITS} % 4)) + 1, 1) || repeat('0', 32), 1, 32)) end"


@query(f"select {_NET4} src4, {_NET6} src6, {TOT} from flows group by 1, 2")
def agg_srcnet(spark: SparkSession, d: str) -> DataFrame:
    return agg.aggregate(flows(spark, d), "srcnet")


@query(f"select exporter_id, src_as, dst_as, {TOT} from flows group by 1, 2, 3")
def agg_exporter_as(spark: SparkSession, d: str) -> DataFrame:
    return agg.aggregate(flows(spark, d), "exp,srcas,dstas")


@query(WIDE + f"select src_vlan, mpls[1] // 16 mpls1, in_src_mac, x_src4, cast(null as blob) x_src6, {TOTW} from w group by 1, 2, 3, 4")
def agg_wide(spark: SparkSession, d: str) -> DataFrame:
    return agg.aggregate(wide(spark, d), "srcvlan,mpls1,insrcmac,xsrcip")


@query(f"with g as (select src4, dst4, proto, {TOT}, min(rec_no) r from flows group by 1, 2, 3) select g.* exclude (r), f.src_port, f.dst_port, f.input_if from g join flows f on f.rec_no = g.r")
def agg_first_record(spark: SparkSession, d: str) -> DataFrame:
    """Attributes that are no keys are those of the first record of a group."""
    return agg.aggregate(flows(spark, d), "srcip4,dstip4,proto", first=["src_port", "dst_port", "input_if"])


_BIDIR = f"""
with x as (select *, coalesce(proto in (6, 17), false) b, case when coalesce(cnt_flows, 0) = 0 then 1 else cnt_flows end wgt,
             coalesce(hex(src6), '') || lpad(coalesce(cast(src4 as varchar), ''), 12, '0') || lpad(cast(src_port as varchar), 6, '0') s,
             coalesce(hex(dst6), '') || lpad(coalesce(cast(dst4 as varchar), ''), 12, '0') || lpad(cast(dst_port as varchar), 6, '0') t from flows),
y as (select *, not b or s <= t fwd, case when not b or s <= t then s || t else t || s end k from x),
f as (select k, proto, arg_min(fwd, rec_no) way, arg_min(rec_no, rec_no) r, min(first_ms) first_ms, max(last_ms) last_ms, cast(sum(wgt) as bigint) cnt_flows, bit_or(cast(coalesce(tcp_flags, 0) as integer)) tcp_flags,
        cast(sum(case when fwd then coalesce(in_packets, 0) else 0 end) as bigint) ip, cast(sum(case when fwd then 0 else coalesce(in_packets, 0) end) as bigint) op,
        cast(sum(case when fwd then coalesce(in_bytes, 0) else 0 end) as bigint) ib, cast(sum(case when fwd then 0 else coalesce(in_bytes, 0) end) as bigint) ob from y group by k, proto)
select l.src4, l.dst4, l.src6, l.dst6, l.src_port, l.dst_port, l.proto, f.first_ms, f.last_ms, case when way then ip else op end in_packets, case when way then op else ip end out_packets,
  case when way then ib else ob end in_bytes, case when way then ob else ib end out_bytes, f.cnt_flows, f.tcp_flags from f join flows l on l.rec_no = f.r
"""


@query(_BIDIR)
def agg_bidirectional(spark: SparkSession, d: str) -> DataFrame:
    return agg.bidirectional(flows(spark, d))


_SWAP = "proto in (6, 17) and ((src_port < 1024 and dst_port >= 1024) or (src_port < 32768 and dst_port >= 32768) or (src_port < 49152 and dst_port >= 49152))"


@query(
    f"with g as (select src_port, dst_port, proto, {TOT} from flows group by 1, 2, 3), h as (select *, coalesce({_SWAP}, false) s from g) select case when s then dst_port else src_port end src_port, case when s then src_port else dst_port end dst_port, proto, first_ms, last_ms, "
    "case when s then 0 else in_packets end in_packets, case when s then 0 else in_bytes end in_bytes, case when s then in_packets else 0 end out_packets, case when s then in_bytes else 0 end out_bytes, cnt_flows, tcp_flags from h"
)
def agg_guess_direction(spark: SparkSession, d: str) -> DataFrame:
    return agg.guess_direction(agg.aggregate(flows(spark, d), "srcport,dstport,proto"))


@query(f"select src4, src6, {TOT} from flows group by 1, 2 having sum(in_bytes) > 100000000")
def agg_post_filter(spark: SparkSession, d: str) -> DataFrame:
    return apply_filter(agg.aggregate(flows(spark, d), "srcip"), "bytes > 100m")


@query(f"select * from (select src4, src6, {TOT} from flows group by 1, 2 order by 6 desc, src4 nulls first, src6 nulls first limit 50) where in_packets > 100000")
def top_then_post_filter(spark: SparkSession, d: str) -> DataFrame:
    """A post filter sees the first rows only."""
    return agg.top(agg.aggregate(flows(spark, d), "srcip"), "bytes", 50, ["src4", "src6"], "packets > 100k")


_DUR = "(last_ms - first_ms)"
_RATE = "case when coalesce({1}, 0) = 0 then 0 else trunc({0} / {1}) end"
_ORDER_SQL = {"flows": "cnt_flows", "packets": "in_packets + out_packets", "opackets": "out_packets", "ibytes": "in_bytes", "bytes": "in_bytes + out_bytes", "duration": _DUR, "tend": "-last_ms", "tstart": "-first_ms"}
_ORDER_SQL |= {"pps": _RATE.format("(in_packets + out_packets) * 1000", _DUR), "obps": _RATE.format("out_bytes * 8000", _DUR), "ibpp": _RATE.format("in_bytes", "in_packets")}


@query(WIDE + f", g as (select src4, {TOTW} from w group by 1) " + " union all ".join(f"select * from (select '{o}' as ord, src4, in_bytes, out_bytes, cnt_flows from g order by {e} desc, src4 limit 10)" for o, e in _ORDER_SQL.items()))
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    g = agg.aggregate(wide(spark, d), "srcip4")
    return agg.tops(g, list(_ORDER_SQL), 10, ["src4"]).select("ord", "src4", "in_bytes", "out_bytes", "cnt_flows")


@query("select rec_no, first_ms, in_bytes from flows where first_ms is not null order by first_ms, rec_no")
def sort_records(spark: SparkSession, d: str) -> DataFrame:
    x = flows(spark, d).where("first_ms is not null")
    return agg.top(x, "tstart", 0, ["rec_no"]).select("rec_no", "first_ms", "in_bytes")


# --- statistics


_SHOWN = f"case when regexp_full_match(key, '[0-9A-F]{{32}}') then {text6_sql('key')} else key end key"


def _stat_sql(name: str, sources: list[str], order: str, n: int, table_: str = "flows", out: bool = False, split: bool = False) -> str:
    """Top n of one element; sources are texts (hex for IPv6 addresses until they are shown), NULL where a record has none."""
    key = _SHOWN if any("hex(" in x for x in sources) and "ip" in name else "key"
    op, ob = ("coalesce(out_packets, 0)", "coalesce(out_bytes, 0)") if out else ("0", "0")
    cols = f"first_ms, last_ms, {_W} f, coalesce(in_packets, 0) + {op} p, coalesce(in_bytes, 0) + {ob} b"
    proto = "cast(proto as integer)" if split else "cast(null as integer)"
    src = " union all ".join(f"select {proto} proto, {s} as key, {cols} from {table_}" for s in sources)
    measure = {"flows": "flows", "bytes": "bytes", "packets": "packets", "pps": _RATE.format("packets * 1000", _DUR), "bps": _RATE.format("bytes * 8000", _DUR), "bpp": _RATE.format("bytes", "packets")}[order]
    return f"""(with x as ({src}), t as (select sum({_W}) f, sum(coalesce(in_packets, 0) + {op}) p, sum(coalesce(in_bytes, 0) + {ob}) b from {table_}),
        g as (select proto, key, min(first_ms) first_ms, max(last_ms) last_ms, cast(sum(f) as bigint) flows, cast(sum(p) as bigint) packets, cast(sum(b) as bigint) bytes from x where key is not null group by 1, 2),
        r as (select *, cast(row_number() over (order by {measure} desc, proto nulls first, key) as integer) rank from g)
        select rank, '{name}' as stat, '{order}' as ord, proto, {key}, first_ms, last_ms, flows, packets, bytes, cast(flows * 10000 // t.f as bigint) flows_share, cast(packets * 10000 // t.p as bigint) packets_share,
          cast(bytes * 10000 // t.b as bigint) bytes_share, cast({_RATE.format('packets * 1000', _DUR)} as bigint) pps, cast({_RATE.format('bytes * 8000', _DUR)} as bigint) bps, cast({_RATE.format('bytes', 'packets')} as bigint) bpp
        from r, t where rank <= {n})"""


def _v6(c: str) -> str:
    return f"hex({c})"


_num = lambda c: f"cast(coalesce({c}, 0) as varchar)"
_ip = lambda c: f"case when {c} is not null then {N4.format(c)} end"


@query(_stat_sql("srcip", [_ip("src4"), _v6("src6")], "bytes", 10, "(select * from flows where proto = 6 and dst_port = 443)"))
def stat_srcip_https(spark: SparkSession, d: str) -> DataFrame:
    """The ten sources with most bytes over HTTPS, of both families."""
    return stat.top_n(apply_filter(flows(spark, d), "proto tcp and dst port 443"), ["srcip/bytes"], 10)


@query(_stat_sql("ip", [_ip("src4"), _ip("dst4"), _v6("src6"), _v6("dst6")], "flows", 20))
def stat_ip_flows(spark: SparkSession, d: str) -> DataFrame:
    return stat.top_n(flows(spark, d), ["ip/flows"], 20)


@query(_stat_sql("port:p", [_num("src_port"), _num("dst_port")], "packets", 25, split=True))
def stat_port_by_proto(spark: SparkSession, d: str) -> DataFrame:
    return stat.top_n(flows(spark, d), ["port:p/packets"], 25)


@query(_stat_sql("as", [_num("src_as"), _num("dst_as")], "bps", 15))
def stat_as_missing(spark: SparkSession, d: str) -> DataFrame:
    """AS numbers that are missing count under 0."""
    return stat.top_n(flows(spark, d), ["as/bps"], 15)


@query(" union all ".join([_stat_sql("srcport", [_num("src_port")], "flows", 10), _stat_sql("srcport", [_num("src_port")], "bytes", 10), _stat_sql("proto", [_num("proto")], "packets", 10), _stat_sql("if", [_num("input_if"), _num("output_if")], "pps", 10), _stat_sql("flags", [_num("tcp_flags")], "flows", 10), _stat_sql("srctos", [_num("src_tos")], "bpp", 10), _stat_sql("dstas", [_num("dst_as")], "flows", 10), _stat_sql("mask", [_num("src_mask"), _num("dst_mask")], "bytes", 10)]))
def stat_many(spark: SparkSession, d: str) -> DataFrame:
    """Several statistics in one pass."""
    return stat.top_n(flows(spark, d), ["srcport/flows/bytes", "proto/packets", "if/pps", "flags/flows", "srctos/bpp", "dstas/flows", "mask/bytes"], 10)


_mac = lambda c: f"case when {c} is not null then regexp_replace(lpad(lower(hex({c})), 12, '0'), '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6') end"


@query(
    WIDE
    + " union all ".join(
        [
            _stat_sql("vlan", [_num("src_vlan"), _num("dst_vlan")], "bytes", 10, "w", True), _stat_sql("mac", [_mac("in_src_mac"), _mac("out_dst_mac")], "flows", 10, "w", True), _stat_sql("mpls2", ["cast(mpls[2] // 16 as varchar)"], "packets", 10, "w", True),
            _stat_sql("natsrcip", [_ip("x_src4")], "bytes", 10, "w", True), _stat_sql("natport", [_num("x_src_port"), "'0'"], "flows", 10, "w", True), _stat_sql("event", [_num("fw_event")], "flows", 10, "w", True), _stat_sql("minttl", [_num("min_ttl")], "bpp", 10, "w", True), _stat_sql("cl", [_num("client_us")], "bps", 10, "w", True),
        ]
    )
)
def stat_wide(spark: SparkSession, d: str) -> DataFrame:
    return stat.top_n(wide(spark, d), ["vlan/bytes", "mac/flows", "mpls2/packets", "natsrcip/bytes", "natport/flows", "event/flows", "minttl/bpp", "cl/bps"], 10)


# --- totals


def _class_sql(p: str = "coalesce(in_packets, 0)", b: str = "coalesce(in_bytes, 0)", where: str = "true") -> str:
    tests = {"": "true", "_tcp": "proto = 6", "_udp": "proto = 17", "_icmp": "proto in (1, 58)", "_other": "coalesce(proto not in (6, 17, 1, 58), true)"}
    return ", ".join(f"cast(coalesce(sum(case when ({t}) and ({where}) then {v} else 0 end), 0) as bigint) {m}{k}" for m, v in (("flows", _W), ("packets", p), ("bytes", b)) for k, t in tests.items())


@query(f"select {_class_sql()}, min(nullif(first_ms, 0)) first_ms, max(nullif(last_ms, 0)) last_ms from flows")
def summary_totals(spark: SparkSession, d: str) -> DataFrame:
    return summary.summary(flows(spark, d))


@query(f"select received_ms // 300000 * 300000 slot_ms, {_class_sql()} from flows where received_ms is not null group by 1")
def summary_per_slot(spark: SparkSession, d: str) -> DataFrame:
    return summary.per_slot(flows(spark, d))


_PORTS = f"with s as (select received_ms // 300000 * 300000 slot_ms, proto, dst_port, cast(sum({_W}) as bigint) flows, cast(sum(coalesce(in_packets, 0)) as bigint) packets, cast(sum(coalesce(in_bytes, 0)) as bigint) bytes from flows where received_ms is not null and proto in (6, 17) and dst_port is not null group by 1, 2, 3) "


@query(_PORTS + "select * from s")
def ports_per_slot(spark: SparkSession, d: str) -> DataFrame:
    return summary.ports(flows(spark, d))


@query(_PORTS + "select *, " + ", ".join(f"cast(sum({n}) over (partition by proto, dst_port order by slot_ms range between 86100000 preceding and current row) as bigint) {n}_day" for n in ("flows", "packets", "bytes")) + " from s")
def ports_rolling_day(spark: SparkSession, d: str) -> DataFrame:
    return summary.rolling_ports(summary.ports(flows(spark, d)))


@query(_PORTS + ", g as (select proto, dst_port, sum(flows) flows, sum(packets) packets, sum(bytes) bytes from s group by 1, 2), u as (" + " union all ".join(f"select '{n}' as type, proto, dst_port, cast({n} as bigint) as value from g" for n in ("flows", "packets", "bytes")) + ") select * from (select *, cast(row_number() over (partition by type, proto order by value desc, dst_port) as integer) rank from u) where rank <= 10")
def ports_top(spark: SparkSession, d: str) -> DataFrame:
    return summary.top_ports(summary.ports(flows(spark, d)))


CHANNELS = {"web": ("proto tcp and port in [80 443]", "proto = 6 and (src_port in (80, 443) or dst_port in (80, 443))"), "dns": ("port 53", "src_port = 53 or dst_port = 53"), "large": ("bytes > 1m", "in_bytes > 1000000"), "all": ("any", "true")}


@query(" union all ".join(f"select '{n}' as channel, received_ms // 300000 * 300000 slot_ms, {_class_sql()} from flows where received_ms is not null and ({c}) group by 2" for n, (_, c) in CHANNELS.items()))
def profile_channels(spark: SparkSession, d: str) -> DataFrame:
    return summary.profile(flows(spark, d), {n: f for n, (f, _) in CHANNELS.items()})


# --- lookups

_BLOCKS = "select octet * 16777216 net_start, octet * 16777216 + 16777215 net_end, octet % 25 location_id from {seq} union all select octet * 16777216 + (octet * 7 % 256) * 65536, octet * 16777216 + (octet * 7 % 256) * 65536 + 65535, (octet + 3) % 25 from {seq}"
# prefixes of IPv6 as beginnings of the hex text
_BLOCKS6 = "select '20010DB80000' || {hex} net, 56 prefix_len, octet % 25 location_id from {seq} union all select '20010DB80000' || {hex} || {hex7}, 64, (octet + 3) % 25 from {seq} union all select 'FD', 8, 7"
_SPARK6 = _BLOCKS6.format(seq="(select id as octet from range(1, 255))", hex="lpad(hex(octet), 2, '0')", hex7="lpad(hex(octet * 7 % 256), 2, '0')")
_DUCK6 = _BLOCKS6.format(seq="(select range octet from range(1, 255))", hex="lpad(to_base(octet, 16), 2, '0')", hex7="lpad(to_base(octet * 7 % 256, 16), 2, '0')")


def lookups(spark: SparkSession, d: str) -> enrich.Lookups:
    """Prefixes of several lengths over both families, with a country of two letters for each of 25 locations, and exit nodes seen at the times of the flows."""
    blocks4 = enrich.with_prefixes4(spark.sql(_BLOCKS.format(seq="(select id as octet from range(1, 255))")))
    blocks6 = spark.sql(_SPARK6).select(F.unhex(F.rpad("net", 32, "0")).alias("net_start"), "prefix_len", "location_id")
    places = spark.sql("select id location_id, concat(chr(65 + id), 'X') country from range(25)")
    numbers = [b.select("net_start", "prefix_len", (F.col("location_id") + 65000).alias("asn")) for b in (blocks4, blocks6)]
    seen = flows(spark, d).where("src4 is not null and first_ms > 0 and last_ms > 0 and proto = 17").select(F.col("src4").alias("ip"), F.floor(F.col("first_ms") / 1000).alias("seen"))
    return enrich.Lookups(places, blocks4, blocks6, *numbers, enrich.tor_intervals(seen))


# the place and number of each address that occurs, by its longest prefix
_PLACES = f"""
b4 as ({_BLOCKS.format(seq='(select range octet from range(1, 255))')}), b6 as ({_DUCK6}),
a4 as (select distinct a from (select src4 a from flows union select dst4 from flows)), a6 as (select distinct a from (select hex(src6) a from flows union select hex(dst6) from flows)),
m4 as (select a, arg_max(location_id, net_start - net_end) loc from a4 join b4 on a between net_start and net_end group by 1),
m6 as (select a, arg_max(location_id, prefix_len) loc from a6 join b6 on starts_with(a, net) group by 1),
loc as (select f.*, coalesce(s4.loc, s6.loc) s_loc, coalesce(d4.loc, d6.loc) d_loc, coalesce(chr(65 + coalesce(s4.loc, s6.loc)::int) || 'X', case when src4 is not null or src6 is not null then '..' end) src_geo, coalesce(chr(65 + coalesce(d4.loc, d6.loc)::int) || 'X', case when dst4 is not null or dst6 is not null then '..' end) dst_geo
  from flows f left join m4 s4 on s4.a = src4 left join m6 s6 on s6.a = hex(src6) left join m4 d4 on d4.a = dst4 left join m6 d6 on d6.a = hex(dst6)),
w as (select * replace (coalesce(nullif(src_as, 0), s_loc + 65000, 0) as src_as, coalesce(nullif(dst_as, 0), d_loc + 65000, 0) as dst_as) from loc)
"""


@query(f"with {_PLACES} select src_geo, count(*) n, cast(sum(in_bytes) as bigint) in_bytes from w group by 1")
def geo_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    x = lookups(spark, d).fill(flows(spark, d).select("src4", "src6", "in_bytes"), "src_geo")
    return x.groupBy("src_geo").agg(F.count(F.lit(1)).alias("n"), F.sum("in_bytes").alias("in_bytes"))


@query(f"with {_PLACES} select src_as, count(*) n from w group by 1")
def as_lookup(spark: SparkSession, d: str) -> DataFrame:
    x = lookups(spark, d).fill(flows(spark, d).select("src4", "src6", "src_as"), "src_as")
    return x.groupBy("src_as").agg(F.count(F.lit(1)).alias("n"))


# how often exit nodes were seen: intervals of sightings at most a day apart
_EXITS = """
s as (select src4 ip, first_ms // 1000 seen from flows where src4 is not null and first_ms > 0 and last_ms > 0 and proto = 17),
m as (select *, lag(seen) over (partition by ip order by seen) p from s), n as (select *, sum(case when p is null or seen - p > 86400 then 1 else 0 end) over (partition by ip order by seen rows unbounded preceding) i from m),
v as (select ip, i, min(seen) a, max(seen) z from n group by 1, 2),
"""
_TOR_HIT = "exists (from v where v.ip = {side}4 and (first_ms // 1000 between a and z + 86400 or last_ms // 1000 between a and z + 86400))"
_TOR_KNOWN = "{side}4 in (select ip from v)"
LOOKUP_FILTERS = {
    "src geo FX": "src_geo = 'FX'", "geo KX": "src_geo = 'KX' or dst_geo = 'KX'", "not geo FX and proto tcp": "not coalesce(src_geo = 'FX' or dst_geo = 'FX', false) and proto = 6",
    "as 65003": "src_as = 65003 or dst_as = 65003", "src as in [65007 65010] and ipv6": "src_as in (65007, 65010) and src6 is not null", "src as 0": "src_as = 0",
    "src ip tor": _TOR_KNOWN.format(side="src"), "ip tor and not geo JX": f"({_TOR_KNOWN.format(side='src')} or {_TOR_KNOWN.format(side='dst')}) and not coalesce(src_geo = 'JX' or dst_geo = 'JX', false)",
}


@query(f"with {_EXITS} {_PLACES} " + " union all ".join("select '{}' as filter, count(*) n, cast(coalesce(sum(in_bytes), 0) as bigint) in_bytes from w where {}".format(f, c) for f, c in LOOKUP_FILTERS.items()))
def filter_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Filters that ask for countries, exit nodes and AS numbers, each filling what it needs; all in one scan."""
    from freshet.api import Flows
    from freshet.filterlang.compiler import derived
    from freshet.filterlang.parser import parse

    cols = ["src4", "src6", "dst4", "dst6", "src_as", "dst_as", "proto", "first_ms", "last_ms", "in_bytes"]
    f = Flows(flows(spark, d).select(*cols), lookups=lookups(spark, d))
    f = f.filled(set().union(*[derived(parse(x)) for x in LOOKUP_FILTERS]))
    hits = [compile_filter(x, f.df) for x in LOOKUP_FILTERS]
    one = f.df.agg(*[F.struct(F.lit(x).alias("filter"), F.count_if(h).alias("n"), F.coalesce(F.sum(F.when(h, F.col("in_bytes"))), F.lit(0).cast("long")).alias("in_bytes")).alias(str(i)) for i, (x, h) in enumerate(zip(LOOKUP_FILTERS, hits))])
    return one.select(F.explode(F.array(*[F.col(str(i)) for i in range(len(hits))])).alias("x")).select("x.*")


@query(f"with {_PLACES} " + " union all ".join(f"select * from {x}" for x in (_stat_sql("srcgeo", ["src_geo"], "bytes", 10, "w"), _stat_sql("geo", ["src_geo", "dst_geo"], "flows", 10, "w"), _stat_sql("as", [_num("src_as"), _num("dst_as")], "packets", 10, "w"))))
def stat_lookups(spark: SparkSession, d: str) -> DataFrame:
    from freshet.api import Flows

    cols = ["src4", "src6", "dst4", "dst6", "src_as", "dst_as", "first_ms", "last_ms", "in_packets", "in_bytes", "cnt_flows"]
    return Flows(flows(spark, d).select(*cols), lookups=lookups(spark, d)).stat("srcgeo/bytes", "geo/flows", "as/packets", n=10)


# how flows stand to the intervals of the sightings
_TOR = (
    "with s as ({seen}), m as (select *, lag(seen) over (partition by ip order by seen) p from s), n as (select *, sum(case when p is null or seen - p > 86400 then 1 else 0 end) over (partition by ip order by seen rows unbounded preceding) i from m), v as (select ip, i, min(seen) a, max(seen) z from n group by 1, 2), "
    "x as (select rec_no, src4, bool_or(first_ms // 1000 between a and z + 86400 or last_ms // 1000 between a and z + 86400) hit, count(v.ip) k from flows left join v on v.ip = src4 group by 1, 2) "
    "select case when src4 is null then null when k = 0 then '..' when hit then 'EX' else 'ex' end src_tor, count(*) n from x group by 1"
)


@query(_TOR.format(seen="select src4 ip, first_ms // 1000 seen from flows where src4 is not null and first_ms > 0 and last_ms > 0"))
def tor_exits(spark: SparkSession, d: str) -> DataFrame:
    """Every source counts as an exit from its first sighting on."""
    f = flows(spark, d)
    seen = f.where("src4 is not null and first_ms > 0 and last_ms > 0").select(F.col("src4").alias("ip"), F.floor(F.col("first_ms") / 1000).alias("seen"))
    x = enrich.tor(f.select("src4", "first_ms", "last_ms"), "src4", enrich.tor_intervals(seen), "src_tor")
    return x.groupBy("src_tor").agg(F.count(F.lit(1)).alias("n"))


@query("select e.ip exporter_ip, e.version, count(*) n, cast(sum(in_bytes) as bigint) in_bytes from flows f left join exporters e on e.sysid = f.exporter_id group by 1, 2")
def exporter_names(spark: SparkSession, d: str) -> DataFrame:
    f, e = flows(spark, d), table(spark, d, "exporters")
    x = enrich.named(enrich.named(f.select("exporter_id", "in_bytes"), "exporter_id", e, "sysid", "ip", "exporter_ip"), "exporter_id", e, "sysid", "version", "version")
    return x.groupBy("exporter_ip", "version").agg(F.count(F.lit(1)).alias("n"), F.sum("in_bytes").alias("in_bytes"))


@query(
    "with s as (select sysid, id, max(struct_pack(p := packet_interval, s := space_interval)) r from samplers where packet_interval > 0 group by 1, 2), b as (select sysid, arg_min(r, case id when -3 then 0 when -1 then 1 when -2 then 2 end) r from s where id in (-3, -2, -1) group by 1) "
    "select exporter_id, cast(sum(case when r.s > 0 then in_packets * (r.p + r.s) // r.p else in_packets end) as bigint) in_packets, cast(sum(case when r.s > 0 then in_bytes * (r.p + r.s) // r.p else in_bytes end) as bigint) in_bytes from flows left join b on sysid = exporter_id group by 1"
)
def sampling_corrected(spark: SparkSession, d: str) -> DataFrame:
    x = enrich.sampling(flows(spark, d).select("exporter_id", "in_packets", "in_bytes"), table(spark, d, "samplers"))
    return x.groupBy("exporter_id").agg(F.sum("in_packets").alias("in_packets"), F.sum("in_bytes").alias("in_bytes"))


# --- decoded version 1 records, and sequences

_BACK = "(sys_uptime - {0} + 4294967296 * 2) % 4294967296"
_ABS = "unix_secs * 1000 + unix_nsecs // 1000000 - case when {b} >= 2147483648 then {b} - 4294967296 else {b} end"


@query(
    f"with p as (select packet_id, max(sys_uptime) sys_uptime, max(unix_secs) unix_secs, max(unix_nsecs) unix_nsecs from v1_packets group by 1) select r.exporter_id, count(*) n, cast(sum(first_ms) as hugeint)::varchar sum_first, cast(sum(last_ms) as hugeint)::varchar sum_last, cast(sum(in_bytes) as bigint) in_bytes from (select v.exporter_id, doctets in_bytes, {_ABS.format(b=_BACK.format('first_uptime'))} first_ms, {_ABS.format(b=_BACK.format('last_uptime'))} last_ms from v1_records v join p on p.packet_id = v.packet_id) r group by 1"
)
def v1_to_flows(spark: SparkSession, d: str) -> DataFrame:
    """Version 1 records with their packet headers become flow records with absolute times."""
    from freshet.sources.netflow import v1_flows

    x = v1_flows(table(spark, d, "v1_packets"), table(spark, d, "v1_records"))
    s = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("string")
    return x.groupBy("exporter_id").agg(F.count(F.lit(1)).alias("n"), s("first_ms").alias("sum_first"), s("last_ms").alias("sum_last"), F.sum("in_bytes").alias("in_bytes"))


# --- output


_addr = lambda side: f"coalesce({_ip(side + '4')}, {text6_sql(f'hex({side}6)')}, '0.0.0.0')"
_FLAGS = "(" + " || ".join(f"case when proto = 6 and tcp_flags & {1 << i} <> 0 then '{'FSRPAUEC'[i]}' else '.' end" for i in range(7, -1, -1)) + ")"
_PROTO = "case coalesce(proto, 0) " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(enums.PROTOCOLS)) + " else cast(proto as varchar) end"
_SEENS = lambda c: f"case when coalesce({c}, 0) = 0 then '0000-00-00 00:00:00.000' else strftime(make_timestamp({c} * 1000), '%Y-%m-%d %H:%M:%S.%g') end"
_SPAN = "coalesce(last_ms - first_ms, 0)"
_DAYS = f"cast(floor({_SPAN} / 86400000.0) as bigint)"
_LEFT = f"({_SPAN} - {_DAYS} * 86400000)"
_CLOCK = f"printf('%02d:%02d:%02d.%03d', {_LEFT} // 3600000, {_LEFT} // 60000 % 60, {_LEFT} // 1000 % 60, {_LEFT} % 1000)"
_DURATION = f"case when {_DAYS} = 0 then '    ' || {_CLOCK} else printf('%2dd ', {_DAYS}) || {_CLOCK} end"
_str = lambda c: f"cast(coalesce({c}, 0) as varchar)"
_WGT = "cast(case when coalesce(cnt_flows, 0) = 0 then 1 else cnt_flows end as varchar)"
_rate = lambda a, b: f"cast(cast(coalesce({_RATE.format(a, b)}, 0) as bigint) as varchar)"
_DPORT = f"case when proto in (1, 58) then (coalesce(dst_port, 0) // 256) || '.' || (coalesce(dst_port, 0) % 256) else {_str('dst_port')} end"
_end = lambda side, port: f"{_addr(side)} || case when {side}4 is null and {side}6 is not null then '.' else ':' end || {port}"
_pad = lambda x, n, left=False: f"{'rpad' if left else 'lpad'}({x}, cast(greatest(length({x}), {n}) as integer), ' ')"


@query(
    f"select coalesce(rec_no, 0) cnt, case when src4 is not null then 4 when src6 is not null then 6 else 0 end af, coalesce(first_ms, 0) \"firstSeen\", coalesce(last_ms, 0) \"lastSeen\", cast(coalesce(proto, 0) as bigint) proto, {_addr('src')} \"srcAddr\", cast(coalesce(src_port, 0) as bigint) \"srcPort\", "
    f"{_addr('dst')} \"dstAddr\", cast(coalesce(dst_port, 0) as bigint) \"dstPort\", coalesce(src_as, 0) \"srcAS\", coalesce(dst_as, 0) \"dstAS\", coalesce(input_if, 0) \"input\", coalesce(output_if, 0) \"output\", "
    f"{_FLAGS} flags, cast(coalesce(src_tos, 0) as bigint) \"srcTos\", coalesce(in_packets, 0) packets, coalesce(in_bytes, 0) bytes from flows"
)
def out_csv_fast(spark: SparkSession, d: str) -> DataFrame:
    return tokens.csv_fast(flows(spark, d))


# the widths of the columns, in order
_EXTENDED = {
    _SEENS("first_ms"): (23, True), _DURATION: (16, True), _PROTO: (5, True), _end("src", _str("src_port")): (22, False), _end("dst", _DPORT): (22, False), _FLAGS: (8, False), _str("src_tos"): (4, False), _str("in_packets"): (8, False),
    _str("in_bytes"): (8, False), _rate("in_packets * 1000", _DUR): (8, False), _rate("in_bytes * 8000", _DUR): (8, False), _rate("in_bytes", "in_packets"): (6, False), _WGT: (5, False),
}


@query("select " + " || ".join((" '-> ' || " if i == 4 else "") + f"{_pad(x, n, left)}" + (" || ' '" if i < len(_EXTENDED) - 1 else "") for i, (x, (n, left)) in enumerate(_EXTENDED.items())) + " as line from flows")
def out_line(spark: SparkSession, d: str) -> DataFrame:
    return tokens.fmt(flows(spark, d), "extended")


@query(
    f"select {_SEENS('first_ms')} \"firstSeen\", trim({_DURATION}) duration, {_PROTO} proto, {_addr('src')} \"srcAddr\", {_str('src_port')} \"srcPort\", {_addr('dst')} \"dstAddr\", {_str('dst_port')} \"dstPort\", {_str('in_packets')} packets, {_str('in_bytes')} bytes, {_WGT} flows from flows"
)
def out_csv(spark: SparkSession, d: str) -> DataFrame:
    return tokens.csv(flows(spark, d), "csv")


_quoted = lambda x: f"'\"' || {x} || '\"'"
_ICMP = "coalesce(proto in (1, 58), false)"
_ISO = lambda c: _quoted(f"strftime(make_timestamp({c} * 1000), '%Y-%m-%dT%H:%M:%S.%g')")
_NET4T = f"case when src_mask is not null then {N4.format(_NET4)} || '/' || src_mask end"
_JSON = {
    "type": "'\"FLOW\"'", "first": _ISO("first_ms"), "last": _ISO("last_ms"), "received": _ISO("received_ms"), "in_packets": "in_packets", "in_bytes": "in_bytes", "proto": "proto", "src_tos": "src_tos", "fwd_status": "fwd_status",
    "input_snmp": "input_if", "output_snmp": "output_if", "src_mask": "src_mask", "dst_mask": "dst_mask", "aggr_flows": "cnt_flows", "src_as": "src_as", "dst_as": "dst_as", "cnt": "rec_no", "ident": _quoted("ident"), "export_sysid": "exporter_id",
    "src4_addr": _quoted(_ip("src4")), "dst4_addr": _quoted(_ip("dst4")), "src6_addr": _quoted(f"case when src6 is not null then {text6_sql('hex(src6)')} end"), "dst6_addr": _quoted(f"case when dst6 is not null then {text6_sql('hex(dst6)')} end"),
    "icmp_type": f"case when {_ICMP} then dst_port // 256 end", "icmp_code": f"case when {_ICMP} then dst_port % 256 end", "src_port": f"case when not {_ICMP} then src_port end", "dst_port": f"case when not {_ICMP} then dst_port end",
    "tcp_flags": _quoted(f"case when not {_ICMP} and tcp_flags is not null then " + _FLAGS.replace("proto = 6 and ", "") + " end"),
    "src_net": _quoted(f"case when src4 is not null then {_NET4T} end"), "dst_net": _quoted(f"case when dst4 is not null then {_NET4T.replace('src', 'dst')} end"), "sampled": "case when flags is not null and flags & 2 <> 0 then 1 else 0 end",
}


@query("select '{' || concat_ws(',', " + ", ".join(f"'\"{k}\":' || ({v})" for k, v in _JSON.items()) + ") || '}' as value from flows")
def out_ndjson(spark: SparkSession, d: str) -> DataFrame:
    return json_out.ndjson(flows(spark, d))


@query(" union all ".join(f"select {n} as bits, count(*) n, cast(sum(in_bytes) as bigint) in_bytes from flows where src4 is not null group by src4 >> {32 - n}" for n in (8, 16, 24, 32)))
def anonymised(spark: SparkSession, d: str) -> DataFrame:
    """Flows by networks of anonymised sources. Anonymising keeps prefixes: networks of any length hold the same flows as before."""
    from freshet.functions.cryptopan import anonymize

    a = anonymize(flows(spark, d).select("src4", "dst4", "src6", "dst6", "src_as", "dst_as", "in_bytes"), "abcdefghijklmnopqrstuvwxyz012345")
    nets = F.array(*[F.struct(F.lit(n).alias("bits"), F.shiftright("src4", 32 - n).alias("net")) for n in (8, 16, 24, 32)])
    x = a.where("src4 is not null").select("in_bytes", F.explode(nets).alias("x")).select("x.*", "in_bytes")
    return x.groupBy("bits", "net").agg(F.count(F.lit(1)).alias("n"), F.sum("in_bytes").alias("in_bytes")).drop("net")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

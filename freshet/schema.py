"""The wide flow schema: one row per flow record, all columns nullable, the columns of one extension NULL together when it is absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# extension: column type ... (types: s short, i int, l long, b binary, t string, d decimal(20,0), a array of long)
EXTENSIONS = """
header: rec_no l, ident t, exporter_id i, engine_type s, engine_id s, nf_version s, flags s
generic: first_ms l, last_ms l, received_ms l, in_packets l, in_bytes l, src_port i, dst_port i, proto s, tcp_flags s, fwd_status s, src_tos s
ipv4: src4 l, dst4 l
ipv6: src6 b, dst6 b
misc: input_if l, output_if l, src_mask s, dst_mask s, dir s, dst_tos s, biflow_dir s, end_reason s
counters: cnt_flows l, out_packets l, out_bytes l
vlan: src_vlan l, dst_vlan l
as: src_as l, dst_as l
bgp_next4: bgp_next4 l
bgp_next6: bgp_next6 b
next4: next4 l
next6: next6 b
router4: router4 l
router6: router6 b
mpls: mpls a
mac: in_src_mac l, out_dst_mac l, in_dst_mac l, out_src_mac l
as_adjacent: next_as l, prev_as l
latency: client_us l, server_us l, app_us l
sampler: selector_id d, sampler_sysid i
nsel: nsel_event_ms l, conn_id l, fw_xevent i, fw_event s
xlate4: x_src4 l, x_dst4 l
xlate6: x_src6 b, x_dst6 b
xlate_port: x_src_port i, x_dst_port i
acl: ingress_acl a, egress_acl a
user: username t
nat: nat_event_ms l, nat_pool l, nat_event s
port_block: pb_start i, pb_end i, pb_step i, pb_size i
nbar: nbar_id b
label: label t
payload: in_payload b, out_payload b
tunnel4: tun_src4 l, tun_dst4 l
tunnel6: tun_src6 b, tun_dst6 b
tunnel: tun_proto l
observation: obs_point_id d, obs_domain_id l
inmon: frame_size i, link_type i, inmon_frame b
vrf: ingress_vrf l, egress_vrf l
pf: pf_action s, pf_reason s, pf_dir s, pf_rewritten s, pf_rule l, pf_subrule l, pf_uid l, pf_pid l, pf_ifname t
layer2: vlan_id i, customer_vlan i, post_vlan i, post_customer_vlan i, l2_ingress l, l2_egress l, vxlan d, ether_type i, ip_version s
flow_id: flow_id d
nokia: in_service_id i, out_service_id i
nokia_string: nat_string t
ip_info: frag_flags s, min_ttl s, max_ttl s
"""
_TYPES = {"s": T.ShortType(), "i": T.IntegerType(), "l": T.LongType(), "b": T.BinaryType(), "t": T.StringType(), "d": T.DecimalType(20, 0), "a": T.ArrayType(T.LongType())}

COLUMNS: dict[str, T.DataType] = {}
EXTENSION_OF: dict[str, str] = {}
for _line in EXTENSIONS.strip().splitlines():
    _ext, _, _cols = _line.partition(":")
    for _c in _cols.split(","):
        _name, _t = _c.split()
        COLUMNS[_name], EXTENSION_OF[_name] = _TYPES[_t], _ext

SCHEMA = T.StructType([T.StructField(n, t) for n, t in COLUMNS.items()])

# Columns that enrichment and payload decoding add on demand.
DERIVED = {
    "src_geo": T.StringType(), "dst_geo": T.StringType(), "x_src_geo": T.StringType(), "x_dst_geo": T.StringType(), "tun_src_geo": T.StringType(), "tun_dst_geo": T.StringType(),
    "src_tor": T.StringType(), "dst_tor": T.StringType(), "ja3": T.StringType(), "ja4": T.StringType(), "ja4s": T.StringType(), "sni": T.StringType(), "tls_version": T.StringType(),
}


def field(df: DataFrame, name: str) -> Column:
    """The column, or a typed NULL where the table lacks it."""
    if name in df.columns:
        return F.col(name)
    kind = COLUMNS.get(name) or DERIVED.get(name)
    if kind is None:
        raise KeyError(name)
    return F.lit(None).cast(kind)


def conform(df: DataFrame) -> DataFrame:
    """All columns of the schema in order: those that the table lacks are NULL, others are dropped."""
    return df.select(*[field(df, n).cast(t).alias(n) for n, t in COLUMNS.items()])


def normalise(df: DataFrame) -> DataFrame:
    """Where a record has no first time, the firewall's or NAT's event time stands in for both; where it has both address families,
    the one that doesn't fit its IP version is dropped (without a version: IPv4 if that is all zero)."""
    first, last = field(df, "first_ms"), field(df, "last_ms")
    event = F.coalesce(F.nullif(field(df, "nsel_event_ms"), F.lit(0)), F.nullif(field(df, "nat_event_ms"), F.lit(0)))
    unset = F.coalesce(first, F.lit(0)) == 0
    both = field(df, "src4").isNotNull() & field(df, "src6").isNotNull()
    version = F.coalesce(field(df, "ip_version"), F.lit(0))
    no4 = both & ((version == 6) | ((version != 4) & (field(df, "src4") + field(df, "dst4") == 0)))
    no6 = both & ~no4
    out = {"first_ms": F.when(unset & event.isNotNull(), event).otherwise(first), "last_ms": F.when(unset & event.isNotNull(), event).otherwise(last)}
    for n, gone in (("src4", no4), ("dst4", no4), ("src6", no6), ("dst6", no6)):
        out[n] = F.when(~F.coalesce(gone, F.lit(False)), field(df, n))
    return df.withColumns(out)

"""Flows as JSON objects, one per row: only fields of extensions that a record has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions import enums, ip
from freshet.output.tokens import Projection

# Field name -> column, where the value goes out as it is.
PLAIN = {
    "in_packets": "in_packets", "in_bytes": "in_bytes", "proto": "proto", "src_tos": "src_tos", "fwd_status": "fwd_status", "src4_geo": "src_geo", "dst4_geo": "dst_geo", "input_snmp": "input_if", "output_snmp": "output_if",
    "src_mask": "src_mask", "dst_mask": "dst_mask", "direction": "dir", "dst_tos": "dst_tos", "ip_minttl": "min_ttl", "ip_maxttl": "max_ttl", "out_packets": "out_packets", "out_bytes": "out_bytes", "aggr_flows": "cnt_flows",
    "src_vlan": "src_vlan", "dst_vlan": "dst_vlan", "src_as": "src_as", "dst_as": "dst_as", "next_as": "next_as", "prev_as": "prev_as", "tun_proto": "tun_proto", "observationDomainID": "obs_domain_id", "observationPointID": "obs_point_id",
    "ingress_vrf": "ingress_vrf", "egress_vrf": "egress_vrf", "vlanID": "vlan_id", "post_vlanID": "post_vlan", "cust_vlanID": "customer_vlan", "post_cust_vlanID": "post_customer_vlan", "phys_ingress": "l2_ingress", "phys_egress": "l2_egress",
    "ip_version": "ip_version", "connect_id": "conn_id", "event_id": "fw_event", "xevent_id": "fw_xevent", "src_xlt_port": "x_src_port", "dst_xlt_port": "x_dst_port", "user_name": "username", "nat_event_id": "nat_event", "nat_pool_id": "nat_pool",
    "pblock_start": "pb_start", "pblock_end": "pb_end", "pblock_step": "pb_step", "pblock_size": "pb_size", "flowID": "flow_id", "inServiceID": "in_service_id", "outServiceID": "out_service_id", "natString": "nat_string",
    "cnt": "rec_no", "ident": "ident", "export_sysid": "exporter_id",
}
TIMES = {"first": "first_ms", "last": "last_ms", "received": "received_ms", "t_event": "nsel_event_ms"}
ADDRESSES = {
    "src4_addr": "src4", "dst4_addr": "dst4", "src6_addr": "src6", "dst6_addr": "dst6", "bgp4_next_hop": "bgp_next4", "bgp6_next_hop": "bgp_next6", "ip4_next_hop": "next4", "ip6_next_hop": "next6", "ip4_router": "router4", "ip6_router": "router6",
    "src4_tun_ip": "tun_src4", "dst4_tun_ip": "tun_dst4", "src6_tun_ip": "tun_src6", "dst6_tun_ip": "tun_dst6", "src4_xlt_ip": "x_src4", "dst4_xlt_ip": "x_dst4", "src6_xlt_ip": "x_src6", "dst6_xlt_ip": "x_dst6",
}
MACS = {"in_src_mac": "in_src_mac", "out_dst_mac": "out_dst_mac", "in_dst_mac": "in_dst_mac", "out_src_mac": "out_src_mac"}
LATENCIES = {"cli_latency": "client_us", "srv_latency": "server_us", "app_latency": "app_us"}


def fields(df: DataFrame) -> dict[str, Column]:
    """Field name -> value; fields whose columns the table lacks are left out."""
    p = Projection(df)
    have = set(df.columns)
    out = {"type": F.lit("FLOW")}
    out |= {k: F.date_format(F.timestamp_millis(p[c]), "yyyy-MM-dd'T'HH:mm:ss.SSS") for k, c in TIMES.items() if c in have}
    out |= {k: p[c] for k, c in PLAIN.items() if c in have}
    out |= {k: (ip.text4 if c.endswith("4") else ip.text6)(p[c]) for k, c in ADDRESSES.items() if c in have}
    out |= {k: ip.mac_text(p[c]) for k, c in MACS.items() if c in have}
    out |= {k: F.format_string("%.3f", p[c] / 1000.0) for k, c in LATENCIES.items() if c in have}
    if {"proto", "dst_port", "src_port"} <= have:
        icmp = F.coalesce(p["proto"].isin(1, 58), F.lit(False))
        out |= {
            "icmp_type": F.when(icmp, F.shiftright(p["dst_port"], 8)), "icmp_code": F.when(icmp, p["dst_port"].bitwiseAND(255)),
            "src_port": F.when(~icmp, p["src_port"]), "dst_port": F.when(~icmp, p["dst_port"]), "tcp_flags": F.when(~icmp, enums.flags_text(p["tcp_flags"].cast("int"))),
        }
    if "ether_type" in have:
        out["ethertype"] = F.format_string("0x%04x", p["ether_type"])
    for side in ("src", "dst"):
        if {side + "_mask", side + "4"} <= have:
            out[f"{side}_net"] = F.when(p[side + "_mask"].isNotNull() & p[side + "4"].isNotNull(), p.network(side))
    if "fw_event" in have:
        out["event"] = enums.name_of(p["fw_event"], enums.FW_EVENTS)
    if "mpls" in have:
        out |= {f"mpls_{i}": F.when(F.get(p["mpls"], F.lit(i - 1)) != 0, F.format_string("%d-%d-%d", F.shiftright(F.get(p["mpls"], F.lit(i - 1)), 4), F.shiftright(F.get(p["mpls"], F.lit(i - 1)), 1).bitwiseAND(7), F.get(p["mpls"], F.lit(i - 1)).bitwiseAND(1))) for i in range(1, 11)}
    if "nat_event" in have:
        out["nat_event"] = enums.name_of(p["nat_event"], enums.NAT_EVENTS)
    for side in ("src", "dst"):  # an address of IPv6 has its country under its own name
        if side + "_geo" in have and side + "6" in have:
            out[f"{side}4_geo"], out[f"{side}6_geo"] = (F.when(p[f"{side}{n}"].isNotNull(), p[side + "_geo"]) for n in (4, 6))
    acl = lambda c: F.concat_ws("/", F.transform(c, lambda x: F.format_string("0x%x", x)))
    out |= {c: F.when(p[c].isNotNull(), acl(p[c])) for c in ("ingress_acl", "egress_acl") if c in have}
    if "frag_flags" in have:
        out["ip_fragment"] = F.when(p["frag_flags"].isNotNull(), F.concat(F.when(p["frag_flags"].bitwiseAND(64) != 0, "DF").otherwise("  "), F.when(p["frag_flags"].bitwiseAND(32) != 0, "MF").otherwise("  ")))
    for side in ("in", "out"):
        if side + "_payload" in have:
            from freshet.functions import payload

            tls = payload.tls(p[side + "_payload"])
            out[f"{side}_tls"] = tls["version"].cast("string")
    prints = {"sni": "sni", "ja3 hash": "ja3", "ja4 hash": "ja4", "ja4s hash": "ja4s"}
    if have & {"in_payload", "out_payload"} or have & set(prints.values()):
        from freshet.functions import payload

        of = lambda part: F.coalesce(*[payload.tls(p[c])[part] for c in ("in_payload", "out_payload") if c in have])
        out |= {k: p[c] if c in have else of(c) for k, c in prints.items() if c in have or have & {"in_payload", "out_payload"}}
    if "flags" in have:
        out["sampled"] = F.when(p["flags"].bitwiseAND(2) != 0, 1).otherwise(0)
    return out


def objects(df: DataFrame) -> DataFrame:
    """The fields as columns: df.write.json makes one object per line of them."""
    return df.select(*[v.alias(k) for k, v in fields(df).items()])


def pretty(df: DataFrame) -> DataFrame:
    """One text column `value` with an object per row, its fields on lines of their own; commas between objects and the array's brackets are
    the printer's, for rows have no last one."""
    x = objects(df)
    return x.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in x.columns]), {"ignoreNullFields": "true", "pretty": "true"}).alias("value"))


def ndjson(df: DataFrame) -> DataFrame:
    """One text column `value` with an object per row; NULL fields are left out."""
    x = objects(df)
    return x.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in x.columns]), {"ignoreNullFields": "true"}).alias("value"))

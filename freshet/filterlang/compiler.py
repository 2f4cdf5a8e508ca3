"""Syntax tree to Spark Column.

Logic has two values: a leaf on a missing extension is false, and its negation true, so every leaf is coalesced before it is combined.
Prefixes become ranges, for which Parquet statistics can skip row groups. AS numbers that are missing count as 0. What needs the
payload decoded or a geo table is listed by needs(), so that a scan adds it only when it is asked for.
"""

from __future__ import annotations

import socket
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.filterlang.parser import And, FilterError, Not, Or, Term, parse, terms
from freshet.functions import enums, ip
from freshet.functions.rates import div
from freshet.functions.time import parse_ms
from freshet.schema import field

# direction -> column pairs (IPv4, IPv6)
IP_COLUMNS = {
    "src": [("src4", "src6")], "dst": [("dst4", "dst6")], "": [("src4", "src6"), ("dst4", "dst6")],
    "src nat": [("x_src4", "x_src6")], "dst nat": [("x_dst4", "x_dst6")], "nat": [("x_src4", "x_src6"), ("x_dst4", "x_dst6")],
    "src tun": [("tun_src4", "tun_src6")], "dst tun": [("tun_dst4", "tun_dst6")], "tun": [("tun_src4", "tun_src6"), ("tun_dst4", "tun_dst6")],
    "next": [("next4", "next6")], "bgp next": [("bgp_next4", "bgp_next6")], "router": [("router4", "router6")],
}
PORTS = {"src": ["src_port"], "dst": ["dst_port"], "": ["src_port", "dst_port"], "src nat": ["x_src_port"], "dst nat": ["x_dst_port"], "nat": ["x_src_port", "x_dst_port"]}
MACS = {
    "in src": ["in_src_mac"], "in dst": ["in_dst_mac"], "out src": ["out_src_mac"], "out dst": ["out_dst_mac"], "src": ["in_src_mac", "out_src_mac"], "dst": ["in_dst_mac", "out_dst_mac"],
    "in": ["in_src_mac", "in_dst_mac"], "out": ["out_src_mac", "out_dst_mac"], "": ["in_src_mac", "in_dst_mac", "out_src_mac", "out_dst_mac"],
}
GEO = {"src": ["src_geo"], "dst": ["dst_geo"], "": ["src_geo", "dst_geo"], "src nat": ["x_src_geo"], "dst nat": ["x_dst_geo"], "nat": ["x_src_geo", "x_dst_geo"], "src tun": ["tun_src_geo"], "dst tun": ["tun_dst_geo"], "tun": ["tun_src_geo", "tun_dst_geo"]}


def _any(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


def _cmp(c: Column, op: str, n) -> Column:
    # numbers beyond 63 bits don't fit a LONG literal
    v = F.lit(n) if not isinstance(n, int) or -(2**63) <= n < 2**63 else F.lit(str(n)).cast("decimal(20,0)")
    return {"=": c == v, ">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v, "&": c.bitwiseAND(v.cast("int")) == v.cast("int")}[op]


def _pick(table: dict, t: Term):
    if t.direction not in table:
        raise FilterError(f"{t.name} has no direction {t.direction!r}")
    return table[t.direction]


class Compiler:
    def __init__(self, df: DataFrame, zone: str = "UTC") -> None:
        self.df, self.zone = df, zone

    def col(self, name: str) -> Column:
        return field(self.df, name)

    def compile(self, tree) -> Column:
        if isinstance(tree, And):
            return self.compile(tree.left) & self.compile(tree.right)
        if isinstance(tree, Or):
            return self.compile(tree.left) | self.compile(tree.right)
        if isinstance(tree, Not):
            return ~self.compile(tree.of)
        return F.coalesce(getattr(self, "c_" + tree.name)(tree), F.lit(False))

    def among(self, names: list[str], t: Term) -> Column:
        if t.op == "in":
            return _any([self.col(n).isin(*t.value) for n in names])
        return _any([F.coalesce(_cmp(self.col(n), t.op, t.value), F.lit(False)) for n in names])

    # --- record and header

    def c_any(self, t):
        return F.lit(True)

    def c_ipv4(self, t):
        return self.col("src4").isNotNull()

    def c_ipv6(self, t):
        return self.col("src6").isNotNull()

    def c_ident(self, t):
        return F.coalesce(F.nullif(self.col("ident"), F.lit("")), F.lit("none")) == t.value

    def c_count(self, t):
        return _cmp(self.col("rec_no"), t.op, t.value)

    def c_engine(self, t):
        return _cmp(self.col("engine_" + t.direction), t.op, t.value)

    def c_exporter(self, t):
        return _cmp(self.col("exporter_id"), t.op, t.value)

    def c_seen(self, t):
        try:
            ms = parse_ms(t.value, self.zone)
        except ValueError as e:
            raise FilterError(str(e)) from None
        return _cmp(self.col(t.direction + "_ms"), t.op, ms)

    # --- protocol and ports

    def c_proto(self, t):
        n = t.value
        if isinstance(n, str):
            n = enums.protocol_number(n)
            if n is None:
                raise FilterError(f"unknown protocol: {t.value}")
        if t.direction in ("tun", "src tun", "dst tun"):
            return self.col("tun_proto") == n
        if t.direction:
            raise FilterError("a protocol has no direction")
        return self.col("proto") == n

    def c_port(self, t):
        return self.among(_pick(PORTS, t), t)

    def c_port_in_pblock(self, t):
        names = _pick({k: PORTS[k] for k in ("src", "dst", "")}, t)
        return _any([F.coalesce(self.col(n).between(self.col("pb_start"), self.col("pb_end")), F.lit(False)) for n in names])

    def c_icmp(self, t):
        v = F.shiftright(self.col("dst_port"), 8) if t.direction == "type" else self.col("dst_port").bitwiseAND(255)
        return self.col("proto").isin(1, 58) & _cmp(v, t.op, t.value)

    def c_flags(self, t):
        return (self.col("proto") == 6) & _cmp(self.col("tcp_flags").cast("int"), t.op, t.value)

    def c_tos(self, t):
        return _cmp(self.col(_pick({"": "src_tos", "src": "src_tos", "dst": "dst_tos"}, t)), t.op, t.value)

    def c_ttl(self, t):
        return self.among(_pick({"min": ["min_ttl"], "max": ["max_ttl"], "": ["min_ttl", "max_ttl"]}, t), t)

    def c_ttl_equal(self, t):
        return self.col("min_ttl") == self.col("max_ttl")

    def c_fwdstat(self, t):
        n = t.value
        if isinstance(n, str):
            n = enums.forwarding_number(n)
            if n is None:
                raise FilterError(f"unknown forwarding status: {t.value}")
        return _cmp(self.col("fwd_status"), t.op, n)

    # --- counters and rates

    def c_packets(self, t):
        return _cmp(self.col(_pick({"": "in_packets", "in": "in_packets", "out": "out_packets"}, t)), t.op, t.value)

    def c_bytes(self, t):
        return _cmp(self.col(_pick({"": "in_bytes", "in": "in_bytes", "out": "out_bytes"}, t)), t.op, t.value)

    def c_flows(self, t):
        return _cmp(self.col("cnt_flows"), t.op, t.value)

    def c_duration(self, t):
        return _cmp(self.col("last_ms") - self.col("first_ms"), t.op, t.value)

    def _rate(self, counter: str, scale: int, t: Term) -> Column:
        d = self.col("last_ms") - self.col("first_ms")
        return self.col(counter).isNotNull() & _cmp(div(self.col(counter) * scale, d), t.op, t.value)

    def c_pps(self, t):
        return self._rate("in_packets", 1000, t)

    def c_bps(self, t):
        return self._rate("in_bytes", 8000, t)

    def c_bpp(self, t):
        return self.col("in_bytes").isNotNull() & _cmp(div(self.col("in_bytes"), self.col("in_packets")), t.op, t.value)

    # --- addresses

    def _in_range(self, pair: tuple[str, str], text: str, bits: int | None) -> Column:
        try:
            family, address = ip.parse(text)
            if bits is None:
                c = self.col(pair[0] if family == 4 else pair[1])
                return c == F.lit(address)
            family, low, high = ip.prefix_range(text, bits)
        except ValueError as e:
            raise FilterError(str(e)) from None
        c = self.col(pair[0] if family == 4 else pair[1])
        return (c >= F.lit(low)) & (c <= F.lit(high))

    def _addresses(self, pairs, items) -> Column:
        return _any([F.coalesce(self._in_range(p, text, bits), F.lit(False)) for p in pairs for text, bits in items])

    def c_ip(self, t):
        pairs = _pick(IP_COLUMNS, t)
        if t.op == "in":
            plain = [ip.parse(x) for x, bits in t.value if bits is None and _is_address(x)]
            if len(plain) == len(t.value):
                # whole addresses only: one hashed set per family
                sets = [(pick, [a for f, a in plain if f == fam]) for fam, pick in ((4, 0), (6, 1))]
                return _any([F.coalesce(self.col(p[pick]).isin(*s), F.lit(False)) for p in pairs for pick, s in sets if s])
            return self._addresses(pairs, t.value)
        if t.value.lower() == "tor":
            names = _pick({"src": ["src_tor"], "dst": ["dst_tor"], "": ["src_tor", "dst_tor"]}, t)
            return _any([F.coalesce(F.lower(self.col(n)) == "ex", F.lit(False)) for n in names])
        if not _is_address(t.value):
            if t.direction not in ("", "src", "dst"):
                raise FilterError("a host name needs no direction, src or dst")
            try:
                found = sorted({x[4][0] for x in socket.getaddrinfo(t.value, None)})
            except OSError:
                raise FilterError(f"host name can't be resolved: {t.value}") from None
            return self._addresses(pairs, [(x, None) for x in found])
        return self._addresses(pairs, [(t.value, None)])

    def c_net(self, t):
        text, mask = t.value
        try:
            bits = mask if isinstance(mask, int) else ip.mask_bits(mask)
        except ValueError as e:
            raise FilterError(str(e)) from None
        return self._addresses(_pick(IP_COLUMNS, t), [(text, bits)])

    def c_geo(self, t):
        return _any([F.coalesce(self.col(n) == t.value, F.lit(False)) for n in _pick(GEO, t)])

    def c_as(self, t):
        if t.direction in ("prev", "next"):
            cols = [F.coalesce(self.col(f"{t.direction}_as"), F.lit(0))]
        else:
            cols = [F.coalesce(self.col(n), F.lit(0)) for n in _pick({"": ["src_as", "dst_as"], "src": ["src_as"], "dst": ["dst_as"]}, t)]
        return _any([c.isin(*t.value) if t.op == "in" else _cmp(c, t.op, t.value) for c in cols])

    def c_mask(self, t):
        return self.among(_pick({"": ["src_mask", "dst_mask"], "src": ["src_mask"], "dst": ["dst_mask"]}, t), t)

    def c_if(self, t):
        return self.among(_pick({"": ["input_if", "output_if"], "in": ["input_if"], "out": ["output_if"]}, t), t)

    def c_vlan(self, t):
        return self.among(_pick({"": ["src_vlan", "dst_vlan", "vlan_id", "post_vlan"], "src": ["src_vlan", "vlan_id"], "dst": ["dst_vlan", "post_vlan"]}, t), t)

    def c_mac(self, t):
        try:
            n = ip.mac_number(t.value)
        except ValueError as e:
            raise FilterError(str(e)) from None
        return self.among(_pick(MACS, t), Term("mac", t.direction, "=", n))

    def c_ethertype(self, t):
        return self.col("ether_type") == t.value

    def c_flowdir(self, t):
        return self.col("dir") == t.value

    def c_mpls(self, t):
        stack = self.col("mpls")
        if t.direction in ("label", "exp"):
            entry = F.get(stack, F.lit(t.extra[0]))
            v = F.shiftright(entry, 4) if t.direction == "label" else F.shiftright(entry, 1).bitwiseAND(7)
            return _cmp(v, t.op, t.value)
        label = lambda x: F.shiftright(x, 4)
        if t.direction == "any":
            return F.exists(stack, lambda x: _cmp(label(x), t.op, t.value))
        bottom = F.get(F.filter(stack, lambda x: x.bitwiseAND(1) == 1), F.lit(0))
        return _cmp(label(bottom), t.op, t.value)

    def c_latency(self, t):
        return _cmp(self.col(_pick({"client": "client_us", "server": "server_us", "app": "app_us"}, t)), t.op, t.value)

    # --- events

    def c_asa(self, t):
        n = t.value
        if isinstance(n, str):
            n = enums.fw_event_number(n) if t.direction == "event" else enums.fw_xevent_number(n)
            if n is None:
                raise FilterError(f"unknown firewall event: {t.value}")
        return _cmp(self.col("fw_event" if t.direction == "event" else "fw_xevent"), t.op, n)

    def c_asa_user(self, t):
        return self.col("username") == t.value

    def c_acl(self, t):
        acl = self.col(_pick({"ingress": "ingress_acl", "egress": "egress_acl"}, t))
        return F.exists(acl, lambda x: _cmp(x, t.op, t.value))

    def c_nat_event(self, t):
        n = t.value
        if isinstance(n, str):
            n = enums.nat_event_number(n)
            if n is None:
                raise FilterError(f"unknown NAT event: {t.value}")
        return _cmp(self.col("nat_event"), t.op, n)

    def c_pblock(self, t):
        return _cmp(self.col("pb_" + t.direction), t.op, t.value)

    def c_observation(self, t):
        return _cmp(self.col("obs_domain_id" if t.direction == "domain" else "obs_point_id"), t.op, t.value)

    def c_vrf(self, t):
        return self.among(_pick({"": ["ingress_vrf", "egress_vrf"], "ingress": ["ingress_vrf"], "egress": ["egress_vrf"]}, t), t)

    def c_pf(self, t):
        if t.direction == "rule":
            return _cmp(self.col("pf_rule"), t.op, t.value)
        if t.direction == "interface":
            return self.col("pf_ifname") == t.value
        if t.direction == "dir":
            if t.value.lower() not in ("in", "out"):
                raise FilterError("a packet filter direction is in or out")
            return self.col("pf_dir") == (0 if t.value.lower() == "in" else 1)
        n = enums.pf_action_number(t.value) if t.direction == "action" else enums.pf_reason_number(t.value)
        if n is None:
            raise FilterError(f"unknown packet filter {t.direction}: {t.value}")
        return self.col("pf_" + t.direction) == n

    # --- payload

    def c_payload(self, t):
        from freshet.functions import payload

        kind, option = t.extra
        sides = [self.col(n) for n in _pick({"": ["in_payload", "out_payload"], "in": ["in_payload"], "out": ["out_payload"], "src": ["in_payload"], "dst": ["out_payload"]}, t)]
        if kind == "content":
            return _any([F.coalesce(F.contains(s, F.lit(t.value.encode())), F.lit(False)) for s in sides])
        if kind == "regex":
            flags = "".join(sorted(set(option or "")))
            pattern = (f"(?{flags})" if flags else "") + t.value
            return _any([F.coalesce(F.decode(s, "ISO-8859-1").rlike(pattern), F.lit(False)) for s in sides])
        tcp, value = self.col("proto") == 6, t.value.lower()
        if kind in ("ssl", "tls"):
            f = [payload.tls(s) for s in sides]
            if value == "defined":
                return tcp & _any([x["kind"].isNotNull() for x in f])
            if value == "version":
                return tcp & _any([F.coalesce(x["version"] == _tls_version(option), F.lit(False)) for x in f])
            if value == "sni":
                return tcp & _any([F.coalesce(F.contains(x["sni"], F.lit(option)), F.lit(False)) for x in f])
            raise FilterError(f"unknown TLS term: {t.value}")
        if kind in ("ja3", "ja4", "ja4s"):
            f = [self.col(kind)] if kind in self.df.columns else [payload.tls(s)[kind] for s in sides]
            if value == "defined":
                return _any([x.isNotNull() for x in f])
            return _any([F.coalesce(x == t.value, F.lit(False)) for x in f])
        if kind == "dns":
            port53 = (self.col("src_port") == 53) | (self.col("dst_port") == 53)
            f = [payload.dns(s, self.col("proto")) for s in sides]
            if value == "defined":
                return port53 & _any([x.isNotNull() for x in f])
            part = {"name": "names", "address": "addresses", "addr": "addresses", "ip": "addresses"}.get(value)
            if part is None:
                raise FilterError(f"unknown DNS term: {t.value}")
            return port53 & _any([F.coalesce(F.exists(x[part], lambda y: F.contains(y, F.lit(option))), F.lit(False)) for x in f])
        raise FilterError(f"unknown payload term: {kind}")


def _tls_version(text: str | None) -> int:
    versions = {"1.0": 0x0301, "1.1": 0x0302, "1.2": 0x0303, "1.3": 0x0304, "3.0": 0x0300, "2.0": 0x0002}
    if text not in versions:
        raise FilterError(f"unknown TLS version: {text}")
    return versions[text]


def _is_address(text: str) -> bool:
    try:
        ip.parse(text)
    except ValueError:
        return False
    return True


def compile_filter(text: str, df: DataFrame, zone: str = "UTC") -> Column:
    return Compiler(df, zone).compile(parse(text))


def needs(tree) -> set[str]:
    """What the flows must be enriched with before the filter can run: geo, tor, as."""
    return {"as" if c.endswith("_as") else c.rpartition("_")[2] for c in derived(tree)}


def derived(tree) -> set[str]:
    """The columns that lookups fill and the filter reads."""
    out: set[str] = set()
    for t in terms(tree):
        if t.name == "geo":
            out |= set(GEO.get(t.direction, ()))
        elif t.name == "ip" and isinstance(t.value, str) and t.value.lower() == "tor":
            out |= {f"{side}_tor" for side in ("src", "dst") if t.direction in ("", side)}
        elif t.name == "as" and t.direction in ("", "src", "dst"):
            out |= {f"{side}_as" for side in ("src", "dst") if t.direction in ("", side)}
    return out


def _conjuncts(tree) -> list:
    return _conjuncts(tree.left) + _conjuncts(tree.right) if isinstance(tree, And) else [tree]


def apply_filter(df: DataFrame, text: str, zone: str = "UTC") -> DataFrame:
    """Cheap conjuncts first; those that decode payloads see only the rows that are left."""
    c = Compiler(df, zone)
    decoded = lambda part: any(t.name == "payload" and t.extra[0] not in ("content", "regex") for t in terms(part))
    parts = sorted(_conjuncts(parse(text)), key=decoded)
    for part in parts:
        df = df.where(c.compile(part))
    return df

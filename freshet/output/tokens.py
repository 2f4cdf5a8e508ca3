"""Output columns by token: `%sap` and the like, for fixed-width text and for CSV, as projections.

Each token is a Column over the flow schema, so a format is one select and stays in the JVM; only IPv6 text and payload decoding use
Arrow batches. Formats may contain other formats and user formats by name.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions import enums, ip, time
from freshet.functions.rates import div, weight
from freshet.operators.aggregate import _own_mask6
from freshet.schema import field

Maker = Callable[["Projection"], Column]


class Projection:
    """Columns of one table, for one way of printing."""

    def __init__(self, df: DataFrame, long6: bool = False, plain: bool = True) -> None:
        self.df, self.long6, self.plain = df, long6, plain

    def __getitem__(self, name: str) -> Column:
        return field(self.df, name)

    def number(self, name: str) -> Column:
        return F.coalesce(self[name], F.lit(0)).cast("string")

    def counter(self, c: Column) -> Column:
        c = F.coalesce(c, F.lit(0).cast("long"))
        return c.cast("string") if self.plain else scaled(c)

    def address(self, name: str) -> Column:
        v6 = ip.text6_long(self[name + "6"]) if self.long6 else ip.text6(self[name + "6"])
        return F.coalesce(ip.text4(self[name + "4"]), v6, F.lit("0.0.0.0"))

    def endpoint(self, name: str, port: str) -> Column:
        """address:port, or address.port where the address has colons; ICMP shows type.code as the destination's port."""
        p = self.number(port)
        if port == "dst_port":
            d = F.coalesce(self["dst_port"], F.lit(0))
            p = F.when(self["proto"].isin(1, 58), F.concat_ws(".", F.shiftright(d, 8), d.bitwiseAND(255))).otherwise(p)
        return F.concat(self.address(name), F.when(self[name + "4"].isNull() & self[name + "6"].isNotNull(), ".").otherwise(":"), p)

    def located(self, name: str, geo: str) -> Column:
        return F.concat(self.address(name), F.lit("("), F.coalesce(self[geo], F.lit("..")), F.lit(")"))

    def network(self, side: str) -> Column:
        bits = F.coalesce(self[side + "_mask"], F.lit(0)).cast("int")
        v6 = _own_mask6(self[side + "6"], bits)
        text = F.coalesce(ip.text4(ip.masked4(self[side + "4"], bits)), ip.text6_long(v6) if self.long6 else ip.text6(v6), F.lit("0.0.0.0"))
        return F.concat_ws("/", text, bits.cast("string"))

    def span(self) -> Column:
        return F.coalesce(self["last_ms"] - self["first_ms"], F.lit(0).cast("long"))


def scaled(c: Column) -> Column:
    """1.2 M, 3.4 G, 5.6 T from 10^6, 10^9 and 10^12 on."""
    step = lambda n, unit: F.format_string(f"%.1f {unit}", c / n)
    return F.when(c >= 10**12, step(1e12, "T")).when(c >= 10**9, step(1e9, "G")).when(c >= 10**6, step(1e6, "M")).otherwise(c.cast("string"))


def _num(name: str) -> Maker:
    return lambda p: p.number(name)


def _text(name: str, missing: str = "") -> Maker:
    return lambda p: F.coalesce(p[name].cast("string"), F.lit(missing))


def _seconds(name: str) -> Maker:
    return lambda p: F.format_string("%d.%03d", F.floor(F.coalesce(p[name], F.lit(0)) / 1000), F.coalesce(p[name], F.lit(0)) % 1000)


def _local(name: str) -> Maker:
    return lambda p: time.iso(p[name])


def _gmt(name: str) -> Maker:
    def make(p: Projection) -> Column:
        ms = F.coalesce(p[name], F.lit(0).cast("long"))
        day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int"))
        r = F.pmod(ms, F.lit(86_400_000))
        clock = F.format_string("%02d:%02d:%02d.%03d", F.floor(r / 3_600_000), F.floor(r / 60_000) % 60, F.floor(r / 1000) % 60, r % 1000)
        return F.concat_ws(" ", day.cast("string"), clock)

    return make


def _mpls(i: int) -> Maker:
    def make(p: Projection) -> Column:
        x = F.coalesce(F.get(p["mpls"], F.lit(i)), F.lit(0).cast("long"))
        return F.format_string("%d-%d-%d", F.shiftright(x, 4), F.shiftright(x, 1).bitwiseAND(7), x.bitwiseAND(1))

    return make


def _rate(kind: str) -> Maker:
    def make(p: Projection) -> Column:
        pk, by = p["in_packets"], p["in_bytes"]
        return p.counter({"pps": div(pk * 1000, p.span()), "bps": div(by * 8000, p.span()), "bpp": div(by, pk)}[kind])

    return make


def _latency(name: str) -> Maker:
    return lambda p: F.format_string("%.3f", F.coalesce(p[name], F.lit(0)) / 1000.0)


def _acl(name: str) -> Maker:
    return lambda p: F.coalesce(F.concat_ws(":", F.transform(p[name], lambda x: F.format_string("0x%x", x))), F.lit("0x0:0x0:0x0"))


def _icmp(part: str) -> Maker:
    def make(p: Projection) -> Column:
        d = F.coalesce(p["dst_port"], F.lit(0))
        v = F.shiftright(d, 8) if part == "type" else d.bitwiseAND(255)
        return F.when(p["proto"].isin(1, 58), v).otherwise(0).cast("string")

    return make


def _proto(p: Projection) -> Column:
    n = F.coalesce(p["proto"], F.lit(0))
    return F.when(n < len(enums.PROTOCOLS), enums.protocol_name(n)).otherwise(n.cast("string"))


def _flags(p: Projection) -> Column:
    return enums.flags_text(F.when(p["proto"] == 6, p["tcp_flags"]).otherwise(F.lit(0)).cast("int"))


def _tls(part: str) -> Maker:
    def make(p: Projection) -> Column:
        from freshet.functions import payload

        if part in p.df.columns:
            return F.coalesce(p[part].cast("string"), F.lit(""))
        one, two = payload.tls(p["in_payload"])[part], payload.tls(p["out_payload"])[part]
        return F.coalesce(one.cast("string"), two.cast("string"), F.lit(""))

    return make


def _name(table_name: str) -> Maker:
    return lambda p: F.coalesce(F.col(table_name) if table_name in p.df.columns else F.lit(None).cast("string"), F.lit("<no-name>"))


def _tor(side: str) -> Maker:
    return _text(side + "_tor", "..")


_END = lambda p: enums.name_of(F.coalesce(p["end_reason"], F.lit(0)), enums.END_REASONS, F.lit("undef"))
_BFD = lambda p: enums.name_of(F.coalesce(p["biflow_dir"], F.lit(0)), enums.BIFLOW, F.lit("undef"))

# token: header of text output (its width is the column's; - if there is none), header of CSV (- if there is none), maker
TOKENS: dict[str, tuple[str, str, Maker]] = {
    "nfv": ("Ver", "version", _num("nf_version")), "cnt": ("Count", "count", _num("rec_no")), "idt": ("Ident       ", "Ident", _text("ident", "none")),
    "eng": (" engine", "engine", lambda p: F.concat_ws("/", p.number("engine_type"), p.number("engine_id"))), "exp": ("Exp ID", "exporterID", _num("exporter_id")),
    "tfs": ("Date first seen        ", "firstSeen", _local("first_ms")), "ts": ("Date first seen        ", "firstSeen", _local("first_ms")), "tsr": ("First seen raw", "firstSeen", _seconds("first_ms")),
    "tsg": ("First seen GMT         ", "firstSeen", _gmt("first_ms")), "te": ("Date last seen         ", "lastSeen", _local("last_ms")), "ter": ("Last seen raw ", "lastSeen", _seconds("last_ms")),
    "teg": ("Last seen GMT          ", "lastSeen", _gmt("last_ms")), "tr": ("Date flow received     ", "received", _local("received_ms")), "trr": ("Received raw  ", "received", _seconds("received_ms")),
    "trg": ("Date flow received GMT ", "received", _gmt("received_ms")), "td": ("Duration        ", "duration", lambda p: time.duration_text(p.span())), "tds": ("Duration        ", "duration", lambda p: F.format_string("%d.%03d", F.floor(p.span() / 1000), F.pmod(p.span(), F.lit(1000)))),
    "pkt": (" Packets", "packets", lambda p: p.counter(p["in_packets"])), "ipkt": ("  In Pkt", "inPackets", lambda p: p.counter(p["in_packets"])), "byt": ("   Bytes", "bytes", lambda p: p.counter(p["in_bytes"])),
    "ibyt": (" In Byte", "inBytes", lambda p: p.counter(p["in_bytes"])), "sp": ("Src Pt", "srcPort", _num("src_port")), "dp": ("Dst Pt", "dstPort", _num("dst_port")), "it": ("ICMP-T", "icmpTYpe", _icmp("type")), "ic": ("ICMP-C", "icmpCode", _icmp("code")),
    "pr": ("Proto", "proto", _proto), "flg": ("   Flags", "flags", _flags), "fwd": ("Fwd", "fwdStatus", _num("fwd_status")), "tos": (" Tos", "tos", _num("src_tos")), "stos": ("STos", "srcTos", _num("src_tos")),
    "bps": ("     bps", "bps", _rate("bps")), "pps": ("     pps", "pps", _rate("pps")), "bpp": ("   Bpp", "bpp", _rate("bpp")),
    "sa": ("     Src IP Addr", "srcAddr", lambda p: p.address("src")), "da": ("     Dst IP Addr", "dstAddr", lambda p: p.address("dst")),
    "sap": ("     Src IP Addr:Port ", "-", lambda p: p.endpoint("src", "src_port")), "dap": ("     Dst IP Addr:Port ", "-", lambda p: p.endpoint("dst", "dst_port")),
    "gsap": (" Src IP Addr(..):Port ", "-", lambda p: F.concat_ws(":", p.located("src", "src_geo"), p.number("src_port"))), "gdap": (" Dst IP Addr(..):Port ", "-", lambda p: F.concat_ws(":", p.located("dst", "dst_geo"), p.number("dst_port"))),
    "gsa": ("     Src IP Addr(..)", "-", lambda p: p.located("src", "src_geo")), "gda": ("     Dst IP Addr(..)", "-", lambda p: p.located("dst", "dst_geo")),
    "in": (" Input", "input", _num("input_if")), "out": ("Output", "output", _num("output_if")), "smk": ("SMask", "srcMask", _num("src_mask")), "dmk": ("DMask", "dstMask", _num("dst_mask")), "dir": ("Dir", "direction", _num("dir")),
    "dtos": ("DTos", "dstTos", _num("dst_tos")), "bfd": ("Bfd", "biDirection", _BFD), "end": ("End", "endReason", _END), "sn": ("Src Network       ", "srcNet", lambda p: p.network("src")), "dn": ("Dst Network       ", "dstNet", lambda p: p.network("dst")),
    "inam": ("Input interface name", "inIfName", _name("input_name")), "onam": ("Output interface name", "outIfName", _name("output_name")), "opkt": (" Out Pkt", "outPackets", lambda p: p.counter(p["out_packets"])), "obyt": ("Out Byte", "outBytes", lambda p: p.counter(p["out_bytes"])),
    "fl": ("Flows", "flows", lambda p: weight(p["cnt_flows"]).cast("string")), "svln": ("SVlan", "srcVlan", _num("src_vlan")), "dvln": ("DVlan", "dstVlan", _num("dst_vlan")), "sas": ("Src AS", "srcAS", _num("src_as")), "das": ("Dst AS", "dstAS", _num("dst_as")),
    "nhb": (" BGP next-hop IP", "bgpNextIP", lambda p: p.address("bgp_next")), "nh": ("     Next-hop IP", "nextIP", lambda p: p.address("next")), "ra": ("       Router IP", "routerIP", lambda p: p.address("router")), "gra": ("       Router IP(..)", "-", lambda p: F.concat(p.address("router"), F.lit("(..)"))),
    **{f"mpls{i}": (f"MPLS lbl {i} ", f"mplsLabel{i}", _mpls(i - 1)) for i in range(1, 11)},
    "mpls": ("MPLS labels", "mplsLabel1-10", lambda p: F.concat_ws(" ", *[_mpls(i)(p) for i in range(10)])),
    "ismc": (" In src MAC Addr ", "inSrcMac", lambda p: F.coalesce(ip.mac_text(p["in_src_mac"]), F.lit("00:00:00:00:00:00"))), "odmc": (" Out dst MAC Addr", "outDstMac", lambda p: F.coalesce(ip.mac_text(p["out_dst_mac"]), F.lit("00:00:00:00:00:00"))),
    "idmc": (" In dst MAC Addr ", "inDstMac", lambda p: F.coalesce(ip.mac_text(p["in_dst_mac"]), F.lit("00:00:00:00:00:00"))), "osmc": (" Out src MAC Addr", "outSrcMac", lambda p: F.coalesce(ip.mac_text(p["out_src_mac"]), F.lit("00:00:00:00:00:00"))),
    "nas": ("Next AS", "nextAS", _num("next_as")), "pas": ("Prev AS", "prevAS", _num("prev_as")), "cl": ("C Latency", "clientLatency", _latency("client_us")), "sl": ("S latency", "serverLatency", _latency("server_us")), "al": ("A latency", "appLatency", _latency("app_us")),
    "tevt": ("Event time             ", "eventTime", _local("nsel_event_ms")), "msec": ("   Event Time", "eventTime", _num("nsel_event_ms")), "evt": (" Event", "event", lambda p: enums.name_of(F.coalesce(p["fw_event"], F.lit(0)), enums.FW_EVENTS)),
    "nevt": (" Event", "event", lambda p: enums.name_of(F.coalesce(p["nat_event"], F.lit(0)), enums.NAT_EVENTS)), "nfc": ("   Conn-ID", "connectionID", _num("conn_id")), "xevt": (" XEvent", "xEvent", lambda p: enums.name_of(F.coalesce(p["fw_xevent"], F.lit(0)), {k: v[0] for k, v in enums.FW_XEVENTS.items()})),
    "xsa": ("   X-late Src IP", "srcXIP", lambda p: p.address("x_src")), "xda": ("   X-late Dst IP", "dstXIP", lambda p: p.address("x_dst")), "xsap": (" X-Src IP Addr:Port ", "-", lambda p: p.endpoint("x_src", "x_src_port")), "xdap": (" X-Dst IP Addr:Port ", "-", lambda p: p.endpoint("x_dst", "x_dst_port")),
    "xsp": ("XsPort", "srcXPort", _num("x_src_port")), "xdp": ("XdPort", "dstXPort", _num("x_dst_port")), "iacl": ("Ingress ACL                     ", "ingressACL", _acl("ingress_acl")), "eacl": ("Egress ACL                      ", "egressACL", _acl("egress_acl")),
    "uname": ("UserName", "nselUser", _text("username")), "pbstart": ("Pb-Start", "pbStart", _num("pb_start")), "pbend": ("Pb-End", "pbEnd", _num("pb_end")), "pbstep": ("Pb-Step", "pbStep", _num("pb_step")), "pbsize": ("Pb-Size", "pbSize", _num("pb_size")),
    "nbid": ("nbar ID", "nbarID", lambda p: F.coalesce(F.concat_ws("..", F.conv(F.hex(F.substring(p["nbar_id"], 1, 1)), 16, 10), F.conv(F.hex(F.substring(p["nbar_id"], 2, 3)), 16, 10)), F.lit("0"))), "nbnam": ("nbar name           ", "nbarName", _name("nbar_name")),
    "ipl": ("Input Payload", "-", lambda p: F.coalesce(F.hex(p["in_payload"]), F.lit(""))), "opl": ("Output Payload", "-", lambda p: F.coalesce(F.hex(p["out_payload"]), F.lit(""))),
    "odid": ("obsDomainID", "obsDomainID", lambda p: F.format_string("0x%x", F.coalesce(p["obs_domain_id"], F.lit(0)).cast("long"))), "opid": ("  obsPointID", "obsPointID", lambda p: F.format_string("0x%x", F.coalesce(p["obs_point_id"], F.lit(0)).cast("long"))),
    "ivrf": ("  I-VRF-ID", "ingressVrfID", _num("ingress_vrf")), "ivrfnam": ("I-VRF-Name", "ingressVrfName", _name("ivrf_name")), "evrf": ("  E-VRF-ID", "egressVrfID", _num("egress_vrf")), "evrfnam": ("E-VRF-Name", "egressVrfName", _name("evrf_name")),
    "pfifn": ("interface", "pfInterface", _text("pf_ifname")), "pfact": ("action", "pfAction", lambda p: enums.name_of(p["pf_action"], enums.PF_ACTIONS, F.lit("<undef>"))), "pfrea": ("reason", "pfReason", lambda p: enums.name_of(p["pf_reason"], enums.PF_REASONS, F.lit("<undef>"))),
    "pfdir": ("dir", "pfDirection", lambda p: F.when(p["pf_dir"] == 1, "out").otherwise("in")), "pfrule": ("rule", "pfRule", _num("pf_rule")), "flid": ("flowID", "flowID", _num("flow_id")), "isid": ("inSrvID", "inSrvID", _num("in_service_id")), "osid": ("outSrvID", "outSrvID", _num("out_service_id")),
    "nats": ("nat string", "natString", _text("nat_string")), "ja3": ("                             ja3", "ja3", _tls("ja3")), "ja4": ("                                 ja4", "ja4", _tls("ja4")), "sni": ("sni name", "sniName", _tls("sni")), "tls": ("TLS ver", "tlsVersion", _tls("version")),
    "sc": ("SC", "srcGeo", _text("src_geo", "..")), "dc": ("DC", "dstGeo", _text("dst_geo", "..")), "sloc": ("Src IP location info", "srcLocation", _name("src_location")), "dloc": ("Dst IP location info", "dstLocation", _name("dst_location")),
    "sasn": ("Src AS organisation", "srcOrg", _name("src_org")), "dasn": ("Dst AS organisation", "dstOrg", _name("dst_org")), "stor": ("STor", "srcTor", _tor("src")), "dtor": ("DTor", "dstTor", _tor("dst")), "lbl": ("           label", "label", _text("label")),
    "ttl": ("min/maxTTL", "-", lambda p: F.concat_ws("/", p.number("min_ttl"), p.number("max_ttl"))), "minttl": ("minTTL", "minTTL", _num("min_ttl")), "maxttl": ("maxTTL", "maxTTL", _num("max_ttl")),
    "frag": ("Frag", "Frag", lambda p: F.concat(F.when(p["frag_flags"].bitwiseAND(64) != 0, "DF").otherwise("  "), F.when(p["frag_flags"].bitwiseAND(32) != 0, "MF").otherwise("  "))), "eth": ("EtherType", "-", lambda p: F.format_string("0x%04x", F.coalesce(p["ether_type"], F.lit(0)))), "n": ("", "-", lambda p: F.lit("\n")),
}
# Other spellings of the same columns.
ALIASES = {"vrf": "ivrf", "nsa": "xsa", "nda": "xda", "nsap": "xsap", "ndap": "xdap", "nsp": "xsp", "ndp": "xdp"}

# The predefined formats.
FORMATS = {
    "line": "%ts %td %pr %sap -> %dap %pkt %byt %fl",
    "gline": "%ts %td %pr %gsap -> %gdap %pkt %byt %fl",
    "long": "%ts %td %pr %sap -> %dap %flg %tos %pkt %byt %fl",
    "glong": "%ts %td %pr %gsap -> %gdap %flg %tos %pkt %byt %fl",
    "extended": "%ts %td %pr %sap -> %dap %flg %tos %pkt %byt %pps %bps %bpp %fl",
    "biline": "%ts %td %pr %sap <-> %dap %opkt %ipkt %obyt %ibyt %fl",
    "bilong": "%ts %td %pr %sap <-> %dap %flg %tos %opkt %ipkt %obyt %ibyt %fl",
    "nsel": "%ts %evt %xevt %pr %sap -> %dap %xsap -> %xdap %ibyt %obyt",
    "nat": "%ts %nevt %pr %sap -> %dap %nsap -> %ndap",
    "csv": "%ts,%td,%pr,%sa,%sp,%da,%dp,%pkt,%byt,%fl",
}
_PART = re.compile(r"%([a-z0-9]+)|([^%]+)")
_LEFT = {"ts", "te", "tr", "tfs", "td", "tds", "tsg", "teg", "trg", "pr", "idt", "inam", "onam", "nbnam", "sn", "dn", "tevt"}
MAX_NESTING = 10


def expand(text: str, user: dict[str, str] | None = None, depth: int = 0) -> str:
    """Replaces names of formats in a format, again and again; tokens come first."""
    named = FORMATS | (user or {})
    if depth > MAX_NESTING:
        raise ValueError("formats are nested too deep")

    def one(m: re.Match) -> str:
        n = m[1]
        return m[0] if n in TOKENS or n in ALIASES or n not in named else expand(named[n], user, depth + 1)

    return re.sub(r"%([a-z0-9]+)", one, text)


def parts(text: str, user: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """("token", name) and ("text", literal) in order."""
    named = FORMATS | (user or {})
    text = expand(named.get(text, text), user)
    out = []
    for m in _PART.finditer(text):
        if m[1] is None:
            out.append(("text", m[2]))
            continue
        n = ALIASES.get(m[1], m[1])
        if n not in TOKENS:
            raise ValueError(f"unknown output token: %{m[1]}")
        out.append(("token", n))
    return out


def fmt(df: DataFrame, text: str = "line", user: dict[str, str] | None = None, long6: bool = False, plain: bool = True) -> DataFrame:
    """One text column `line`: every token padded to the width of its header."""
    p = Projection(df, long6, plain)
    cols = []
    for kind, x in parts(text, user):
        if kind == "text":
            cols.append(F.lit(x))
            continue
        width = len(TOKENS[x][0]) + (23 if long6 and x in ("sa", "da", "sap", "dap") else 0)
        v = TOKENS[x][2](p)
        pad = F.rpad if x in _LEFT else F.lpad
        cols.append(pad(v, F.greatest(F.length(v), F.lit(width)), F.lit(" ")) if width else v)
    return df.select(F.concat(*cols).alias("line"))


def header(text: str = "line", user: dict[str, str] | None = None) -> str:
    return "".join(x if k == "text" else TOKENS[x][0] for k, x in parts(text, user))


def csv(df: DataFrame, text: str = "csv", user: dict[str, str] | None = None, long6: bool = False) -> DataFrame:
    """A column of text per token, under its CSV header; a header that occurs again gets a number. Write it with df.write.csv."""
    p = Projection(df, long6, True)
    cols, seen = [], {}
    for kind, x in parts(text, user):
        if kind == "text":
            continue
        name = TOKENS[x][1]
        if name == "-":
            raise ValueError(f"%{x} has no CSV column")
        seen[name] = seen.get(name, 0) + 1
        cols.append(F.trim(TOKENS[x][2](p)).alias(name if seen[name] == 1 else f"{name}{seen[name]}"))
    return df.select(*cols)


def csv_fast(df: DataFrame) -> DataFrame:
    """Raw values in fixed columns, for consumers that want speed."""
    p = Projection(df)
    z = lambda n: F.coalesce(p[n], F.lit(0)).cast("long")
    family = F.when(p["src4"].isNotNull(), 4).when(p["src6"].isNotNull(), 6).otherwise(0)
    return df.select(
        z("rec_no").alias("cnt"), family.alias("af"), z("first_ms").alias("firstSeen"), z("last_ms").alias("lastSeen"), z("proto").alias("proto"), p.address("src").alias("srcAddr"), z("src_port").alias("srcPort"),
        p.address("dst").alias("dstAddr"), z("dst_port").alias("dstPort"), z("src_as").alias("srcAS"), z("dst_as").alias("dstAS"), z("input_if").alias("input"), z("output_if").alias("output"), _flags(p).alias("flags"),
        z("src_tos").alias("srcTos"), z("in_packets").alias("packets"), z("in_bytes").alias("bytes"),
    )


def auto_format(keys: str) -> str:
    """Format that suits an aggregation: times, keys, counters and rates."""
    token = {
        "proto": "pr", "srcport": "sp", "dstport": "dp", "tos": "tos", "srctos": "stos", "flags": "flg", "srcip4": "sa", "dstip4": "da", "srcip6": "sa", "dstip6": "da", "srcip": "sa", "dstip": "da", "srcnet": "sn", "dstnet": "dn",
        "xsrcip": "xsa", "xdstip": "xda", "xsrcport": "xsp", "xdstport": "xdp", "next": "nh", "bgpnext": "nhb", "router": "ra", "insrcmac": "ismc", "outdstmac": "odmc", "indstmac": "idmc", "outsrcmac": "osmc", "srcas": "sas", "dstas": "das",
        "srcasn": "sasn", "dstasn": "dasn", "nextas": "nas", "prevas": "pas", "inif": "in", "outif": "out", "srcmask": "smk", "dstmask": "dmk", "dsttos": "dtos", "srcvlan": "svln", "dstvlan": "dvln", "odid": "odid", "opid": "opid", "exp": "exp",
        "srcgeo": "sc", "dstgeo": "dc", "ethertype": "eth", "minttl": "minttl", "maxttl": "maxttl", **{f"mpls{i}": f"mpls{i}" for i in range(1, 11)},
    }
    names = [token[k.strip().lower().partition("/")[0]] for k in keys.split(",")]
    return " ".join(["%ts %td", *[f"%{n}" for n in names], "%pkt %byt %bps %bpp %fl"])

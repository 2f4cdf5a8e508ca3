"""Exporter packets to flow records: NetFlow 1, 5, 7, 9 and IPFIX.

Packets are rows (exporter, received_ms, payload). Versions 1, 5 and 7 have fixed layouts: each packet decodes on its own. Versions 9
and IPFIX describe their records by templates that come in the same stream, so packets are decoded in order per exporter and
domain, with the templates as state. Decoding works on Arrow batches; what it gives is the flow schema.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.operators.enrich import uptime_to_ms
from freshet.schema import COLUMNS

PACKET = "exporter_id int, received_ms long, payload binary"


def v1_flows(packets: DataFrame, records: DataFrame) -> DataFrame:
    """Version 1 records that were stored raw, joined with their packet headers: flow records with absolute times.

    Next hop and interfaces that are 0 are unknown. ICMP records keep type and code in the destination port.
    """
    p = packets.select("packet_id", "sys_uptime", (F.col("unix_secs") * 1000 + F.call_function("div", F.col("unix_nsecs"), F.lit(1_000_000))).alias("_unix"))
    x = records.join(p, "packet_id")
    at = lambda c: uptime_to_ms(F.col("sys_uptime"), F.col("_unix"), F.col(c))
    icmp = F.coalesce(F.col("prot") == 1, F.lit(False))
    return x.select(
        "exporter_id", F.lit(1).cast("short").alias("nf_version"), at("first_uptime").alias("first_ms"), at("last_uptime").alias("last_ms"), "received_ms",
        F.col("dpkts").alias("in_packets"), F.col("doctets").alias("in_bytes"), F.when(icmp, F.lit(0)).otherwise(F.col("srcport")).alias("src_port"),
        F.when(icmp & (F.col("dstport") == 0), F.col("srcport")).otherwise(F.col("dstport")).alias("dst_port"), F.col("prot").alias("proto"), F.col("tcp_flags"), F.col("tos").alias("src_tos"),
        F.col("srcaddr").alias("src4"), F.col("dstaddr").alias("dst4"), F.nullif("nexthop", F.lit(0)).alias("next4"),
        F.nullif(F.col("input_if"), F.lit(0)).cast("long").alias("input_if"), F.nullif(F.col("output_if"), F.lit(0)).cast("long").alias("output_if"),
    )


# --- fixed layouts: (name, struct code) in wire order; names with _ in front are read over

_V1 = [("src4", "I"), ("dst4", "I"), ("next4", "I"), ("input_if", "H"), ("output_if", "H"), ("in_packets", "I"), ("in_bytes", "I"), ("_first", "I"), ("_last", "I"), ("src_port", "H"), ("dst_port", "H"), ("_p1", "H"), ("proto", "B"), ("src_tos", "B"), ("tcp_flags", "B"), ("_p2", "7s")]
_V5 = [("src4", "I"), ("dst4", "I"), ("next4", "I"), ("input_if", "H"), ("output_if", "H"), ("in_packets", "I"), ("in_bytes", "I"), ("_first", "I"), ("_last", "I"), ("src_port", "H"), ("dst_port", "H"), ("_p1", "B"), ("tcp_flags", "B"), ("proto", "B"), ("src_tos", "B"), ("src_as", "H"), ("dst_as", "H"), ("src_mask", "B"), ("dst_mask", "B"), ("_p2", "H")]
_V7 = [*_V5[:-1], ("_p2", "H"), ("router4", "I")]
LAYOUTS = {1: (16, _V1), 5: (24, _V5), 7: (24, _V7)}


def _absolute(unix_ms: int, sys_uptime: int, uptime: int) -> int:
    back = (sys_uptime - uptime) % 2**32
    return unix_ms - (back - 2**32 if back >= 2**31 else back)


def decode_fixed(packet: bytes, received_ms: int | None = None, exporter_id: int | None = None) -> list[dict]:
    """Records of a version 1, 5 or 7 packet; a packet that is too short for its count gives those that are whole.

    Version 5 headers carry a sampling mode and interval (14 bits): counters are multiplied by the interval.
    """
    if len(packet) < 16:
        return []
    version, count, uptime, secs, nsecs = struct.unpack_from(">HHIII", packet)
    if version not in LAYOUTS:
        return []
    head, layout = LAYOUTS[version]
    if len(packet) < head:
        return []
    s = struct.Struct(">" + "".join(c for _, c in layout))
    unix_ms = secs * 1000 + nsecs // 1_000_000
    engine = struct.unpack_from(">BBH", packet, 20) if version == 5 else (0, 0, 0)
    interval = max(1, engine[2] & 0x3FFF)
    out = []
    for i in range(min(count, (len(packet) - head) // s.size)):
        r = dict(zip((n for n, _ in layout), s.unpack_from(packet, head + i * s.size)))
        r |= {"first_ms": _absolute(unix_ms, uptime, r["_first"]), "last_ms": _absolute(unix_ms, uptime, r["_last"]), "nf_version": version, "received_ms": received_ms, "exporter_id": exporter_id, "engine_type": engine[0], "engine_id": engine[1]}
        r["in_packets"] *= interval
        r["in_bytes"] *= interval
        if r["proto"] == 1 and r["dst_port"] == 0:
            r["dst_port"], r["src_port"] = r["src_port"], 0
        out.append({k: v for k, v in r.items() if k[0] != "_"})
    return out


# --- templates: element number -> (column, how to read). n number, b bytes, r relative to uptime (ms), s seconds, m milliseconds, t text,
# u microseconds before the export, p NTP time, + microseconds to add up, +s the same in seconds, a list of 32-bit numbers
# Information elements that the flow schema holds.
ELEMENTS = {
    1: ("in_bytes", "n"), 2: ("in_packets", "n"), 3: ("cnt_flows", "n"), 4: ("proto", "n"), 5: ("src_tos", "n"), 6: ("tcp_flags", "n"), 7: ("src_port", "n"), 8: ("src4", "n"), 9: ("src_mask", "n"), 10: ("input_if", "n"),
    11: ("dst_port", "n"), 12: ("dst4", "n"), 13: ("dst_mask", "n"), 14: ("output_if", "n"), 15: ("next4", "n"), 16: ("src_as", "n"), 17: ("dst_as", "n"), 18: ("bgp_next4", "n"), 21: ("last_ms", "r"), 22: ("first_ms", "r"),
    23: ("out_bytes", "n"), 24: ("out_packets", "n"), 27: ("src6", "b"), 28: ("dst6", "b"), 29: ("src_mask", "n"), 30: ("dst_mask", "n"), 32: ("dst_port", "n"), 38: ("engine_type", "n"), 39: ("engine_id", "n"), 48: ("selector_id", "n"),
    52: ("min_ttl", "n"), 53: ("max_ttl", "n"), 55: ("dst_tos", "n"), 56: ("in_src_mac", "n"), 57: ("out_dst_mac", "n"), 58: ("src_vlan", "n"), 59: ("dst_vlan", "n"), 61: ("dir", "n"), 62: ("next6", "b"), 63: ("bgp_next6", "b"),
    80: ("in_dst_mac", "n"), 81: ("out_src_mac", "n"), 85: ("in_bytes", "n"), 86: ("in_packets", "n"), 89: ("fwd_status", "n"), 95: ("nbar_id", "b"), 128: ("next_as", "n"), 129: ("prev_as", "n"), 130: ("router4", "n"), 131: ("router6", "b"),
    136: ("end_reason", "n"), 138: ("obs_point_id", "n"), 139: ("dst_port", "n"), 148: ("flow_id", "n"), 149: ("obs_domain_id", "n"), 150: ("first_ms", "s"), 151: ("last_ms", "s"), 152: ("first_ms", "m"), 153: ("last_ms", "m"), 176: ("_icmp_type", "n"), 177: ("_icmp_code", "n"),
    178: ("_icmp_type", "n"), 179: ("_icmp_code", "n"), 197: ("frag_flags", "n"), 225: ("x_src4", "n"), 226: ("x_dst4", "n"), 227: ("x_src_port", "n"), 228: ("x_dst_port", "n"), 230: ("nat_event", "n"), 233: ("fw_event", "n"), 234: ("ingress_vrf", "n"), 235: ("egress_vrf", "n"),
    239: ("biflow_dir", "n"), 243: ("vlan_id", "n"), 245: ("customer_vlan", "n"), 254: ("post_vlan", "n"), 255: ("post_customer_vlan", "n"), 256: ("ether_type", "n"), 281: ("x_src6", "b"), 282: ("x_dst6", "b"), 283: ("nat_pool", "n"), 302: ("selector_id", "n"), 315: ("inmon_frame", "b"),
    60: ("ip_version", "n"), 156: ("first_ms", "p"), 157: ("last_ms", "p"), 158: ("first_ms", "u"), 159: ("last_ms", "u"), 161: ("_duration", "n"), 171: ("out_bytes", "n"), 172: ("out_packets", "n"), 180: ("src_port", "n"), 181: ("dst_port", "n"), 182: ("src_port", "n"), 183: ("dst_port", "n"),
    192: ("min_ttl", "n"), 231: ("in_bytes", "n"), 232: ("out_bytes", "n"), 252: ("l2_ingress", "n"), 253: ("l2_egress", "n"), 278: ("cnt_flows", "n"), 298: ("in_packets", "n"), 299: ("out_packets", "n"), 312: ("frame_size", "n"), 408: ("link_type", "n"),
    33000: ("ingress_acl", "a"), 33001: ("egress_acl", "a"), 33002: ("fw_xevent", "n"), 40000: ("username", "t"), 40001: ("x_src4", "n"), 40002: ("x_dst4", "n"), 40003: ("x_src_port", "n"), 40004: ("x_dst_port", "n"), 40005: ("fw_event", "n"),
    57554: ("client_us", "+s"), 57555: ("client_us", "+"), 57556: ("server_us", "+s"), 57557: ("server_us", "+"), 57558: ("app_us", "+s"), 57559: ("app_us", "+"),
    323: ("_event_ms", "m"), 361: ("pb_start", "n"), 362: ("pb_end", "n"), 363: ("pb_step", "n"), 364: ("pb_size", "n"), 371: ("username", "t"),
}
MPLS_FIRST = 70  # elements 70..79 are the label stack
SAMPLER_ELEMENTS = {34: "packet_interval", 50: "packet_interval", 305: "packet_interval", 306: "space_interval", 35: "algorithm", 49: "algorithm", 304: "algorithm", 48: "id", 302: "id"}
REVERSE = {1: "out_bytes", 2: "out_packets", 85: "out_bytes", 86: "out_packets"}  # under the reverse enterprise number
REVERSE_PEN = 29305
# (enterprise number, element) -> the plain element it means (Cisco), or column and how to read (Nokia, CERT).
ENTERPRISE = {
    (9, 12236): 8, (9, 12237): 12, (9, 12241): 11, (9, 8337): 1, (9, 8338): 23, (637, 91): ("in_service_id", "n"), (637, 92): ("out_service_id", "n"), (637, 93): ("nat_string", "t"), (6871, 18): ("in_payload", "b"), (6871, 16402): ("out_payload", "b"),
}
NTP_UNIX_S = 2_208_988_800  # from 1900 to 1970
MAX_NESTING = 16


class TemplateDecoder:
    """Templates of one exporter and observation domain, and the samplers it told of."""

    def __init__(self, state: dict | None = None) -> None:
        self.templates: dict[int, list] = dict(state or {})
        self.samplers: dict[int, dict] = {}

    def packet(self, data: bytes, received_ms: int | None = None, exporter_id: int | None = None) -> list[dict]:
        try:
            return self._packet(data, received_ms, exporter_id)
        except (struct.error, IndexError):
            return []

    def _packet(self, data: bytes, received_ms: int | None, exporter_id: int | None) -> list[dict]:
        (version,) = struct.unpack_from(">H", data)
        if version == 9:
            _, _, uptime, secs, _, domain = struct.unpack_from(">HHIIII", data)
            at, end, ids = 20, len(data), (0, 1)
        elif version == 10:
            _, length, secs, _, domain = struct.unpack_from(">HHIII", data)
            at, end, ids, uptime = 16, min(length, len(data)), (2, 3), None
        else:
            return []
        base = {"nf_version": version, "received_ms": received_ms, "exporter_id": exporter_id, "obs_domain_id": domain}
        out: list[dict] = []
        while at + 4 <= end:
            kind, size = struct.unpack_from(">HH", data, at)
            if size < 4:
                break
            body = data[at + 4 : min(at + size, end)]
            at += size
            if kind == ids[0]:
                self._templates(body, version, False)
            elif kind == ids[1]:
                self._templates(body, version, True)
            elif kind > 255 and kind in self.templates:
                out += self._records(body, kind, base, secs, uptime)
        return out

    def _templates(self, b: bytes, version: int, options: bool) -> None:
        i = 0
        while i + 4 <= len(b):
            tid, n = struct.unpack_from(">HH", b, i)
            i += 4
            if tid < 256:
                break
            scope = 0
            if options and version == 9:
                scope, n = n // 4, n // 4 + struct.unpack_from(">H", b, i)[0] // 4
                i += 2
            elif options and n:
                (scope,) = struct.unpack_from(">H", b, i)
                i += 2
            if n == 0:  # withdrawn
                self.templates.pop(tid, None)
                continue
            fields = []
            for j in range(n):
                element, length = struct.unpack_from(">HH", b, i)
                i += 4
                pen = 0
                if version == 10 and element & 0x8000:
                    (pen,) = struct.unpack_from(">I", b, i)
                    i += 4
                    element &= 0x7FFF
                if options and j < scope and version == 9:
                    element = -1 - element  # scopes have numbers of their own
                fields.append((element, length, pen))
            self.templates[tid] = [options, fields]

    def _field(self, b: bytes, i: int, length: int) -> tuple[bytes, int]:
        if length == 0xFFFF:
            length, i = b[i], i + 1
            if length == 255:
                length, i = int.from_bytes(b[i : i + 2], "big"), i + 2
        if i + length > len(b):
            raise IndexError
        return b[i : i + length], i + length

    def _records(self, b: bytes, tid: int, base: dict, secs: int, uptime: int | None, depth: int = 0) -> list[dict]:
        options, fields = self.templates[tid]
        least = sum(1 if n == 0xFFFF else n for _, n, _ in fields)
        out, i = [], 0
        while least and i + least <= len(b):
            r, nested, tell = dict(base), [], {}
            for element, length, pen in fields:
                v, i = self._field(b, i, length)
                if element in (292, 293) and depth < MAX_NESTING:
                    nested += self._lists(v, element, base, secs, uptime, depth)
                elif options:
                    if element in SAMPLER_ELEMENTS:
                        tell[SAMPLER_ELEMENTS[element]] = int.from_bytes(v, "big")
                elif pen == REVERSE_PEN:
                    if element in REVERSE:
                        r[REVERSE[element]] = int.from_bytes(v, "big")
                elif not pen:
                    self._put(r, element, v, secs, uptime)
                elif (pen, element) in ENTERPRISE:
                    self._put(r, ENTERPRISE[pen, element], v, secs, uptime)
            if options:
                if tell:
                    self.samplers[tell.get("id", -1)] = tell
                continue
            self._finish(r)
            out.append(r)
            out += nested
        return out

    def _lists(self, v: bytes, element: int, base: dict, secs: int, uptime: int | None, depth: int) -> list[dict]:
        """subTemplateList and subTemplateMultiList: records of other templates inside a field."""
        out, i = [], 1
        if element == 292:
            (tid,) = struct.unpack_from(">H", v, 1)
            return self._records(v[3:], tid, base, secs, uptime, depth + 1) if tid in self.templates else []
        while i + 4 <= len(v):
            tid, size = struct.unpack_from(">HH", v, i)
            if size < 4:
                break
            if tid in self.templates:
                out += self._records(v[i + 4 : i + size], tid, base, secs, uptime, depth + 1)
            i += size
        return out

    def _put(self, r: dict, element: int | tuple[str, str], v: bytes, secs: int, uptime: int | None) -> None:
        if isinstance(element, tuple):
            self._set(r, *element, v, secs, uptime)
            return
        if MPLS_FIRST <= element < MPLS_FIRST + 10:
            stack = r.setdefault("mpls", [0] * 10)
            stack[element - MPLS_FIRST] = int.from_bytes(v, "big")
            return
        if element == 160:
            r["_boot"] = int.from_bytes(v, "big")
            return
        if element not in ELEMENTS:
            return
        if element == 148 and r.get("nf_version") == 9:
            self._set(r, "conn_id", "n", v, secs, uptime)
            return
        self._set(r, *ELEMENTS[element], v, secs, uptime)

    def _set(self, r: dict, name: str, how: str, v: bytes, secs: int, uptime: int | None) -> None:
        n = int.from_bytes(v, "big")
        if how == "b":
            r[name] = bytes(v)
        elif how == "t":
            r[name] = v.rstrip(b"\0").decode("utf-8", "replace")
        elif how == "s":
            r[name] = n * 1000
        elif how == "u":
            r["_far_" + name] = secs * 1000 - n // 1000
        elif how == "p":
            r["_ntp_" + name] = ((n >> 32) - NTP_UNIX_S) * 1000 + ((n & 0xFFFFFFFF) * 1000 >> 32) if n >> 32 >= NTP_UNIX_S else 0
        elif how in ("+", "+s"):
            r[name] = r.get(name, 0) + n * (1_000_000 if how == "+s" else 1)
        elif how == "a":
            r[name] = [int.from_bytes(v[i : i + 4], "big") for i in range(0, len(v), 4)]
        elif how == "r":
            if uptime is not None:
                r[name] = _absolute(secs * 1000, uptime, n)
            else:
                r["_rel_" + name] = n
        elif name not in ("selector_id", "obs_domain_id") or n:
            r[name] = n

    def _finish(self, r: dict) -> None:
        for name in ("first_ms", "last_ms"):
            rel = r.pop("_rel_" + name, None)
            if rel is not None and "_boot" in r:
                r[name] = r["_boot"] + rel
            for kind in ("_ntp_", "_far_"):
                t = r.pop(kind + name, None)
                if t is not None:
                    r.setdefault(name, t)
        r.pop("_boot", None)
        duration = r.pop("_duration", None)
        if duration and r.get("first_ms") and not r.get("last_ms"):
            r["last_ms"] = r["first_ms"] + duration
        kind, code = r.pop("_icmp_type", None), r.pop("_icmp_code", 0)
        if kind is not None:
            r["dst_port"] = kind << 8 | code
        event = r.pop("_event_ms", None)
        if event is not None:
            r["nat_event_ms" if "nat_event" in r else "nsel_event_ms"] = event
        s = self.samplers.get(r.get("selector_id", -1)) or self.samplers.get(-1)
        if s and s.get("packet_interval"):
            # with a space interval: so many packets of each p + space; the older form just says one of p
            p = s["packet_interval"]
            up, down = (p + s["space_interval"], p) if "space_interval" in s else (p, 1)
            for n in ("in_packets", "in_bytes", "out_packets", "out_bytes"):
                if n in r:
                    r[n] = r[n] * up // down


FLOW_COLUMNS = [c for c in COLUMNS if c != "rec_no"]
FLOW_SCHEMA = T.StructType([T.StructField(c, COLUMNS[c]) for c in FLOW_COLUMNS])


def rows_to_batch(rows: list[dict]) -> pa.RecordBatch:
    """Records to the flow schema; numbers that a column can't hold become NULL."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from decimal import Decimal

    schema = to_arrow_schema(FLOW_SCHEMA)
    limit = {pa.int16(): 2**15, pa.int32(): 2**31, pa.int64(): 2**63}

    def fit(v, f):
        if isinstance(v, int):
            if pa.types.is_decimal(f.type):
                return Decimal(v)
            return v if f.type in limit and -limit[f.type] <= v < limit[f.type] else None
        return v

    return pa.RecordBatch.from_arrays([pa.array([fit(r.get(f.name), f) for r in rows], type=f.type) for f in schema], schema=schema)


def decode_fixed_packets(packets: DataFrame) -> DataFrame:
    """Rows (exporter_id, received_ms, payload) of versions 1, 5 and 7 to flow records. Malformed packets give nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for e, t, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()) if p for r in decode_fixed(p, t, e)]
            if rows:
                yield rows_to_batch(rows)

    return packets.select("exporter_id", "received_ms", "payload").mapInArrow(run, FLOW_SCHEMA)


def _domain(payload):
    """Observation domain of a version 9 or 10 packet: the last four bytes of its header."""
    at = F.when(F.substring(payload, 1, 2) == F.lit(b"\x00\x09"), 17).otherwise(13)
    return F.substring(payload, at, F.lit(4))


CHUNK_MS = 300_000


def _template_sets(data: bytes) -> list[tuple[int, bytes, bool]]:
    """(template number, a packet that holds just this template, whether its records tell of samplers) for each template that a packet defines."""
    out: list[tuple[int, bytes, bool]] = []
    try:
        (version,) = struct.unpack_from(">H", data)
        at, ids = (20, (0, 1)) if version == 9 else (16, (2, 3))
        while at + 4 <= len(data):
            kind, size = struct.unpack_from(">HH", data, at)
            if size < 4:
                break
            if kind in ids:
                d = TemplateDecoder()
                d._templates(data[at + 4 : at + size], version, kind == ids[1])
                head = data[:20] if version == 9 else data[:2] + struct.pack(">H", 16 + size) + data[4:16]
                out += [(tid, head + data[at : at + size], options and any(e in SAMPLER_ELEMENTS for e, _, _ in fields)) for tid, (options, fields) in d.templates.items()]
            at += size
    except (struct.error, IndexError):
        pass
    return out


def _set_ids(data: bytes) -> set[int]:
    out, at = set(), 20 if data[:2] == b"\x00\x09" else 16
    while at + 4 <= len(data):
        kind, size = struct.unpack_from(">HH", data, at)
        if size < 4:
            break
        out.add(kind)
        at += size
    return out


# What is known of a stream: its templates (kind 0: id is the template's number, payload a packet that defines it) and samplers (kind 1:
# id is the sampler's, payload what was told of it as JSON). `at` and `seq` order definitions.
KNOWN = "exporter_id int, d string, kind int, id string, at long, seq long, payload binary, sampling boolean"
_BEFORE = -(2**62)  # chunk of what was known before the first one


def _stream_packets(packets: DataFrame) -> DataFrame:
    """Packets with their domain, order and chunk. One without an arrival time is placed by the time of its header."""
    v9 = F.substring("payload", 1, 2) == F.lit(b"\x00\x09")
    u32 = lambda nine, ten: F.coalesce(F.conv(F.hex(F.substring(F.col("payload"), F.when(v9, nine).otherwise(ten), F.lit(4))), 16, 10).cast("long"), F.lit(0).cast("long"))
    x = packets.where("payload is not null").select("exporter_id", "received_ms", "payload", F.hex(_domain(F.col("payload"))).alias("d"), F.coalesce("received_ms", u32(9, 5) * 1000).alias("at"), u32(13, 9).alias("seq"))
    return x.withColumn("chunk", F.floor(F.col("at") / CHUNK_MS))


def _same_stream(a: str, b: str):
    return F.col(f"{a}.exporter_id").eqNullSafe(F.col(f"{b}.exporter_id")) & (F.col(f"{a}.d") == F.col(f"{b}.d"))


def _carried(told: DataFrame, chunks: DataFrame) -> DataFrame:
    """What was told last of each id, copied to every later chunk of its stream up to the next that tells of it anew."""
    w = Window.partitionBy("exporter_id", "d", "kind", "id").orderBy("chunk")
    t = told.withColumn("next", F.lead("chunk").over(w)).alias("t")
    c = chunks.select("exporter_id", "d", "chunk").distinct().alias("c")
    later = (F.col("c.chunk") > F.col("t.chunk")) & (F.col("t.next").isNull() | (F.col("c.chunk") <= F.col("t.next")))
    return t.join(c, _same_stream("t", "c") & later).select("t.exporter_id", F.lit(None).cast("long").alias("received_ms"), "t.payload", "t.d", "t.at", "t.seq", "c.chunk", F.col("t.kind").alias("rank"))


_ORDER = ["exporter_id", "d", "chunk", "rank", "at", "seq"]  # copies come first, in the order of their definition


def _in_order(x: DataFrame) -> DataFrame:
    return x.repartition("exporter_id", "d", "chunk").sortWithinPartitions(*_ORDER)


def _told(x: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Templates and samplers by the chunk in which they were told last; `known` counts as told before the first."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(e, d, 0, str(tid), t, q, p, s) for e, data, d, t, q in zip(*(b.column(i).to_pylist() for i in range(5))) for tid, p, s in _template_sets(data)]
            if out:
                yield _known_batch(out)

    templates = x.select("exporter_id", "payload", "d", "at", "seq").mapInArrow(sets, KNOWN).withColumn("chunk", F.floor(F.col("at") / CHUNK_MS))
    last = lambda c: F.max_by(c, F.struct("at", "seq")).alias(c)
    templates = templates.groupBy("exporter_id", "d", "kind", "id", "chunk").agg(*[last(c) for c in ("at", "seq", "payload", "sampling")])
    if known is not None:
        templates = templates.unionByName(known.where("kind = 0").withColumn("chunk", F.lit(_BEFORE)))

    # only packets with option records of samplers, and those that define templates, are decoded for the samplers
    streams = templates.where("sampling").groupBy("exporter_id", "d").agg(F.collect_set("id").alias("ids"))
    some = x.alias("x").join(streams.alias("s"), _same_stream("x", "s")).select("x.*", "s.ids")

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [bool(k & ({0, 1, 2, 3} | {int(i) for i in ids})) for k, ids in ((_set_ids(p), ids) for p, ids in zip(b.column("payload").to_pylist(), b.column("ids").to_pylist()))]
            yield b.filter(pa.array(keep, pa.bool_())).drop_columns(["ids"])

    some = some.mapInArrow(telling, x.schema).withColumn("rank", F.lit(2))
    both = some.unionByName(_carried(templates, some))

    def samplers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, decoder, at = None, TemplateDecoder(), (0, 0)

        def rows() -> list[tuple]:
            return [(key[0], key[1], 1, str(i), *at, json.dumps(told).encode(), False) for i, told in decoder.samplers.items()]

        for b in batches:
            out: list[tuple] = []
            for e, d, c, p, t, q in zip(*(b.column(n).to_pylist() for n in ("exporter_id", "d", "chunk", "payload", "at", "seq"))):
                if (e, d, c) != key:
                    out += rows()
                    key, decoder = (e, d, c), TemplateDecoder()
                decoder.packet(p)
                at = (t, q)
            if out:
                yield _known_batch(out)
        if key and (out := rows()):
            yield _known_batch(out)

    told = _in_order(both).mapInArrow(samplers, KNOWN).withColumn("chunk", F.floor(F.col("at") / CHUNK_MS))
    if known is not None:
        told = told.unionByName(known.where("kind = 1").withColumn("chunk", F.lit(_BEFORE)))
    return templates, told


def _known_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names=[c.split()[0] for c in KNOWN.split(", ")])


def stream_state(packets: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Templates and samplers that are known after these packets (columns of KNOWN), from those known before."""
    templates, told = _told(_stream_packets(_templated(packets)), known)
    last = lambda c: F.max_by(c, F.struct("chunk", "at", "seq")).alias(c)
    return templates.unionByName(told).groupBy("exporter_id", "d", "kind", "id").agg(*[last(c) for c in ("at", "seq", "payload", "sampling")])


def decode_template_packets(packets: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows of version 9 and 10 to flow records, in order of arrival per exporter and domain, with the templates as state.

    A stream is decoded in chunks of CHUNK_MS, each with the templates and samplers known at its start, so that one exporter's packets
    spread over many tasks. Records whose template hasn't come yet are lost, as they are on the wire. `known` has what earlier packets
    of the streams told, see stream_state().
    """
    x = _stream_packets(packets)
    templates, told = _told(x, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, decoder = None, TemplateDecoder()
        for b in batches:
            rows: list[dict] = []
            for e, t, p, d, c, rank in zip(*(b.column(n).to_pylist() for n in ("exporter_id", "received_ms", "payload", "d", "chunk", "rank"))):
                if (e, d, c) != key:
                    key, decoder = (e, d, c), TemplateDecoder()
                if rank == 1:
                    tell = json.loads(p)
                    decoder.samplers[tell.get("id", -1)] = tell
                else:
                    rows += decoder.packet(p, t, e)
            if rows:
                yield rows_to_batch(rows)

    whole = x.withColumn("rank", F.lit(2)).unionByName(_carried(templates, x)).unionByName(_carried(told, x))
    return _in_order(whole).mapInArrow(run, FLOW_SCHEMA)


def _templated(packets: DataFrame) -> DataFrame:
    return packets.where(F.substring("payload", 1, 2).isin(b"\x00\x09", b"\x00\x0a"))


def decode_packets(packets: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Packets of any version, told apart by their first two bytes; for `known` see decode_template_packets()."""
    v = F.substring("payload", 1, 2)
    fixed = packets.where(v.isin(b"\x00\x01", b"\x00\x05", b"\x00\x07"))
    return decode_fixed_packets(fixed).unionByName(decode_template_packets(_templated(packets), known))


def encode_v5(rows: list[dict], sequence: int = 0, uptime: int = 3_600_000, unix_ms: int | None = None) -> bytes:
    """A version 5 packet of up to 30 flow records, for replay."""
    unix_ms = unix_ms if unix_ms is not None else max((r.get("last_ms") or 0 for r in rows), default=0)
    out = struct.pack(">HHIIIIBBH", 5, len(rows), uptime, unix_ms // 1000, unix_ms % 1000 * 1_000_000, sequence, 0, 0, 0)
    get = lambda r, n, bits: min(int(r.get(n) or 0), 2**bits - 1)
    for r in rows:
        first, last = ((uptime - (unix_ms - (r.get(n) or 0))) % 2**32 for n in ("first_ms", "last_ms"))
        out += struct.pack(
            ">IIIHHIIIIHHBBBBHHBBH", get(r, "src4", 32), get(r, "dst4", 32), get(r, "next4", 32), get(r, "input_if", 16), get(r, "output_if", 16), get(r, "in_packets", 32), get(r, "in_bytes", 32), first, last,
            get(r, "src_port", 16), get(r, "dst_port", 16), 0, get(r, "tcp_flags", 8), get(r, "proto", 8), get(r, "src_tos", 8), get(r, "src_as", 16), get(r, "dst_as", 16), get(r, "src_mask", 8), get(r, "dst_mask", 8), 0,
        )
    return out


_V9_COMMON = [(10, 4), (14, 4), (2, 8), (1, 8), (22, 4), (21, 4), (7, 2), (11, 2), (6, 1), (4, 1), (5, 1), (16, 4), (17, 4)]
# template id -> elements and their sizes: IPv4 and IPv6 flows
V9_TEMPLATES = {256: [(8, 4), (12, 4), (15, 4), *_V9_COMMON, (9, 1), (13, 1)], 257: [(27, 16), (28, 16), *_V9_COMMON, (29, 1), (30, 1)]}


def encode_v9(rows: list[dict], sequence: int = 0, uptime: int = 3_600_000, unix_ms: int | None = None, domain: int = 0, with_template: bool = True) -> bytes:
    """A version 9 packet with its templates and flow records of both families, for replay."""
    unix_ms = (unix_ms if unix_ms is not None else max((r.get("last_ms") or 0 for r in rows), default=0)) // 1000 * 1000
    of = {t: [r for r in rows if (r.get("src6") is not None) == (t == 257)] for t in V9_TEMPLATES}
    body, n = b"", len(rows)
    for t, elements in V9_TEMPLATES.items():
        if with_template and of[t]:
            x = struct.pack(">HH", t, len(elements)) + b"".join(struct.pack(">HH", *f) for f in elements)
            body += struct.pack(">HH", 0, 4 + len(x)) + x
            n += 1
    for t, elements in V9_TEMPLATES.items():
        data = b""
        for r in of[t]:
            for element, size in elements:
                name, how = ELEMENTS[element]
                v = r.get(name)
                if size == 16:
                    data += bytes(v or bytes(16))
                    continue
                v = (uptime - (unix_ms - int(v or 0))) % 2**32 if how == "r" else int(v or 0)
                data += min(v, 256**size - 1).to_bytes(size, "big")
        if data:
            data += bytes(-len(data) % 4)
            body += struct.pack(">HH", t, 4 + len(data)) + data
    return struct.pack(">HHIIII", 9, n, uptime, unix_ms // 1000, sequence, domain) + body


def to_packets(flows: DataFrame, version: int = 9, per_packet: int = 24) -> DataFrame:
    """Flows as exporter packets (exporter_id, received_ms, payload): versions 5 (IPv4 flows only; others are left out), 9, or 250 for native
    records. A task holds at most `per_packet` flows of each exporter; a packet was received when its last flow was."""
    encode = {5: encode_v5, 9: encode_v9, RAW_VERSION: encode_raw}[version]
    x = flows.select(*[c for c in FLOW_COLUMNS if c in flows.columns])
    if version == 5:
        x = x.where("src6 is null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int | None, list[dict]] = {}
        sent: dict[int | None, int] = {}

        def packed(ready: list) -> pa.RecordBatch:
            out = []
            for e, rows in ready:
                out.append((e, max((r["received_ms"] for r in rows if r.get("received_ms")), default=None), encode(rows, sent.get(e, 0))))
                sent[e] = sent.get(e, 0) + len(rows)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary()))], names=["exporter_id", "received_ms", "payload"])

        for b in batches:
            ready = []
            for r in b.to_pylist():
                rows = held.setdefault(r.get("exporter_id"), [])
                rows.append(r)
                if len(rows) == per_packet:
                    ready.append((r.get("exporter_id"), held.pop(r.get("exporter_id"))))
            if ready:
                yield packed(ready)
        if held:
            yield packed(list(held.items()))

    return x.mapInArrow(run, PACKET)


def replay(flows: DataFrame, host: str, port: int, version: int = 5, per_packet: int = 24, delay_s: float = 0.0, speed: float | None = None) -> None:
    """Sends flows as packets over UDP, each partition on its own: versions 5, 9, or 250 for native records.

    `delay_s` is a pause after each packet; with `speed` packets keep the distances of the flows' first times, divided by speed.
    """
    cols = [c for c in FLOW_COLUMNS if c in flows.columns]
    encode = {5: encode_v5, 9: encode_v9, RAW_VERSION: encode_raw}[version]
    if speed:
        flows = flows.sortWithinPartitions("first_ms")

    def send(rows) -> None:
        import socket
        import time

        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            held, sequence, began, zero = [], 0, time.monotonic(), None

            def flush() -> None:
                nonlocal zero
                if speed and held[0].get("first_ms"):
                    zero = zero or held[0]["first_ms"]
                    time.sleep(max(0.0, began + (held[0]["first_ms"] - zero) / 1000 / speed - time.monotonic()))
                s.sendto(encode(held, sequence), (host, port))
                if delay_s:
                    time.sleep(delay_s)

            for r in rows:
                held.append(r.asDict())
                if len(held) == per_packet:
                    flush()
                    sequence += len(held)
                    held = []
            if held:
                flush()

    flows.select(*cols).foreachPartition(send)




# --- other carriers of the same records

RAW_VERSION = 250


def decode_raw(packet: bytes, received_ms: int | None = None) -> list[dict]:
    """Native packets: a header of 12 bytes (version, length, number of records, sequence), then records as they are in flow files."""
    from freshet.sources.flowfile import FLOW_RECORD, Corrupt, decode_record

    if len(packet) < 12:
        return []
    version, _, n = struct.unpack_from(">HHI", packet)
    out, i = [], 12
    while version == RAW_VERSION and len(out) < n and i + 4 <= len(packet):
        kind, size = struct.unpack_from("<HH", packet, i)
        if size < 4 or i + size > len(packet):
            break
        if kind == FLOW_RECORD:
            try:
                r = decode_record(packet, i, size)
            except (Corrupt, struct.error):
                break
            out.append(r | {"received_ms": r.get("received_ms") or received_ms})
        i += size
    return out


def encode_raw(rows: list[dict], sequence: int = 0) -> bytes:
    from freshet.sources.flowfile import encode_record

    body = b"".join(encode_record(r) for r in rows)
    return struct.pack(">HHII", RAW_VERSION, 12 + len(body), len(rows), sequence) + body


def decode_raw_packets(packets: DataFrame) -> DataFrame:
    """Rows (exporter_id, received_ms, payload) of native packets to flow records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for t, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist()) if p for r in decode_raw(p, t)]
            if rows:
                yield rows_to_batch(rows)

    return packets.select("exporter_id", "received_ms", "payload").mapInArrow(run, FLOW_SCHEMA)


def captured_packets(packets: DataFrame, port: int | None = None) -> DataFrame:
    """Exporter packets out of a capture (see pcap.packets): the UDP payloads, all or those to one port; IPv4 senders are the exporters."""
    x = packets.where("proto = 17 and payload is not null and frag_offset = 0")
    if port is not None:
        x = x.where(F.col("dst_port") == port)
    # addresses above 2^31 don't fit the id as they are
    sender = F.when(F.col("src4") >= 2**31, F.col("src4") - 2**32).otherwise(F.col("src4")).cast("int")
    return x.select(sender.alias("exporter_id"), F.floor(F.col("ts_us") / 1000).alias("received_ms"), "payload")


def read_ipfix_files(spark, path: str) -> DataFrame:
    """Files of IPFIX messages one after the other, as meters write them: each file is decoded in order, with its own templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                decoders: dict[int, TemplateDecoder] = {}
                i, rows = 0, []
                while i + 16 <= len(data):
                    version, size, _, _, domain = struct.unpack_from(">HHIII", data, i)
                    if version != 10 or size < 16:
                        break
                    rows += decoders.setdefault(domain, TemplateDecoder()).packet(data[i : i + size])
                    i += size
                    if len(rows) >= 5000:
                        yield rows_to_batch(rows)
                        rows = []
                if rows:
                    yield rows_to_batch(rows)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content").mapInArrow(run, FLOW_SCHEMA)


# Option records that name things: kind, element of the number, element of the name.
NAMES = {"interface": ((10, 14, 252), (82, 83)), "application": ((95,), (96,)), "vrf": ((234, 235), (236,))}


def decode_names(packets: DataFrame) -> DataFrame:
    """(exporter_id, kind, id, name) from the option records of version 9 and IPFIX packets; numbers of applications as hex."""
    schema = "exporter_id int, kind string, id string, name string"

    class Names(TemplateDecoder):
        def __init__(self) -> None:
            super().__init__()
            self.found: list[tuple] = []

        def _records(self, b, tid, base, secs, uptime, depth=0):
            options, fields = self.templates[tid]
            if not options:
                return []
            i = 0
            least = sum(1 if n == 0xFFFF else n for _, n, _ in fields)
            while least and i + least <= len(b):
                got = {}
                for element, length, _ in fields:
                    v, i = self._field(b, i, length)
                    got[element if element >= 0 else {1: 252, 2: 10}.get(-1 - element, element)] = v
                for kind, (ids, names) in NAMES.items():
                    number, name = next((got[e] for e in ids if e in got), None), next((got[e] for e in names if e in got), None)
                    if number is not None and name is not None:
                        text = number.hex() if kind == "application" else str(int.from_bytes(number, "big"))
                        self.found.append((kind, text, name.split(b"\0")[0].decode("utf-8", "replace")))
            return []

    x = packets.select("exporter_id", "received_ms", "payload", F.hex(_domain(F.col("payload"))).alias("d")).where("payload is not null")

    def option_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for e, p, d in zip(*(b.column(n).to_pylist() for n in ("exporter_id", "payload", "d"))):
                if _set_ids(p) & {1, 3}:
                    decoder = TemplateDecoder()
                    decoder.packet(p)
                    out += [(e, d, i) for i, (options, _) in decoder.templates.items() if options]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.string(), pa.int32()))], names=["exporter_id", "d", "id"])

    # Of a stream's packets only those go on that define or hold option records: few, however many flows the exporter sends.
    streams = x.mapInArrow(option_ids, "exporter_id int, d string, id int").groupBy("exporter_id", "d").agg(F.collect_set("id").alias("ids"))

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [bool(_set_ids(p) & {1, 3, *ids}) for p, ids in zip(b.column("payload").to_pylist(), b.column("ids").to_pylist())]
            yield b.filter(pa.array(keep, pa.bool_())).drop_columns(["ids"])

    # a row for each exporter and domain that sends options, whatever the number of packets
    x = x.alias("x").join(F.broadcast(streams).alias("s"), _same_stream("x", "s")).select("x.*", "s.ids").mapInArrow(telling, x.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, decoder = None, Names()
        for b in batches:
            out: list[tuple] = []
            for e, t, p, d in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (e, d) != key:
                    key, decoder = (e, d), Names()
                decoder.packet(p, t, e)
                out += [(e, *f) for f in decoder.found]
                decoder.found = []
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.string()) for c in cols[1:]]], names=["exporter_id", "kind", "id", "name"])

    return x.repartition("exporter_id", "d").sortWithinPartitions("exporter_id", "d", "received_ms").mapInArrow(run, schema).distinct()


def packet_sequences(packets: DataFrame) -> DataFrame:
    """(exporter_id, received_ms, sequence, n_flows) of version 5 and 7 packets, for summary.sequence_gaps(): their sequence counts flows."""
    u = lambda at, n: F.conv(F.hex(F.substring("payload", at, n)), 16, 10).cast("long")
    x = packets.where(F.substring("payload", 1, 2).isin(b"\x00\x05", b"\x00\x07"))
    return x.select("exporter_id", "received_ms", u(17, 4).alias("sequence"), u(3, 2).alias("n_flows"))

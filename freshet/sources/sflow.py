"""sFlow datagrams (versions 2, 4 and 5) to flow records: one record per flow sample, scaled by its sampling rate."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from freshet.sources.netflow import FLOW_SCHEMA, rows_to_batch
from freshet.sources.pcap import ETHERNET, RAW, decode

# Bytes of the counter blocks of versions 2 and 4 by their number; all but that of a VLAN begin with the 88 of an interface.
_COUNTERS = {1: 88, 2: 88 + 52, 3: 88 + 72, 4: 88, 5: 88 + 80, 6: 88, 7: 28}
# Protocol numbers of sampled headers that are understood.
_LINK = {1: ETHERNET, 11: RAW[0], 12: RAW[0]}


class _Xdr:
    def __init__(self, b: bytes, at: int = 0) -> None:
        self.b, self.i = b, at

    def u(self) -> int:
        (v,) = struct.unpack_from(">I", self.b, self.i)
        self.i += 4
        return v

    def opaque(self, n: int) -> bytes:
        if self.i + n > len(self.b):
            raise IndexError
        v = self.b[self.i : self.i + n]
        self.i += (n + 3) // 4 * 4
        return v

    def address(self) -> dict:
        kind = self.u()
        if kind == 1:
            return {"4": self.u()}
        if kind == 2:
            return {"6": self.opaque(16)}
        return {}


def datagram(b: bytes, received_ms: int | None = None, exporter_id: int | None = None) -> list[dict]:
    """Records of the flow samples; a malformed datagram gives those before the fault. Counter samples are read over."""
    out: list[dict] = []
    try:
        x = _Xdr(b)
        version = x.u()
        agent = x.address()
        if version == 5:
            x.u()
        elif version not in (2, 4):
            return []
        _, _, samples = x.u(), x.u(), x.u()
        base = {"received_ms": received_ms, "first_ms": received_ms, "last_ms": received_ms, "exporter_id": exporter_id, "nf_version": 9, "router4": agent.get("4"), "router6": agent.get("6")}
        for _ in range(samples):
            kind = x.u()
            if version == 5:
                size = x.u()
                end = x.i + size
                if kind in (1, 3):
                    out.append(base | _sample5(_Xdr(b[:end], x.i), expanded=kind == 3))
                x.i = end
            elif kind == 1:
                out.append(base | _sample_old(x, version))
            elif kind == 2:
                _counters_old(x)
            else:
                break  # what follows can't be placed
    except (struct.error, IndexError):
        pass
    return out


def _sample5(x: _Xdr, expanded: bool) -> dict:
    x.u()
    if expanded:
        x.u()
    x.u()
    rate = x.u()
    x.u(), x.u()
    if expanded:
        _, inp, _, outp = x.u(), x.u(), x.u(), x.u()
    else:
        inp, outp = x.u(), x.u()
    r = {"input_if": inp & 0x3FFFFFFF, "output_if": outp & 0x3FFFFFFF, "in_packets": rate, "in_bytes": 0}
    for _ in range(x.u()):
        kind, size = x.u(), x.u()
        end = x.i + size
        _record5(kind, _Xdr(x.b[:end], x.i), r, rate)
        x.i = end
    return r


def _record5(kind: int, x: _Xdr, r: dict, rate: int) -> None:
    if kind == 1:
        link, length, _ = x.u(), x.u(), x.u()
        _header(link, x.opaque(x.u()), length, r, rate)
    elif kind == 2:
        length = x.u()
        r["in_src_mac"], r["out_dst_mac"] = int.from_bytes(x.opaque(6), "big"), int.from_bytes(x.opaque(6), "big")
        r["in_bytes"] = rate * length
    elif kind in (3, 4):
        length, r["proto"] = x.u(), x.u()
        for side in ("src", "dst"):
            r[side + ("4" if kind == 3 else "6")] = x.u() if kind == 3 else x.opaque(16)
        r["src_port"], r["dst_port"], r["tcp_flags"], r["src_tos"] = x.u(), x.u(), x.u(), x.u()
        r["in_bytes"] = rate * length
    elif kind == 1001:
        r["src_vlan"], _, r["dst_vlan"] = x.u(), x.u(), x.u()
    elif kind == 1002:
        hop = x.address()
        r["next4"], r["next6"] = hop.get("4"), hop.get("6")
        r["src_mask"], r["dst_mask"] = x.u(), x.u()
    elif kind == 1003:
        hop = x.address()
        r["bgp_next4"], r["bgp_next6"] = hop.get("4"), hop.get("6")
        x.u()
        r["src_as"], r["prev_as"] = x.u(), x.u()
        path: list[int] = []
        for _ in range(x.u()):
            x.u()
            path += [x.u() for _ in range(x.u())]
        if path:
            r["next_as"], r["dst_as"] = path[0], path[-1]


def _header(link: int, data: bytes, length: int, r: dict, rate: int) -> None:
    r["in_bytes"] = rate * length
    p = decode(0, _LINK.get(link, -1), data)
    if not p:
        return
    for name in ("src4", "dst4", "src6", "dst6", "src_port", "dst_port", "proto", "tcp_flags", "tun_src4", "tun_dst4", "tun_proto"):
        if p.get(name) is not None:
            r[name] = p[name]
    if p.get("frag_offset"):
        r["src_port"] = r["dst_port"] = 0
    r["src_tos"], r["min_ttl"], r["max_ttl"] = p.get("tos"), p.get("ttl"), p.get("ttl")
    if "src_mac" in p:
        r["in_src_mac"], r["out_dst_mac"] = p["src_mac"], p["dst_mac"]
    if "vlan" in p:
        r.setdefault("src_vlan", p["vlan"])


def _sample_old(x: _Xdr, version: int) -> dict:
    x.u(), x.u()
    rate = x.u()
    x.u(), x.u()
    r = {"input_if": x.u(), "output_if": x.u(), "in_packets": rate, "in_bytes": 0}
    kind = x.u()
    if kind == 1:
        link, length = x.u(), x.u()
        _header(link, x.opaque(x.u()), length, r, rate)
    elif kind in (2, 3):
        length, r["proto"] = x.u(), x.u()
        for side in ("src", "dst"):
            r[side + ("4" if kind == 2 else "6")] = x.u() if kind == 2 else x.opaque(16)
        r["src_port"], r["dst_port"], r["tcp_flags"], r["src_tos"] = x.u(), x.u(), x.u(), x.u()
        r["in_bytes"] = rate * length
    for _ in range(x.u()):
        ext = x.u()
        if ext == 1:
            r["src_vlan"], _, r["dst_vlan"], _ = x.u(), x.u(), x.u(), x.u()
        elif ext == 2:
            hop = x.address()
            r["next4"], r["next6"], r["src_mask"], r["dst_mask"] = hop.get("4"), hop.get("6"), x.u(), x.u()
        elif ext == 3:
            x.u()
            r["src_as"], r["prev_as"] = x.u(), x.u()
            path: list[int] = []
            for _ in range(x.u()):
                if version == 2:  # a plain list of numbers; version 4 has segments
                    path.append(x.u())
                    continue
                x.u()
                path += [x.u() for _ in range(x.u())]
            if path:
                r["next_as"], r["dst_as"] = path[0], path[-1]
            if version == 4:
                for _ in range(x.u()):
                    x.u()
                x.u()
        elif ext == 4:  # source and destination user
            x.opaque(x.u()), x.opaque(x.u())
        elif ext == 5:  # direction, URL
            x.u(), x.opaque(x.u())
        else:
            raise IndexError  # what follows can't be placed
    return r


def _counters_old(x: _Xdr) -> None:
    """Reads over a counter sample: sequence, source, interval, number of the block, block."""
    x.u(), x.u(), x.u()
    block = x.u()
    if block not in _COUNTERS:
        raise IndexError  # what follows can't be placed
    x.opaque(_COUNTERS[block])


def decode_datagrams(packets: DataFrame) -> DataFrame:
    """Rows (exporter_id, received_ms, payload) to flow records; each datagram decodes on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for e, t, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()) if p for r in datagram(p, t, e)]
            if rows:
                yield rows_to_batch(rows)

    return packets.select("exporter_id", "received_ms", "payload").mapInArrow(run, FLOW_SCHEMA)

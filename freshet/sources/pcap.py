"""Packet captures: files to packets, packets to flows.

packets() reads capture files (micro- and nanosecond, either byte order, gzipped or not) with the binaryFile source and decodes link,
IP and transport headers. flows() assembles packets into flow records: packets are sorted by flow key and time within each task, and
one pass over the sorted stream closes flows on FIN or RST, on the inactive and on the active timeout. The pass keeps one flow at a
time, whatever the number of packets of a key.
"""

from __future__ import annotations

import gzip
import struct
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKETS = T.StructType(
    [
        T.StructField("ts_us", T.LongType()), T.StructField("src4", T.LongType()), T.StructField("dst4", T.LongType()), T.StructField("src6", T.BinaryType()), T.StructField("dst6", T.BinaryType()),
        T.StructField("src_port", T.IntegerType()), T.StructField("dst_port", T.IntegerType()), T.StructField("proto", T.ShortType()), T.StructField("tcp_flags", T.ShortType()), T.StructField("bytes", T.LongType()),
        T.StructField("ttl", T.ShortType()), T.StructField("tos", T.ShortType()), T.StructField("vlan", T.IntegerType()), T.StructField("frag_id", T.LongType()), T.StructField("frag_offset", T.IntegerType()), T.StructField("more_frags", T.BooleanType()),
        T.StructField("tun_src4", T.LongType()), T.StructField("tun_dst4", T.LongType()), T.StructField("tun_proto", T.LongType()), T.StructField("src_mac", T.LongType()), T.StructField("dst_mac", T.LongType()), T.StructField("payload", T.BinaryType()),
    ]
)
MAX_STEPS = 32
UNREADABLE = (ValueError, OSError, EOFError, struct.error, zlib.error)
# Link types.
ETHERNET, PPP, RAW, LOOP, LINUX_SLL, NULL = 1, 9, (12, 14, 101), 108, 113, 0


def read_capture(data: bytes) -> Iterator[tuple[int, int, bytes, int]]:
    """(microseconds, link type, captured bytes, length on the wire) of each packet; a file cut short ends with its last whole one."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    kinds = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
    if data[:4] not in kinds or len(data) < 24:
        raise ValueError("not a capture file")
    order, per_us = kinds[data[:4]]
    link = struct.unpack_from(order + "I", data, 20)[0] & 0xFFFF
    i, head = 24, struct.Struct(order + "IIII")
    while i + 16 <= len(data):
        secs, frac, size, wire = head.unpack_from(data, i)
        i += 16
        if i + size > len(data):
            return
        yield secs * 1_000_000 + frac // per_us, link, data[i : i + size], wire
        i += size


def decode(ts_us: int, link: int, b: bytes) -> dict | None:
    """Headers of one packet down to TCP, UDP or ICMP, through tags, labels and IP tunnels; None if it is no IP packet."""
    try:
        return _decode(ts_us, link, b)
    except (struct.error, IndexError):
        return None


def _decode(ts_us: int, link: int, b: bytes) -> dict | None:
    r: dict = {"ts_us": ts_us}
    i = 0
    if link == ETHERNET:
        r["dst_mac"], r["src_mac"] = int.from_bytes(b[:6], "big"), int.from_bytes(b[6:12], "big")
        (kind,) = struct.unpack_from(">H", b, 12)
        i = 14
    elif link == LINUX_SLL:
        (kind,) = struct.unpack_from(">H", b, 14)
        i = 16
    elif link == PPP:
        kind, i = {0x0021: 0x0800, 0x0057: 0x86DD}.get(struct.unpack_from(">H", b, 2)[0], 0), 4
    elif link in RAW:
        kind = 0x0800 if b[0] >> 4 == 4 else 0x86DD
    elif link in (NULL, LOOP):
        i = 4
        kind = 0x0800 if b[4] >> 4 == 4 else 0x86DD
    else:
        return None
    for _ in range(MAX_STEPS):
        if kind in (0x8100, 0x88A8, 0x9100):
            tag, kind = struct.unpack_from(">HH", b, i)
            r.setdefault("vlan", tag & 0xFFF)
            i += 4
        elif kind == 0x8847:
            while not b[i + 2] & 1:
                i += 4
            i += 4
            kind = 0x0800 if b[i] >> 4 == 4 else 0x86DD
        elif kind == 0x8864:
            kind, i = {0x0021: 0x0800, 0x0057: 0x86DD}.get(struct.unpack_from(">H", b, i + 6)[0], 0), i + 8
        else:
            break
    if kind not in (0x0800, 0x86DD):
        return None
    for _ in range(MAX_STEPS):
        inner = _network(b, i, r)
        if inner is None:
            return r
        i, proto = inner
        if proto in (4, 41) or (proto == 47 and struct.unpack_from(">H", b, i + 2)[0] in (0x0800, 0x86DD)):
            if proto == 47:
                flags = struct.unpack_from(">H", b, i)[0]
                i += 4 + 4 * (bool(flags & 0x8000) + bool(flags & 0x2000) + bool(flags & 0x1000))
            r["tun_src4"], r["tun_dst4"], r["tun_proto"] = r.pop("src4", None), r.pop("dst4", None), proto
            for k in ("src6", "dst6"):
                r.pop(k, None)
            continue
        _transport(b, i, proto, r)
        return r
    return None


def _network(b: bytes, i: int, r: dict) -> tuple[int, int] | None:
    """Reads an IP header; (place, protocol) of what it carries, None if there is nothing more to decode (later fragments)."""
    if b[i] >> 4 == 4:
        r["tos"], size, r["frag_id"], frag, r["ttl"], proto = b[i + 1], *struct.unpack_from(">HHH", b, i + 2), b[i + 8], b[i + 9]
        r["src4"], r["dst4"] = struct.unpack_from(">II", b, i + 12)
        r["bytes"] = r.get("bytes", size)
        r["frag_offset"], r["more_frags"], r["proto"] = (frag & 0x1FFF) * 8, bool(frag & 0x2000), proto
        r["src_port"] = r["dst_port"] = 0
        head = i + (b[i] & 15) * 4
        if r["frag_offset"]:
            r["payload"] = b[head : i + size]
            return None
        return head, proto
    if b[i] >> 4 != 6:
        raise IndexError
    (word, size), proto, r["ttl"] = struct.unpack_from(">IH", b, i), b[i + 6], b[i + 7]
    r["tos"], r["bytes"] = word >> 20 & 0xFF, r.get("bytes", size + 40)
    r["src6"], r["dst6"] = b[i + 8 : i + 24], b[i + 24 : i + 40]
    if len(r["dst6"]) < 16:
        raise IndexError
    i += 40
    r["frag_offset"], r["more_frags"], r["src_port"], r["dst_port"] = 0, False, 0, 0
    for _ in range(MAX_STEPS):
        if proto in (0, 43, 60, 135):
            proto, i = b[i], i + (b[i + 1] + 1) * 8
        elif proto == 51:
            proto, i = b[i], i + (b[i + 1] + 2) * 4
        elif proto == 44:
            (off, r["frag_id"]), nxt = struct.unpack_from(">HI", b, i + 2), b[i]
            r["frag_offset"], r["more_frags"] = off & 0xFFF8, bool(off & 1)
            proto, i = nxt, i + 8
            if r["frag_offset"]:
                r["proto"], r["payload"] = proto, b[i:]
                return None
        else:
            break
    r["proto"] = proto
    return i, proto


def _transport(b: bytes, i: int, proto: int, r: dict) -> None:
    if proto in (6, 17, 132, 136):
        r["src_port"], r["dst_port"] = struct.unpack_from(">HH", b, i)
    if proto == 6:
        r["tcp_flags"] = b[i + 13]
        r["payload"] = b[i + (b[i + 12] >> 4) * 4 :] or None
    elif proto == 17:
        r["payload"] = b[i + 8 :] or None
    elif proto in (1, 58):
        r["dst_port"] = b[i] << 8 | b[i + 1]


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], type=f.type) for f in schema], schema=schema)


def packets(spark: SparkSession, path: str) -> DataFrame:
    """All IP packets of the capture files at `path`. A file is one task; other packets give nothing. A file that is no capture,
    or whose packing is broken, is named in the worker's log; unreadable() lists such files."""
    schema = _arrow(PACKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows: list[dict] = []
                try:
                    for ts, link, data, _ in read_capture(content):
                        r = decode(ts, link, data)
                        if r:
                            rows.append(r)
                        if len(rows) == 10_000:
                            yield _rows(rows, schema)
                            rows = []
                except UNREADABLE as e:
                    print(f"{name}: not read to its end: {e}", file=sys.stderr)
                if rows:
                    yield _rows(rows, schema)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content", "path").mapInArrow(run, PACKETS)


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """path, packets (records that could be read) and error of each file at `path` that packets() can't read to its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = 0
                try:
                    for _ in read_capture(content):
                        n += 1
                except UNREADABLE as e:
                    yield pa.RecordBatch.from_pydict({"path": [name], "packets": pa.array([n], pa.int64()), "error": [str(e)]})

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content", "path").mapInArrow(run, "path string, packets long, error string")


def _whole(parts: list[dict], timeout_us: int) -> dict | None:
    """One packet of a datagram's fragments, None if one is missing, they overlap, or the last came too late."""
    parts = sorted({r["frag_offset"]: r for r in reversed(parts)}.values(), key=lambda r: r["frag_offset"])
    first, rest = parts[0], parts[1:]
    if first["frag_offset"] or not rest or parts[-1]["more_frags"] or max(r["ts_us"] for r in parts) - min(r["ts_us"] for r in parts) > timeout_us:
        return None
    head = rest[0]["frag_offset"] - len(first["payload"] or b"")  # the transport header, which the first fragment's payload lacks
    at = rest[0]["frag_offset"]
    for r in rest:
        if r["frag_offset"] != at or r["payload"] is None:
            return None
        at += len(r["payload"])
    if not 0 <= head <= 60:
        return None
    return first | {"payload": b"".join([first["payload"] or b"", *(r["payload"] for r in rest)]), "bytes": sum(r["bytes"] or 0 for r in parts), "more_frags": False, "frag_offset": 0}


def reassembled(p: DataFrame, timeout_us: int = 10_000_000) -> DataFrame:
    """Packets with the fragments of a datagram (addresses, protocol, fragment id) put together, so that payload terms see it whole: the
    first fragment's packet with the payload of all and the sum of their bytes. Datagrams of which a part is missing, or came later than
    the timeout, stay in fragments. Only fragments are shuffled; a task holds one datagram at a time, at most 64 kB in 8 byte steps.
    """
    schema = _arrow(T.StructType([p.schema[c] for c in p.columns]))
    key = ["src4", "src6", "dst4", "dst6", "proto", "frag_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def close() -> list[dict]:
            one = _whole(parts, timeout_us) if parts else None
            return [one] if one else parts

        for b in batches:
            out: list[dict] = []
            for r in b.to_pylist():
                k = tuple(r[c] for c in key)
                # an id comes again: what is complete goes before a new first fragment, and nothing waits beyond the timeout
                if k != now or (parts and (r["ts_us"] - parts[0]["ts_us"] > timeout_us or len(parts) >= 8192 or (r["frag_offset"] == 0 and _whole(parts, timeout_us)))):
                    out += close()
                    now, parts = k, []
                parts.append(r)
            if out:
                yield _rows(out, schema)
        if parts:
            yield _rows(close(), schema)

    is_part = F.coalesce((F.col("frag_offset") > 0) | F.col("more_frags"), F.lit(False))
    made = p.where(is_part).repartition(*key).sortWithinPartitions(*key, "ts_us").mapInArrow(run, p.schema)
    return p.where(~is_part).unionByName(made)


def with_fragment_ports(p: DataFrame, timeout_us: int = 10_000_000) -> DataFrame:
    """Gives later fragments the ports of the first one of the same datagram (addresses, protocol, fragment id) within the timeout."""
    first = p.where("more_frags and frag_offset = 0").select(
        F.coalesce(F.col("src4").cast("string"), F.hex("src6")).alias("_s"), F.coalesce(F.col("dst4").cast("string"), F.hex("dst6")).alias("_d"), F.col("proto").alias("_p"), F.col("frag_id").alias("_f"),
        F.col("ts_us").alias("_t"), F.col("src_port").alias("_sp"), F.col("dst_port").alias("_dp"),
    )
    slot = F.floor(F.col("_t") / timeout_us)
    first = first.withColumn("_slot", F.explode(F.array(slot, slot + 1)))  # a datagram may go on in the next slot
    heads = first.groupBy("_s", "_d", "_p", "_f", "_slot").agg(F.max_by(F.struct("_sp", "_dp"), "_t").alias("_ports"))
    same = (F.coalesce(F.col("src4").cast("string"), F.hex("src6")) == F.col("_s")) & (F.coalesce(F.col("dst4").cast("string"), F.hex("dst6")) == F.col("_d")) & (F.col("proto") == F.col("_p")) & (F.col("frag_id") == F.col("_f")) & (F.floor(F.col("ts_us") / timeout_us) == F.col("_slot"))
    tail = p.where("frag_offset > 0").join(heads, same, "left")
    fixed = tail.select(*[F.coalesce(F.col("_ports._sp"), F.col("src_port")).alias(c) if c == "src_port" else F.coalesce(F.col("_ports._dp"), F.col("dst_port")).alias(c) if c == "dst_port" else F.col(c) for c in p.columns])
    return p.where("frag_offset = 0 or frag_offset is null").unionByName(fixed)


def without_repeats(p: DataFrame, window_us: int = 1000) -> DataFrame:
    """Drops a packet that equals one at most `window_us` before it in everything but its time."""
    from pyspark.sql import Window

    same = F.xxhash64(*[c for c in p.columns if c != "ts_us"])
    w = Window.partitionBy("_h").orderBy("ts_us")
    x = p.withColumn("_h", same).withColumn("_prev", F.lag("ts_us").over(w))
    return x.where(F.col("_prev").isNull() | (F.col("ts_us") - F.col("_prev") > window_us)).drop("_h", "_prev")


KEY = ["src4", "dst4", "src6", "dst6", "src_port", "dst_port", "proto"]
FLOWS = T.StructType(
    [
        *[PACKETS[k] for k in KEY], T.StructField("first_ms", T.LongType()), T.StructField("last_ms", T.LongType()), T.StructField("in_packets", T.LongType()), T.StructField("in_bytes", T.LongType()), T.StructField("tcp_flags", T.ShortType()),
        T.StructField("src_tos", T.ShortType()), T.StructField("min_ttl", T.ShortType()), T.StructField("max_ttl", T.ShortType()), T.StructField("src_vlan", T.LongType()), T.StructField("in_payload", T.BinaryType()),
        T.StructField("client_us", T.LongType()), T.StructField("server_us", T.LongType()), T.StructField("app_us", T.LongType()),
    ]
)


def single_packet() -> Column:
    """Packets that are flows of their own: DNS over UDP, and ICMP."""
    return ((F.col("proto") == 17) & ((F.col("src_port") == 53) | (F.col("dst_port") == 53))) | F.col("proto").isin(1, 58)


class Assembler:
    """Flows of one pair of end points. Packets come in order of time; both directions are open at once, for the latencies."""

    def __init__(self, active_us: int, inactive_us: int) -> None:
        self.active, self.inactive, self.open, self.ready = active_us, inactive_us, {}, []

    def expire(self, now: int) -> None:
        for k, f in list(self.open.items()):
            if now > min(f["last"] + self.inactive, f["first"] + self.active):
                self.ready.append(self.open.pop(k))

    def packet(self, p: dict) -> None:
        now = p["ts_us"]
        self.expire(now)
        way = tuple(p[k] for k in KEY)
        back = (way[1], way[0], way[3], way[2], way[5], way[4], way[6])
        f, other = self.open.get(way), self.open.get(back)
        flags = p["tcp_flags"] or 0
        if f is None:
            f = {**{k: p[k] for k in KEY}, "first": now, "last": now, "n": 0, "b": 0, "flags": 0, "tos": p["tos"], "lo": p["ttl"], "hi": p["ttl"], "vlan": p["vlan"], "payload": None, "step": 0, "client": None, "server": None, "app": None}
            self.open[way] = f
            if other is not None and p["proto"] == 6:
                f["server"] = other["server"] = now - other["first"]
                f["step"], other["step"] = 2, 1
        elif f["step"] == 1 and other is not None:
            f["client"] = other["client"] = now - other["last"]
            f["step"] = 0
        elif f["step"] == 2 and other is not None:
            f["app"] = other["app"] = now - other["last"]
            f["step"] = other["step"] = 0
        f["last"], f["n"], f["b"], f["flags"] = now, f["n"] + 1, f["b"] + (p["bytes"] or 0), f["flags"] | flags
        if p["ttl"] is not None:
            f["lo"], f["hi"] = min(f["lo"] if f["lo"] is not None else 255, p["ttl"]), max(f["hi"] or 0, p["ttl"])
        if f["payload"] is None and p["payload"]:
            f["payload"] = p["payload"]
        if p["proto"] == 6 and flags & 5:
            self.ready.append(self.open.pop(way))

    def flush(self) -> None:
        self.ready += self.open.values()
        self.open = {}

    def take(self) -> list[dict]:
        out = [
            {**{k: f[k] for k in KEY}, "first_ms": f["first"] // 1000, "last_ms": f["last"] // 1000, "in_packets": f["n"], "in_bytes": f["b"], "tcp_flags": f["flags"], "src_tos": f["tos"], "min_ttl": f["lo"], "max_ttl": f["hi"], "src_vlan": f["vlan"], "in_payload": f["payload"], "client_us": f["client"], "server_us": f["server"], "app_us": f["app"]}
            for f in self.ready
        ]
        self.ready = []
        return out


def _pair() -> Column:
    """The same for both directions of a conversation."""
    end = lambda side: F.struct(*[F.col(f"{side}{n}").alias(n) for n in ("4", "6", "_port")])
    a, b = end("src"), end("dst")
    return F.xxhash64(F.least(a, b), F.greatest(a, b), "proto")


def flows(p: DataFrame, active_s: int = 300, inactive_s: int = 60) -> DataFrame:
    """Flow records of packets: a flow ends with FIN or RST, after `inactive_s` without a packet, or `active_s` after its first packet.

    DNS and ICMP packets are single-packet flows, made without a shuffle. The latencies come from the first packets of both directions
    of a TCP connection. Packets without a time or protocol are left out.
    """
    p = p.where("ts_us is not null and proto is not null")
    ms = F.floor(F.col("ts_us") / 1000)
    none = F.lit(None).cast("long")
    alone = p.where(single_packet()).select(
        *KEY, ms.alias("first_ms"), ms.alias("last_ms"), F.lit(1).cast("long").alias("in_packets"), F.coalesce("bytes", F.lit(0).cast("long")).alias("in_bytes"), F.coalesce("tcp_flags", F.lit(0).cast("short")).alias("tcp_flags"), F.col("tos").alias("src_tos"),
        F.col("ttl").alias("min_ttl"), F.col("ttl").alias("max_ttl"), F.col("vlan").cast("long").alias("src_vlan"), F.col("payload").alias("in_payload"), none.alias("client_us"), none.alias("server_us"), none.alias("app_us"),
    )
    schema = _arrow(FLOWS)
    cols = [*KEY, "ts_us", "tcp_flags", "bytes", "ttl", "tos", "vlan", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, a = None, Assembler(active_s * 1_000_000, inactive_s * 1_000_000)
        for b in batches:
            for r in b.to_pylist():
                if r["_pair"] != pair:
                    a.flush()
                    pair = r["_pair"]
                a.packet(r)
            if a.ready:
                yield _rows(a.take(), schema)
        a.flush()
        if a.ready:
            yield _rows(a.take(), schema)

    x = p.where(~single_packet()).select(*cols, _pair().alias("_pair"))
    made = x.repartition("_pair").sortWithinPartitions("_pair", "ts_us").mapInArrow(run, FLOWS)
    return made.unionByName(alone)

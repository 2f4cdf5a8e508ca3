"""What payloads tell: TLS hellos with their fingerprints, and DNS messages. Decoded in Arrow batches, once per distinct payload of a batch."""

from __future__ import annotations

import hashlib
import ipaddress
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_text = T.StringType()
TLS = T.StructType([T.StructField(n, T.IntegerType() if n == "version" else _text) for n in ("kind", "version", "sni", "ja3", "ja4", "ja4s")])
DNS = T.StructType([T.StructField(n, T.ArrayType(_text)) for n in ("names", "addresses")])
_VERSION_TEXT = {0x0304: "13", 0x0303: "12", 0x0302: "11", 0x0301: "10", 0x0300: "s3", 0x0002: "s2"}


def _grease(v: int) -> bool:
    return v & 0x0F0F == 0x0A0A and v >> 8 == v & 0xFF


class _Reader:
    def __init__(self, b: bytes) -> None:
        self.b, self.i = b, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.i + n > len(self.b):
            raise ValueError("short")
        self.i += n
        return self.b[self.i - n : self.i]

    def u(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def more(self) -> bool:
        return self.i < len(self.b)


def _shorts(b: bytes) -> list[int]:
    return [x for (x,) in struct.iter_unpack(">H", b[: len(b) // 2 * 2])]


def parse_tls(data: bytes | None) -> dict | None:
    """Client or server hello at the start of a payload; None if it is none or is cut off within its hello."""
    if data is None or len(data) < 9 or data[0] != 0x16:
        return None
    r = _Reader(bytes(data))
    try:
        r.take(1)
        if r.u(2) not in (0x0002, 0x0300, 0x0301, 0x0302, 0x0303):
            return None
        r = _Reader(r.take(r.u(2)))
        kind = r.u(1)
        if kind not in (1, 2):
            return None
        r = _Reader(r.take(r.u(3)))
        version = r.u(2)
        r.take(32)
        r.take(r.u(1))
        if kind == 1:
            ciphers = [x for x in _shorts(r.take(r.u(2))) if not _grease(x)]
            r.take(r.u(1))
        else:
            ciphers = [r.u(2)]
            r.take(1)
        ext, sni, alpn, groups, formats, sigs, highest = [], None, "", [], [], [], version
        if r.more():
            x = _Reader(r.take(r.u(2)))
            while x.more():
                t, body = x.u(2), _Reader(x.take(x.u(2)))
                if _grease(t):
                    continue
                ext.append(t)
                if t == 0 and kind == 1 and body.more():
                    body.take(3)
                    sni = body.take(body.u(2)).decode("latin-1")
                elif t == 10 and body.more():
                    groups = [v for v in _shorts(body.take(body.u(2))) if not _grease(v)]
                elif t == 11 and body.more():
                    formats = list(body.take(body.u(1)))
                elif t == 13 and body.more():
                    sigs = [v for v in _shorts(body.take(body.u(2))) if not _grease(v)]
                elif t == 16 and body.more():
                    body.take(2)
                    alpn = body.take(body.u(1)).decode("latin-1")
                elif t == 43 and body.more():
                    vs = [v for v in (_shorts(body.take(body.u(1))) if kind == 1 else [body.u(2)]) if not _grease(v)]
                    highest = max(vs, default=version)
    except ValueError:
        return None
    dash = lambda xs: "-".join(map(str, xs))
    parts = [str(version), dash(ciphers), dash(ext)] + ([dash(groups), dash(formats)] if kind == 1 else [])
    out = {"kind": "client" if kind == 1 else "server", "version": highest, "sni": sni, "ja3": hashlib.md5(",".join(parts).encode()).hexdigest(), "ja4": None, "ja4s": None}
    ends = (alpn[0] + alpn[-1]) if alpn and alpn.isascii() and alpn[0].isalnum() and alpn[-1].isalnum() else "00" if not alpn else f"{alpn.encode('latin-1')[0]:02x}"[0] + f"{alpn.encode('latin-1')[-1]:02x}"[1]
    v = _VERSION_TEXT.get(highest, "00")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()[:12]
    hexes = lambda xs: ",".join(f"{x:04x}" for x in xs)
    if kind == 1 and len(ciphers) <= 99 and len(ext) <= 99:
        head = f"t{v}{'d' if 0 in ext else 'i'}{len(ciphers):02d}{len(ext):02d}{ends}"
        tail = hexes(sorted(x for x in ext if x not in (0, 16))) + ("_" + hexes(sigs) if sigs else "")
        out["ja4"] = f"{head}_{sha(hexes(sorted(ciphers))) if ciphers else '0' * 12}_{sha(tail) if ext else '0' * 12}"
    elif kind == 2:
        out["ja4s"] = f"t{v}{len(ext):02d}{ends}_{ciphers[0]:04x}_{sha(hexes(ext)) if ext else '0' * 12}"
    return out


def _name(msg: bytes, at: int) -> tuple[str, int]:
    labels, end, jumps = [], None, 0
    while True:
        n = msg[at]
        if n >= 0xC0:
            end = at + 2 if end is None else end
            at = (n & 0x3F) << 8 | msg[at + 1]
            jumps += 1
            if jumps > 32:
                raise ValueError("loop")
        elif n == 0:
            return ".".join(labels), at + 1 if end is None else end
        else:
            labels.append(msg[at + 1 : at + 1 + n].decode("latin-1"))
            at += 1 + n


def parse_dns(data: bytes | None, tcp: bool) -> dict | None:
    """Question names, and the A and AAAA addresses of answers and additional records."""
    if data is None:
        return None
    msg = bytes(data)[2:] if tcp else bytes(data)
    try:
        _, _, nq, na, nn, nx = struct.unpack_from(">6H", msg)
        at, names, addresses = 12, [], []
        for _ in range(nq):
            n, at = _name(msg, at)
            names.append(n)
            at += 4
        for i in range(na + nn + nx):
            _, at = _name(msg, at)
            kind, _, _, size = struct.unpack_from(">HHIH", msg, at)
            at += 10
            if at + size > len(msg):
                raise ValueError("short")
            if not na <= i < na + nn and (kind, size) in ((1, 4), (28, 16)):
                addresses.append(str(ipaddress.ip_address(msg[at : at + size])))
            at += size
    except (struct.error, ValueError, IndexError):
        return None
    return {"names": names, "addresses": addresses} if at <= len(msg) else None


@F.pandas_udf(TLS)
def _tls(payload: pd.Series) -> pd.DataFrame:
    seen: dict[bytes, dict] = {}
    none = dict.fromkeys(("kind", "version", "sni", "ja3", "ja4", "ja4s"))
    rows = []
    for p in payload:
        k = bytes(p) if p is not None else b""
        if k not in seen:
            seen[k] = parse_tls(k) or none
        rows.append(seen[k])
    out = pd.DataFrame(rows, columns=list(none))
    out["version"] = out["version"].astype("Int32")
    return out


def tls(payload: Column) -> Column:
    """struct(kind, version, sni, ja3, ja4, ja4s); all NULL if the payload holds no hello."""
    return _tls(payload)


@F.pandas_udf(DNS)
def _dns(payload: pd.Series, proto: pd.Series) -> pd.DataFrame:
    rows = [parse_dns(p, n == 6) or {"names": None, "addresses": None} for p, n in zip(payload, proto)]
    return pd.DataFrame(rows, columns=["names", "addresses"])


def dns(payload: Column, proto: Column) -> Column:
    """struct(names, addresses), NULL if the payload is no DNS message."""
    x = _dns(payload, proto)
    return F.when(x["names"].isNotNull(), x)

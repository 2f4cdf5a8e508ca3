"""Prefix-preserving anonymisation of addresses (Crypto-PAn): addresses that share k leading bits still do so afterwards.

Bit i of the result is bit i of the address XOR the first bit of AES(first i bits, filled up from a secret pad). All blocks of a batch
are encrypted at once; each distinct prefix of a batch only once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.schema import COLUMNS


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """S-box (inverse in GF(2^8), then the affine map) and multiplication by x, from their definitions."""
    xtime = np.array([(i << 1) ^ (0x11B if i & 0x80 else 0) for i in range(256)], np.uint8)
    exp, log = [0] * 255, [0] * 256
    v = 1
    for i in range(255):
        exp[i], log[v] = v, i
        v ^= int(xtime[v])
    box = []
    for i in range(256):
        inv = exp[-log[i] % 255] if i else 0
        x = inv
        for s in range(1, 5):
            x ^= (inv << s | inv >> (8 - s)) & 0xFF
        box.append(x ^ 0x63)
    return np.array(box, np.uint8), xtime


SBOX, XTIME = _tables()


def expand_key(key: bytes) -> np.ndarray:
    """Round keys (11, 16) of a 16-byte key."""
    w = [list(key[i : i + 4]) for i in range(0, 16, 4)]
    rcon = 1
    for i in range(4, 44):
        t = list(w[i - 1])
        if i % 4 == 0:
            t = [int(SBOX[x]) for x in t[1:] + t[:1]]
            t[0] ^= rcon
            rcon = int(XTIME[rcon])
        w.append([a ^ b for a, b in zip(w[i - 4], t)])
    return np.array(w, np.uint8).reshape(11, 16)


_SHIFT = np.array([(i + 4 * (i % 4)) % 16 for i in range(16)])


def encrypt(blocks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """AES-128 of (n, 16) bytes."""
    s = blocks ^ keys[0]
    for r in range(1, 11):
        s = SBOX[s][:, _SHIFT]
        if r < 10:
            c = s.reshape(-1, 4, 4)
            a = c ^ np.roll(c, -1, axis=2)
            s = (XTIME[a] ^ np.roll(c, -1, axis=2) ^ np.roll(c, -2, axis=2) ^ np.roll(c, -3, axis=2)).reshape(-1, 16)
        s = s ^ keys[r]
    return s


def parse_key(key: str) -> bytes:
    """32 characters, or 0x and 64 hex digits."""
    raw = bytes.fromhex(key[2:]) if key.lower().startswith("0x") and len(key) == 66 else key.encode()
    if len(raw) != 32:
        raise ValueError("a key has 32 characters, or 0x and 64 hex digits")
    return raw


class Anonymizer:
    def __init__(self, key: str) -> None:
        raw = parse_key(key)
        self.keys = expand_key(raw[:16])
        self.pad = encrypt(np.frombuffer(raw[16:], np.uint8)[None], self.keys)[0]

    def bits(self, addresses: np.ndarray) -> np.ndarray:
        """(n, width/8) bytes to bytes of the same shape."""
        width = addresses.shape[1] * 8
        bit = np.unpackbits(addresses, axis=1)
        pad = np.unpackbits(self.pad)
        out = np.empty_like(bit)
        for i in range(width):
            prefix, place = np.unique(np.packbits(bit[:, :i], axis=1), axis=0, return_inverse=True) if i else (np.empty((1, 0), np.uint8), np.zeros(len(bit), np.int64))
            block = np.tile(pad, (len(prefix), 1))
            if i:
                block[:, :i] = np.unpackbits(prefix, axis=1)[:, :i]
            first = encrypt(np.packbits(block, axis=1), self.keys)[:, 0] >> 7
            out[:, i] = bit[:, i] ^ first[place.ravel()]
        return np.packbits(out, axis=1)

    def v4(self, ips: list[int]) -> list[int]:
        if not len(ips):
            return []
        b = self.bits(np.array(ips, ">u4").view(np.uint8).reshape(-1, 4))
        return b.copy().view(">u4").ravel().tolist()

    def v6(self, ips: list[bytes]) -> list[bytes]:
        if not len(ips):
            return []
        return [x.tobytes() for x in self.bits(np.frombuffer(b"".join(ips), np.uint8).reshape(-1, 16))]


def _mapped(s: pd.Series, f) -> pd.Series:
    known = s.dropna()
    values = list(dict.fromkeys(bytes(x) if isinstance(x, (bytes, bytearray)) else int(x) for x in known))
    table = dict(zip(values, f(values)))
    return s.map(lambda x: None if x is None or x != x else table[bytes(x) if isinstance(x, (bytes, bytearray)) else int(x)])


def anonymize4(ip: Column, key: str) -> Column:
    a = Anonymizer(key)

    @F.pandas_udf("long")
    def f(s: pd.Series) -> pd.Series:
        return _mapped(s, a.v4).astype("Int64")

    return f(ip)


def anonymize6(ip: Column, key: str) -> Column:
    a = Anonymizer(key)

    @F.pandas_udf("binary")
    def f(s: pd.Series) -> pd.Series:
        return _mapped(s, a.v6)

    return f(ip)


# By side of a record; what belongs to neither side goes with both.
_SRC = ["src4", "src6", "x_src4", "x_src6", "tun_src4", "tun_src6"]
_DST = ["dst4", "dst6", "x_dst4", "x_dst6", "tun_dst4", "tun_dst6"]
_BOTH = ["next4", "next6", "bgp_next4", "bgp_next6", "router4", "router6"]
_AS = {"src": ["src_as"], "dst": ["dst_as"], "both": ["src_as", "dst_as", "next_as", "prev_as"]}


def anonymize(flows: DataFrame, key: str, side: str = "both") -> DataFrame:
    """Flows with anonymised addresses and AS numbers set to 0; `side` src or dst leaves the other side as it is."""
    names = {"src": _SRC, "dst": _DST, "both": _SRC + _DST + _BOTH}[side]
    out = {n: (anonymize4 if COLUMNS[n].typeName() == "long" else anonymize6)(F.col(n), key) for n in names if n in flows.columns}
    out |= {n: F.when(F.col(n).isNotNull(), F.lit(0).cast("long")) for n in _AS[side] if n in flows.columns}
    return flows.withColumns(out)

"""Addresses: text and numbers, prefixes as ranges."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX4 = 0xFFFFFFFF


def parse(text: str) -> tuple[int, int | bytes]:
    """(4, number) or (6, 16 bytes). IPv4 may be short of trailing parts, which are 0 then."""
    if ":" not in text:
        parts = text.split(".")
        if not 1 <= len(parts) <= 4 or not all(p.isdigit() and int(p) < 256 for p in parts) or (len(parts) == 1):
            raise ValueError(f"not an address: {text}")
        return 4, int.from_bytes(bytes([int(p) for p in parts] + [0] * (4 - len(parts))), "big")
    return 6, ipaddress.IPv6Address(text).packed


def prefix_range(text: str, bits: int) -> tuple[int, int | bytes, int | bytes]:
    """(family, first, last address) of a prefix; host bits of the address are dropped."""
    family, ip = parse(text)
    width = 32 if family == 4 else 128
    if not 0 <= bits <= width:
        raise ValueError(f"prefix length out of range: {bits}")
    n = ip if family == 4 else int.from_bytes(ip, "big")
    low = n >> (width - bits) << (width - bits)
    high = low | ((1 << (width - bits)) - 1)
    return (4, low, high) if family == 4 else (6, low.to_bytes(16, "big"), high.to_bytes(16, "big"))


def mask_bits(mask: str) -> int:
    """Prefix length of a dotted mask."""
    family, m = parse(mask)
    if family != 4:
        raise ValueError("a mask is an IPv4 address")
    bits = m.bit_count()
    if m != (MAX4 << (32 - bits)) & MAX4:
        raise ValueError(f"not a contiguous mask: {mask}")
    return bits


def masked4(ip: Column, bits: int | Column) -> Column:
    """Network of an IPv4 address; 0 bits give 0."""
    if isinstance(bits, int):
        return ip.bitwiseAND(F.lit((MAX4 << (32 - bits)) & MAX4).cast("long"))
    shift = (F.lit(32) - F.least(F.greatest(bits.cast("int"), F.lit(0)), F.lit(32))).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", ip, shift), shift)


def masked6(ip: Column, bits: int) -> Column:
    """Network of an IPv6 address (16 bytes), for any prefix length."""
    whole, rest = divmod(bits, 8)
    head = F.substring(ip, 1, whole)
    zero = F.lit(bytes(16))
    if not rest:
        return F.when(ip.isNotNull(), F.substring(F.concat(head, zero), 1, 16))
    byte = F.conv(F.hex(F.substring(ip, whole + 1, 1)), 16, 10).cast("int").bitwiseAND((0xFF << (8 - rest)) & 0xFF)
    return F.when(ip.isNotNull(), F.substring(F.concat(head, F.unhex(F.lpad(F.hex(byte.cast("long")), 2, "0")), zero), 1, 16))


def text4(ip: Column) -> Column:
    part = lambda n: F.shiftright(ip, n).bitwiseAND(255).cast("string")
    return F.when(ip.isNotNull(), F.concat_ws(".", part(24), part(16), part(8), part(0)))


def text6(ip: Column) -> Column:
    """RFC 5952 text of 16 bytes: no leading zeros, the first of the longest runs of zero groups as ::, mapped IPv4 addresses with dots."""
    def shortened(plain: Column) -> Column:
        out = plain
        for k in range(2, 9):  # the longest run is tried first
            run = f"(?:^|:)0(?::0){{{k - 1}}}(?:$|:)"
            out = F.when(plain.rlike(run), F.regexp_replace(plain, f"^(.*?){run}(.*)$", "$1::$2")).otherwise(out)
        return out

    # bound to a name once: the text is used many times
    out = F.get(F.transform(F.array(F.regexp_replace(text6_long(ip), "(^|:)0{1,3}", "$1")), shortened), F.lit(0))
    h = F.hex(ip)
    byte = lambda i: F.conv(F.substring(h, 1 + 2 * i, 2), 16, 10)
    mapped = F.concat(F.lit("::ffff:"), F.concat_ws(".", *[byte(i) for i in range(12, 16)]))
    return F.when(ip.isNotNull(), F.when(h.startswith("00000000000000000000FFFF"), mapped).otherwise(out))


def text6_long(ip: Column) -> Column:
    """Eight groups of four hex digits."""
    h = F.lower(F.hex(ip))
    return F.when(ip.isNotNull(), F.concat_ws(":", *[F.substring(h, 1 + 4 * i, 4) for i in range(8)]))


def number4(text: Column) -> Column:
    p = [F.split_part(text, F.lit("."), F.lit(i)).cast("long") for i in (1, 2, 3, 4)]
    return p[0] * 16777216 + p[1] * 65536 + p[2] * 256 + p[3]


def mac_text(mac: Column) -> Column:
    h = F.lpad(F.lower(F.hex(mac)), 12, "0")
    return F.when(mac.isNotNull(), F.concat_ws(":", *[F.substring(h, 1 + 2 * i, 2) for i in range(6)]))


def mac_number(text: str) -> int:
    parts = text.split(":")
    if len(parts) != 6 or not all(p and len(p) <= 2 for p in parts):
        raise ValueError(f"not a MAC address: {text}")
    return int("".join(p.zfill(2) for p in parts), 16)

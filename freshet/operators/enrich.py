"""Lookups: longest prefixes, exit node intervals, names, exporters and samplers.

A prefix table of up to MAX_PREFIXES rows (checked before it is used) is made into a sorted array of disjoint ranges, each with its longest
prefix, and sent to the workers; flows stay where they are and whole batches of addresses are looked up by binary search. A larger table
is met in a join: an address is looked up under the prefix lengths that occur, key (length, masked address), once for each distinct
address. Other dimension tables are broadcast by the planner when their size allows, otherwise the same join runs as a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.functions import ip
from freshet.functions.rates import div
from freshet.schema import field

DAY_S = 86_400
MAX_PREFIXES = 2_000_000  # about 50 MB on each worker, and the values


def with_prefixes4(ranges: DataFrame, start: str = "net_start", end: str = "net_end") -> DataFrame:
    """Adds prefix_len to IPv4 ranges that are prefixes."""
    return ranges.withColumn("prefix_len", (32 - F.bit_count(F.col(end) - F.col(start))).cast("int"))


def with_prefixes6(ranges: DataFrame, start: str = "net_start", end: str = "net_end") -> DataFrame:
    """Adds prefix_len to IPv6 ranges that are prefixes: twice the whole hex digits that are equal, and the bits of the next one."""
    a, b = F.hex(start), F.hex(end)
    digits = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.conv(F.substring(a, i, F.lit(1)), 16, 10).cast("int").bitwiseXOR(F.conv(F.substring(b, i, F.lit(1)), 16, 10).cast("int")))
    bits = F.aggregate(digits, F.lit(0), lambda acc, x: acc + F.bit_count(x))
    return ranges.withColumn("prefix_len", (128 - bits).cast("int"))


def disjoint_ranges(starts: list, lengths: np.ndarray, family: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted bounds, and for the range from each bound to the next the place of its longest prefix, -1 if none holds it. Of equal prefixes
    the last counts. IPv4 addresses are numbers, IPv6 addresses 16 bytes in network order, which sort as text."""
    width = 32 if family == 4 else 128
    first = [int.from_bytes(x, "big") if family == 6 else x for x in starts]
    first = [x >> (width - n) << (width - n) for x, n in zip(first, lengths.tolist())]
    after = [x + (1 << (width - n)) for x, n in zip(first, lengths.tolist())]
    kind = (lambda xs: np.array(xs, np.int64)) if family == 4 else (lambda xs: np.array([x.to_bytes(16, "big") for x in xs], "S16"))
    top = 1 << width  # nothing comes after the last address
    bounds = np.unique(kind([0, *first, *(x for x in after if x < top)]))
    lo, hi = np.searchsorted(bounds, kind(first)), np.full(len(first), len(bounds))
    inner = np.array([x < top for x in after], bool)
    hi[inner] = np.searchsorted(bounds, kind([x for x in after if x < top]))
    owner = np.full(len(bounds), -1, np.int64)
    for n in np.unique(lengths):  # prefixes of one length are disjoint or equal; longer ones come later
        at = np.flatnonzero(lengths == n)
        size = hi[at] - lo[at]
        owner[np.repeat(lo[at] - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.repeat(at, size)
    return bounds, owner


def _addresses(a: pa.Array, family: int) -> np.ndarray:
    if family == 4:
        return a.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.array([x if x is not None and len(x) == 16 else b"" for x in a.to_pylist()], "S16")


def _by_search(df: DataFrame, address: str, table: pa.Table, family: int, kind: T.StructType) -> Column:
    """The values of each address's longest prefix, as a struct; NULL if none holds it."""
    values = table.column("_v").combine_chunks()
    bounds, owner = disjoint_ranges(table.column("_net").to_pylist(), table.column("_len").to_numpy().astype(np.int64), family)
    sent = df.sparkSession.sparkContext.broadcast((bounds, owner, values))

    @F.arrow_udf(kind)
    def found(a: pa.Array) -> pa.Array:
        bounds, owner, values = sent.value
        x = _addresses(a, family)
        at = owner[np.searchsorted(bounds, x, "right") - 1]
        none = (at < 0) | a.is_null().to_numpy(zero_copy_only=False)
        return values.take(pa.array(at, mask=none))

    return found(F.col(f"`{address}`"))


def longest_prefix(df: DataFrame, address: str, prefixes: DataFrame, values: dict[str, str], family: int = 4, start: str = "net_start") -> DataFrame:
    """df with the columns `values` (prefix table column -> new name) of the longest prefix that holds the address; NULL if none does.

    `prefixes` has prefix_len. NULL addresses match nothing. Prefixes given twice: the one whose values are greatest wins. Flows aren't
    shuffled unless the table has more than MAX_PREFIXES rows; then distinct addresses are looked up once each and joined back.
    """
    table = prefixes.where(F.col(start).isNotNull() & F.col("prefix_len").isNotNull()).select(F.col(start).alias("_net"), F.col("prefix_len").cast("int").alias("_len"), F.struct(*[F.col(o).alias(n) for o, n in values.items()]).alias("_v"))
    kind = table.schema["_v"].dataType
    some = table.limit(MAX_PREFIXES + 1).toArrow()
    if some.num_rows <= MAX_PREFIXES:
        if not some.num_rows:
            return df.withColumns({n: F.lit(None).cast(kind[n].dataType) for n in kind.names})
        order = some.append_column("_order", table_order(some))
        x = df.withColumn("_v", _by_search(df, address, order.sort_by("_order").drop_columns(["_order"]), family, kind))
        return x.withColumns({n: F.col(f"_v.{n}") for n in kind.names}).drop("_v")
    lengths = sorted((r[0] for r in table.select("_len").distinct().collect()), reverse=True)  # at most 33 or 129 numbers
    mask = ip.masked4 if family == 4 else ip.masked6
    distinct = df.select(F.col(f"`{address}`").alias("_a")).where("_a is not null").distinct()
    tries = distinct.select("_a", F.explode(F.array(*[F.struct(F.lit(n).alias("_len"), mask(F.col("_a"), n).alias("_net")) for n in lengths])).alias("t")).select("_a", "t.*")
    found = tries.join(table, ["_len", "_net"]).groupBy("_a").agg(F.max_by("_v", F.struct("_len", "_v")).alias("_v"))
    joined = df.join(found, df[address] == found["_a"], "left")
    return joined.select(*[df[c] for c in df.columns], *[F.col(f"_v.{n}").alias(n) for n in values.values()])


def table_order(t: pa.Table) -> pa.Array:
    """Place of each row when the values ascend, NULL first, so that of equal prefixes the one with the greatest comes last."""
    rows = t.column("_v").to_pylist()
    key = lambda i: [(v is not None, v) for v in rows[i].values()]
    place = np.empty(len(rows), np.int64)
    place[sorted(range(len(rows)), key=key)] = np.arange(len(rows))
    return pa.array(place)


def geo(df: DataFrame, address: str, blocks: DataFrame, locations: DataFrame, name: str, family: int = 4) -> DataFrame:
    """Adds `name`: the country code of the address, `..` where it is unknown, NULL where there is no address."""
    coded = blocks.join(locations.select("location_id", "country"), "location_id")
    x = longest_prefix(df, address, coded, {"country": name}, family)
    return x.withColumn(name, F.when(F.col(address).isNotNull(), F.coalesce(F.col(name), F.lit(".."))))


def as_number(df: DataFrame, address: str, as_blocks: DataFrame, stored: str, family: int = 4) -> DataFrame:
    """Fills `stored` where it is missing or 0 with the AS of the address; 0 where it is unknown."""
    x = longest_prefix(df, address, as_blocks, {"asn": "_asn"}, family)
    return x.withColumn(stored, F.coalesce(F.nullif(field(df, stored), F.lit(0)), F.col("_asn"), F.lit(0))).drop("_asn")


def as_organisation(df: DataFrame, asn: str, orgs: DataFrame, name: str) -> DataFrame:
    """Adds `name`: the organisation of an AS, `not found` where it is unknown."""
    return named(df, asn, orgs, "asn", "org", name, "not found")


def named(df: DataFrame, key: str, names: DataFrame, names_key: str, names_value: str, name: str, missing: str | None = None) -> DataFrame:
    """Left join with a table of names (interfaces, VRFs, applications, organisations): a key given twice takes the smallest name."""
    t = names.groupBy(F.col(names_key).alias("_k")).agg(F.min(names_value).alias("_n"))
    x = df.join(t, df[key] == t["_k"], "left")
    value = F.coalesce(F.col("_n"), F.lit(missing)) if missing is not None else F.col("_n")
    return x.select(*[df[c] for c in df.columns], value.alias(name))


def tor(df: DataFrame, address: str, exits: DataFrame, name: str) -> DataFrame:
    """Adds `name`: EX if the flow's first or last time lies in an interval of the exit node (and a day after), ex if the address is a
    known exit node at another time, `..` otherwise; NULL where there is no address. exits: ip, intervals array<struct<first, last>> in seconds."""
    x = df.join(exits.select(F.col("ip").alias("_ip"), F.col("intervals").alias("_iv")), df[address] == F.col("_ip"), "left")
    at = lambda t, v: F.floor(t / 1000).between(v["first"], v["last"] + DAY_S)
    hit = F.exists("_iv", lambda v: at(F.col("first_ms"), v) | at(F.col("last_ms"), v))
    state = F.when(F.col(address).isNull(), F.lit(None)).when(F.col("_ip").isNull(), "..").when(hit, "EX").otherwise("ex")
    return x.select(*[df[c] for c in df.columns], state.alias(name))


def tor_intervals(sightings: DataFrame) -> DataFrame:
    """exits table from sightings (ip, seen: seconds): successive sightings at most a day apart are one interval; the last eight are kept
    (the format's own limit), in order of time."""
    from freshet.operators.sessions import sessionize

    s = sessionize(sightings, "ip", "seen", "seen", DAY_S)
    last8 = F.slice(F.sort_array(F.collect_list(F.struct(F.col("session_start").alias("first"), F.col("session_end").alias("last"))), asc=False), 1, 8)
    return s.groupBy("ip").agg(F.array_sort(last8).alias("intervals"), F.max("session_end").alias("last_published"))


# Priorities of samplers: an exporter's own setting by hand, then the record's, then the static ones.
OVERWRITE, DEFAULT, GENERIC = -3, -2, -1


def sampling(df: DataFrame, samplers: DataFrame, exporter: str = "exporter_id", sampler: str = "selector_id") -> DataFrame:
    """Packets and bytes scaled by (packet_interval + space_interval) / packet_interval where space_interval > 0.

    Of an exporter's samplers that with id -3 comes first, then the one that the record names, then -1, then -2. Records without
    any stay as they are. Each exporter's samplers are one map, so a record is joined once.
    """
    ratio = F.struct(F.col("packet_interval").alias("p"), F.col("space_interval").alias("s"))
    # an exporter has a handful of samplers
    per = samplers.where("packet_interval > 0").groupBy(F.col("sysid").alias("_sysid"), "id").agg(F.max(ratio).alias("r")).groupBy("_sysid").agg(F.map_from_entries(F.collect_list(F.struct("id", "r"))).alias("_m"))
    x = df.join(per, df[exporter] == per["_sysid"], "left")
    own = F.coalesce(field(df, sampler).cast("long"), F.lit(-99).cast("long"))
    get = lambda k: F.try_element_at(F.col("_m"), k)
    r = F.coalesce(get(F.lit(OVERWRITE).cast("long")), get(own), get(F.lit(GENERIC).cast("long")), get(F.lit(DEFAULT).cast("long")))
    x = x.withColumn("_r", r)
    scaled = lambda n: F.when(F.coalesce(F.col("_r.s"), F.lit(0)) > 0, div(F.col(n) * (F.col("_r.p") + F.col("_r.s")), F.col("_r.p"))).otherwise(F.col(n))
    out = {n: F.when(F.col(n).isNotNull(), scaled(n)).alias(n) for n in ("in_packets", "in_bytes", "out_packets", "out_bytes") if n in df.columns}
    return x.select(*[out.get(c, df[c]) for c in df.columns])


def uptime_to_ms(sys_uptime: Column, unix_ms: Column, uptime: Column) -> Column:
    """Absolute time of an uptime stamp of a packet that was sent at unix_ms with sys_uptime; counters wrap at 2^32."""
    back = F.pmod(sys_uptime - uptime, F.lit(2**32))
    signed = F.when(back >= 2**31, back - 2**32).otherwise(back)
    return unix_ms - signed


def whois(spark, addresses: list[str], blocks4: DataFrame | None = None, locations: DataFrame | None = None, as4: DataFrame | None = None, exits: DataFrame | None = None) -> DataFrame:
    """What the dimension tables know of IPv4 addresses given as text: ip, and country, asn, org and known exit node where their tables are given."""
    df = spark.createDataFrame([(a, ip.parse(a)[1]) for a in addresses], "ip string, _a long")
    if blocks4 is not None and locations is not None:
        df = geo(df, "_a", blocks4, locations, "country")
    if as4 is not None:
        df = longest_prefix(df, "_a", as4, {c: c for c in ("asn", "org") if c in as4.columns})
    if exits is not None:
        known = exits.select(F.col("ip").alias("_ip"), F.col("intervals").alias("exit_intervals"))
        df = df.join(known, df["_a"] == known["_ip"], "left").drop("_ip")
    return df.drop("_a")


@dataclass(frozen=True)
class Lookups:
    """Dimension tables that fill derived columns when a filter, statistic, key or format asks for them. blocks4/6 and as4/6 have prefix_len."""

    locations: DataFrame | None = None
    blocks4: DataFrame | None = None
    blocks6: DataFrame | None = None
    as4: DataFrame | None = None
    as6: DataFrame | None = None
    exits: DataFrame | None = None

    def has(self, what: str) -> bool:
        if what == "geo":
            return self.locations is not None and (self.blocks4 is not None or self.blocks6 is not None)
        return self.exits is not None if what == "tor" else self.as4 is not None or self.as6 is not None

    def fill(self, df: DataFrame, column: str) -> DataFrame:
        """df with the derived column: side_geo, side_tor, side_org, side_location; or side_as with missing numbers looked up. A flow has an
        address of one family; that of the other is NULL."""
        side, _, what = column.rpartition("_")
        if what == "tor":
            return tor(df, f"{side}4", self.exits, column) if f"{side}4" in df.columns else df.withColumn(column, F.lit(None).cast("string"))
        place = {"geo": "country", "location": "_place", "org": "org", "as": "asn"}[what]
        tables = {4: self.as4, 6: self.as6} if what in ("as", "org") else {n: b.join(self._places(), "location_id") for n, b in ((4, self.blocks4), (6, self.blocks6)) if b is not None}
        got, new = df, []
        for family, t in tables.items():
            if t is not None and f"{side}{family}" in df.columns:
                new.append(f"_{what}{family}")
                got = longest_prefix(got, f"{side}{family}", t, {place: new[-1]}, family)
        value = F.coalesce(*[F.col(n) for n in new]) if new else F.lit(None).cast("string")
        if what == "as":
            value = F.coalesce(F.nullif(field(df, column), F.lit(0)), value.cast("long"), F.lit(0))
        elif what == "geo":
            has = [F.col(f"{side}{n}").isNotNull() for n in (4, 6) if f"{side}{n}" in df.columns]
            value = F.when(has[0] | has[-1], F.coalesce(value, F.lit(".."))) if has else value
        return got.withColumn(column, value).drop(*new)

    def _places(self) -> DataFrame:
        parts = [n for n in ("continent", "country", "city") if n in self.locations.columns]
        return self.locations.select("location_id", "country", F.concat_ws("/", *parts).alias("_place"))

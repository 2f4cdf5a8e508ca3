"""Where flows come from and go to: Parquet trees by source and slot, selection of slots and sources, time windows, retention."""

from __future__ import annotations

import re
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.schema import SCHEMA, conform

SLOT_MS = 300_000


def in_window(start_ms: int, end_ms: int) -> Column:
    """Flows strictly inside a time window: first after its start, last before its end."""
    return (F.col("first_ms") > start_ms) & (F.col("last_ms") < end_ms)


def in_replay_window(start_ms: int, end_ms: int) -> Column:
    """As in_window(), with the bounds included."""
    return (F.col("first_ms") >= start_ms) & (F.col("last_ms") <= end_ms)


def slot_name(ms: Column) -> Column:
    """YYYYMMDDhhmm of the slot's start, in the session's zone."""
    return F.date_format(F.timestamp_millis(ms - F.pmod(ms, F.lit(SLOT_MS))), "yyyyMMddHHmm")


# By number, the levels of folders between a source and its slots. y year, m month, d day, h hour, w week (from Monday, the days
# before the first one are week 0), u day of the week (Monday is 1), j day of the year, date YYYY-MM-DD.
LAYOUTS = ("", "y m d", "y m d h", "y w u", "y w u h", "y j", "y j h", "date", "date h")


def layout_columns(ms: Column, layout: int) -> dict[str, Column]:
    """Partition columns of a layout, in order, from a time; in the session's zone."""
    t = F.timestamp_millis(ms)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    week = F.floor((F.dayofyear(t) + 6 - F.weekday(t)) / 7)
    how = {
        "y": ("year", F.date_format(t, "yyyy")), "m": ("month", F.date_format(t, "MM")), "d": ("day", F.date_format(t, "dd")), "h": ("hour", F.date_format(t, "HH")), "w": ("week", two(week)),
        "u": ("weekday", (F.weekday(t) + 1).cast("string")), "j": ("yearday", F.lpad(F.dayofyear(t).cast("string"), 3, "0")), "date": ("date", F.date_format(t, "yyyy-MM-dd")),
    }
    return dict(how[x] for x in LAYOUTS[layout].split())


def with_partitions(flows: DataFrame) -> DataFrame:
    """Adds `source` (the ident, `none` if it has none) and `slot` (of arrival; the record's end where that is missing)."""
    return flows.withColumns({"source": F.coalesce(F.nullif(F.col("ident"), F.lit("")), F.lit("none")), "slot": slot_name(arrival(flows))})


def arrival(flows: DataFrame) -> Column:
    return F.coalesce(F.nullif(F.col("received_ms"), F.lit(0)), F.nullif(F.col("last_ms"), F.lit(0)), F.lit(0))


def write(flows: DataFrame, path: str, mode: str = "append", compression: str = "zstd", layout: int = 0) -> None:
    """Parquet below source=/slot=, with the folders of a layout of LAYOUTS between the two. Rows are spread over a few files per slot, so a
    large source is written by many tasks. read() finds the slots of any layout."""
    x = with_partitions(flows)
    between = layout_columns(arrival(flows), layout)
    x = x.withColumns(between) if between else x
    x.repartition("source", "slot", F.pmod(F.xxhash64("rec_no"), F.lit(8))).write.mode(mode).option("compression", compression).partitionBy("source", *between, "slot").parquet(path)


def read(spark: SparkSession, path: str, slots: str | None = None, sources: list[str] | None = None, window: tuple[int, int] | None = None) -> DataFrame:
    """Flows below `path`. `slots`: `first:last` (either may be left out), by name; `sources`: idents, `*` and `?` are wildcards;
    `window`: strict time window, which also prunes row groups by the statistics of the times."""
    df = spark.read.parquet(path)
    if slots is not None:
        first, _, last = slots.partition(":")
        clean = lambda s: re.sub(r"\D", "", s)
        if clean(first):
            df = df.where(F.col("slot").cast("string") >= clean(first))
        if clean(last):
            df = df.where(F.col("slot").cast("string") <= clean(last))
    if sources:
        exact = [s for s in sources if not re.search(r"[*?]", s)]
        likes = [F.col("source").rlike("^" + re.escape(s).replace(r"\*", ".*").replace(r"\?", ".") + "$") for s in sources if re.search(r"[*?]", s)]
        test = F.col("source").isin(*exact) if exact else F.lit(False)
        for x in likes:
            test = test | x
        df = df.where(test)
    if window:
        df = df.where(in_window(*window))
    return df


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several trees as one table; columns that one lacks are NULL."""
    out = conform(spark.read.parquet(paths[0]))
    for p in paths[1:]:
        out = out.unionByName(conform(spark.read.parquet(p)))
    return out


def expired(slots: DataFrame, now_ms: int, max_age_ms: int | None = None, max_bytes: int | None = None, low_water: float = 0.95) -> DataFrame:
    """Of slots (source, slot_ms, bytes) those that retention drops: older than the age, and the oldest until the rest fits
    low_water * max_bytes if it exceeds max_bytes. The running total is taken over slots, never over flows."""
    from pyspark.sql import Window

    old = F.col("slot_ms") < (now_ms - max_age_ms) if max_age_ms is not None else F.lit(False)
    x = slots.withColumn("_old", old)
    if max_bytes is None:
        return x.where("_old").drop("_old")
    w = Window.partitionBy("source").orderBy(F.col("slot_ms").desc())
    kept = F.when(F.col("_old"), 0).otherwise(F.col("bytes"))
    x = x.withColumn("_total", F.sum(kept).over(Window.partitionBy("source"))).withColumn("_newer", F.sum(kept).over(w))
    full = (F.col("_total") > max_bytes) & (F.col("_newer") > low_water * max_bytes)
    return x.where(F.col("_old") | full).drop("_old", "_total", "_newer")


def slot_sizes(spark: SparkSession, path: str) -> DataFrame:
    """source, slot_ms, bytes and folder of each slot below a tree that write() or a rotating stream made, by any file system of Spark's."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    part = lambda n: F.regexp_extract("path", rf"/{n}=([^/]*)/", 1)
    x = files.select(part("source").alias("source"), part("slot").alias("slot"), F.regexp_extract("path", r"^(.*/slot=[^/]*)/", 1).alias("folder"), "length").where("slot <> ''")
    return x.groupBy("source", F.unix_millis(F.to_timestamp("slot", "yyyyMMddHHmm")).alias("slot_ms"), "folder").agg(F.sum("length").alias("bytes")).select("source", "slot_ms", "bytes", "folder")


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Deletes folders, by any file system of Spark's."""
    jvm = spark._jvm
    for f in folders:
        at = jvm.org.apache.hadoop.fs.Path(f)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def load_config(path: str) -> dict:
    """Settings by tool section; user formats are under `fmt` and `csv`."""
    return tomllib.loads(Path(path).read_text())


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def read_geo_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Geo tables as delivered in CSV: kind is locations, blocks4, blocks6, as4 or as6. Prefix texts become ranges with prefix_len."""
    df = spark.read.option("header", True).csv(path)
    if kind == "locations":
        return df.select(F.col("geoname_id").cast("long").alias("location_id"), F.col("continent_code").alias("continent"), F.col("country_iso_code").alias("country"), F.col("city_name").alias("city"))
    network, bits = F.split_part("network", F.lit("/"), F.lit(1)), F.split_part("network", F.lit("/"), F.lit(2)).cast("int")
    from freshet.functions import ip

    if kind.endswith("4"):
        start = ip.number4(network)
        size = F.call_function("shiftleft", F.lit(1).cast("long"), 32 - bits)
        span = [start.alias("net_start"), (start + size - 1).alias("net_end"), bits.alias("prefix_len")]
    else:
        span = [bytes6(network).alias("net_start"), bits.alias("prefix_len")]
    if kind.startswith("as"):
        return df.select(*span, F.col("autonomous_system_number").cast("long").alias("asn"), F.col("autonomous_system_organization").alias("org"))
    return df.select(*span, F.coalesce(F.col("geoname_id"), F.col("registered_country_geoname_id")).cast("long").alias("location_id"), F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon"), F.col("accuracy_radius").cast("long").alias("accuracy"))


@F.pandas_udf(T.BinaryType())
def bytes6(text):
    """16 bytes of an IPv6 text, NULL if it is none."""
    import ipaddress

    def one(x):
        try:
            return ipaddress.IPv6Address(x).packed
        except (ValueError, TypeError):
            return None

    return text.map(one)


def read_tor(spark: SparkSession, path: str) -> DataFrame:
    """Sightings (ip, seen) from exit node lists: lines `ExitNode`, `Published`, `LastStatus`, `ExitAddress <ip> <date> <time>`."""
    from freshet.functions import ip

    x = spark.read.text(path).select(F.regexp_extract("value", r"^ExitAddress (\d+\.\d+\.\d+\.\d+) (\S+ \S+)", 1).alias("a"), F.regexp_extract("value", r"^ExitAddress (\d+\.\d+\.\d+\.\d+) (\S+ \S+)", 2).alias("t"))
    return x.where("a <> ''").select(ip.number4(F.col("a")).alias("ip"), F.unix_timestamp("t", "yyyy-MM-dd HH:mm:ss").alias("seen"))


def ident_of(flows: DataFrame, router: str, fixed: dict[str, str]) -> DataFrame:
    """Sets `ident` by the sender's address: from prefixes (`10.1.0.0/16`) to names, the longest first; others get the address with
    dashes for dots and colons."""
    from freshet.functions import ip

    rules = sorted(((ip.prefix_range(*((p.split("/")[0], int(p.split("/")[1])) if "/" in p else (p, 32))), name) for p, name in fixed.items()), key=lambda r: r[0][2] - r[0][1])
    c = F.col(router)
    out = F.regexp_replace(ip.text4(c), r"[.:]", "-")
    for (_, low, high), name in reversed(rules):
        out = F.when(c.between(low, high), F.lit(name)).otherwise(out)
    return flows.withColumn("ident", out)

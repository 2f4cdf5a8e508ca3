"""Totals: of a table, per file slot, per port, per profile channel, and rolling over a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.filterlang.compiler import compile_filter
from freshet.functions.rates import weight
from freshet.schema import EXTENSION_OF, field

CLASSES = {"tcp": [6], "udp": [17], "icmp": [1, 58]}
SLOT_MS, DAY_MS = 300_000, 86_400_000


def _counts(df: DataFrame) -> dict[str, Column]:
    zero = F.lit(0).cast("long")
    return {
        "flows": weight(field(df, "cnt_flows")),
        "packets": F.coalesce(field(df, "in_packets"), zero) + F.coalesce(field(df, "out_packets"), zero),
        "bytes": F.coalesce(field(df, "in_bytes"), zero) + F.coalesce(field(df, "out_bytes"), zero),
    }


def _set_time(c: Column) -> Column:
    return F.when(c != 0, c)


def class_totals(df: DataFrame, when: Column | None = None, prefix: str = "") -> list[Column]:
    """flows, packets and bytes, in all and for tcp, udp, icmp and other; rows for which `when` is false don't count."""
    proto = field(df, "proto")
    named = F.coalesce(proto.isin(*[p for ps in CLASSES.values() for p in ps]), F.lit(False))
    tests = {"": F.lit(True), **{f"_{n}": F.coalesce(proto.isin(*ps), F.lit(False)) for n, ps in CLASSES.items()}, "_other": ~named}
    zero = F.lit(0).cast("long")
    return [F.coalesce(F.sum(F.when(t if when is None else t & when, v).otherwise(zero)), zero).alias(f"{prefix}{m}{k}") for m, v in _counts(df).items() for k, t in tests.items()]


def summary(df: DataFrame) -> DataFrame:
    """One row: totals by protocol class, first and last time (unset times don't count). An empty table gives zeros and no times."""
    return df.agg(*class_totals(df), F.min(_set_time(F.col("first_ms"))).alias("first_ms"), F.max(_set_time(F.col("last_ms"))).alias("last_ms"))


def per_slot(df: DataFrame, time: str = "received_ms", slot_ms: int = SLOT_MS) -> DataFrame:
    """One row per slot of arrival: slot_ms, flows, packets, bytes and the protocol classes. Rows without a time are left out."""
    t = F.col(time)
    return df.where(t.isNotNull()).groupBy((t - F.pmod(t, F.lit(slot_ms))).alias("slot_ms")).agg(*class_totals(df))


def ports(df: DataFrame, time: str = "received_ms", slot_ms: int = SLOT_MS) -> DataFrame:
    """slot_ms, proto (6, 17), dst_port, flows, packets, bytes."""
    c = _counts(df)
    t = F.col(time)
    x = df.where(t.isNotNull() & F.col("proto").isin(6, 17) & F.col("dst_port").isNotNull())
    return x.groupBy((t - F.pmod(t, F.lit(slot_ms))).alias("slot_ms"), "proto", "dst_port").agg(*[F.sum(v).alias(n) for n, v in c.items()])


def rolling_ports(slots: DataFrame, slot_ms: int = SLOT_MS) -> DataFrame:
    """From ports(): adds the sums of the 24 hours that end with each slot. A window per port holds its slots, not its flows."""
    w = Window.partitionBy("proto", "dst_port").orderBy("slot_ms").rangeBetween(slot_ms - DAY_MS, 0)
    return slots.withColumns({f"{n}_day": F.sum(n).over(w) for n in ("flows", "packets", "bytes")})


def top_ports(slots: DataFrame, n: int = 10) -> DataFrame:
    """The n ports with most flows, packets and bytes, for each protocol: type, proto, rank, dst_port, value."""
    kinds = ("flows", "packets", "bytes")
    g = slots.groupBy("proto", "dst_port").agg(*[F.sum(k).alias(k) for k in kinds])
    x = g.select("proto", "dst_port", F.explode(F.array(*[F.struct(F.lit(k).alias("type"), F.col(k).alias("value")) for k in kinds])).alias("x")).select("x.type", "proto", "dst_port", "x.value")
    w = Window.partitionBy("type", "proto").orderBy(F.col("value").desc(), "dst_port")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def profile(df: DataFrame, channels: dict[str, str], slot_ms: int = SLOT_MS, time: str = "received_ms") -> DataFrame:
    """channel, slot_ms and the totals of class_totals() of the flows that pass the channel's filter; one scan for all channels.

    A flow counts in each channel that it passes. Channels without a flow in a slot have no row there.
    """
    t = F.col(time)
    hits = F.filter(F.array(*[F.when(compile_filter(f, df), F.lit(n)) for n, f in channels.items()]), lambda x: x.isNotNull())
    x = df.where(t.isNotNull()).withColumn("channel", F.explode(hits))
    return x.groupBy("channel", (t - F.pmod(t, F.lit(slot_ms))).alias("slot_ms")).agg(*class_totals(df))


def line_protocol(totals: DataFrame, measurement: str, tags: list[str]) -> DataFrame:
    """Rows of totals as lines of the time series line protocol: measurement,tag=... field=...i time."""
    fields = [c for c in totals.columns if c not in tags and c != "slot_ms"]
    clean = lambda c: F.regexp_replace(F.col(c).cast("string"), "([ ,=])", r"\\$1")
    head = F.concat(F.lit(measurement), *[F.concat(F.lit(f",{t}="), clean(t)) for t in tags])
    body = F.concat_ws(",", *[F.concat(F.lit(f"{f}="), F.col(f).cast("string"), F.lit("i")) for f in fields])
    return totals.select(F.concat_ws(" ", head, body, (F.col("slot_ms") * 1_000_000).cast("string")).alias("value"))


def sequence_gaps(packets: DataFrame, source: str, sequence: str, count: str, order: str, modulus: int = 2**32, slot: int = SLOT_MS) -> DataFrame:
    """source, packets, failures, lost: a packet whose sequence number isn't the last one plus what the last packet held is a failure.

    Packets are compared with the one before within slots of `order`, and first packets of slots with the last one of the slot before:
    a window holds one slot of a source, or one row per slot, never all packets of a source. Packets at the same time are taken by
    their sequence number.
    """
    x = packets.select(F.col(source).alias("_src"), F.floor(F.col(order) / slot).alias("_slot"), F.col(sequence).alias("_s"), F.col(count).alias("_n"), F.struct(F.col(order).alias("o"), F.col(sequence).alias("s")).alias("_o"))
    last = F.struct("_s", "_n")
    inside = x.select("_src", "_s", F.lag(last).over(Window.partitionBy("_src", "_slot").orderBy("_o")).alias("_p"))
    ends = x.groupBy("_src", "_slot").agg(F.min_by("_s", "_o").alias("_s"), F.max_by(last, "_o").alias("_l"), F.count(F.lit(1)).alias("_k"))
    between = ends.select("_src", "_s", F.lag("_l").over(Window.partitionBy("_src").orderBy("_slot")).alias("_p"), "_k")
    steps = inside.where("_p is not null").withColumn("_k", F.lit(0).cast("long")).unionByName(between)
    gap = F.when(F.col("_p").isNotNull(), F.pmod(F.col("_s") - F.col("_p._s") - F.col("_p._n"), F.lit(modulus)))
    ahead = (gap > 0) & (gap < modulus // 2)
    g = steps.groupBy("_src").agg(F.sum("_k").alias("packets"), F.count_if(gap != 0).alias("failures"), F.coalesce(F.sum(F.when(ahead, gap)), F.lit(0).cast("long")).alias("lost"))
    return g.withColumnRenamed("_src", source)


def exporters(df: DataFrame) -> DataFrame:
    """exporter_id, versions, engines and samplers seen, and flows, packets, bytes, first and last arrival of each exporter."""
    zero = F.lit(0).cast("long")
    few = lambda c, n: F.array_sort(F.collect_set(c)).alias(n)
    return df.groupBy("exporter_id").agg(
        few(field(df, "nf_version"), "versions"), few(F.struct(field(df, "engine_type").alias("type"), field(df, "engine_id").alias("id")), "engines"), few(field(df, "selector_id"), "samplers"),
        F.count(F.lit(1)).alias("flows"), F.sum(F.coalesce(field(df, "in_packets"), zero)).alias("packets"), F.sum(F.coalesce(field(df, "in_bytes"), zero)).alias("bytes"), F.min("received_ms").alias("first_received_ms"), F.max("received_ms").alias("last_received_ms"),
    )


def extensions(df: DataFrame) -> DataFrame:
    """extension, n: records that have each extension (any of its columns), those that none has included."""
    from functools import reduce

    of: dict[str, list[str]] = {}
    for c, e in EXTENSION_OF.items():
        of.setdefault(e, []).extend([c] if c in df.columns else [])
    counts = {e: F.count_if(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in cs])) if cs else F.lit(0).cast("long") for e, cs in of.items()}
    one = df.agg(F.count(F.lit(1)).alias("_all"), *[n.alias(e) for e, n in counts.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(e).alias("extension"), F.col(e).alias("n")) for e in counts])).alias("x")).select("x.*")

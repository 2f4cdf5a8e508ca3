"""Queries that send all flows through a carrier and back: exporter packets and flow files. What comes out is compared with the flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.flowview import flows

_COMMON = ["src4", "dst4", "src_port + dst_port", "tcp_flags", "src_tos", "input_if", "output_if", "src_mask", "dst_mask"]
_NAMES = ["src4", "dst4", "ports", "tcp_flags", "src_tos", "input_if", "output_if", "src_mask", "dst_mask"]
_WHOLE = ["first_ms", "last_ms", "in_packets", "in_bytes", "src_as", "dst_as", "fwd_status", "cnt_flows"]


def _sums(df: DataFrame, keys: list, more: list[str]) -> DataFrame:
    """Sums of the columns; what is NULL counts as 0, for carriers have no other way to say it."""
    zero = F.lit(0).cast("long")
    one = {n: F.coalesce(F.col(n).cast("long"), zero) for n in [*more, *(x for x in _NAMES if x != "ports")]}
    one["ports"] = F.coalesce(F.col("src_port").cast("long"), zero) + F.coalesce(F.col("dst_port").cast("long"), zero)
    least = [F.min(F.hex(c)).alias(f"{c}_min") for c in ("src6", "dst6")]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("src6").alias("n6"), *least, *[F.sum(v).alias(n) for n, v in one.items()])


def _sums_sql(keys: str, more: dict[str, str], where: str = "true") -> str:
    cols = {n: f"coalesce({x}, 0)" for n, x in zip(_NAMES, _COMMON) if n != "ports"} | {"ports": "coalesce(src_port, 0) + coalesce(dst_port, 0)"} | {n: f"coalesce({x}, 0)" for n, x in more.items()}
    return f"select {keys}, count(*) n, count(src6) n6, min(hex(src6)) src6_min, min(hex(dst6)) dst6_min, " + ", ".join(f"cast(sum({x}) as bigint) {n}" for n, x in cols.items()) + f" from flows where {where} group by all"


def through_v5(spark: SparkSession, d: str) -> DataFrame:
    """Version 5 has room for IPv4 flows only, counters of 32 bits and AS numbers and interfaces of 16: larger ones are
    sent as the largest."""
    from freshet.sources import netflow

    back = netflow.decode_packets(netflow.to_packets(flows(spark, d), 5))
    return _sums(back, ["exporter_id", "proto"], ["in_packets", "in_bytes", "src_as", "dst_as"])


def through_v9(spark: SparkSession, d: str) -> DataFrame:
    from freshet.sources import netflow

    back = netflow.decode_packets(netflow.to_packets(flows(spark, d), 9))
    return _sums(back, ["exporter_id", "proto"], ["in_packets", "in_bytes", "src_as", "dst_as"])


def through_native(spark: SparkSession, d: str) -> DataFrame:
    from freshet.sources import netflow

    back = netflow.decode_raw_packets(netflow.to_packets(flows(spark, d), netflow.RAW_VERSION))
    return _sums(back, ["exporter_id", "proto"], _WHOLE)


def through_files(spark: SparkSession, d: str) -> DataFrame:
    from freshet.sources import flowfile

    back = flowfile.from_files(flowfile.to_files(flows(spark, d)))
    return _sums(back, [F.coalesce(F.nullif(F.col("ident"), F.lit("")), F.lit("none")).alias("ident"), "exporter_id"], _WHOLE)


def queries() -> dict:
    return {f.__name__: f for f in (through_v5, through_v9, through_native, through_files)}


def oracle_sql() -> dict[str, str]:
    narrow = {n: f"least(coalesce({n}, 0), {top})" for top, names in ((4294967295, ("in_packets", "in_bytes")), (65535, ("src_as", "dst_as", "input_if", "output_if"))) for n in names}
    wide = {n: n for n in ("in_packets", "in_bytes", "src_as", "dst_as")}
    by_proto = "exporter_id, coalesce(proto, 0)::smallint proto"
    return {
        "through_v5": _sums_sql(by_proto, narrow, "src6 is null"), "through_v9": _sums_sql(by_proto, wide), "through_native": _sums_sql(by_proto, {n: n for n in _WHOLE}),
        "through_files": _sums_sql("coalesce(nullif(ident, ''), 'none') ident, exporter_id", {n: n for n in _WHOLE}),
    }

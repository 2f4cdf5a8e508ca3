"""Flow tables for queries: the flow records themselves, and a wide view of the order lines that fills columns which the records lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from freshet.util import table

# (column, Spark and DuckDB expression): whole numbers only, so that both engines agree bit for bit.
_COMMON = """
l_orderkey * 8 + l_linenumber as rec_no
cast(1 + l_suppkey % 5 as int) as exporter_id
10000000000 * 0 + l_orderkey % 86400 * 1000 + 1700000000000 as first_ms
10000000000 * 0 + l_orderkey % 86400 * 1000 + 1700000000000 + (l_linenumber - 1) * 1000 as last_ms
l_orderkey % 86400 * 1000 + 1700000060000 as received_ms
cast(floor(l_quantity) as bigint) as in_packets
cast(floor(l_extendedprice) as bigint) as in_bytes
167772160 + l_suppkey as src4
2886729728 + l_partkey as dst4
cast(1024 + l_orderkey % 64000 as int) as src_port
cast(case l_partkey % 5 when 0 then 53 when 1 then 80 when 2 then 123 when 3 then 443 else 8080 end as int) as dst_port
cast(case l_orderkey % 4 when 0 then 17 when 1 then 1 else 6 end as smallint) as proto
cast(case l_returnflag when 'A' then 2 when 'N' then 16 else 18 end as smallint) as tcp_flags
cast(l_linenumber * 4 as smallint) as src_tos
case when l_partkey % 7 <> 0 then 64512 + l_suppkey % 100 end as src_as
case when l_partkey % 7 <> 0 then 64512 + l_partkey % 100 end as dst_as
l_suppkey % 8 as input_if
l_partkey % 8 as output_if
cast(16 + l_suppkey % 9 as smallint) as src_mask
cast(16 + l_partkey % 9 as smallint) as dst_mask
cast(l_linenumber % 2 as smallint) as dir
case when l_orderkey % 2 = 0 then cast(floor(l_quantity) as bigint) * 2 end as out_packets
case when l_orderkey % 2 = 0 then cast(floor(l_extendedprice) as bigint) * 3 end as out_bytes
case when l_orderkey % 2 = 0 then l_orderkey % 3 end as cnt_flows
l_suppkey % 16 as src_vlan
l_partkey % 16 as dst_vlan
1000 + l_suppkey % 32 as in_src_mac
2000 + l_partkey % 32 as out_dst_mac
case when l_linenumber = 1 then 167772160 + l_partkey % 50 end as x_src4
case when l_linenumber = 1 then cast(1024 + l_partkey % 100 as int) end as x_src_port
l_orderkey % 1000 as client_us
l_orderkey % 500 as server_us
case when l_linenumber = 2 then cast(l_suppkey % 6 as smallint) end as fw_event
cast(32 + l_suppkey % 32 as smallint) as min_ttl
cast(64 + l_suppkey % 64 as smallint) as max_ttl
"""
_EXPRS = [x for x in _COMMON.strip().splitlines()]
_MPLS = {"spark": "array((l_suppkey % 100) * 16, (l_partkey % 100) * 16 + 1) as mpls", "duckdb": "[(l_suppkey % 100) * 16, (l_partkey % 100) * 16 + 1] as mpls"}


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as flow records."""
    return table(spark, sf_dir, "lineitem").selectExpr(*_EXPRS, _MPLS["spark"])


WIDE_SQL = "select " + ", ".join([*_EXPRS, _MPLS["duckdb"]]) + " from lineitem"


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "flows")

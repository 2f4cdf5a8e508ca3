"""Queries p3, p4, p5 and p7 over the flow tables, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators import intervals, lateness, sessions, skew
from freshet.util import has_time, table

SESSION_GAP_MS = 1_800_000
GAP_LIMIT_MS = 43_200_000
TUNNEL_PROTOCOLS = (47, 50)
PERIOD_MS, ON_TIME_MS, CUTOFF_MS, IDLE_MS = 300_000, 60_000, 7_200_000, 1_800_000
HEAVY_SHARE = 0.04


def timed(flows: DataFrame) -> DataFrame:
    return flows.where(has_time(F.col("first_ms"), F.col("last_ms")))


def p3_sessions(spark: SparkSession, d: str) -> DataFrame:
    f = timed(table(spark, d, "flows"))
    return sessions.sessionize(f, "src4", "first_ms", "last_ms", SESSION_GAP_MS, {"sum_packets": "in_packets", "sum_bytes": "in_bytes"}).drop("session_no").withColumnRenamed("n_events", "n_flows")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    f = timed(table(spark, d, "flows"))
    s = sessions.sessionize(f, "src4", "first_ms", "last_ms", SESSION_GAP_MS)
    return s.select("src4", F.col("session_start").alias("session_start_ms"), F.col("session_end").alias("session_end_ms"))


def _tunnels(spark: SparkSession, d: str) -> DataFrame:
    return timed(table(spark, d, "flows")).where(F.col("proto").isin(*TUNNEL_PROTOCOLS))


def p4_periods(spark: SparkSession, d: str) -> DataFrame:
    return intervals.periods(_tunnels(spark, d), "src4", "first_ms", "last_ms")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    g = intervals.gaps(_tunnels(spark, d), "src4", "first_ms", "last_ms")
    return g.where(F.col("gap_end") - F.col("gap_start") <= GAP_LIMIT_MS).select("src4", F.col("gap_start").alias("gap_start_ms"), F.col("gap_end").alias("gap_end_ms"))


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    return timed(table(spark, d, "flows")).withColumn("end_ms", F.greatest("first_ms", "last_ms"))


def p5_periods(spark: SparkSession, d: str) -> DataFrame:
    return lateness.period_results(_arrivals(spark, d), "exporter_id", "end_ms", "received_ms", PERIOD_MS, ON_TIME_MS, CUTOFF_MS, {"packets": "in_packets", "bytes": "in_bytes"}, IDLE_MS).withColumnRenamed("period_start", "period_start_ms")


def p5_closures(spark: SparkSession, d: str) -> DataFrame:
    return lateness.closures(_arrivals(spark, d), "exporter_id", "end_ms", "received_ms", PERIOD_MS, CUTOFF_MS, IDLE_MS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    r = lateness.period_results(_arrivals(spark, d), "exporter_id", "end_ms", "received_ms", PERIOD_MS, ON_TIME_MS, CUTOFF_MS, idle_timeout=IDLE_MS)
    return lateness.verdicts(r, "exporter_id").withColumnRenamed("period_start", "period_start_ms")


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "flows").select("exporter_id", "src4", "in_packets", "in_bytes")
    pair = lambda n: F.struct(F.lit(n).alias("field"), F.col(n).cast("long").alias("key"))
    return f.select("in_packets", "in_bytes", F.explode(F.array(pair("exporter_id"), pair("src4"))).alias("x")).select("x.field", "x.key", "in_packets", "in_bytes")


def p7_totals(spark: SparkSession, d: str) -> DataFrame:
    aggs = [skew.count_rows("n_flows"), skew.Partial("sum_packets", F.sum("in_packets")), skew.Partial("sum_bytes", F.sum("in_bytes")), skew.Partial("max_bytes", F.max("in_bytes"), "max")]
    return skew.salted_aggregate(_keyed(spark, d), ["field", "key"], aggs, per=["field"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys with their share of all rows. Every row has an exporter_id, NULL or not, so the counts of that field add up to all rows; said in
    one condition that both uses share, so the totals are made once."""
    totals = skew.salted_aggregate(_keyed(spark, d).select("field", "key"), ["field", "key"], [skew.count_rows()], per=["field"])
    totals = totals.where("n_rows > 0")
    n = totals.agg(F.sum(F.when(F.col("field") == "exporter_id", F.col("n_rows")))).scalar()
    # in whole numbers: 4 % of n rows or more
    return totals.where(F.coalesce(F.col("key").isNotNull() & (F.col("n_rows") * 100 >= n * round(HEAVY_SHARE * 100)), F.lit(False))).select("field", "key")


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p3_sessions, p4_found, p4_periods, p5_found, p5_periods, p5_closures, p7_found, p7_totals)}


_TIMED = "first_ms is not null and last_ms is not null and first_ms <> 0 and last_ms <> 0"
_SESSIONS = f"""
with f as (select src4, least(first_ms, last_ms) s, greatest(first_ms, last_ms) e, coalesce(in_packets, 0) p, coalesce(in_bytes, 0) b
           from flows where {_TIMED} and src4 is not null),
m as (select *, max(e) over (partition by src4 order by s, e rows between unbounded preceding and 1 preceding) last_e from f),
n as (select *, sum(case when last_e is null or s > last_e + {SESSION_GAP_MS} then 1 else 0 end)
         over (partition by src4 order by s, e rows unbounded preceding) no from m)
"""
_PERIODS = f"""
with f as (select src4, least(first_ms, last_ms) s, greatest(first_ms, last_ms) e from flows
           where {_TIMED} and src4 is not null and proto in (47, 50)),
m as (select *, max(e) over (partition by src4 order by s, e rows between unbounded preceding and 1 preceding) last_e from f),
n as (select *, sum(case when last_e is null or s > last_e then 1 else 0 end) over (partition by src4 order by s, e rows unbounded preceding) no from m),
p as (select src4, no, min(s) s, max(e) e from n group by src4, no)
"""
_LATE = f"""
with f as (select exporter_id, greatest(first_ms, last_ms) // {PERIOD_MS} * {PERIOD_MS} p, received_ms r, coalesce(in_packets, 0) k, coalesce(in_bytes, 0) b
           from flows where {_TIMED} and received_ms is not null),
g as (select *, case when r <= p + {PERIOD_MS + ON_TIME_MS} then 0 when r <= p + {PERIOD_MS + CUTOFF_MS} then 1 else 2 end c from f)
"""
# when every source that was heard of before the bound b has released it
_CLOSED = f"""
, d as (select distinct exporter_id, r from f), e as (select distinct exporter_id from f), q as (select distinct p, p + {PERIOD_MS + CUTOFF_MS} b from f),
h as (select q.p, q.b, d.exporter_id, d.r last_r from (q cross join e) qe (p, b, exporter_id) asof join d on qe.exporter_id = d.exporter_id and qe.b > d.r join q on q.p = qe.p),
k as (select h.p, max(least(coalesce(d.r, 9000000000000000000), greatest(h.b, h.last_r + {IDLE_MS}))) close_at, count(*) n_sources
      from h asof left join d on h.exporter_id = d.exporter_id and h.b <= d.r group by h.p),
z as (select q.p, coalesce(close_at, q.b) close_at, coalesce(n_sources, 0) n_sources from q left join k on k.p = q.p)
"""


def oracle_sql() -> dict[str, str]:
    kept = "case when c < 2 then {0} else 0 end"
    return {
        "p3_found": _SESSIONS + "select src4, min(s) session_start_ms, max(e) session_end_ms from n group by src4, no",
        "p3_sessions": _SESSIONS + "select src4, min(s) session_start, max(e) session_end, max(e) - min(s) duration, count(*) n_flows, cast(sum(p) as bigint) sum_packets, cast(sum(b) as bigint) sum_bytes from n group by src4, no",
        "p4_found": _PERIODS + f"select src4, e gap_start_ms, nx gap_end_ms from (select src4, e, lead(s) over (partition by src4 order by s) nx from p) where nx - e <= {GAP_LIMIT_MS}",
        "p4_periods": _PERIODS + "select src4, s period_start, e period_end from p",
        "p5_found": _LATE + "select distinct exporter_id, p period_start_ms, case c when 1 then 'corrected' else 'dropped' end verdict from g where c > 0",
        "p5_periods": _LATE + _CLOSED
        + "select exporter_id, p period_start_ms, count(*) filter (where c = 0) n_first, count(*) filter (where c < 2) n_final, count(*) filter (where c = 1) n_late, count(*) filter (where c = 2) n_dropped, "
        + ", ".join(f"cast(sum(case when {w} then {v} else 0 end) as bigint) {n}_{x}" for v, n in (("k", "packets"), ("b", "bytes")) for w, x in (("c = 0", "first"), ("c < 2", "final"), ("c = 2", "dropped")))
        + ", min(case when c = 2 then r end) closed_at, any_value(close_at) close_at from g join z using (p) group by exporter_id, p",
        "p5_closures": _LATE + _CLOSED + "select p period_start, close_at, n_sources from z",
        "p7_found": "with k as (select 'exporter_id' field, cast(exporter_id as bigint) as key from flows union all select 'src4', src4 from flows) select field, key from k where key is not null group by field, key having 100 * count(*) >= 4 * (select count(*) from flows)",
        "p7_totals": "with k as (select 'exporter_id' field, cast(exporter_id as bigint) as key, in_packets, in_bytes from flows union all select 'src4', src4, in_packets, in_bytes from flows) select field, key, count(*) n_flows, cast(sum(in_packets) as bigint) sum_packets, cast(sum(in_bytes) as bigint) sum_bytes, max(in_bytes) max_bytes from k group by field, key",
    }

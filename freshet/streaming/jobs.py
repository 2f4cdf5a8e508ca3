"""Continuous jobs over a stream of flow records: rotation into slots, metrics, port sums, profiles.

Every job takes a streaming DataFrame of the flow schema (from decoded packets, files or a queue) and gives a started query or a
streaming DataFrame. Writes are made once per micro-batch and batch number, so a batch that is run again after a loss leaves no copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from freshet.filterlang.compiler import apply_filter
from freshet.operators.summary import class_totals, profile
from freshet.sources.files import with_partitions


def _query(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str | None) -> StreamingQuery:
    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def rotate(stream: DataFrame, path: str, checkpoint: str, every: str | None = "5 minutes", hook: Callable[[list[tuple[str, str]]], None] | None = None) -> StreamingQuery:
    """Appends arriving flows below source=/slot=/batch=. A slot holds what arrived in it, however late it is by its own times.

    `hook` is called after each batch with the (source, slot) pairs that were written: a list of slots, not of flows.
    """

    def each(df: DataFrame, batch: int) -> None:
        x = store(df, path, batch)
        if hook:
            hook(sorted((r[0], r[1]) for r in x.select("source", "slot").distinct().collect()))

    return _query(stream, each, checkpoint, every)


def store(df: DataFrame, path: str, batch: int) -> DataFrame:
    """Writes one batch below source=/slot=/batch=; a repeated batch replaces its own folders only. Gives the rows with their folders."""
    x = with_partitions(df).withColumn("batch", F.lit(batch))
    x.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "slot", "batch").parquet(path)
    return x


def event_time(stream: DataFrame, delay: str = "2 hours", time: str = "received_ms") -> DataFrame:
    """Adds `ts` with a watermark."""
    return stream.withColumn("ts", F.timestamp_millis(F.col(time))).withWatermark("ts", delay)


def metrics(stream: DataFrame, every: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """Counters by protocol class for each minute, ident and exporter."""
    x = event_time(stream, delay)
    g = x.groupBy(F.window("ts", every), F.coalesce(F.nullif(F.col("ident"), F.lit("")), F.lit("none")).alias("source"), "exporter_id").agg(*class_totals(stream))
    return g.select((F.unix_millis("window.start")).alias("slot_ms"), *[c for c in g.columns if c != "window"])


def port_sums(stream: DataFrame, length: str = "24 hours", slide: str | None = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Flows, packets and bytes of TCP and UDP destination ports over sliding windows."""
    x = event_time(stream, delay).where(F.col("proto").isin(6, 17))
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    zero = F.lit(0).cast("long")
    g = x.groupBy(w, "proto", "dst_port").agg(F.count(F.lit(1)).alias("records"), F.sum(F.coalesce("in_packets", zero)).alias("packets"), F.sum(F.coalesce("in_bytes", zero)).alias("bytes"))
    return g.select(F.unix_millis("window.end").alias("until_ms"), "proto", "dst_port", "records", "packets", "bytes")


def profiles(stream: DataFrame, channels: dict[str, str], path: str, checkpoint: str, every: str | None = "5 minutes", keep_flows: bool = True) -> StreamingQuery:
    """Writes each batch's totals per channel to path/_totals, and the flows of each channel to path/channel=name."""

    def each(df: DataFrame, batch: int) -> None:
        df = df.persist()  # n filters read the same batch
        try:
            profile(df, channels).withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/_totals")
            if keep_flows:
                for name, text in channels.items():
                    apply_filter(df, text).withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/channel={name}")
        finally:
            df.unpersist()

    return _query(stream, each, checkpoint, every)

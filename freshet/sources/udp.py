"""Datagrams from exporters: a collector that spools them, and the stream over the spool.

The collector writes what arrived within a few seconds as one Parquet file of (exporter_id, sender, received_ms, payload), under a hidden name
that is renamed when the file is whole. The stream reads the spool as any folder of files, so a job that is started again after a loss reads
the same packets again, and several collectors may fill one spool.
"""

from __future__ import annotations

import ipaddress
import socket
import threading
import time
import uuid
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SPOOL = T.StructType([T.StructField("exporter_id", T.IntegerType()), T.StructField("sender", T.StringType()), T.StructField("received_ms", T.LongType()), T.StructField("payload", T.BinaryType())])
_ARROW = pa.schema([("exporter_id", pa.int32()), ("sender", pa.string()), ("received_ms", pa.int64()), ("payload", pa.binary())])


class Collector:
    """Listens on one UDP port. `exporters` maps sender addresses (or prefixes) to ids; others get `unknown` or, if that is None, are dropped.
    Every packet that is kept is also sent on, unchanged, to each (host, port) of `repeat_to`. The spool is a folder that the jobs can read."""

    def __init__(self, spool: str, host: str = "0.0.0.0", port: int = 9995, exporters: dict[str, int] | None = None, unknown: int | None = 0, every_s: float = 5.0, max_packets: int = 50_000, repeat_to: list[tuple[str, int]] | None = None) -> None:
        self.repeat_to = [socket.getaddrinfo(h, p, type=socket.SOCK_DGRAM)[0] for h, p in repeat_to or []]
        self.senders = {f: socket.socket(f, socket.SOCK_DGRAM) for f in {x[0] for x in self.repeat_to}}
        self.spool, self.every, self.most, self.unknown = Path(spool), every_s, max_packets, unknown
        self.spool.mkdir(parents=True, exist_ok=True)
        nets = [(ipaddress.ip_network(k, strict=False), v) for k, v in (exporters or {}).items()]
        self.nets = sorted(nets, key=lambda n: -n[0].prefixlen)
        family = socket.AF_INET6 if ":" in host else socket.AF_INET
        self.socket = socket.socket(family, socket.SOCK_DGRAM)
        self.socket.bind((host, port))
        self.socket.settimeout(0.2)
        self.port = self.socket.getsockname()[1]
        self.held: list[tuple] = []
        self.known: dict[str, int | None] = {}
        self.stopped = threading.Event()
        self.thread: threading.Thread | None = None

    def exporter(self, sender: str) -> int | None:
        if sender not in self.known:
            ip = ipaddress.ip_address(sender)
            self.known[sender] = next((v for n, v in self.nets if ip.version == n.version and ip in n), self.unknown)
        return self.known[sender]

    def flush(self) -> None:
        if not self.held:
            return
        name = uuid.uuid4().hex
        cols = [pa.array(c, f.type) for c, f in zip(zip(*self.held), _ARROW)]
        pq.write_table(pa.Table.from_arrays(cols, schema=_ARROW), self.spool / f".{name}.parquet")
        (self.spool / f".{name}.parquet").rename(self.spool / f"{name}.parquet")
        self.held = []

    def run(self) -> None:
        due = time.monotonic() + self.every
        while not self.stopped.is_set():
            try:
                data, address = self.socket.recvfrom(65535)
                e = self.exporter(address[0])
                if e is not None:
                    self.held.append((e, address[0], int(time.time() * 1000), data))
                    for to in self.repeat_to:
                        self.senders[to[0]].sendto(data, to[4])
            except TimeoutError:
                pass
            if time.monotonic() >= due or len(self.held) >= self.most:
                self.flush()
                due = time.monotonic() + self.every
        self.flush()
        for s in (self.socket, *self.senders.values()):
            s.close()

    def __enter__(self) -> Collector:
        self.thread = threading.Thread(target=self.run, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.stopped.set()
        if self.thread:
            self.thread.join()


def stream(spark: SparkSession, spool: str, max_files: int | None = None) -> DataFrame:
    """Streaming packets of a spool."""
    r = spark.readStream.schema(SPOOL)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(spool)


def _state_folders(spark: SparkSession, path: str) -> tuple[object, dict[int, object]]:
    """The file system of `path` and the whole batch folders in it by number."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
    return fs, {int(p.getName().removeprefix("batch=")): p for p in found if p.getName().startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}


def decoded(packets: DataFrame, sflow: bool = False):
    """Function for foreachBatch that hands each batch's flow records on: decoded(stream)(lambda flows, batch: ...).

    Templates and samplers of NetFlow 9 and IPFIX are kept per exporter and domain in the checkpoint's folder `templates`, a table for each
    batch. A batch starts from the table of the last one before it, so one that is run again after a loss decodes the same.
    """
    from freshet.sources.netflow import KNOWN, decode_packets, decode_raw_packets, stream_state
    from freshet.sources.sflow import decode_datagrams

    def start(each, checkpoint: str, every: str | None = "5 minutes"):
        path = f"{checkpoint}/templates"

        def run(df: DataFrame, batch: int) -> None:
            if sflow:
                each(decode_datagrams(df), batch)
                return
            spark = df.sparkSession
            fs, folders = _state_folders(spark, path)
            before = max((b for b in folders if b < batch), default=None)
            known = spark.read.schema(KNOWN).parquet(folders[before].toString()) if before is not None else None
            each(decode_packets(df, known).unionByName(decode_raw_packets(df)), batch)
            stream_state(df, known).write.mode("overwrite").parquet(f"{path}/batch={batch}")
            for b, p in folders.items():
                if before is not None and b < before:
                    fs.delete(p, True)

        w = packets.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()

    return start

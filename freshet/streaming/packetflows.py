"""Streaming form of packet assembly: flows per conversation with timers for the inactive and active timeout."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from freshet.sources.pcap import FLOWS, KEY, Assembler, _pair, single_packet


def assemble(packets: DataFrame, active_s: int = 300, inactive_s: int = 60, delay: str = "10 seconds") -> DataFrame:
    """Flows of a stream of packets: emitted when they end. Packets later than `delay` behind the newest may come after their flow's end
    and start another. DNS and ICMP packets are left to the batch form's rule: each is a flow, see single_packet()."""
    cols = [*KEY, "ts_us", "tcp_flags", "bytes", "ttl", "tos", "vlan", "payload"]
    x = packets.where(F.col("ts_us").isNotNull() & F.col("proto").isNotNull() & ~single_packet())
    x = x.select(*cols, _pair().alias("pair"), F.timestamp_micros("ts_us").alias("ts")).withWatermark("ts", delay)
    names = [f.name for f in FLOWS]

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        a = Assembler(active_s * 1_000_000, inactive_s * 1_000_000)
        if state.exists:
            a.open = pickle.loads(state.get[0])
        if state.hasTimedOut:
            a.expire(state.getCurrentWatermarkMs() * 1000)
        else:
            rows = pd.concat(list(frames)).sort_values("ts_us", kind="stable")
            for r in rows[cols].astype(object).where(rows[cols].notna(), None).to_dict("records"):
                a.packet({k: bytes(v) if isinstance(v, (bytes, bytearray)) else int(v) if isinstance(v, float) else v for k, v in r.items()})
        if a.open:
            state.update((pickle.dumps(a.open),))
            ends = min(min(f["last"] + a.inactive, f["first"] + a.active) for f in a.open.values()) // 1000 + 1
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if a.ready:
            yield pd.DataFrame(a.take(), columns=names).astype(object)

    return x.groupBy("pair").applyInPandasWithState(update, FLOWS, "open binary", "append", GroupStateTimeout.EventTimeTimeout)

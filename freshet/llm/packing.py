"""Filling containers of fixed capacity: harmonic packing with a backfill.

Items are classed by how many of their kind fit: class k holds sizes in (C/(k+1), C/k], and a container of class k takes exactly k of
them, whichever they are. So every worker fills its containers on its own, by counting. Items of at most C/CLASSES go by running total
into containers of their own kind. What a worker cannot complete it leaves over (fewer than k items per class); the leftovers of
many workers are packed together in a second round, and what is incomplete there largest item first.

Backfill: harmonic containers of large items keep free space by design (up to half for items just above C/2). Before smaller items are
packed among themselves, the largest that still fit are put there. An item is never split unless it alone exceeds the capacity; then
its full parts fill containers and the rest is an item.

Scale: texts are read once and only ids and sizes are shuffled. Workers are hash buckets of the parts of items, about ITEMS_PER_WORKER
each, so their number grows with the table and no worker's group does; part p of the items is spread over as many more of them as there
can be parts like it. Which worker an item goes to depends on the item alone, so containers don't change with the files' splits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.util import c

CLASSES = 32
ITEMS_PER_WORKER = 50_000
WORKERS_PER_ROUND = 64


def token_count(text: Column) -> Column:
    """Tokens of the public byte-level tokenizer of ByT5: one per UTF-8 byte and one end token."""
    return F.octet_length(text).cast("long") + 1


def pack(sizes: np.ndarray, cap: int, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, for each bin whether it is complete). sizes are in 0..cap and falling. A bin of class k is complete if it has
    its k items; one of small items if another was begun after it."""
    n = len(sizes)
    place = np.full(n, -1, np.int64)
    free_next = np.arange(n + 1)  # next item at or after this one that isn't packed

    def find(i: int) -> int:
        root = i
        while free_next[root] != root:
            root = free_next[root]
        while free_next[i] != root:
            free_next[i], i = root, free_next[i]
        return int(root)

    complete: list[bool] = []
    small = np.searchsorted(-sizes, -(cap // classes), "left")  # first item of the smallest class
    rising = -sizes
    i = find(0)
    while i < small:
        k = int(cap // sizes[i])
        last_of_class = int(np.searchsorted(rising, -(cap // (k + 1)), "left"))
        room, taken, b = cap, 0, len(complete)
        while taken < k and i < last_of_class:
            place[i] = b
            room -= int(sizes[i])
            free_next[i] = i + 1
            taken += 1
            i = find(i + 1)
        complete.append(taken == k)
        if taken == k and room:
            j = find(max(int(np.searchsorted(rising, -room, "left")), i))
            while j < n:
                place[j] = b
                room -= int(sizes[j])
                free_next[j] = j + 1
                j = find(max(int(np.searchsorted(rising, -room, "left")), j + 1))
            i = find(i)
    rest = np.flatnonzero(place < 0)
    if len(rest):
        # a bin takes what begins within cap - (largest small item) of running total: it can't overflow
        width = max(cap - int(sizes[rest[0]]) + 1, 1)
        before = np.cumsum(sizes[rest]) - sizes[rest]
        no = np.unique(before // width, return_inverse=True)[1]
        place[rest] = len(complete) + no
        complete += [True] * int(no.max()) + [False]
    return place, np.array(complete, bool)


def finish(sizes: np.ndarray, place: np.ndarray, complete: np.ndarray, cap: int) -> np.ndarray:
    """place with the incomplete bins (fewer than k items of each class, some hundred items in all) packed anew, largest item first into
    the fullest bin that takes it."""
    loose = np.flatnonzero(~complete[place])
    room = np.empty(0, np.int64)
    out, base = place.copy(), len(complete)
    for i in loose:
        fits = np.flatnonzero(room >= sizes[i])
        if len(fits):
            b = int(fits[np.argmin(room[fits])])
        else:
            b, room = len(room), np.append(room, cap)
        room[b] -= sizes[i]
        out[i] = base + b
    return out


PACKED = "container_class string, cap long, id long, n_parts long, part long, size long, worker long, bin long, complete boolean"


def _round(x: DataFrame, last: bool) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id"], ascending=[False, True], kind="stable")
        sizes, cap = pdf["size"].to_numpy(np.int64), int(pdf["cap"].iloc[0])
        place, complete = pack(sizes, cap)
        done = complete[place] | last
        if last:
            place = finish(sizes, place, complete, cap)
        return pdf.assign(bin=place, complete=done)[[f.split()[0] for f in PACKED.split(", ")]]

    return x.groupBy("container_class", "cap", "worker").applyInPandas(one, PACKED)


def assign(items: DataFrame, item_id: str, size: str, containers: DataFrame, container_class: str, capacity: str) -> DataFrame:
    """container_class, item_id, part, n_parts, size, container_id: where each part of each item lies, for each class of containers.

    `containers` is a short fixed list of classes. Ids should be unique; rows of one id and size go to one worker, each packed for
    itself. Items whose id or size is NULL are left out; size 0 takes no space. An empty table fills no container. Classes whose capacity is NULL or below 1 are left out.
    """
    kinds = containers.where(c(capacity) >= 1).agg(F.collect_list(F.struct(c(container_class).alias("container_class"), c(capacity).cast("long").alias("cap")))).scalar()
    workers = F.greatest(F.ceil(items.groupBy().count().scalar() / F.lit(ITEMS_PER_WORKER)), F.lit(1).cast("long"))
    x = items.select(c(item_id).cast("long").alias("id"), c(size).cast("long").alias("size")).where("id is not null and size is not null")
    x = x.select("id", "size", F.explode(kinds).alias("k")).select("k.container_class", "k.cap", "id", "size")
    full = F.greatest(F.floor((F.col("size") - 1) / F.col("cap")).cast("long"), F.lit(0).cast("long"))
    x = x.withColumn("full", full).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))))
    # Parts 2^j - 1 .. 2^(j+1) - 2 have 2^j times as many workers, numbered from workers * 2^j on.
    lanes = workers * F.pow(F.lit(2), F.floor(F.log2(F.col("part") + 1))).cast("long")
    # a part of full size is packed like any other and fills a container by itself
    part_size = F.when(F.col("part") < F.col("full"), F.col("cap")).otherwise(F.col("size") - F.col("full") * F.col("cap"))
    rest = x.select("container_class", "cap", "id", (F.col("full") + 1).alias("n_parts"), "part", part_size.alias("size"), (F.pmod(F.xxhash64("id", "size", "part"), lanes) + lanes).alias("worker"))
    first = _round(rest, last=False)
    second = _round(first.where("not complete").withColumn("worker", F.floor(F.col("worker") / WORKERS_PER_ROUND)).drop("bin", "complete"), last=True)
    name = lambda r: F.concat_ws(":", "container_class", F.lit(r), F.col("worker"), F.col("bin"))
    cols = ["container_class", "id", "part", "n_parts", "size", "container_id"]
    return (
        first.where("complete").withColumn("container_id", name("first")).select(*cols)
        .unionByName(second.withColumn("container_id", name("second")).select(*cols))
        .withColumnRenamed("id", item_id)
    )


def fill(assigned: DataFrame, containers: DataFrame, container_class: str, capacity: str) -> DataFrame:
    """container_class, n_items, n_containers, tokens, fill (share of the capacity used)."""
    per = assigned.groupBy("container_class", "container_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    g = per.groupBy("container_class").agg(F.sum("n").alias("n_items"), F.count(F.lit(1)).alias("n_containers"), F.sum("size").alias("tokens"), F.max("size").alias("fullest"))
    return g.join(containers.select(c(container_class).alias("container_class"), c(capacity).alias("cap")), "container_class").select("container_class", "n_items", "n_containers", "tokens", "fullest", (F.col("tokens") / (F.col("n_containers") * F.col("cap"))).alias("fill"))

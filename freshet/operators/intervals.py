"""Continuous periods and gaps of overlapping intervals, by canonical dyadic blocks.

Times are mapped to cells so that closed intervals become half-open ones: [s, e] covers the cells 2s .. 2e. Intervals that share an
end point then share a cell; [1, 5] and [6, 9] stay one cell apart. A cell range is decomposed into canonical dyadic blocks
(block i of level l covers the cells i*2^l .. (i+1)*2^l - 1); blocks covered by an ancestor are removed, sibling pairs are merged
upward level by level, and what is left is coalesced where blocks touch.

Scale: blocks of up to 2^TILE_BITS cells are kept by tile, larger ones stay whole, so an interval costs at most two tiles and two blocks
for each level above them, however long it is: 50 years are some forty rows. Every map task canonicalises its own rows first (a
combiner: repeated and overlapping intervals of a hot key vanish here), then each (key, tile) is canonicalised once more after one
shuffle. A tile holds at most 2^(TILE_BITS-1) separate runs, whatever the number of rows, so no group grows without bound; a hot key's
tiles spread over all tasks. Only the first and last run of each tile and the larger blocks take part in the sweep over a whole key;
tiles that a larger block covers are found there and what lies within them is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.util import c

TILE_BITS = 23  # 2^23 half milliseconds: 70 minutes
CHUNK_ROWS = 200_000
SPACE_BITS = 40  # tiles that times may lie in: +-2^39, beyond 70 million years


def dyadic_blocks(group: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> list[np.ndarray]:
    """Canonical blocks of the half-open ranges [a, b) within a tile of 2^bits cells, by level, as codes group * 2^(bits-level) + index."""
    levels = []
    for level in range(bits + 1):
        odd_a, odd_b = (a & 1).astype(bool), (b & 1).astype(bool)
        levels.append(np.concatenate([(group[odd_a] << (bits - level)) + a[odd_a], (group[odd_b] << (bits - level)) + b[odd_b] - 1]))
        a, b = (a + 1) >> 1, b >> 1
        on = a < b
        group, a, b = group[on], a[on], b[on]
        if not len(a):
            break
    return levels


def without_covered(levels: list[np.ndarray]) -> list[np.ndarray]:
    """Removes repeated blocks and those that lie in a larger block. Blocks nest or are disjoint, so in order of start and falling
    size a block is covered exactly if some earlier one ends at or after its end."""
    start = np.concatenate([x << level for level, x in enumerate(levels)])
    level = np.concatenate([np.full(len(x), i, np.int64) for i, x in enumerate(levels)])
    order = np.lexsort((-level, start))
    start, level = start[order], level[order]
    end = start + (np.int64(1) << level)
    keep = np.ones(len(start), bool)
    keep[1:] = np.maximum.accumulate(end)[:-1] < end[1:]
    start, level = start[keep], level[keep]
    return [start[level == i] >> i for i in range(len(levels))]


def merged_upward(levels: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Replaces pairs of siblings by their parent, from the smallest blocks up."""
    out, rising = [], np.empty(0, np.int64)
    for level in range(bits + 1):
        x = np.sort(np.concatenate([levels[level] if level < len(levels) else np.empty(0, np.int64), rising]))
        pair = np.zeros(len(x), bool)
        if level < bits and len(x) > 1:
            pair[:-1] = ((x[:-1] & 1) == 0) & (x[1:] == x[:-1] + 1)
        rising = x[pair] >> 1
        gone = pair.copy()
        gone[1:] |= pair[:-1]
        out.append(x[~gone])
    return out


def coalesced(levels: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (group, a, b) of touching blocks."""
    start = np.concatenate([x << level for level, x in enumerate(levels)])
    end = start + np.concatenate([np.full(len(x), np.int64(1) << i, np.int64) for i, x in enumerate(levels)])
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != end[:-1]) | (start[1:] >> bits != start[:-1] >> bits)
    last = np.roll(first, -1)
    group = start[first] >> bits
    base = group << bits
    return group, start[first] - base, end[last] - base


def canonical_runs(group: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int = TILE_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint, non-touching runs that cover the same cells as the ranges [a, b) of each group, ordered by group and a."""
    if not len(a):
        return group, a, b
    return coalesced(merged_upward(without_covered(dyadic_blocks(group, a, b, bits)), bits), bits)


def _grouped(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Distinct (key, tile) of a table and each row's place among them. Sorted by neither; equal keys get equal places."""
    code, tile = _code(t), t.column("tile").to_numpy()
    tiles, tcode = np.unique(tile, return_inverse=True)
    both, first, place = np.unique(code * len(tiles) + tcode, return_index=True, return_inverse=True)
    return t.select(["k", "tile"]).take(pa.array(first)), place.astype(np.int64)


def _code(t: pa.Table) -> np.ndarray:
    return t.column("k").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _pieces(k: pa.Array, level: int, tile: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"k": k, "level": pa.array(np.full(len(tile), level, np.int32)), "tile": tile, "a": a, "b": b})


def _decomposed(t: pa.Table) -> pa.Table:
    """Intervals (k, s, e) as pieces within tiles (level 0: tile, cells a .. b of it) and larger blocks (level of 2^level tiles, number), both
    canonical among themselves. Tiles of blocks are counted from -2^(SPACE_BITS - 1)."""
    s, e = t.column("s").to_numpy(), t.column("e").to_numpy()
    size, k = np.int64(1) << TILE_BITS, t.column("k").combine_chunks()
    head, tail = s >> TILE_BITS, (e - 1) >> TILE_BITS
    more = np.flatnonzero(head < tail)
    long = np.flatnonzero(tail - head > 1)
    parts = [_pieces(k, 0, head, s - (head << TILE_BITS), np.minimum(e - (head << TILE_BITS), size)), _pieces(k.take(pa.array(more)), 0, tail[more], np.zeros(len(more), np.int64), e[more] - (tail[more] << TILE_BITS))]
    blocks = []
    if len(long):
        code, at = _code(t)[long], np.int64(1) << (SPACE_BITS - 1)
        key_of = np.zeros(code.max() + 1, np.int64)
        key_of[code] = long  # a row that has the key
        levels = merged_upward(without_covered(dyadic_blocks(code, head[long] + 1 + at, tail[long] + at, SPACE_BITS)), SPACE_BITS)
        for level, x in enumerate(levels):
            if len(x):
                keys, no, zero = k.take(pa.array(key_of[x >> (SPACE_BITS - level)])), x & ((np.int64(1) << (SPACE_BITS - level)) - 1), np.zeros(len(x), np.int64)
                if level:
                    blocks.append(_pieces(keys, level, no, zero, zero))
                else:
                    parts.append(_pieces(keys, 0, no - at, zero, zero + size))
    runs = _runs(pa.concat_tables(parts))
    return pa.concat_tables([_pieces(runs.column("k").combine_chunks(), 0, *(runs.column(x).to_numpy() for x in ("tile", "a", "b"))), *blocks])


def _runs(t: pa.Table) -> pa.Table:
    heads, place = _grouped(t)
    g, a, b = canonical_runs(place, t.column("a").to_numpy(), t.column("b").to_numpy())
    out = heads.take(pa.array(g))
    first = np.ones(len(g), bool)
    first[1:] = g[1:] != g[:-1]
    prev = np.where(first, -1, np.roll(b, 1))
    return pa.table({"k": out.column("k"), "tile": out.column("tile"), "a": a, "b": b, "prev_b": prev, "last": np.roll(first, -1)})


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: canonical pieces and blocks of what came so far, whenever enough rows are there."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for x in batches:
        held.append(x)
        rows += x.num_rows
        if rows >= CHUNK_ROWS:
            yield from _decomposed(pa.Table.from_batches(held)).combine_chunks().to_batches()
            held, rows = [], 0
    if rows:
        yield from _decomposed(pa.Table.from_batches(held)).combine_chunks().to_batches()


def _placed(t: pa.Table) -> pa.Table:
    """Whole groups (k, level, tile) as runs in cells of the whole axis: a, b, prev_b (of the run before it in the tile, NULL if none), edge
    (whether the run is its tile's first or last, or a block) and level."""
    import pyarrow.compute as pc

    low, high = t.filter(pc.equal(t.column("level"), 0)), t.filter(pc.greater(t.column("level"), 0))
    out = []
    if low.num_rows:
        r = _runs(low)
        tile, a, b, prev = (r.column(x).to_numpy() for x in ("tile", "a", "b", "prev_b"))
        base, has = tile << TILE_BITS, prev >= 0
        edge = ~has | r.column("last").to_numpy(zero_copy_only=False)
        out.append(pa.table({"k": r.column("k"), "level": pa.array(np.zeros(len(a), np.int32)), "tile": tile, "a": a + base, "b": b + base, "prev_b": pa.array(prev + base, mask=~has), "edge": edge}))
    if high.num_rows:
        high = high.select(["k", "level", "tile"]).group_by(["k", "level", "tile"]).aggregate([])
        level, no = high.column("level").to_numpy().astype(np.int64), high.column("tile").to_numpy()
        first = (no << level) - (np.int64(1) << (SPACE_BITS - 1))
        a, b = first << TILE_BITS, (first + (np.int64(1) << level)) << TILE_BITS
        out.append(pa.table({"k": high.column("k"), "level": high.column("level"), "tile": no, "a": a, "b": b, "prev_b": pa.nulls(len(a), pa.int64()), "edge": np.ones(len(a), bool)}))
    return pa.concat_tables(out)


def _final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (k, level, tile): whole groups are canonicalised, the last, perhaps unfinished one waits for the next batch; what
    waits is canonical, so it is bounded by what a tile can hold."""
    held: pa.Table | None = None
    for x in batches:
        if not x.num_rows:
            continue
        t = pa.Table.from_batches([x])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows < CHUNK_ROWS:
            continue
        tile, level, k = held.column("tile").to_numpy(), held.column("level").to_numpy(), _code(held)
        change = np.flatnonzero((tile[1:] != tile[:-1]) | (level[1:] != level[:-1]) | (k[1:] != k[:-1]))
        if len(change):
            cut = int(change[-1]) + 1
            yield from _placed(held.slice(0, cut)).combine_chunks().to_batches()
            held = held.slice(cut)
        if held.num_rows >= CHUNK_ROWS and held.column("level")[0].as_py() == 0:
            r = _runs(held)
            held = _pieces(r.column("k").combine_chunks(), 0, *(r.column(x).to_numpy() for x in ("tile", "a", "b")))
    if held is not None and held.num_rows:
        yield from _placed(held).combine_chunks().to_batches()


def _tile_runs(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """k, level, tile, a, b, prev_b, edge: the runs of all tiles, and the larger blocks."""
    ktype = df.select(c(key)).schema[0].dataType
    limit = 1 << (SPACE_BITS + TILE_BITS - 3)
    iv = df.select(c(key).alias("k"), F.least(c(start), c(end)).cast("long").alias("s"), F.greatest(c(start), c(end)).cast("long").alias("e"), c(start).alias("_s"), c(end).alias("_e"))
    iv = iv.where("k is not null and _s is not null and _e is not null").where((F.col("s") > -limit) & (F.col("e") < limit))
    cells = iv.select("k", (F.col("s") * 2).alias("s"), (F.col("e") * 2 + 1).alias("e"))
    head = [T.StructField("k", ktype), T.StructField("level", T.IntegerType()), T.StructField("tile", T.LongType()), *(T.StructField(x, T.LongType()) for x in ("a", "b"))]
    local = cells.mapInArrow(_combine, T.StructType(head))
    by = ["k", "level", "tile"]
    return local.repartition(*by).sortWithinPartitions(*by).mapInArrow(_final, T.StructType([*head, T.StructField("prev_b", T.LongType()), T.StructField("edge", T.BooleanType())]))


def _swept(runs: DataFrame) -> DataFrame:
    """First and last runs of tiles, and blocks, each with the end of all that begins before it. A key's window holds two rows for each of
    its tiles and its blocks, not its rows."""
    before = Window.partitionBy("k").orderBy("a", F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return runs.where("edge").withColumn("reach", F.max("b").over(before))


def _uncovered(inner: DataFrame, swept: DataFrame) -> DataFrame:
    """Without what lies in tiles that a larger block covers: there the reach of all before goes beyond the tile's beginning."""
    covered = swept.where((F.col("level") == 0) & F.col("prev_b").isNull() & (F.col("reach") > F.call_function("shiftleft", F.col("tile"), F.lit(TILE_BITS))))
    return inner.join(covered.select("k", "tile").distinct(), ["k", "tile"], "left_anti")


def gaps(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """`key`, gap_start, gap_end: each gap between successive continuous periods of a key, from the end of one to the start of the next.

    Bounds count as part of an interval: intervals that share an end point are continuous. Bounds in the wrong order are swapped; an
    interval of no length is a period. Rows whose key or either bound is NULL, or with a bound of 2^60 or more either way, are left out.
    Repeated rows change nothing. An empty input gives an empty result. Other columns of the input are not looked at.
    """
    runs = _tile_runs(df, key, start, end)
    swept = _swept(runs)
    outer = swept.where("prev_b is null and reach < a").select("k", F.col("reach").alias("p"), "a")
    inner = _uncovered(runs.where("prev_b is not null"), swept).select("k", F.col("prev_b").alias("p"), "a")
    return outer.unionByName(inner).select(F.col("k").alias(key), F.shiftright(F.col("p") - 1, 1).alias("gap_start"), F.shiftright("a", 1).alias("gap_end"))


def periods(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """`key`, period_start, period_end: the continuous periods of a key. Same rules as gaps()."""
    runs = _tile_runs(df, key, start, end)
    swept = _swept(runs)
    so_far = Window.partitionBy("k").orderBy("a", F.col("b").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.when(F.col("reach") >= F.col("a"), 0).otherwise(1)
    islands = swept.withColumn("i", F.sum(opens).over(so_far)).groupBy("k", "i").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    # a tile's other runs are whole periods
    inner = _uncovered(runs.where("not edge"), swept)
    return islands.select("k", "a", "b").unionByName(inner.select("k", "a", "b")).select(F.col("k").alias(key), F.shiftright("a", 1).alias("period_start"), F.shiftright(F.col("b") - 1, 1).alias("period_end"))

"""Convex hulls of many regions at once, in two mergeable steps.

A region is given by the two ends of each of its image rows. Blocks of rows are reduced to the
corners of their own hulls, and the hull of a region is that of its blocks' corners. Both steps work
on whole batches of regions with array operations: a point on or below the line between two others
around it is no corner, so all such points can go at once, until none is left.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 1024  # image rows of a block
CELLS = 1 << 20  # image rows measured together
LEFT, RIGHT = 0, 1


def corners(region: np.ndarray, y: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Places of the corners of the upper hulls of points ordered by region and ``y``; of equal ``y`` the first counts."""
    fresh = np.ones(len(y), bool)
    fresh[1:] = (region[1:] != region[:-1]) | (y[1:] != y[:-1])
    left = np.flatnonzero(fresh)
    while len(left) > 2:
        r, a, b = region[left], y[left], v[left]
        inner = (r[1:-1] == r[:-2]) & (r[1:-1] == r[2:])
        below = inner & ((b[1:-1] - b[:-2]) * (a[2:] - a[:-2]) <= (b[2:] - b[:-2]) * (a[1:-1] - a[:-2]))
        if not below.any():
            break
        left = left[np.concatenate([[True], ~below, [True]])]
    return left


def upper_hulls(region: np.ndarray, y: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corners ``(region, y, v)`` of the upper hull of each region's points, in order."""
    order = np.lexsort((-v, y, region))
    region, y, v = region[order], y[order], v[order]
    kept = corners(region, y, v)
    return region[kept], y[kept], v[kept]


def at_rows(region: np.ndarray, y: np.ndarray, v: np.ndarray, of: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Height of the hull of region ``of`` at ``row``, between the region's corners."""
    span = float(y.max() - y.min() + 4)
    line = region * span + (y - y.min())
    k = np.clip(np.searchsorted(line, of * span + (row - y.min()), side="right"), 1, len(y) - 1)
    k = np.where(region[k] == of, k, k - 1)  # the last corner of a region
    return v[k - 1] + (v[k] - v[k - 1]) * (row - y[k - 1]) / (y[k] - y[k - 1])


def convex_areas(region: np.ndarray, side: np.ndarray, y: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Pixels whose centre lies in the hull of each of ``n`` regions, from the corners of its parts."""
    hulls = [upper_hulls(region[side == s], y[side == s], v[side == s]) for s in (LEFT, RIGHT)]
    first, last = np.full(n, np.inf), np.full(n, -np.inf)
    np.minimum.at(first, region, y)
    np.maximum.at(last, region, y)
    first, height = first + 0.5, (last - first).astype(np.int64)
    out = np.zeros(n, np.int64)
    stops = np.unique(np.append(np.searchsorted(np.cumsum(height), np.arange(CELLS, height.sum(), CELLS), side="right"), n))
    begin = 0
    for stop in stops.tolist():
        own = np.repeat(np.arange(begin, stop), height[begin:stop])
        row = np.arange(len(own)) - np.repeat(np.cumsum(height[begin:stop]) - height[begin:stop], height[begin:stop]) + first[own]
        if len(own):
            left, right = (at_rows(*h, own, row) for h in hulls)
            cells = np.floor(right + 1e-9) - np.ceil(-left - 1e-9) + 1
            out[begin:stop] = np.bincount(own - begin, cells, minlength=stop - begin).round()
        begin = stop
    return out


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups, where rows come ordered by their first ``n_keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [c[batch.num_rows - 1] for c in batch.columns[:n_keys]]
        cut = batch.num_rows - 1
        # the last group may go on in the next batch
        while cut and all(batch.column(k)[cut - 1].equals(last[k]) for k in range(n_keys)):
            cut -= 1
        if cut == 0 and held and not all(held[-1].column(k)[held[-1].num_rows - 1].equals(last[k]) for k in range(n_keys)):
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _groups(table: pa.Table, n_keys: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's group, and the place of each group's first row."""
    fresh = np.zeros(table.num_rows, bool)
    fresh[0] = True
    for k in range(n_keys):
        column = table.column(k).combine_chunks()
        codes = (column if pa.types.is_dictionary(column.type) else column.dictionary_encode(null_encoding="encode")).indices.to_numpy(zero_copy_only=False)
        fresh[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(fresh) - 1, np.flatnonzero(fresh)


def convex_hulls(labels: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Area and pixel area of the convex hull per label: ``(keys, label, area, convex_area)``."""
    by = [*keys, "label"]
    kinds = dict(labels.dtypes)
    typed = ", ".join(f"{c} {kinds[c]}" for c in by)
    block = F.floor(F.col("y") / ROWS).cast("int").alias("block")
    rows = labels.groupBy(*by, block, "y").agg(
        F.min("x").cast("double").alias("lo"), F.max("x").cast("double").alias("hi"), F.count("*").alias("n")
    )

    def reduce_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, len(by) + 1):
            region, starts = _groups(table, len(by) + 1)
            y = table["y"].to_numpy().astype(np.float64)
            # the midpoints of the edges of a row's two end pixels
            three, ys = np.tile(region, 3), np.concatenate([y, y - 0.5, y + 0.5])
            area = np.bincount(region, table["n"].to_numpy(), minlength=len(starts)).astype(np.int64)
            for side, ends in ((LEFT, -table["lo"].to_numpy()), (RIGHT, table["hi"].to_numpy())):
                own, cy, cv = upper_hulls(three, ys, np.concatenate([ends + 0.5, ends, ends]))
                part = table.select(by).take(pa.array(starts[own]))
                first = np.ones(len(own), bool)
                first[1:] = own[1:] != own[:-1]
                counted = np.where(first & (side == LEFT), area[own], 0)
                columns = {**{c: part[c] for c in by}, "side": pa.array(np.full(len(own), side, np.int32)), "y": cy, "v": cv, "n": counted}
                yield from pa.table(columns).to_batches()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, len(by)):
            region, starts = _groups(table, len(by))
            convex = convex_areas(region, table["side"].to_numpy(), table["y"].to_numpy(), table["v"].to_numpy(), len(starts))
            area = np.bincount(region, table["n"].to_numpy(), minlength=len(starts)).astype(np.int64)
            part = table.select(by).take(pa.array(starts))
            yield from pa.table({**{c: part[c] for c in by}, "area": area, "convex_area": convex}).to_batches()

    whole = [*by, "block"]
    points = rows.select(*whole, "y", "lo", "hi", "n").repartition(*whole).sortWithinPartitions(*whole, "y").mapInArrow(
        reduce_blocks, f"{typed}, side int, y double, v double, n long"
    )
    return points.repartition(*by).sortWithinPartitions(*by).mapInArrow(measure, f"{typed}, area long, convex_area long")

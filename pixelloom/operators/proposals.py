"""Region proposals without a model: stable regions across intensity levels."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.functions.scalars import column_name, key_column, key_row
from pixelloom.operators.components import TILE, label_runs
from pixelloom.operators.spread import bucketed_row_number, merge_join, salted_join
from pixelloom.operators.trees import component_tree, pixel_runs, stable_nodes
from pixelloom.session import StoredTable

LEVEL = ["polarity", "level"]
BRIGHT, DARK = 0, 1


def level_runs(image: DataFrame, delta: int, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Horizontal runs of ``value >= level * delta`` for every level and polarity.

    ``image`` is dense with values 0..255. A run starts where a scanline climbs past a
    level and ends where it falls below, so the rows made follow the image's total
    variation instead of pixels times levels. Dark polarity works on ``255 - value``.
    Starts meet their ends within the scanline, so only pixels are shuffled or sorted.
    """
    keys = list(keys)
    pixels = image.select(*keys, "y", "x", F.col("value").cast("int").alias("value")).filter("value is not null")
    kinds = {f.name: f for f in pixels.schema.fields}
    schema = T.StructType([
        *[kinds[k] for k in keys], T.StructField("polarity", T.IntegerType()), T.StructField("level", T.IntegerType()),
        kinds["y"], T.StructField("x0", kinds["x"].dataType), T.StructField("x1", kinds["x"].dataType),
    ])
    return pixels.groupBy(*keys, "y").applyInArrow(_line_runs(keys, int(delta)), schema)


#: Runs of a scanline that are worked at a time.
RUNS = 1 << 18


def _line_runs(keys: Sequence[str], delta: int):
    """All runs of one scanline, some levels at a time."""

    def crossings(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Level and place of each level that ``high`` reaches and ``low`` does not, by level, then place."""
        many = np.maximum(high - low, 0)
        at = np.repeat(np.arange(len(high)), many)
        level = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + low[at] + 1
        order = np.argsort(level, kind="stable")
        return level[order], at[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = pa.Table.from_batches(batches).combine_chunks().sort_by("x")
        x, value = line.column("x").to_numpy(), line.column("value").to_numpy().astype(np.int64)
        for polarity in (BRIGHT, DARK):
            k = (value if polarity == BRIGHT else 255 - value) // delta
            rises = int(np.maximum(np.diff(k, prepend=0), 0).sum())
            cuts = np.linspace(0, max(k.max(), 0), -(-rises // RUNS) + 1).astype(np.int64)
            for above, upto in zip(cuts[:-1], cuts[1:]):
                here = np.clip(k, above, upto)
                level, first = crossings(here, np.append(above, here[:-1]))
                _, last = crossings(here, np.append(here[1:], above))
                n = len(level)
                columns = [pa.repeat(line.column(c)[0], n) for c in keys] + [
                    pa.repeat(pa.scalar(polarity, pa.int32()), n), pa.array(level, pa.int32()), pa.repeat(line.column("y")[0], n),
                    pa.array(x[first]), pa.array(x[last]),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "polarity", "level", "y", "x0", "x1"])

    return run


def split_runs(runs: DataFrame, tile: int) -> DataFrame:
    """Cut runs at tile borders."""
    cells = F.explode(F.sequence(F.floor(F.col("x0") / tile), F.floor(F.col("x1") / tile))).alias("_t")
    rest = [c for c in runs.columns if c not in ("x0", "x1")]
    return runs.select("*", cells).select(
        *rest, F.greatest(F.col("x0"), F.col("_t") * tile).cast("int").alias("x0"),
        F.least(F.col("x1"), (F.col("_t") + 1) * tile - 1).cast("int").alias("x1"),
    )


def _parents(runs: DataFrame, regions: DataFrame, keys: Sequence[str], apart: str | None = None, out: str = "parent") -> DataFrame:
    """For each region, the region one level lower that holds its first pixel, or as many as its column ``apart`` says.

    An as-of lookup inside a scanline: first pixels and the runs of the lower level
    are merged in x order and the last run seen covers the pixel.
    """
    steps = F.col(apart) if apart else F.lit(1)
    seeds = regions.select(
        *keys, "polarity", (F.col("level") - steps).alias("level"), F.col("level").alias("_of"), key_row("root").alias("y"),
        key_column("root").alias("x"), F.lit(1).alias("_seed"), F.col("root").alias("_child"),
        F.lit(None).cast("bigint").alias("_root"),
    )
    spans = runs.select(
        *keys, *LEVEL, "y", F.col("x0").alias("x"), F.lit(0).alias("_seed"),
        F.lit(None).cast("bigint").alias("_child"), F.col("root").alias("_root"), F.lit(None).cast("int").alias("_of"),
    )
    line = Window.partitionBy(*keys, *LEVEL, "y").orderBy("x", "_seed").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    merged = seeds.unionByName(spans).withColumn("_holder", F.last("_root", ignorenulls=True).over(line))
    return merged.filter("_seed = 1").select(
        *keys, "polarity", F.col("_of").alias("level"), F.col("_child").alias("root"), F.col("_holder").alias(out),
    )


#: What bounds stable regions, by column, and how it is brought into range.
LIMITS = ["_delta", "_least", "_most", "_varies"]


def _limited(image: DataFrame, params: DataFrame | None, keys: Sequence[str], fixed: tuple) -> DataFrame:
    """``image`` with the columns ``LIMITS``: each image's own of ``params``, or the fixed ones."""
    if params is None:
        return image.select("*", *[F.lit(v).alias(c) for c, v in zip(LIMITS, _in_range(*fixed))])
    delta, least, most, varies = (F.col(column_name(n)) for n in ("MSER delta", "MSER min area", "MSER max area", "MSER max variation"))
    least = F.greatest(F.lit(5), F.bround(least.cast("double"), 0).cast("int"))
    own = params.select(
        *keys, F.greatest(F.lit(1), F.bround(delta.cast("double"), 0).cast("int")).alias("_delta"), least.alias("_least"),
        F.greatest(least + 1, F.bround(most.cast("double"), 0).cast("int")).alias("_most"), varies.cast("double").alias("_varies"),
    )
    return salted_join(image, own, keys, [c for c in ("y", "root") if c in image.columns], "inner")


def _in_range(delta: float, min_area: float, max_area: float, max_variation: float) -> tuple[int, int, int, float]:
    least = max(5, round(min_area))
    return max(1, round(delta)), least, max(least + 1, round(max_area)), float(max_variation)


def _stable_in_images(limited: DataFrame, keys: Sequence[str], side: int, with_spans: bool) -> DataFrame:
    """Stable regions, with their runs if wanted, of images of at most ``side`` rows and columns: a tree per polarity."""
    image = limited
    kinds = dict(image.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + (
        ", polarity int, level int, root long, area long, variation double"
    ) + (", spans array<struct<y:int,x0:int,x1:int>>" if with_spans else "")

    def run(key, frame):
        y, x = frame["y"].to_numpy(), frame["x"].to_numpy()
        if max(y.max(), x.max()) >= side:
            raise ValueError(f"a pixel lies outside max_side={side}")
        parts = []
        for polarity in (BRIGHT, DARK):
            levels = np.zeros((y.max() + 1, x.max() + 1), np.int64)
            levels[y, x] = frame["value"].to_numpy() if polarity == BRIGHT else 255 - frame["value"].to_numpy()
            tree, width = component_tree(levels), levels.shape[1]
            node, level, variation = stable_nodes(tree, *(frame[c].iloc[0] for c in LIMITS))
            first = tree.first[node].astype(np.int64)
            part = pd.DataFrame({
                **{k: [v] * len(node) for k, v in zip(keys, key)}, "polarity": polarity, "level": level,
                "root": (first // width << 32) + first % width, "area": tree.area[node], "variation": variation,
            })
            if with_spans:
                part["spans"] = [
                    [dict(zip(("y", "x0", "x1"), map(int, s))) for s in zip(*pixel_runs(tree, n, width))] for n in node
                ]
            parts.append(part)
        return pd.concat(parts, ignore_index=True)

    return image.select(*keys, "y", "x", "value", *LIMITS).groupBy(*keys).applyInPandas(run, schema)


def stable_regions(
    image: DataFrame, delta: int = 5, min_area: int = 30, max_area: int = 15000,
    max_variation: float = 1.2, keys: Sequence[str] = ("session",), tile: int = TILE,
    max_side: int | None = None, params: DataFrame | None = None, with_spans: bool = True,
) -> tuple[DataFrame, DataFrame | None]:
    """Regions that change least across grey levels, and their runs, or None for these without ``with_spans``.

    Every grey level is looked at. variation = (area ``delta`` levels lower - area ``delta``
    levels higher) / area. A region is kept when its variation is no more than that of the
    region it lies in one level lower, less than that of the largest one inside it one level
    higher, at most ``max_variation``, and its area is in range. A region with nothing
    ``delta`` levels below it has no variation.

    Images of at most ``max_side`` rows and columns, if that fits a tile, are worked one by one
    by their component tree; others by runs of every level, tile by tile. With ``params``, a table of
    each image's own parameters, these replace the four numbers.
    """
    keys = list(keys)
    fixed = (delta, min_area, max_area, max_variation)
    levels = [*keys, *LEVEL]
    if max_side is not None and max_side <= tile:
        found = StoredTable(_stable_in_images(_limited(image, params, keys, fixed), keys, max_side, with_spans)).df
        numbered = _numbered(found.drop("spans"), keys)
        if not with_spans:
            return numbered, None
        span = F.explode("spans").alias("s")
        spans = merge_join(found.select(*levels, "root", span), numbered.select(*levels, "root", "region"), [*levels, "root"])
        return numbered, spans.select(*keys, "region", "s.y", "s.x0", "s.x1")
    runs = level_runs(image, 1, keys)
    # read by the area count, the lookups and the final selection
    rooted = StoredTable(label_runs(split_runs(runs, tile), levels, tile, max_side, LEVEL)).df
    regions = rooted.groupBy(*levels, "root").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    regions = StoredTable(_limited(regions, params, keys, fixed)).df
    linked = merge_join(regions, _parents(rooted, regions, keys), [*levels, "root"], "left")
    linked = merge_join(linked, _parents(rooted, regions, keys, "_delta", "far"), [*levels, "root"], "left")
    linked = StoredTable(linked).df

    def lookup(df: DataFrame, of: DataFrame, apart: Column, name: str, fact: Column) -> DataFrame:
        """A fact of the region ``name``, which lies ``apart`` levels lower."""
        facts = of.select(*keys, "polarity", F.col("level").alias("_low"), F.col("root").alias(name), fact)
        return merge_join(df.withColumn("_low", F.col("level") - apart), facts, [*keys, "polarity", "_low", name], "left").drop("_low")

    def inside(df: DataFrame, apart: Column, name: str, fact: Column) -> DataFrame:
        """Facts of the regions ``apart`` levels higher, gathered on the one that holds them."""
        return df.filter(F.col(name).isNotNull()).groupBy(
            *keys, "polarity", (F.col("level") - apart).alias("level"), F.col(name).alias("root")
        ).agg(fact)

    sized = lookup(linked, regions, F.col("_delta"), "far", F.col("area").alias("_outer"))
    inner = inside(linked, F.col("_delta"), "far", F.max("area").alias("_inner"))
    varied = StoredTable(merge_join(sized, inner, [*levels, "root"], "left").withColumn(
        "variation", (F.col("_outer") - F.coalesce("_inner", F.lit(0))) / F.col("area")
    ).select(*levels, "root", "parent", "area", "variation", *LIMITS)).df
    main = F.max(F.struct("area", (-F.col("root")).alias("r"), "variation")).alias("_main")
    judged = merge_join(
        lookup(varied, varied, F.lit(1), "parent", F.col("variation").alias("_pv")),
        inside(varied, F.lit(1), "parent", main), [*levels, "root"], "left",
    )
    v = F.col("variation")
    stable = judged.filter(
        (v <= F.col("_varies")) & (F.col("area") >= F.col("_least")) & (F.col("area") <= F.col("_most"))
        & (F.col("_pv").isNull() | (v <= F.col("_pv")))
        & (F.col("_main.variation").isNull() | (v < F.col("_main.variation")))
    ).select(*levels, "root", "area", "variation")
    numbered = _numbered(stable, keys)
    if not with_spans:
        return numbered, None
    spans = salted_join(
        rooted, numbered.select(*levels, "root", "region"), [*levels, "root"], ["y"], "inner", salts=8
    ).select(*keys, "region", "y", "x0", "x1")
    return numbered, spans


def _numbered(stable: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Regions numbered from 1 per image by polarity, level and first pixel."""
    row = (F.col("polarity") * 256 + F.col("level")).cast("bigint")
    return bucketed_row_number(
        stable, keys, F.shiftleft(row, 32) + key_row("root"), [F.col("root")], "region"
    ).withColumn("region", F.col("region").cast("int"))


def regions_to_labels(spans: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Label rows from region runs; a later region takes the pixels it shares."""
    cells = F.explode(F.sequence("x0", "x1")).alias("x")
    return spans.select(*keys, "region", "y", cells).groupBy(*keys, "y", "x").agg(
        F.max("region").alias("label")
    )


def run_statistics(
    shapes: DataFrame, regions: DataFrame, candidates: DataFrame, kept: DataFrame, fixed: DataFrame
) -> DataFrame:
    """Regions found, candidates, kept and fixed ROIs per session.

    ``candidates`` and ``kept`` hold one row per ROI; ``fixed`` one per fixed ROI.
    """
    out = shapes.select("session")
    for df, name in ((regions, "regions"), (candidates, "candidates"), (kept, "kept"), (fixed, "fixed")):
        out = merge_join(out, df.groupBy("session").agg(F.count("*").alias(name)), ["session"], "left")
    return out.fillna(0, ["regions", "candidates", "kept", "fixed"])


def candidate_labels(
    image: DataFrame, params: Mapping[str, float] | DataFrame, tile: int = TILE, max_side: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Stable regions of a prepared image and the label rows they draw."""
    if isinstance(params, DataFrame):
        regions, spans = stable_regions(image, tile=tile, max_side=max_side, params=params)
    else:
        regions, spans = stable_regions(
            image, params["MSER delta"], params["MSER min area"], params["MSER max area"],
            params["MSER max variation"], tile=tile, max_side=max_side,
        )
    return regions, regions_to_labels(spans)

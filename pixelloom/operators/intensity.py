"""Pixel intensities: background fill, normalisation, filters, dilation, overlays.

Neighbourhood filters work along image rows and then along image columns with
window functions, so the unit of work is one scanline, never a whole image, and no
pixel is copied once per neighbour.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.scalars import blend, keyed_uniform
from pixelloom.operators.spread import group_quantiles, merge_join, salted_join, shapes_once
from pixelloom.session import StoredTable


# ------------------------------------------------------------------ background
def densify(
    pixels: DataFrame, shapes: DataFrame, keys: Sequence[str] = ("session",),
    value: str = "value", fill: float = 0.0,
) -> DataFrame:
    """Every cell of every image; cells without a row take ``fill``, rows outside are left out.

    Gap filling inside each scanline: only the rows present and one marker per
    scanline are shuffled, and the output stays partitioned by scanline.
    """
    keys = list(keys)
    markers = shapes.select(
        *keys, F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"),
        F.lit(-1).alias("x"), F.lit(None).cast("double").alias(value), F.col("width").alias("_w"),
    )
    # a pixel left of the image would come before the marker
    rows = pixels.filter("x >= 0").select(
        *keys, "y", "x", F.col(value).cast("double").alias(value), F.lit(None).cast("int").alias("_w")
    )
    line = Window.partitionBy(*keys, "y").orderBy("x")
    spanned = (
        rows.unionByName(markers)
        .withColumn("_width", F.first("_w").over(line))
        .withColumn("_end", F.coalesce(F.lead("x").over(line), F.col("_width")) - 1)
        .withColumn("_start", F.greatest("x", F.lit(0)))
        .filter("x < _width and _end >= _start")
    )
    cells = F.sequence("_start", F.least(F.col("_end"), F.col("_width") - 1))
    return spanned.select(*keys, "y", "x", value, F.explode(cells).alias("_x")).select(
        *keys, "y", F.col("_x").alias("x"),
        F.when(F.col("_x") == F.col("x"), F.col(value)).otherwise(F.lit(fill)).alias(value),
    )


def is_finite(value: str = "value") -> Column:
    v = F.col(value)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def _with_background(pixels: DataFrame, shapes: DataFrame | None, keys: Sequence[str], value: str) -> DataFrame:
    """Value rows with a weight; absent cells become one weighted zero per image."""
    rows = pixels.select(*keys, F.col(value).cast("double").alias(value), F.lit(1).cast("bigint").alias("_weight"))
    if shapes is None:
        return rows
    present = pixels.groupBy(*keys).agg(F.count("*").alias("_n"))
    zeros = merge_join(shapes_once(shapes, keys), present, keys, "left").select(
        *keys, F.lit(0.0).alias(value),
        (F.col("height").cast("bigint") * F.col("width") - F.coalesce("_n", F.lit(0))).alias("_weight"),
    )
    return rows.unionByName(zeros.filter("_weight > 0"))


def image_percentiles(
    pixels: DataFrame, probs: dict[str, float], shapes: DataFrame | None = None,
    keys: Sequence[str] = ("session",), value: str = "value",
) -> DataFrame:
    """Percentiles per image. With ``shapes`` absent cells count as zeros, which
    needs no dense table: the background is one row with a weight."""
    rows = _with_background(pixels, shapes, keys, value)
    return group_quantiles(rows, list(keys), value, probs, weight="_weight")


# --------------------------------------------------------------- normalisation
def _attach(pixels: DataFrame, facts: DataFrame, keys: Sequence[str], spread_by: str = "y") -> DataFrame:
    return salted_join(pixels, facts, list(keys), [spread_by], "left", hashed=True)


def _clip01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def robust_normalise(
    pixels: DataFrame, low: float = 1, high: float = 99.7, shapes: DataFrame | None = None,
    keys: Sequence[str] = ("session",), value: str = "value", measured: DataFrame | None = None,
) -> DataFrame:
    """Scale each image between two percentiles of its finite pixels, clipped to 0..1.

    Equal percentiles fall back to the extremes, a constant image gives zeros, NaN
    stays NaN and infinities go to the ends. Adds ``normalised``. ``measured`` may name
    the sparse pixels behind a densified table, so that the percentiles read those and
    count the background from ``shapes``.
    """
    source = pixels if measured is None else measured
    probs = {"_lo": low / 100.0, "_hi": high / 100.0, "_min": 0.0, "_max": 1.0}
    bounds = image_percentiles(source.filter(is_finite(value)), probs, shapes, keys, value)
    flat = F.col("_hi") <= F.col("_lo")
    bounds = bounds.select(
        *keys, F.when(flat, F.col("_min")).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_max")).otherwise(F.col("_hi")).alias("_hi"),
    )
    v = F.col(value)
    scaled = _clip01((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    out = (
        F.when(F.col("_lo").isNull() | (F.col("_hi") <= F.col("_lo")), F.lit(0.0))
        .when(F.isnan(v), v).otherwise(scaled)
    )
    return _attach(pixels, bounds, keys).select(*pixels.columns, out.alias("normalised"))


def robust_normalise_arrays(
    images: DataFrame, low: float = 1, high: float = 99.7, pixels: str = "pixels"
) -> DataFrame:
    """:func:`robust_normalise` for images that are one array per row, in place of ``pixels``."""
    finite = F.array_sort(F.filter(F.col("_all"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))

    def at(percent: float) -> Column:
        rank = F.lit(percent / 100.0) * (F.size("_sorted") - 1)
        below = F.get("_sorted", F.floor(rank).cast("int"))
        return below + (F.get("_sorted", F.ceil(rank).cast("int")) - below) * (rank - F.floor(rank))

    flat = F.col("_hi") <= F.col("_lo")
    lo = F.when(flat, F.get("_sorted", F.lit(0))).otherwise(F.col("_lo"))
    hi = F.when(flat, F.get("_sorted", F.size("_sorted") - 1)).otherwise(F.col("_hi"))

    def scaled(v: Column) -> Column:
        b = F.col("_bounds")
        return (
            F.when(b["lo"].isNull() | (b["hi"] <= b["lo"]), F.lit(0.0))
            .when(F.isnan(v), v).otherwise(_clip01((v - b["lo"]) / (b["hi"] - b["lo"])))
        )

    return (
        images.withColumn("_all", F.col(pixels).cast("array<double>"))
        .withColumn("_sorted", finite)
        .withColumn("_lo", at(low)).withColumn("_hi", at(high))
        .withColumn("_bounds", F.struct(lo.alias("lo"), hi.alias("hi")))
        .withColumn(pixels, F.transform("_all", scaled))
        .select(*images.columns)
    )


def display_percentiles(black=1.0, white=99.7) -> tuple[float, float]:
    """Usable display limits: defaults for bad input, kept in 0..100, in order."""

    def usable(given, default: float) -> float:
        try:
            number = float(given)
        except (TypeError, ValueError):
            return None
        return number if math.isfinite(number) else default

    b, w = usable(black, 1.0), usable(white, 99.7)
    if b is None or w is None:
        b, w = 1.0, 99.7
    b, w = (min(max(p, 0.0), 100.0) for p in (b, w))
    return (w, b) if b > w else (b, w)


def normalise_for_display(
    pixels: DataFrame, black=1.0, white=99.7, shapes: DataFrame | None = None,
    keys: Sequence[str] = ("session",), value: str = "value",
) -> DataFrame:
    """Display scaling: a flat range gives zeros and non-finite pixels are zero."""
    b, w = display_percentiles(black, white)
    bounds = image_percentiles(
        pixels.filter(is_finite(value)), {"_lo": b / 100.0, "_hi": w / 100.0}, shapes, keys, value
    )
    scaled = _clip01((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    out = F.when(is_finite(value) & (F.col("_hi") > F.col("_lo")), scaled).otherwise(F.lit(0.0))
    return _attach(pixels, bounds, keys).select(*pixels.columns, out.alias("shown"))


def threshold_to_zero(
    pixels: DataFrame, percentile: float | DataFrame = 85.0, shapes: DataFrame | None = None,
    keys: Sequence[str] = ("session",), value: str = "value",
) -> DataFrame:
    """Pixels below the image's percentile become zero; equal ones stay.

    The percentile is one number, or a table ``(keys, percentile)`` with each image's own.
    """
    if isinstance(percentile, DataFrame):
        rows = _attach(
            _with_background(pixels, shapes, keys, value), percentile.select(*keys, (F.col("percentile") / 100).alias("_p")), keys, value
        )
        cut = group_quantiles(rows, [*keys, "_p"], value, {"_cut": "_p"}, weight="_weight").drop("_p")
    else:
        cut = image_percentiles(pixels, {"_cut": percentile / 100.0}, shapes, keys, value)
    kept = F.when(F.col(value) < F.col("_cut"), F.lit(0)).otherwise(F.col(value))
    kind = dict(pixels.dtypes)[value]
    rest = [c for c in pixels.columns if c != value]
    return _attach(pixels, cut, keys).select(*rest, kept.cast(kind).alias(value))


# ------------------------------------------------------------- image statistics
def contrast_and_brightness(
    pixels: DataFrame, shapes: DataFrame | None = None, keys: Sequence[str] = ("session",),
    value: str = "value",
) -> DataFrame:
    """Contrast (p99 - p5) / max(abs(p99), 1) and the share of pixels at or above p95.

    NaN pixels are left out of the percentiles but stay in the denominator. The rows are read by
    several steps, each of which would repeat their plan, so they are stored once.
    """
    keys = list(keys)
    rows = StoredTable(_with_background(pixels, shapes, keys, value)).df
    known = rows.filter(F.col(value).isNotNull() & ~F.isnan(value))
    cuts = group_quantiles(known, keys, value, {"p5": 0.05, "p95": 0.95, "p99": 0.99}, "_weight")
    seen = F.col(value) >= F.col("p95")
    seen = F.when(F.isnan(value), F.lit(False)).otherwise(seen)
    shares = salted_join(rows, cuts, keys, [value], "inner").groupBy(*keys).agg(
        (F.sum(F.when(seen, F.col("_weight")).otherwise(0)) / F.sum("_weight")).alias("bright_fraction")
    )
    contrast = (F.col("p99") - F.col("p5")) / F.greatest(F.abs("p99"), F.lit(1.0))
    return merge_join(cuts, shares, keys).select(*keys, contrast.alias("contrast"), "bright_fraction")


def intensity_histogram(
    pixels: DataFrame, tile: int, keys: Sequence[str] = ("session",), value: str = "value"
) -> DataFrame:
    return pixels.groupBy(
        *keys, F.floor(F.col("y") / tile).cast("int").alias("tile_y"),
        F.floor(F.col("x") / tile).cast("int").alias("tile_x"), value,
    ).agg(F.count("*").alias("pixels"))


# ---------------------------------------------------------------------- filters
def _lines(keys: Sequence[str]) -> tuple:
    """Windows along an image row and along an image column."""
    return Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")


def median3(dense: DataFrame, keys: Sequence[str] = ("session",), value: str = "value") -> DataFrame:
    """3 x 3 median of a dense table; the edge pixel stands in for its missing neighbour."""
    row, column = _lines(keys)
    v = F.col(value)
    triple = F.array(F.coalesce(F.lag(v).over(row), v), v, F.coalesce(F.lead(v).over(row), v))
    across = dense.withColumn("_t", triple)
    t = F.col("_t")
    nine = F.concat(F.coalesce(F.lag(t).over(column), t), t, F.coalesce(F.lead(t).over(column), t))
    rest = [c for c in dense.columns if c != value]
    return across.withColumn("_nine", nine).select(*rest, F.sort_array("_nine")[4].alias(value))


def ellipse_half_widths(size: int) -> list[int]:
    """Half width of each row of a filled ellipse in a square of odd side ``size``."""
    r = size // 2
    if r == 0:
        return [0]
    return [round(r * math.sqrt((r * r - dy * dy) / (r * r))) for dy in range(-r, r + 1)]


def _shift(name: str, by: int, window) -> Column:
    if by == 0:
        return F.col(name)
    return F.lag(name, -by).over(window) if by < 0 else F.lead(name, by).over(window)


def _footprint(kernel: int) -> tuple[dict[int, int], dict[int, int]]:
    """Half width of each row, and half height of each column, of an elliptical kernel; even sizes grow by one."""
    size = int(kernel) + (1 - int(kernel) % 2)
    r = size // 2
    widths = dict(zip(range(-r, r + 1), ellipse_half_widths(size)))
    heights = {dx: max(abs(dy) for dy in widths if widths[dy] >= abs(dx)) for dx in range(-r, r + 1)
               if any(widths[dy] >= abs(dx) for dy in widths)}
    return widths, heights


def _of_kernel(name: str, parts: dict[int, list[Column]], pick) -> Column:
    """``pick`` of the parts of the row's own kernel."""
    out = None
    for size, own in parts.items():
        best = pick(*own) if len(own) > 1 else own[0]
        here = F.col(name) == size
        out = F.when(here, best) if out is None else out.when(here, best)
    return out


def top_hat(
    dense: DataFrame, kernel: int | DataFrame = 11, keys: Sequence[str] = ("session",), value: str = "value"
) -> DataFrame:
    """Value minus its opening with an elliptical footprint clipped at the edges.

    The footprint is a stack of horizontal spans, so erosion is a sliding minimum per
    span along rows and then a minimum of shifted rows along columns; dilation goes
    the other way round, so the whole filter changes partitioning twice.

    ``kernel`` is one size, or a table ``(keys, kernel)`` with each image's own. All sizes
    share the sorts and the sliding minima of equal spans; the sizes in use are read from
    the table, and are no more than the parameter's range allows.
    """
    names = [c for c in dense.columns if c != value]
    if isinstance(kernel, DataFrame):
        sizes = kernel.select(*keys, F.col("kernel").cast("int").alias("_kernel"))
        used = sorted(r[0] for r in sizes.select("_kernel").distinct().collect())
        if not used:
            return dense.limit(0)
        dense = salted_join(dense, sizes, list(keys), ["y"], "inner")
    else:
        used = [int(kernel)]
        dense = dense.withColumn("_kernel", F.lit(used[0]))
    prints = {k: _footprint(k) for k in used}
    row, column = _lines(keys)
    held = [*names, "_kernel", value]

    spans = sorted({w for widths, _ in prints.values() for w in widths.values()})
    low = dense.select(*held, *[
        F.min(value).over(row.rowsBetween(-w, w)).alias(f"_e{w}") for w in spans
    ])
    shifted = {k: [_shift(f"_e{w}", dy, column) for dy, w in widths.items()] for k, (widths, _) in prints.items()}
    eroded = low.select(*held, _of_kernel("_kernel", shifted, F.least).alias("_er"))
    tall = sorted({h for _, heights in prints.values() for h in heights.values()})
    high = eroded.select("*", *[
        F.max("_er").over(column.rowsBetween(-h, h)).alias(f"_d{h}") for h in tall
    ])
    shifted = {k: [_shift(f"_d{h}", dx, row) for dx, h in heights.items()] for k, (_, heights) in prints.items()}
    return high.select(*held, _of_kernel("_kernel", shifted, F.greatest).alias("_op")).select(
        *names, (F.col(value) - F.col("_op")).alias(value)
    )


def scale_to_bytes(
    dense: DataFrame, keys: Sequence[str] = ("session",), value: str = "value"
) -> DataFrame:
    """Percentile 1 to 99 onto 0..255, cut to whole numbers."""
    bounds = image_percentiles(dense, {"_lo": 0.01, "_hi": 0.99}, None, keys, value)
    hi = F.when(F.col("_hi") <= F.col("_lo"), F.col("_lo") + 1.0).otherwise(F.col("_hi"))
    scaled = _clip01((F.col(value) - F.col("_lo")) / (hi - F.col("_lo")))
    rest = [c for c in dense.columns if c != value]
    return _attach(dense, bounds, keys).select(*rest, F.floor(scaled * 255).cast("int").alias(value))


TILES = 8
LEVELS = 256


def equalise_tiles(
    dense: DataFrame, shapes: DataFrame, clip: float | DataFrame = 2.0, keys: Sequence[str] = ("session",),
    value: str = "value",
) -> DataFrame:
    """Contrast-limited equalisation on an 8 x 8 grid of tiles for 0..255 values.

    ``clip`` is one limit, or a table ``(keys, clip)`` with each image's own.

    Tile histograms are clipped, the excess is spread evenly, and each pixel blends
    the mappings of its four nearest tiles. Mappings are worked out only for the
    (cell, value) pairs that occur, at most 81 * 256 per image; pixels meet them in
    one salted join.
    """
    keys = list(keys)
    shapes = shapes_once(shapes, keys)
    rows, cols = F.col("height"), F.col("width")
    uneven = (rows % TILES != 0) | (cols % TILES != 0)
    if isinstance(clip, DataFrame):
        shapes = merge_join(shapes, clip.select(*keys, F.col("clip").cast("double").alias("_clip")), keys)
    else:
        shapes = shapes.withColumn("_clip", F.lit(float(clip)))
    sized = shapes.select(
        *keys, "height", "width", "_clip",
        F.when(uneven, rows + TILES - rows % TILES).otherwise(rows).alias("_ph"),
        F.when(uneven, cols + TILES - cols % TILES).otherwise(cols).alias("_pw"),
    ).withColumn("_th", (F.col("_ph") / TILES).cast("int")).withColumn("_tw", (F.col("_pw") / TILES).cast("int"))
    at = salted_join(dense.select(*keys, "y", "x", F.col(value).alias("_v")), sized, keys, ["y"], "inner")

    def mirrored(c: str, side: str, padded: str) -> Column:
        """The coordinate itself and its mirror image in the padding, if it has one."""
        m = 2 * (F.col(side) - 1) - F.col(c)
        return F.filter(F.array(F.col(c), m), lambda p: (p == F.col(c)) | ((p >= F.col(side)) & (p < F.col(padded))))

    facts = [F.max(c).alias(c) for c in ("_th", "_tw", "_clip")]
    hist = (
        at.withColumn("_py", F.explode(F.array_distinct(mirrored("y", "height", "_ph"))))
        .withColumn("_px", F.explode(F.array_distinct(mirrored("x", "width", "_pw"))))
        .groupBy(
            *keys, F.floor(F.col("_py") / F.col("_th")).cast("int").alias("_ty"),
            F.floor(F.col("_px") / F.col("_tw")).cast("int").alias("_tx"), "_v",
        ).agg(F.count("*").alias("_n"), *facts)
    )
    fy = F.col("y") / F.col("_th") - 0.5
    fx = F.col("x") / F.col("_tw") - 0.5
    # cell (cy, cx) has tiles cy - 1 and cy above and below it; edge cells repeat a tile
    placed = at.select(
        *keys, "y", "x", "_v", "_th", "_tw", "_clip",
        (F.floor(fy) + 1).cast("int").alias("_cy"), (F.floor(fx) + 1).cast("int").alias("_cx"),
        (fy - F.floor(fy)).alias("_wy"), (fx - F.floor(fx)).alias("_wx"),
    )
    corner = F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)
    ])).alias("_at")

    def tile_of(cell: str, side: str) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(TILES - 1), F.col(cell) - 1 + F.col(f"_at.{side}")))

    asked = (
        placed.groupBy(*keys, "_cy", "_cx", "_v").agg(*facts)
        .select("*", corner)
        .select(
            *keys, tile_of("_cy", "a").alias("_ty"), tile_of("_cx", "b").alias("_tx"), "_v",
            F.lit(0).cast("bigint").alias("_n"), "_th", "_tw", "_clip", "_cy", "_cx", "_at",
        )
    )
    # a tile sees its own counts and the values asked of it: at most 256 + 4 * 256 rows
    tile = Window.partitionBy(*keys, "_ty", "_tx")
    upto = tile.orderBy("_v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    area = F.col("_th") * F.col("_tw")
    limit = F.greatest(F.floor(F.col("_clip") * area / LEVELS), F.lit(1)).cast("bigint")
    spread = (
        hist.unionByName(asked, allowMissingColumns=True)
        .withColumn("_limit", limit)
        .withColumn("_excess", F.sum(F.greatest(F.col("_n") - F.col("_limit"), F.lit(0))).over(tile))
        .withColumn("_kept", F.sum(F.least("_n", "_limit")).over(upto))
        .filter("_at is not null")
    )
    batch, left = F.floor(F.col("_excess") / LEVELS), F.col("_excess") % LEVELS
    step = F.greatest(F.floor(LEVELS / F.greatest(left, F.lit(1))), F.lit(1))
    total = (
        F.col("_kept") + batch * (F.col("_v") + 1)
        + F.when(left > 0, F.least(left, F.floor(F.col("_v") / step) + 1)).otherwise(F.lit(0))
    )
    mapped = spread.withColumn("_m", F.least(F.lit(255.0), F.bround(total * (F.lit(255.0) / area), 0)))
    corners = mapped.groupBy(*keys, "_cy", "_cx", "_v").agg(*[
        F.max(F.when((F.col("_at.a") == a) & (F.col("_at.b") == b), F.col("_m"))).alias(f"_m{a}{b}")
        for a in (0, 1) for b in (0, 1)
    ])
    mixed = salted_join(placed, corners, [*keys, "_cy", "_cx", "_v"], ["y", "x"], "inner", salts=4)
    top = F.col("_m00") * (1 - F.col("_wx")) + F.col("_m01") * F.col("_wx")
    bottom = F.col("_m10") * (1 - F.col("_wx")) + F.col("_m11") * F.col("_wx")
    out = F.bround(F.round(top * (1 - F.col("_wy")) + bottom * F.col("_wy"), 9), 0).cast("int")
    return mixed.select(*keys, "y", "x", out.alias(value))


def enhance_contrast(
    dense: DataFrame, shapes: DataFrame, kernel: int | DataFrame = 11, clip: float | DataFrame = 2.0,
    keys: Sequence[str] = ("session",), value: str = "value",
) -> DataFrame:
    """Byte scaling, top-hat and tile equalisation.

    The input is read twice by the scaling and the filtered bytes three times by the
    equalisation, so both are stored once instead of being worked out again.
    """
    dense = StoredTable(dense).df
    flat = StoredTable(top_hat(scale_to_bytes(dense, keys, value), kernel, keys, value)).df
    return equalise_tiles(flat, shapes, clip, keys, value)


# ------------------------------------------------------------------------- runs
def mask_runs(mask: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Horizontal runs ``(keys, y, x0, x1)`` of a mask, one shuffle on the scanline; pixels may repeat."""
    line = Window.partitionBy(*keys, "y").orderBy("x")
    gap = F.col("x") - F.dense_rank().over(line)
    return mask.select(*keys, "y", "x", gap.alias("_g")).groupBy(*keys, "y", "_g").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1")
    ).drop("_g")


def _union_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge overlapping or touching runs of a scanline."""
    line = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    reach = F.max("x1").over(line.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("x0") > reach + 1), 1).otherwise(0)
    return runs.withColumn("_new", fresh).withColumn("_i", F.sum("_new").over(line)).groupBy(
        *keys, "y", "_i"
    ).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_i")


def dilate(
    mask: DataFrame, shapes: DataFrame, radius: int = 3, keys: Sequence[str] = ("session",)
) -> DataFrame:
    """Grow a mask by ``radius`` steps of the 4-neighbour cross, cut at the image edge.

    Works on runs: a run widens by what is left of the radius on each nearby row, so
    ``2 * radius + 1`` spans are shuffled per run instead of a diamond per pixel.
    """
    keys = list(keys)
    shifts = F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("_dy")
    grown = mask_runs(mask, keys).select(*keys, "y", "x0", "x1", shifts)
    reach = F.lit(radius) - F.abs("_dy")
    moved = grown.select(
        *keys, (F.col("y") + F.col("_dy")).alias("y"), (F.col("x0") - reach).alias("x0"),
        (F.col("x1") + reach).alias("x1"),
    )
    fitted = salted_join(moved, shapes_once(shapes, keys), keys, ["y"], "inner").filter(
        "y >= 0 and y < height"
    ).select(
        *keys, "y", F.greatest("x0", F.lit(0)).alias("x0"), F.least("x1", F.col("width") - 1).alias("x1")
    )
    return _union_runs(fitted, keys).select(*keys, "y", F.explode(F.sequence("x0", "x1")).alias("x"))


# --------------------------------------------------------------------- overlays
def label_boundary(
    labels: DataFrame, shapes: DataFrame, keys: Sequence[str] = ("session",)
) -> DataFrame:
    """Label rows with ``boundary``: some 4-neighbour, wrapping round the edges, differs."""
    keys = list(keys)
    shaped = salted_join(labels, shapes_once(shapes, keys), keys, ["y"], "inner")
    row, column = _lines(keys)

    def differs(window, c: str, size: str) -> Column:
        whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        here, pair = F.col("label"), F.struct(F.col(c).alias("c"), F.col("label").alias("l"))
        before, after = F.lag(pair).over(window), F.lead(pair).over(window)
        first, last = F.first(pair).over(whole), F.last(pair).over(whole)
        back = F.when(F.col(c) == 0, F.when(last["c"] == F.col(size) - 1, last["l"])).otherwise(
            F.when(before["c"] == F.col(c) - 1, before["l"])
        )
        ahead = F.when(F.col(c) == F.col(size) - 1, F.when(first["c"] == 0, first["l"])).otherwise(
            F.when(after["c"] == F.col(c) + 1, after["l"])
        )
        return (F.coalesce(back, F.lit(0)) != here) | (F.coalesce(ahead, F.lit(0)) != here)

    along = shaped.withColumn("_h", differs(row, "x", "width"))
    return along.withColumn("_v", differs(column, "y", "height")).select(
        *keys, "y", "x", "label", (F.col("_h") | F.col("_v")).alias("boundary")
    )


# fixed values: overlay colours and strengths
ERROR_COLOURS = {"TP": (0.0, 0.9, 0.2), "FP": (1.0, 0.1, 0.8), "FN": (0.0, 0.45, 1.0)}
ERROR_ALPHA = 0.6
LABEL_ALPHA = 0.55
BOUNDARY_COLOUR = (1.0, 0.95, 0.05)
PALETTE_SEED = 9176


def error_overlay(
    normalised: DataFrame, errors: DataFrame, keys: Sequence[str] = ("session",), alpha: float = ERROR_ALPHA
) -> DataFrame:
    """Grey image rows tinted by error class: ``(keys, y, x, r, g, b)``."""
    base = F.col("normalised")
    joined = merge_join(normalised, errors, [*keys, "y", "x"], "left")
    out = []
    for i, name in enumerate("rgb"):
        tint = base
        for kind, colour in ERROR_COLOURS.items():
            tint = F.when(F.col("error") == kind, blend(base, colour[i], alpha)).otherwise(tint)
        out.append(tint.alias(name))
    return joined.select(*keys, "y", "x", *out)


def label_colour(label: Column | str, channel: int, seed: int = PALETTE_SEED) -> Column:
    """A steady colour per label between 0.1 and 1."""
    return F.lit(0.1) + F.lit(0.9) * keyed_uniform(seed, label, F.lit(channel))


def label_overlay(
    normalised: DataFrame, labels: DataFrame, shapes: DataFrame, keys: Sequence[str] = ("session",),
    alpha: float = LABEL_ALPHA,
) -> DataFrame:
    """Grey image rows tinted by label, with label boundaries in one bright colour."""
    marked = label_boundary(labels, shapes, keys)
    joined = merge_join(normalised, marked, [*keys, "y", "x"], "left")
    base = F.col("normalised")
    out = [
        F.when(F.col("boundary"), F.lit(BOUNDARY_COLOUR[i]))
        .when(F.col("label").isNotNull(), blend(base, label_colour("label", i), alpha))
        .otherwise(base).alias(name)
        for i, name in enumerate("rgb")
    ]
    return joined.select(*keys, "y", "x", *out)


def load_pairs(
    pixels: DataFrame, mask: DataFrame, low: float = 1, high: float = 99.7,
    keys: Sequence[str] = ("session",),
) -> DataFrame:
    """Normalised image rows with the mask beside them."""
    normal = robust_normalise(pixels, low, high, keys=keys)
    flags = mask.select(*keys, "y", "x", F.lit(1.0).alias("_m")).distinct()
    return merge_join(normal, flags, [*keys, "y", "x"], "left").select(
        *keys, "y", "x", "normalised", F.coalesce("_m", F.lit(0.0)).alias("mask")
    )

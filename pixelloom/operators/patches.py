"""Seeded training patches: crop sampling, cropping, augmentation, targets.

Draws are hashes of (seed, epoch, session, patch), so a patch does not depend on
partitioning or on other patches.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.scalars import keyed_digest, keyed_uniform
from pixelloom.operators.intensity import dilate
from pixelloom.operators.spread import bucketed_row_number, merge_join, salted_join

PATCH = ["session", "epoch", "patch"]
VAL_SEED_OFFSET = 1000


def draw(seed: int, tag: str) -> Column:
    return keyed_uniform(seed, "epoch", "session", "patch", F.lit(tag))


def plan_patches(shapes: DataFrame, epochs: Sequence[int], patches_per_image: int) -> DataFrame:
    """One row per (session, epoch, patch)."""
    return shapes.select(
        "session", "height", "width",
        F.explode(F.array(*[F.lit(int(e)) for e in epochs])).alias("epoch"),
    ).withColumn("patch", F.explode(F.sequence(F.lit(0), F.lit(int(patches_per_image) - 1))))


def sample_crops(
    plan: DataFrame, mask: DataFrame, patch_size: int, foreground_fraction: float = 0.75, seed: int = 7
) -> DataFrame:
    """Crop bounds per patch, centred on a random mask pixel for a share of patches.

    Mask pixels are numbered in row-major order by scanline counts; a patch looks its
    drawn number up, so a mask is never gathered.
    """
    size = int(patch_size)
    ranked = bucketed_row_number(
        mask.select("session", "y", "x").distinct(), ["session"], F.col("y"), [F.col("x")], "_rank"
    ).select("session", (F.col("_rank") - 1).alias("_pick"), F.col("y").alias("_cy"), F.col("x").alias("_cx"))
    totals = mask.select("session", "y", "x").distinct().groupBy("session").agg(F.count("*").alias("_fg"))
    drawn = salted_join(plan, totals, ["session"], ["epoch", "patch"], "left")
    small = (F.col("height") <= size) | (F.col("width") <= size)
    centred = ~small & (F.coalesce("_fg", F.lit(0)) > 0) & (draw(seed, "kind") < foreground_fraction)
    pick = F.when(centred, F.floor(draw(seed, "pixel") * F.col("_fg")).cast("bigint"))
    aimed = merge_join(drawn.withColumn("_pick", pick), ranked, ["session", "_pick"], "left")

    def start(centre: str, side: str, tag: str) -> Column:
        room = F.col(side) - size
        free = F.floor(draw(seed, tag) * (room + 1))
        at = F.when(F.col(centre).isNotNull(), F.col(centre) - size // 2).otherwise(free)
        return F.when(small, F.lit(0)).otherwise(F.least(F.greatest(at, F.lit(0)), room)).cast("int")

    def length(side: str) -> Column:
        return F.when(small, F.least(F.lit(size), F.col(side))).otherwise(F.lit(size))

    return aimed.select(
        *PATCH, start("_cy", "height", "top").alias("top"), start("_cx", "width", "left").alias("left"),
        length("height").alias("h"), length("width").alias("w"),
    )


def crop(pixels: DataFrame, crops: DataFrame, block: int = 256) -> DataFrame:
    """Pixels of each patch in patch coordinates.

    A patch is spread over its scanlines, and each of them over the ``block`` wide pieces
    it crosses, two for a patch no wider than a piece. There it meets the pixels.
    """
    right = F.col("left") + F.col("w") - 1
    pieces = F.sequence(F.floor(F.col("left") / block), F.floor(right / block))
    lines = crops.withColumn(
        "y", F.explode(F.sequence(F.col("top"), F.col("top") + F.col("h") - 1))
    ).withColumn("_piece", F.explode(pieces))
    rest = [c for c in pixels.columns if c not in ("session", "y", "x")]
    placed = pixels.withColumn("_piece", F.floor(F.col("x") / block))
    met = merge_join(placed, lines, ["session", "y", "_piece"]).filter(
        (F.col("x") >= F.col("left")) & (F.col("x") < F.col("left") + F.col("w"))
    )
    return met.select(
        *PATCH, (F.col("y") - F.col("top")).alias("py"), (F.col("x") - F.col("left")).alias("px"),
        "h", "w", *rest, *(["aug"] if "aug" in crops.columns else []),
    )


def flip(y: Column, x: Column, h: Column, w: Column, vertical: Column, horizontal: Column):
    """Coordinates after optional flips."""
    return F.when(vertical, h - 1 - y).otherwise(y), F.when(horizontal, w - 1 - x).otherwise(x)


def rotate(y: Column, x: Column, h: Column, w: Column, quarter_turns: Column):
    """Coordinates and sides after counter-clockwise quarter turns."""
    k = quarter_turns
    ny = F.when(k == 1, w - 1 - x).when(k == 2, h - 1 - y).when(k == 3, x).otherwise(y)
    nx = F.when(k == 1, y).when(k == 2, w - 1 - x).when(k == 3, h - 1 - y).otherwise(x)
    odd = k % 2 == 1
    return ny, nx, F.when(odd, w).otherwise(h), F.when(odd, h).otherwise(w)


def unit_normal(seed: int, *key: str) -> Column:
    """A standard normal draw fixed by seed and key (Box and Muller), from one digest that any engine repeats."""
    digest = keyed_digest(seed, *key)

    def uniform(at: int) -> Column:
        return (F.conv(F.substring(digest, at, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)

    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(9))


def draw_augmentation(
    crops: DataFrame, seed: int = 7, rotation_90: bool = True, jitter: float = 0.15
) -> DataFrame:
    """Add the random choices of each patch, drawn once per patch and not per pixel."""
    turns = F.floor(draw(seed, "turns") * 4).cast("int") if rotation_90 else F.lit(0)
    return crops.withColumn("aug", F.struct(
        (draw(seed, "flip_y") < 0.5).alias("flip_y"), (draw(seed, "flip_x") < 0.5).alias("flip_x"),
        turns.alias("turns"),
        (1 + (2 * draw(seed, "scale") - 1) * float(jitter)).alias("scale"),
        ((2 * draw(seed, "offset") - 1) * float(jitter) * 0.25).alias("offset"),
    ))


def augment(patches: DataFrame, noise_sd: float = 0.02, seed: int = 7, value: str = "value") -> DataFrame:
    """Flips and quarter turns of image and mask together; brightness and noise on the
    image alone; the image clipped to 0..1. Row-wise: no shuffle."""
    h, w, aug = F.col("h"), F.col("w"), F.col("aug")
    y, x = flip(F.col("py"), F.col("px"), h, w, aug["flip_y"], aug["flip_x"])
    flipped = patches.withColumn("_y", y).withColumn("_x", x)
    ny, nx, nh, nw = rotate(F.col("_y"), F.col("_x"), h, w, aug["turns"])
    v = F.col(value) * aug["scale"] + aug["offset"]
    if noise_sd > 0:
        v = v + noise_sd * unit_normal(seed, *PATCH, "py", "px")
    rest = [c for c in patches.columns if c not in (*PATCH, "py", "px", "h", "w", value, "aug")]
    return flipped.select(
        *PATCH, ny.cast("int").alias("py"), nx.cast("int").alias("px"), nh.alias("h"), nw.alias("w"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)).alias(value), *rest,
    )


def make_targets(patches: DataFrame, mode: str = "foreground", support_radius: int = 3) -> DataFrame:
    """Target rows ``(patch, channel, py, px)`` that are set: the mask, and for
    ``foreground_support`` its dilation inside the patch as channel 1."""
    mask = patches.filter("mask > 0").select(*PATCH, F.col("py").alias("y"), F.col("px").alias("x"))
    first = mask.select(*PATCH, F.lit(0).alias("channel"), F.col("y").alias("py"), F.col("x").alias("px"))
    if mode == "foreground":
        return first
    if mode != "foreground_support":
        raise ValueError(f"targets are foreground or foreground_support, not {mode}")
    sides = patches.groupBy(*PATCH).agg(F.max("h").alias("height"), F.max("w").alias("width"))
    wide = dilate(mask, sides, support_radius, keys=PATCH)
    return first.unionByName(
        wide.select(*PATCH, F.lit(1).alias("channel"), F.col("y").alias("py"), F.col("x").alias("px"))
    )


def build_patches(
    normalised: DataFrame, mask: DataFrame, shapes: DataFrame, epochs: Sequence[int],
    patches_per_image: int = 24, patch_size: int = 256, foreground_fraction: float = 0.75,
    seed: int = 7, augmented: bool = True, rotation_90: bool = True, jitter: float = 0.15, noise_sd: float = 0.02,
) -> DataFrame:
    """Patch pixels ``(session, epoch, patch, py, px, h, w, value, mask)``.

    ``normalised`` is the dense image table ``(session, y, x, value, mask)``.
    """
    crops = sample_crops(
        plan_patches(shapes, epochs, patches_per_image), mask, patch_size, foreground_fraction, seed
    )
    if not augmented:
        return crop(normalised, crops)
    return augment(crop(normalised, draw_augmentation(crops, seed, rotation_90, jitter)), noise_sd, seed)


def train_and_validation(
    normalised: DataFrame, mask: DataFrame, manifest: DataFrame, epochs: Sequence[int],
    train_patches: int = 24, val_patches: int = 8, seed: int = 7, train_split: str = "train",
    val_split: str = "val", **options,
) -> tuple[DataFrame, DataFrame]:
    """Augmented training patches and plain validation patches of the two splits.

    Validation has its own seed and at least one patch per image.
    """
    used = manifest.filter("included")
    parts = []
    for split, count, s, augmented in (
        (train_split, train_patches, seed, True),
        (val_split, max(1, val_patches), seed + VAL_SEED_OFFSET, False),
    ):
        rows = used.filter(F.col("split") == split).select("session", "height", "width")
        parts.append(build_patches(
            normalised, mask, rows, epochs, count, seed=s, augmented=augmented, **options
        ))
    return parts[0], parts[1]

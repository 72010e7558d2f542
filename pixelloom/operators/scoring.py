"""Batch scoring of images with a pluggable model, and flip averaging."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.operators.intensity import robust_normalise_arrays

Score = Callable[[np.ndarray], np.ndarray]

# fixed values: the four flip views as (vertical, horizontal)
VIEWS = ((False, False), (True, False), (False, True), (True, True))


def _score_views(score: Score, images: np.ndarray, tta: bool) -> np.ndarray:
    if not tta:
        return score(images)
    total = np.zeros(images.shape)
    for vertical, horizontal in VIEWS:
        axes = [a for a, on in ((1, vertical), (2, horizontal)) if on]
        total += np.flip(score(np.flip(images, axes)), axes)
    return total / len(VIEWS)


def score_images(
    images: DataFrame, load: Callable[[], Score], tta: bool = False,
    percentiles: tuple[float, float] = (1, 99.7), batch: int = 16, keys: Sequence[str] = ("session",),
) -> DataFrame:
    """Probability images ``(keys, height, width, probability[])``.

    ``images`` has one row per image, row-major in ``pixels``. ``load`` builds the
    model once per task and returns a function from a batch (n, height, width) of
    normalised images to probabilities of the same shape. Images are scored where they
    lie: no shuffle, at most ``batch`` images per call.
    """
    keys = list(keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for frame in frames:
            for _, same in frame.groupby(["height", "width"], sort=False):
                shape = (int(same["height"].iloc[0]), int(same["width"].iloc[0]))
                for at in range(0, len(same), batch):
                    part = same.iloc[at:at + batch]
                    stack = np.stack([np.asarray(p, dtype=float).reshape(shape) for p in part["pixels"]])
                    scored = _score_views(score, stack, tta)
                    yield part[[*keys, "height", "width"]].assign(
                        probability=[p.ravel() for p in scored]
                    )

    kinds = dict(images.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", height int, width int, probability array<double>"
    normal = robust_normalise_arrays(images, *percentiles)
    return normal.select(*keys, "height", "width", "pixels").mapInPandas(run, schema)


def explode_image(images: DataFrame, column: str, out: str, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Array images to pixel rows."""
    at = images.select(*keys, "width", F.posexplode(column).alias("_p", out))
    return at.select(
        *keys, F.floor(F.col("_p") / F.col("width")).cast("int").alias("y"),
        (F.col("_p") % F.col("width")).cast("int").alias("x"), out,
    )


def flip_views(pixels: DataFrame) -> DataFrame:
    """Four flipped copies of pixel rows that carry ``height`` and ``width``; the view
    number tells how to undo the flip."""
    view = F.explode(F.array(*[
        F.struct(F.lit(i).alias("view"), F.lit(v).alias("v"), F.lit(h).alias("h"))
        for i, (v, h) in enumerate(VIEWS)
    ])).alias("_f")
    rest = [c for c in pixels.columns if c not in ("y", "x")]
    copies = pixels.select("*", view)
    return copies.select(*rest, F.col("_f.view").alias("view"), *_flipped("_f.v", "_f.h"))


def _flipped(vertical: str, horizontal: str) -> list[Column]:
    return [
        F.when(F.col(vertical), F.col("height") - 1 - F.col("y")).otherwise(F.col("y")).alias("y"),
        F.when(F.col(horizontal), F.col("width") - 1 - F.col("x")).otherwise(F.col("x")).alias("x"),
    ]


def average_views(scored: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Undo the flips and average the four probabilities of each pixel."""
    back = scored.withColumn("_v", F.col("view").isin(*[i for i, v in enumerate(VIEWS) if v[0]])).withColumn(
        "_h", F.col("view").isin(*[i for i, v in enumerate(VIEWS) if v[1]])
    )
    return back.select(*keys, "probability", *_flipped("_v", "_h")).groupBy(*keys, "y", "x").agg(
        F.avg("probability").alias("probability")
    )

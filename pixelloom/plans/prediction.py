"""Prediction bundle: ROIs, labels, probabilities, advice and operating point."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.operators.components import TILE, labels_at_points, pack_rois
from pixelloom.operators.parameters import recommend
from pixelloom.operators.scoring import explode_image, score_images
from pixelloom.session import StoredTable


@dataclass(frozen=True)
class Prediction:
    """``points`` is the operating point of each session: threshold, size bounds, flip averaging."""

    rois: DataFrame
    labels: DataFrame
    probability: DataFrame
    parameters: DataFrame
    points: DataFrame


def predict_images(
    images: DataFrame, load: Callable, threshold: float = 0.5, min_size: int = 30,
    max_size: int | None = None, tta: bool = False, tile: int = TILE, max_side: int | None = None,
    points: DataFrame | None = None,
) -> Prediction:
    """Score array images and derive everything a curator starts from.

    ``points(session, threshold, min_size, max_size, tta)``, as ``resolve_operating_point`` gives,
    replaces the four values for each session; sessions without a row are left out. Probabilities
    are stored once; labels can be rebuilt from them at another operating point without scoring again.
    """
    if points is None:
        points = images.select("session").distinct().select(
            "session", F.lit(float(threshold)).alias("threshold"), F.lit(int(min_size)).alias("min_size"),
            F.lit(max_size).cast("int").alias("max_size"), F.lit(bool(tta)).alias("tta"),
        )
        scored = StoredTable(score_images(images, load, tta)).df
    else:
        points = StoredTable(points.select("session", "threshold", "min_size", "max_size", "tta")).df
        images = images.join(points.select("session", "tta"), "session")
        parts = [score_images(images.filter(F.col("tta") == flips).drop("tta"), load, flips) for flips in (False, True)]
        scored = StoredTable(parts[0].unionByName(parts[1])).df
    probability = explode_image(scored, "probability", "probability")
    labels = labels_at_points(probability, points, tile=tile, max_side=max_side)
    pixels = explode_image(images, "pixels", "value")
    return Prediction(pack_rois(labels), labels, probability, recommend(pixels, labels), points)
